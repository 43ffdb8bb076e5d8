"""tidemark: Spark DataFrame operators for irregular time series and the text that goes with them."""
