"""Sources: CSV readings with fallbacks, XML event channels, JSON and text documents, catalogues."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import validate

#: Event channels of the XML files and their time and value attributes.
CHANNELS = {"glucose_level": ("ts", "value"), "finger_stick": ("ts", "value"), "basal": ("ts", "value"), "bolus": ("ts_begin", "dose"), "meal": ("ts", "carbs"), "exercise": ("ts", "intensity"), "stressors": ("ts", None), "sleep": ("ts_begin", None), "work": ("ts_begin", None), "illness": ("ts_begin", None)}
XML_TIME = "dd-MM-yyyy HH:mm:ss"


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Readings from CSV, checked against the contract; a missing path raises."""
    return validate(spark.read.option("header", True).csv(path))


def load_preferred(spark: SparkSession, *paths: str) -> tuple[DataFrame, str]:
    """The first path that can be read, and which it was; all errors if none can."""
    errors = []
    for path in paths:
        try:
            return load_csv(spark, path), path
        except (AnalysisException, ValueError) as e:
            errors.append(f"{path}: {str(e).splitlines()[0]}")
    raise FileNotFoundError("; ".join(errors))


#: Files that are preferred to newer ones, and the names of known sources.
DEFAULT_FILES = ["training_data_complete.csv", "dummy_diabetes_data.csv"]
SOURCES = {"ohio_t1dm": "ohio_t1dm_merged.csv", "manual_logbook": "manual_logbook.csv"}


def latest_dataset(spark: SparkSession, folder: str) -> str:
    """The path of a preferred file of a folder, else of its newest CSV file; an error if it has none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "modificationTime")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, DEFAULT_FILES)), F.element_at(F.split("path", "/"), -1)), F.lit(0))
    found = files.orderBy(F.when(rank > 0, rank).otherwise(len(DEFAULT_FILES) + 1), F.desc("modificationTime"), "path").first()
    if found is None:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return found.path


def load_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Readings of a source by its name; ``latest_generated`` is :func:`latest_dataset`, other names are file names."""
    return load_csv(spark, latest_dataset(spark, folder) if name == "latest_generated" else f"{folder.rstrip('/')}/{SOURCES.get(name, name)}")


def load_chunks(spark: SparkSession, path: str, schema: str = "chunk_id string, text string, source string, topic string") -> DataFrame:
    """Chunks from JSON lines, or from a file that is one list."""
    lines = spark.read.text(path)
    one = lines.where(F.trim("value") != "").first()
    return spark.read.schema(schema).option("multiLine", bool(one and one.value.lstrip().startswith("["))).json(path)


def load_twins(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """States of all patients, one JSON document a file, with the ``file`` they came from."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.col("_metadata.file_path"))


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """``path, rows`` of each CSV file below a folder."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))


def read_channel(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """``file, ts, value`` of one XML channel; bad times are dropped, bad or missing values are 0."""
    time, value = CHANNELS[channel]
    attributes = f"_{time} STRING" + (f", _{value} STRING" if value else "")
    df = spark.read.format("xml").option("rowTag", channel).schema(f"event ARRAY<STRUCT<{attributes}>>").load(path)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.explode("event").alias("e"))
    number = F.coalesce(F.expr(f"try_cast(e._{value} AS double)"), F.lit(0.0)) if value else F.lit(1.0)
    return df.select("file", F.try_to_timestamp(F.col(f"e._{time}"), F.lit(XML_TIME)).alias("ts"), number.alias("value")).where("ts is not null")


def read_patients(spark: SparkSession, path: str, pattern: str = "*-ws-*.xml", prefix: str = "patient_", keep_file: bool = False) -> DataFrame:
    """``patient_id, channel, timestamp, value, event_id`` of all channels of all XML files below a folder, in one read.

    The id is the root's ``id`` (``unknown`` without one) behind the prefix. Bad times are dropped, bad or missing
    values are 0, marks without a value 1. ``temporal.assemble`` makes readings of them, with ``finger_stick`` as base
    for the finger-stick time line. ``keep_file`` adds the ``file`` each event came from.
    """
    attributes = lambda time, value: f"_{time} STRING" + (f", _{value} STRING" if value else "")
    schema = "_id STRING, " + ", ".join(f"{c} STRUCT<event: ARRAY<STRUCT<{attributes(*a).replace(' STRING', ': STRING')}>>>" for c, a in CHANNELS.items())
    df = spark.read.format("xml").option("rowTag", "patient").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(schema).load(path)

    def listed(channel: str, time: str, value: str | None) -> Column:
        number = lambda e: F.coalesce(e[f"_{value}"].try_cast("double"), F.lit(0.0)) if value else F.lit(1.0)
        row = lambda e, i: F.struct(F.lit(channel).alias("channel"), F.try_to_timestamp(e[f"_{time}"], F.lit(XML_TIME)).alias("timestamp"), number(e).alias("value"), i.alias("place"))
        return F.coalesce(F.transform(F.col(f"{channel}.event"), row), F.expr("array()"))

    lists = [listed(c, *a) for c, a in CHANNELS.items()]
    patient = F.concat(F.lit(prefix), F.coalesce("_id", F.lit("unknown")))
    rows = df.select(patient.alias("patient_id"), F.col("_metadata.file_path").alias("_file"), F.explode(F.concat(*lists)).alias("e"))
    file = [F.col("_file").alias("file")] if keep_file else []
    return rows.select("patient_id", "e.channel", "e.timestamp", "e.value", F.xxhash64("_file", "patient_id", "e.channel", "e.place").alias("event_id"), *file).where("timestamp is not null")


def patient_data(df: DataFrame, patient: str, by: str = "patient_id") -> DataFrame:
    """One patient's rows; an equality that Parquet scans take over."""
    return df.where(F.col(by) == patient)


def load_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``doc_id, text, source`` of whole text files; blank ones are dropped."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return df.select(F.concat(F.lit("txt_"), name).alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("source")).where(F.trim("text") != "")


def load_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files without fenced code."""
    return load_documents(spark, folder, "*.md").withColumn("text", F.regexp_replace("text", r"```[\s\S]*?```", ""))


def load_manual(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``text, source, topic, chunk_id`` with defaults by place; blank texts are dropped."""
    raw = spark.read.option("wholetext", True).text(path)
    items = F.from_json("value", "array<struct<text string, source string, topic string, chunk_id string>>")
    df = raw.select(F.posexplode(items).alias("i", "d")).select("i", "d.*").where(F.trim("text") != "")
    return df.select(F.coalesce("chunk_id", F.concat(F.lit("manual_doc_"), "i")).alias("doc_id"), "text", F.coalesce("source", F.lit("manual")).alias("source"), F.coalesce("topic", F.concat(F.lit("topic_"), "i")).alias("topic"))


def load_logbook(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries newest first; an empty table of the schema if there is no file yet."""
    try:
        df = spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException:
        df = spark.createDataFrame([], schema)
    return df.orderBy(F.desc("timestamp"))


def read_states(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """State records as JSON lines, and the lines that do not parse."""
    raw = spark.read.text(path)
    parsed = raw.withColumn("s", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where("s is not null and s._corrupt is null").select("s.*").drop("_corrupt")
    return good, parsed.where("s is null or s._corrupt is not null").select("value")
