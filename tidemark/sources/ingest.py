"""A run over a folder of patients' XML files: what can be read is written, what can't is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import assemble
from . import readers
from .scratch import saved
from .writers import write_readings

#: Columns whose share of rows above zero is reported.
SHARES = ("carbs", "insulin", "bolus_dose", "basal_rate", "activity", "stress")


def file_errors(spark: SparkSession, folder: str, pattern: str, events: DataFrame) -> DataFrame:
    """``file, error`` of the files that gave no event at all: their XML is broken, or they hold none.

    Files without a byte are passed over by Spark's sources and are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    has = lambda x: F.contains("content", F.lit(x))
    files = files.select(F.col("path").alias("file"), has(b"<patient").alias("root"), has(b"</patient>").alias("closed"))
    given = events.select("file").distinct()
    reason = F.when(~F.col("root"), "no patient").when(~F.col("closed"), "XML is not closed").otherwise("no event that can be read")
    return files.join(given, "file", "left_anti").select("file", reason.alias("error"))


def ingest(spark: SparkSession, folder: str, output: str, pattern: str = "[0-9]*-ws-*.xml") -> dict:
    """Write the readings of all files below ``folder``: ``<output>/cgm`` with the sensor's time line, ``<output>/smbg`` with the finger sticks'.

    Returns for each table its ``rows`` and ``patients`` and the percent of rows above zero in some columns, counted in the pass that
    writes it (a table without rows is not written and None), and ``errors``: the files that gave nothing, and why.
    """
    events = saved(readers.read_patients(spark, folder, pattern, keep_file=True), "ingest")
    made: dict = {"errors": file_errors(spark, folder, pattern, events)}
    for name, base in (("cgm", "glucose_level"), ("smbg", "finger_stick")):
        rows = assemble(events.drop("file"), base=base)
        if rows.isEmpty():
            made[name] = None
            continue
        seen = Observation()
        counts = [F.count("*").alias("rows"), F.approx_count_distinct("patient_id").alias("patients")]
        write_readings(rows.observe(seen, *counts, *[F.round(F.avg((F.col(c) > 0).cast("int")) * 100, 2).alias(f"{c}_share") for c in SHARES]), f"{output}/{name}")
        made[name] = seen.get
    return made
