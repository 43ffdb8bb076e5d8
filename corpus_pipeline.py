"""A corpus pipeline of five stages; each takes and returns documents, the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bottomk, langid, packing, recompress, toxicity
from tidemark.llm.common import discard, discarding, key_of, saved

#: Documents whose language is less sure than this are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.5

# In every stage rows stay whole: all columns are carried in one struct, so that no name clashes. A stage of an empty
# table gives an empty table. Repeated rows are each judged alike, and null ids are documents like others.


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on ``labels``, does not predict as toxic.

    Null and empty texts stay, as they score lowest; repeated rows go or stay together; long texts are scored whole.
    """
    model = toxicity.fit_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(_carried(docs), model).where(F.col("toxicity") < toxicity.THRESHOLD).select("row.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus.

    Null and empty texts and texts without letters have none and go, as do all if no row has a ``lang`` to learn from;
    repeated rows go or stay together; long texts are read whole.
    """
    found = langid.identify_languages(_carried(docs), langid.fit_language_model(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id (a null id is smallest).

    Rows of one id are one document and go or stay together; null and empty texts have no copies and stay.
    """
    first = bottomk.link_near_duplicates(docs).where("k = component").select("k").distinct()
    return docs.select(key_of("doc_id").alias("k"), F.struct("*").alias("row")).join(first, "k", "left_semi").select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages, and ``n_chars`` of what stays; a text of which nothing stays is dropped.

    Null, empty and short texts stay as they are. Repeated rows are one document and get the same text.
    """
    made = recompress.remove_repeats(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens.

    A null or empty text is one piece with the end id; every row is packed, repeated ones too; long texts are cut.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("packing", pack),
]
#: SQL cannot express the learned stages; tests/llm compares each stage, on what the one before kept, with a plain version row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one saved table after the other; what a stage saved for itself is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with discarding() as keep:
            made = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(made)
        if i:
            discard(docs)
        docs = made
    found = STAGES[-1][1](spark, docs, sf_dir)
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
