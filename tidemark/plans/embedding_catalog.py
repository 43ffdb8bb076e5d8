"""Queries over embedded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, text
from ..sources.scratch import saved, scratch_dir
from ..sources.vectors import VectorTable
from .catalog import query, r6, table

#: The signed places of a text's tokens, counted: ``id, b, x`` of a table ``t`` of ``id, text``.
_VEC = """tok AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM t), wd AS (SELECT w, md5(w) AS h FROM (SELECT DISTINCT w FROM tok)),
pl AS (SELECT w, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS b, CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM wd),
raw AS (SELECT id, b, CAST(sum(s) AS DOUBLE) AS x FROM tok JOIN pl USING (w) GROUP BY id, b), vec AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM raw WHERE x <> 0)"""


@query(f"WITH t AS (SELECT item_id AS id, text FROM benchmark), {_VEC} SELECT id AS item_id, CAST(b AS INT) AS place, round(x, 6) AS value FROM vec")
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The places of the benchmark texts' vectors that are not zero."""
    v = embedding.embed(table(spark, d, "benchmark").select("item_id", "text"), "text")
    return v.select("item_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", r6("value"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    made = text.word_chunks(table(spark, d, "documents").select("doc_id", "text"), "text")
    return made.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("chunk_id"), F.col("chunk").alias("text"))


_CHUNKS = r"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents), ch AS (SELECT doc_id, unnest(range(0, len(w), 780)) AS o, w FROM dw WHERE len(w) > 0),
chunks AS (SELECT doc_id * 100000 + o // 780 AS id, array_to_string(w[o + 1:o + 900], ' ') AS text FROM ch)"""


@query(f"""WITH {_CHUNKS}, t AS (SELECT id * 2 AS id, text FROM chunks UNION ALL SELECT item_id * 2 + 1, text FROM benchmark), {_VEC},
q AS (SELECT item_id, item_id * 2 + 1 AS id FROM benchmark), dot AS (SELECT a.id AS qid, b.id AS cid, sum(a.x * b.x) AS s FROM vec a JOIN vec b USING (b) WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT q.item_id, c.id AS chunk_id, round(coalesce(s, 0), 9) AS similarity FROM q CROSS JOIN chunks c LEFT JOIN dot ON qid = q.id AND cid = c.id * 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) SELECT item_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM k WHERE rank <= 4""")
def embedded_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text's nearest chunks of the documents, from a vector table that is filled, changed and filled again."""
    rows = _chunks(spark, d)
    store = VectorTable(spark, scratch_dir(spark, "vectors"), buckets=8)
    store.upsert(rows.withColumn("text", F.when(F.col("chunk_id") % 3 == 0, F.lit("outdated")).otherwise(F.col("text"))).where("chunk_id % 5 <> 0"))
    store.upsert(rows)
    store.upsert(rows)
    found = store.search(table(spark, d, "benchmark"), "item_id", "text")
    return found.withColumn("similarity", r6("similarity"))


@query()
def chunk_size_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How well benchmark passages are found in chunks of 500, 900 and 1500 characters: a hit is a chunk that holds the passage's first 40 characters."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    sizes = {s: int(s * 0.13) for s in (500, 900, 1500)}
    near, counts = embedding.piece_search(docs, embedding.embed(items, "item"), "doc_id", "item_id", "text", sizes, 5)
    # of the pieces, texts of those that were found are saved alone, cut again from their documents; their list is broadcast up to a million rows, else joined
    found = near.select("size", "chunk_id").distinct()
    held = F.broadcast if near.count() <= 1_000_000 else lambda df: df
    number = F.pmod("chunk_id", F.lit(embedding.PIECES).cast("long"))
    of = found.select(F.call_function("div", F.col("chunk_id") - number, F.lit(embedding.PIECES)).alias("doc_id")).distinct()
    chunks = text.chunk_sizes(docs.join(held(of), "doc_id", "left_semi"), "text", sizes).select("size", (F.col("doc_id") * embedding.PIECES + F.col("pos")).alias("chunk_id"), "chunk")
    chunks = saved(chunks.join(held(found), ["size", "chunk_id"], "left_semi").select("size", "chunk_id", "chunk"), "chunks")
    place = F.min(F.when(F.contains("chunk", F.substring("item", 1, 40)), F.col("rank")))
    per = near.join(chunks, ["size", "chunk_id"]).join(items, "item_id").groupBy("size", "item_id").agg(place.alias("place"))
    row = per.groupBy("size").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("place") == 1).cast("int"), F.lit(0))).alias("hit1"), F.avg(F.col("place").isNotNull().cast("int")).alias("hit5"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))
    every = spark.range(1).select(F.explode(F.lit(list(sizes))).alias("size")).join(counts, "size", "left").join(row, "size", "left")
    return every.select("size", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n", F.lit(0)).alias("n"), r6("hit1").alias("hit1"), r6("hit5").alias("hit5"), r6("mrr").alias("mrr"))
