"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions alone.

A shingle's hash is kept when it lies below a fixed fraction of the hash range. The sketch of a union is
the union of sketches, and the share of one sketch found in another estimates containment, however unequal
the documents are. A text none of whose hashes lies below the bound has its smallest hash alone for a sketch, which
merging drops as soon as another text has one below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of

SHINGLE, KEEP_ONE_IN = 5, 8
#: Words are what the near-duplicate operators take: runs of bytes other than space and tab to carriage return.
SPACE = r"[ \t\n\u000B\f\r]+"
#: About so many rows are in a range of neighbours. Quantiles give MAX_RANGES ranges at most; where that is too few, each is cut
#: by quantiles of its own into as many again.
MAX_RANGES, RANGE_ROWS = 1024, 8192


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """One xxhash64 per run of ``shingle`` lower-cased words; fewer words make one shingle, no word none."""
    hashes = F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - shingle + 1), lambda i: F.xxhash64(*(F.get(h, i + (j - 1)) for j in range(shingle))))
    whole = lambda h: F.array(F.aggregate(h, F.lit(42).cast("long"), lambda s, x: F.xxhash64(s, x)))
    one = lambda h: F.when(F.size(h) >= shingle, runs(h)).when(F.size(h) > 0, whole(h)).otherwise(F.array().cast("array<long>"))
    return F.get(F.transform(F.array(hashes), one), F.lit(0))


def _bound(keep_one_in: int) -> int:
    return -(2**63) + 2**64 // keep_one_in


def sketch(text: Column, shingle: int = SHINGLE, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """The retained hashes, distinct and ascending, or the smallest one where none is below the bound; null for a null text."""
    bound = _bound(keep_one_in)
    kept = lambda h: F.get(F.transform(F.array(F.array_min(h)), lambda m: F.array_sort(F.array_distinct(F.filter(h, lambda x: (x < bound) | (x == m))))), F.lit(0))
    return F.get(F.transform(F.array(shingle_hashes(text, shingle)), kept), F.lit(0))


def merge(a: Column, b: Column, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """The sketch of two texts' shingles together: what the sketch of the union of their shingle sets would be."""
    both = F.array_sort(F.array_union(a, b))
    return F.when(F.get(both, F.lit(0)) < _bound(keep_one_in), F.filter(both, lambda x: x < _bound(keep_one_in))).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that the larger one holds, 0 to 1.

    A short text that lies whole in a long one scores 1. Two empty sketches are alike (1), an empty and another one are
    not (0).
    """
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def written(a: Column) -> Column:
    """A sketch as text: hexadecimal hashes joined by commas."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def _placed(rows: DataFrame, cuts: Column, at: str) -> DataFrame:
    """``at``: the number of the range, between ``cuts``, that a row of key ``k`` and place ``u`` (0 to 1) among equal keys is in.

    A key that is several cuts at once holds as many ranges' rows, so its rows are spread over these in the order of
    ``u``, which becomes the place within that range.
    """
    key = F.col("k").cast("double")
    spread = rows.withColumns({"_below": F.size(F.filter(cuts, lambda c: c < key)), "_same": F.size(F.filter(cuts, lambda c: c == key))})
    wide = F.col("u") * F.greatest("_same", F.lit(1))
    return spread.withColumns({at: (F.col("_below") + F.floor(wide)).cast("int"), "u": wide - F.floor(wide)}).drop("_same")


def _in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (``k, h, t``) with ``r``, the number of a range of about RANGE_ROWS rows that follow each other by ``k, h``."""
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    first = min(ranges, MAX_RANGES)
    if first == 1:
        return rows.withColumn("r", F.lit(0).cast("long"))
    cuts = rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / first for i in range(1, first)], 0.25 / first)
    rows = rows.withColumn("u", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(2.0**53))
    rows = _placed(rows, F.array(*map(F.lit, sorted(cuts))), "r")
    if ranges > first:
        each = math.ceil(ranges / first)
        # one row of ``each`` numbers for each of the first ranges: 8 MB at most up to a million ranges
        finer = rows.groupBy("_below").agg(F.percentile_approx(F.col("k").cast("double"), F.array(*[F.lit(i / each) for i in range(1, each)]), F.lit(4 * each)).alias("cuts"))
        finer = rows.sparkSession.createDataFrame(finer.collect(), finer.schema)
        rows = rows.withColumnRenamed("r", "r1").join(F.broadcast(finer), "_below").drop("_below")
        rows = _placed(rows, F.col("cuts"), "r2").withColumn("r", F.col("r1").cast("long") * each + F.col("r2"))
    return rows.select("k", "h", "t", F.col("r").cast("long").alias("r"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep_one_in: int = KEEP_ONE_IN) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    The next document is the one before in ascending order of (id, hash of the text); after the smallest comes the
    largest. The edited text has its last half of code points replaced by the first as many (or all) of the
    next document. Columns: ``doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch``. Null
    texts count as empty and have an empty sketch; null ids come first; repeated rows each get a row; the
    only row is its own next; an empty table gives none. Other columns are ignored.

    Rows are dealt to ranges of ids by approximate quantiles, those of an id with many rows (or of none) by the hash of
    the text too; each range also gets the last row of the range before, so that neighbours meet in one window without
    a global sort. Only rows equal in id and text all share a range.
    """
    rows = _in_ranges(docs.select(key_of(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("k", F.xxhash64("t").alias("h"), "t"))
    ends = rows.groupBy("r").agg(F.max(F.struct("k", "h")).alias("end"))
    before = Window.orderBy("r")  # over one short row a range
    ends = ends.select("r", F.coalesce(F.lag("end").over(before), F.last("end").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    ahead = rows.drop("r").join(F.broadcast(ends.select("r", "end.*")), ["k", "h"]).groupBy("r").agg(F.max(F.struct("k", "h", "t")).alias("x")).select("x.*", "r", F.lit(False).alias("real"))
    rows = rows.select("k", "h", "t", "r", F.lit(True).alias("real")).unionByName(ahead)
    w = Window.partitionBy("r").orderBy("real", "k", "h", "t")
    rows = rows.withColumn("s", sketch(F.col("t"), shingle, keep_one_in))
    rows = rows.withColumns({"nt": F.lag("t").over(w), "ns": F.lag("s").over(w)}).where("real")
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - half), F.substring("nt", F.lit(1), half))
    rows = rows.withColumn("edited_text", edited)
    return rows.select(id_of(F.col("k")).alias("doc_id"), F.length("t").cast("long").alias("n_chars"), "edited_text", F.col("s").alias("sketch"), sketch(F.col("edited_text"), shingle, keep_one_in).alias("edited_sketch"), F.col("ns").alias("next_sketch"))
