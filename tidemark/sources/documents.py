"""Documents of several kinds from a folder, and their import into a knowledge base.

Files are read by Spark's ``binaryFile`` source, so they can be in any store that Spark reads and are dealt to tasks;
a file that can't be read is a row with its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import normalize, topic_of

#: Kinds that can be read. PDF needs a library that is not there; such files are rows with an error.
KINDS = ("txt", "md", "pdf", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes of a Word document's text that are unpacked at most; more is an error, as it is no document.
MOST_BYTES = 256 << 20


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word document's body, one a line; tables, headers and notes are not part of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError("the document's text is too large")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    of = lambda p: "".join(marks.get(e.tag, e.text or "" if e.tag == f"{_W}t" else "") for run in p.iter(f"{_W}r") for e in run)
    return "\n".join(of(p) for p in ([] if body is None else body.findall(f"{_W}p")))


def document_text(kind: str, content: bytes) -> str:
    """The text of a file's content; an unknown kind is an error."""
    if kind == "txt":
        return content.decode("utf-8", "ignore")
    if kind == "md":
        return re.sub(r"```[\s\S]*?```", "", content.decode("utf-8", "ignore"))
    if kind == "docx":
        return docx_text(content)
    if kind == "pdf":
        raise RuntimeError("no PDF reader is installed")
    raise ValueError(f"Unsupported extension: .{kind}")


def _parsed(kinds: pa.Array, contents: pa.Array) -> pa.Array:
    texts, errors = [], []
    for kind, content in zip(kinds.to_pylist(), contents.to_pylist(), strict=True):
        try:
            texts.append(document_text(kind, content or b""))
            errors.append(None)
        except Exception as e:  # noqa: BLE001 - whatever a file holds becomes its row's error
            texts.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])


def read_documents(spark: SparkSession, folder: str, kinds: Sequence[str] = KINDS, recursive: bool = False) -> DataFrame:
    """``source`` (the file's name), ``kind, text, error`` of the files of some kinds (extensions, in any case) in a folder, by path.

    A kind that can't be read by any means raises.
    """
    wanted = [k.lower().lstrip(".") for k in kinds]
    for k in wanted:
        if k not in KINDS:
            raise ValueError(f"Unsupported extension: .{k}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    files = files.select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source"), kind.alias("kind"), "content").where(kind.isin(wanted))
    return files.withColumn("_d", F.arrow_udf(_parsed, "text string, error string")("kind", "content")).select("path", "source", "kind", "_d.text", "_d.error")


def document_id(source: Column, text: Column) -> Column:
    """``ext_<name>_<digest>``: the file's name without its extension in lower case and underscores, 12 digits of the text's SHA-1."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(source, r"\.[^.]*$", ""), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.concat(F.lit("ext_"), F.when(stem == "", "doc").otherwise(stem), F.lit("_"), F.substring(F.sha1(text.cast("binary")), 1, 12))


def plan_import(files: DataFrame, existing: DataFrame | None, min_chars: int = 120) -> DataFrame:
    """What an import does with each of :func:`read_documents`' files: ``source, topic, doc_id, text, status``.

    ``status`` is ``imported``, ``too short``, ``duplicate`` (of the knowledge base, or of a file of an earlier path), or the error.
    """
    text = normalize(F.col("text"))
    rows = files.withColumn("text", text).withColumn("doc_id", document_id(F.col("source"), F.col("text")))
    rows = rows.withColumn("topic", topic_of(F.regexp_replace("source", r"\.[^.]*$", "")))
    long = F.col("error").isNull() & (F.length("text") >= min_chars)
    first = F.row_number().over(Window.partitionBy("doc_id", long).orderBy("path")) == 1
    held = (existing.select("doc_id").distinct() if existing is not None else rows.sparkSession.createDataFrame([], "doc_id string")).withColumn("_held", F.lit(True))
    rows = rows.withColumn("_first", first).join(held, "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(~long, "too short").when(F.col("_held") | ~F.col("_first"), "duplicate").otherwise("imported")
    return rows.select("source", "topic", "doc_id", "text", status.alias("status"))


def import_documents(spark: SparkSession, folder: str, base: str, kinds: Sequence[str] = KINDS, recursive: bool = False, min_chars: int = 120, dry_run: bool = False) -> tuple[dict[str, int], DataFrame]:
    """Append a folder's new documents to a knowledge base of JSON lines; counts, and what was skipped and why.

    The counts are observed in the pass that writes. A dry run writes nothing.
    """
    from .scratch import exists, saved

    schema = "text string, source string, topic string, doc_id string"
    known = spark.read.schema(schema).json(base) if exists(spark, base) else None
    plan = saved(plan_import(read_documents(spark, folder, kinds, recursive), known, min_chars), "import")
    seen = Observation()
    counted = plan.observe(seen, F.count("*").alias("found"), F.count_if(F.col("status") == "imported").alias("imported"), F.count_if(F.col("status") != "imported").alias("skipped"))
    new = counted.where("status = 'imported'").select("text", "source", "topic", "doc_id")
    if dry_run:
        new.write.format("noop").mode("overwrite").save()
    else:
        new.write.mode("append").json(base)
    return seen.get, plan.where("status <> 'imported'").select("source", "status")
