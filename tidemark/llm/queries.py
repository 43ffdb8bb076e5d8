"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, fingerprint, importance, int8dedup, langid, licenses, packing, pages, recompress, runs, spm, tokenbin, toxicity, wordbpe
from .common import id_of, learned_from


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify_languages(docs.select("doc_id", "text"), langid.fit_language_model(docs))
    return found.select("doc_id", (~learned_from("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"), F.size("unknown").cast("long").alias("n_unknown"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity_model(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxicity")
    return found.select("doc_id", (~learned_from("doc_id")).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("toxic_passages").alias("n_passages"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenbin.write_token_files(_table(spark, sf_dir, "documents"))
    return tokenbin.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select(id_of(F.col("k")).alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spm.encode_pieces(_table(spark, sf_dir, "documents"), wordbpe.vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))
    own, edited, beyond = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprint.written(own).alias("fingerprint"), fingerprint.written(edited).alias("edited_fingerprint"), fingerprint.containment(own, edited).alias("near_edited"), fingerprint.containment(own, beyond).alias("near_next"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.link_near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(id_of(F.col("k")).alias("doc_id"), "n_shingles", id_of(F.col("component")).alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = int8dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))
    return found.select(id_of(F.col("k")).alias("vec_id"), F.col("n_links").cast("long"), id_of(F.col("component")).alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_main_text(_table(spark, sf_dir, "pages"), pages.drawn_model())
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", runs.made_periodic("doc_id", "text").alias("text"))
    found = runs.find_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    best, digest = F.col("best"), lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), digest(runs.listed(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_toxicity, op4_token_files, op5_substring_dedup, op6_sentencepiece, op7_fingerprints, op8_packing, op9_minhash_dedup, op10_embedding_dedup, op11_html_extraction, op12_periodic_runs, op13_importance_resampling)}


_COMPONENTS = """
  reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  comps AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
"""
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = {
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
  p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos, len(w) AS n FROM d),
  g AS (SELECT doc_id, pos, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM p),
  x AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS d0, first_value(pos) OVER o AS p0 FROM g WHERE pos + 19 <= n WINDOW o AS (PARTITION BY win ORDER BY doc_id, pos)),
  r AS (SELECT p.doc_id, p.pos, p.word, max(CASE WHEN x.d0 <> x.doc_id OR x.p0 <> x.pos THEN x.pos END) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS last_bad FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.pos = p.pos),
  k AS (SELECT doc_id, count(*) AS n_removed FROM r WHERE last_bad >= pos - 19 GROUP BY doc_id),
  t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM r WHERE last_bad IS NULL OR last_bad < pos - 19 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
  reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets),
  rs AS (SELECT s.doc_id, s.g FROM s JOIN reps USING (doc_id) WHERE doc_id = rep),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  good AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
  links AS (SELECT a, b FROM good UNION SELECT b, a FROM good), {_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comps.c, reps.rep, d.doc_id) AS component_id, d.doc_id = coalesce(comps.c, reps.rep, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN comps ON comps.a = reps.rep""",
    "op10_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93), {_COMPONENTS},
  n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comps.c, vec_id) AS component_id, vec_id = coalesce(comps.c, vec_id) AS kept
FROM embeddings LEFT JOIN comps ON comps.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op13_importance_resampling": r"""
WITH bits AS (SELECT n, list_reduce(range(0, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM (SELECT unnest(range(0, 256)) AS n)),
  tab AS (SELECT list(v ORDER BY n) AS t FROM bits),
  txt AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
  w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM txt),
  f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
  hex AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
  crc AS (SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) % 10000 AS b FROM hex, tab),
  fb AS (SELECT side, id, b FROM f JOIN crc USING (f)),
  cnt AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fb GROUP BY b),
  tot AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fb),
  gain AS (SELECT b, CAST(floor(1000 * ln(CAST((cnt.t + 1) * (tot.s + 10000) AS DOUBLE) / CAST((cnt.s + 1) * (tot.t + 10000) AS DOUBLE))) AS BIGINT) AS g FROM cnt, tot),
  wt AS (SELECT id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM fb JOIN gain USING (b) WHERE side = 0 GROUP BY id),
  d AS (SELECT id AS doc_id, coalesce(wt.n, 0) AS n_features, coalesce(wt.weight, 0) AS weight, len(w.w) AS n_words, CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN wt USING (id) WHERE side = 0),
  sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
  fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN r <= 25 * n // 100 THEN r END AS BIGINT) AS rank FROM sc LEFT JOIN fit USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
