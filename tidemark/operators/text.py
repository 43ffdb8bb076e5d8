"""Text operators: cleaning, chunks, keyword retrieval, query and advice texts, safety checks."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: Typographic ligatures and what they stand for.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st")]
FACTORS = {"insulin": 1.0, "carbs": 10.0, "stress": 7, "idle": 15, "active": 60}
#: Pairs of a query and a chunk that a task of the keyword search holds at most, about.
PAIRS = 250_000


def normalize(text: Column) -> Column:
    """Line ends to LF, at most one blank line, single blanks, no white space at the ends."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


#: Lines that PDF extraction leaves behind.
NOISE = [r"\.{4,}\s*\d+\s*$", r"(?i)diabetesjournals\.org|downloaded from http|article-pdf|by guest on", r"(?i)diabetes care volume \d+,\s*supplement"]


def clean_lines(text: Column, noise: list[str] = NOISE) -> Column:
    """Ligatures spelt out, control characters to spaces, noise lines dropped, then normalised."""
    for mark, letters in LIGATURES:
        text = F.replace(text, F.lit(mark), F.lit(letters))
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: ~x.rlike("|".join(f"(?:{n})" for n in noise)))
    return normalize(F.array_join(lines, "\n"))


def topic_of(name: Column) -> Column:
    t = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, "[_-]", " "), " +", " ")))
    return F.when(t == "", "General").otherwise(t)


def doc_key(source: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit("ext"), F.regexp_replace(F.lower(source), "[^a-z0-9]+", "-"), F.substring(F.sha1(text), 1, 12))


def import_new(batch: DataFrame, existing: DataFrame, key: str, order: str, min_chars: int = 120, text: str = "text") -> DataFrame:
    """Rows long enough whose key is neither in ``existing`` nor earlier in the batch."""
    kept = batch.where(F.length(text) >= min_chars).join(existing.select(key).distinct(), key, "left_anti")
    return kept.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def word_chunks(df: DataFrame, text: str, size: int = 900, overlap: int = 120) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap``; ``chunk`` text and its ``pos`` in the document."""
    step = max(size - overlap, 1)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    df = df.withColumn("_w", words)
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("_w", s, size), " "))).alias("pos", "chunk")).drop("_w")


#: Where texts are cut, strongest first.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", " ")


def _cut(text: str, ends: list[int], size: int, separators: tuple[str, ...]) -> list[int]:
    """Ends of the parts of a text once those longer than ``size`` are cut behind each separator in turn."""
    for sep in separators:
        cut, start = [], 0
        for end in ends:
            if end - start > size:
                *parts, last = text[start:end].split(sep)
                cut += [start := start + len(p) + len(sep) for p in parts]
            if end > start:
                cut.append(end)
            start = end
        ends = cut
    return ends


def _packed(text: str, parts: list[int], size: int, overlap: int, last: str) -> list[tuple[int, int]] | None:
    """Where the pieces of a text begin and end, from the ends of its parts; longer parts are cut behind ``last``. Nothing if an atom is longer than ``size``."""
    starts, made, begin = [0, *parts], [], 0
    while begin < len(text):
        x = begin + size
        k = bisect_right(starts, x) - 1
        end = starts[k] if x >= len(text) or starts[k + 1] - starts[k] <= size else max(starts[k], text.rfind(last, starts[k], x) + 1)
        if end == len(text):
            return [*made, (begin, end)]
        k = bisect_right(starts, end) - 1
        after = starts[k + 1] if starts[k + 1] - starts[k] <= size else text.find(last, end, starts[k + 1]) + 1 or starts[k + 1]
        if after - end > size:
            return None
        made.append((begin, end))
        x = max(end - overlap, after - size)
        if x < end:  # the first atom that begins there or later
            k = bisect_left(starts, x)
            x = text.find(last, x - 1, starts[k]) + 1 or starts[k] if starts[k] > x and starts[k] - starts[k - 1] > size else starts[k]
        begin = min(x, end)
    return made


def piece_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Where the pieces of :func:`split_recursively` begin and end.

    Parts longer than ``size`` are cut into atoms behind each separator in turn, and what is still longer every ``size`` characters.
    A piece takes as many atoms as fit; the next one begins with those of its last atoms that fit the overlap, and the next atom
    with them. Atoms behind a last separator of one character are looked for only where a piece begins or ends.
    """
    parts = _cut(text, [len(text)] if text else [], size, separators[:-1])
    last = "".join(separators[-1:])
    made = _packed(text, parts, size, overlap, last) if len(last) == 1 else None
    if made is None:
        ends = _cut(text, parts, size, separators[-1:])
        made = _packed(text, [x for start, end in zip([0, *ends], ends, strict=False) for x in (*range(start + size, end, size), end)], size, overlap, last)
    return made


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the strongest separator that helps, with overlaps of at most ``overlap``."""
    return [text[a:b] for a, b in piece_spans(text, size, overlap, separators)]


def chunk_sizes(df: DataFrame, text: str, sizes: dict[int, int]) -> DataFrame:
    """Each row's pieces for several sizes (with their overlaps) in one pass: ``size, pos, chunk``."""

    @F.arrow_udf("array<struct<size:int,pos:int,chunk:string>>")
    def pieces(texts: pa.Array) -> pa.Array:
        cut = [[{"size": s, "pos": i, "chunk": p} for s, o in sizes.items() for i, p in enumerate(split_recursively(t or "", s, o))] for t in texts.to_pylist()]
        return pa.array(cut, pa.list_(pa.struct([("size", pa.int32()), ("pos", pa.int32()), ("chunk", pa.string())])))

    return df.withColumn("_p", F.explode(pieces(F.col(text)))).select(*[F.col(f"`{c}`") for c in df.columns], "_p.*")


def char_chunks(df: DataFrame, text: str, size: int = 900, overlap: int = 120) -> DataFrame:
    """Chunks by recursive splitting of whole texts."""

    @F.pandas_udf("array<string>")
    def chunks(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: split_recursively(t or "", size, overlap))

    return df.select("*", F.posexplode(chunks(text)).alias("pos", "chunk"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def matches(expected: dict[str, str]) -> Column:
    """Whether a row's metadata fit: equal fields, and membership where a field is a list (named with a ``[]`` behind)."""
    ok = F.lit(True)
    for name, value in expected.items():
        ok = ok & (F.array_contains(name[:-2], F.lit(value)) if name.endswith("[]") else F.col(name).eqNullSafe(F.lit(value)))
    return F.coalesce(ok, F.lit(False))


def keyword_topk(chunks: DataFrame, queries: DataFrame, chunk_id: str, query_id: str, k: int = 4, text: str = "text", where: Column | None = None) -> DataFrame:
    """Best chunks of each query by shared tokens over distinct query tokens, ties by chunk id; ``k`` rows a query.

    Chunks without a shared token count zero and fill up what the others leave, by id. Only tokens that a query has are
    counted (their list is broadcast up to a million rows, else joined). ``where`` filters the chunks first. Texts are dealt
    by chunk, so that a task counts and compares its own chunks only, about PAIRS of them with a query. The queries' tokens and the best hits are saved, so that
    the chunks' texts are read once.
    """
    chunks = chunks if where is None else chunks.where(where)
    bag = lambda df, i: df.groupBy(i, "token").agg(F.count("*").alias("n"))
    split = lambda df, i: df.select(i, F.explode(tokens(F.col(text))).alias("token"))
    asked = bag(split(queries, query_id), query_id).withColumnRenamed("n", "nq")
    wanted = saved(asked.join(asked.groupBy(query_id).agg(F.count("*").alias("distinct")), query_id), "query-tokens")
    known = wanted.select("token").distinct()
    few = wanted.count() <= 1_000_000
    held = F.broadcast if few else lambda df: df
    parts = max(1, math.ceil(chunks.count() * queries.count() / PAIRS))
    own = split(chunks.select(chunk_id, text).repartition(parts, chunk_id), chunk_id).join(held(known), "token", "left_semi")
    shared = bag(own, chunk_id).join(held(wanted), "token")
    shared = shared if few else shared.repartition(parts, chunk_id)
    scored = shared.groupBy(query_id, chunk_id).agg((F.sum(F.least("n", "nq")) / F.max("distinct")).alias("similarity"))
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), chunk_id)
    top = saved(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, chunk_id, "similarity"), "hits")
    # queries with fewer than k hits: at most k - 1 of the first 2k chunks by id can be hits, so these suffice
    first = chunks.select(chunk_id).orderBy(chunk_id).limit(2 * k).agg(F.collect_list(chunk_id).alias("first"))
    hits = top.groupBy(query_id).agg(F.collect_list(chunk_id).alias("hits"))
    rest = queries.select(query_id).join(hits, query_id, "left").where(F.coalesce(F.size("hits"), F.lit(0)) < k).crossJoin(F.broadcast(first))  # one row is broadcast
    rest = rest.select(query_id, F.explode(F.array_except("first", F.coalesce("hits", F.slice("first", 1, 0)))).alias(chunk_id), F.lit(0.0).alias("similarity"))
    ranked = top.unionByName(rest).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def enhance_query(query: Column, glucose: Column, stress: Column) -> Column:
    """The query with the patient's condition behind it (fixed words)."""
    tags = F.array_join(F.filter(F.array(F.when(glucose < 70, "hipoglikemia").when(glucose > 180, "hiperglikemia"), F.when(stress >= 7, "stress tinggi")), lambda x: x.isNotNull()), ", ")
    return F.when(tags == "", query).otherwise(F.concat(query, F.lit(". Konteks pasien: "), tags, F.lit(".")))


def metadata(source: Column, topic: Column, doc_id: Column, index: Column) -> Column:
    """A chunk's metadata struct with the knowledge base's defaults (fixed values)."""
    text_, words = lambda v, n: F.lit(v).alias(n), lambda n, *v: F.array(*map(F.lit, v)).alias(n)
    return F.struct(
        doc_id.alias("doc_id"), F.concat(doc_id, F.lit("_ch_000")).alias("chunk_id"), text_("manual", "domain"), F.replace(F.lower(topic), F.lit(" "), F.lit("_")).alias("subdomain"),
        text_("Manual KB", "sumber"), topic.alias("judul"), text_(2024, "tahun"), text_("v1", "versi"), text_("", "url_sumber"), text_("N/A", "halaman"),
        words("jenis_dm", "dm_tipe2"), words("setting", "fktp", "fkrtl"), words("sasaran", "dokter_umum", "sppd"), words("populasi_khusus", "umum"),
        text_("panduan_klinis", "tipe_konten"), text_("id", "bahasa"), text_("guideline", "level_bukti"), F.array(topic).alias("topik_terkait"), text_("2026-12", "perlu_update_sebelum"), text_("aktif", "status"),
        source.alias("source"), index.alias("index"),
    )


def numbered_chunks(chunks: DataFrame, doc_id: str) -> DataFrame:
    """Chunks (with ``pos`` in their document) and their ``chunk_id``."""
    return chunks.withColumn("chunk_id", F.concat(F.col(doc_id).cast("string"), F.lit("_ch_"), F.lpad(F.col("pos").cast("string"), 3, "0")))


def with_citations(docs: DataFrame, by: str, rank: str) -> DataFrame:
    """``context``: a query's documents numbered by rank, each with its source, year and page in brackets.

    Texts lose the white space at their ends; an unknown source is ``Manual KB``, an unknown year or page ``N/A``. One row a query of
    ``docs``; for queries without documents see :func:`context_of`.
    """
    known = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    source = F.coalesce(F.nullif(F.col("source").cast("string"), F.lit("")), F.lit("Manual KB"))
    line = F.concat(F.col(rank).cast("string"), F.lit(". "), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), F.lit(" ["), source, F.lit(", "), known("year", "N/A"), F.lit(", Hal. "), known("page", "N/A"), F.lit("]"))
    lines = docs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("line")))).alias("s"))
    return lines.select(by, F.array_join(F.transform("s", lambda x: x["line"]), "\n\n").alias("context"))


#: Fixed value: what stands for the context of a query without documents.
NO_CONTEXT = "(Tidak ada konteks dokumen yang ditemukan)"


def context_of(queries: DataFrame, docs: DataFrame, by: str, rank: str) -> DataFrame:
    """``queries`` with ``context`` (:func:`with_citations`) and ``sources``: source, title, year and page of each document by rank."""
    known = lambda c, none: F.coalesce(F.col(c).cast("string"), none)
    source = F.coalesce(F.nullif(F.col("source").cast("string"), F.lit("")), F.lit("Manual KB"))
    title = known("title", source) if "title" in docs.columns else source
    row = F.struct(F.col(rank).alias("rank"), source.alias("source"), title.alias("title"), known("year", F.lit("N/A")).alias("year"), known("page", F.lit("N/A")).alias("page"))
    rows = docs.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["source"].alias("source"), x["title"].alias("title"), x["year"].alias("year"), x["page"].alias("page"))).alias("sources"))
    out = queries.join(with_citations(docs, by, rank), by, "left").join(rows, by, "left")
    none = F.array().cast(out.schema["sources"].dataType)
    return out.withColumns({"context": F.coalesce("context", F.lit(NO_CONTEXT)), "sources": F.coalesce("sources", none)})


#: Classes of chunks and the weights of their key words, in the order that decides ties.
CLASS_WORDS = {
    "hipoglikemia": [("hipoglikemi", 3), ("hypoglycemi", 3), ("gula darah rendah", 2), ("glukosa darah rendah", 2), ("15-15", 2), ("glukagon", 2), ("dekstrosa", 1), ("< 70 mg", 1), ("<70 mg", 1), ("< 54", 1)],
    "hiperglikemia": [("hiperglikemi", 3), ("hyperglycemi", 3), ("ketoasidosis", 3), ("ketoacidosis", 3), ("gula darah tinggi", 2), ("keton", 2), ("hiperosmolar", 2), ("hyperosmolar", 2), ("krisis hiperglikemia", 2), ("> 180 mg", 1), (">180 mg", 1), ("> 250", 1), ("poliuria", 1)],
    "normal": [("target kontrol glikemik", 3), ("kontrol glikemik", 2), ("time in range", 2), ("pemantauan glukosa", 1), ("hba1c", 1), ("target glikemik", 2)],
}


def topic_scores(text: Column, words: dict[str, list[tuple[str, float]]]) -> dict[str, Column]:
    """Weighted presence of each class's words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {c: sum((F.when(low.contains(w), F.lit(float(x))).otherwise(0.0) for w, x in ws), F.lit(0.0)) for c, ws in words.items()}


def best_topic(scores: dict[str, Column], none: str = "other") -> Column:
    """The first class of the highest score; ``none`` if that is zero."""
    top = F.greatest(*scores.values())
    out = F.lit(none)
    for c in reversed(scores):
        out = F.when((scores[c] == top) & (top > 0), c).otherwise(out)
    return out


#: Names of trends and risks, and what the interval may hold.
TREND_NAMES = {"rising": "meningkat", "falling": "menurun", "stable": "stabil"}
RISK_TERMS = {"hypoglycemia": "hipoglikemia (glukosa di bawah 70 mg/dL)", "hyperglycemia": "hiperglikemia (glukosa di atas 180 mg/dL)"}


def exact_round(x: Column, places: int) -> Column:
    """The absolute value's multiple of ``10 ** -places`` nearest to its exact binary value, halves to even, as a double.

    The product with the power of ten is taken with its rounding error (the factors are split in halves), so that a
    number like 0.15, whose double lies below the tie, goes down.
    """
    m, x = float(10**places), F.abs(x.cast("double"))

    def of(v: Column) -> Column:
        part = 134217729.0 * v
        hi = part - (part - v)
        p = v * m
        return F.struct(p.alias("p"), ((hi * m - p) + (v - hi) * m).alias("e"), F.floor(p).cast("double").alias("f"))

    def rounded(s: Column) -> Column:
        over = (s["p"] - s["f"]) - 0.5
        up = (over > 0) | ((over == 0) & ((s["e"] > 0) | ((s["e"] == 0) & (s["f"] % 2 == 1))))
        return (s["f"] + up.cast("int")) / m

    big = x >= 2.0**52 / m  # whole multiples already
    return F.when(big | F.isnan(x), x).otherwise(F.transform(F.transform(F.array(x), of), rounded)[0])


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, from its exact binary value, halves to even; a negative one and negative zero keep their sign, as ``-0.0``; null stays null.

    What is no number is ``nan``, ``inf`` or ``-inf``; from ``2 ** 63`` on digits behind the 17th may be zeros.
    """
    x = x.cast("double")
    minus = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))  # zeros of both signs are equal
    whole = F.format_string(f"%d{'.' * bool(places)}{'0' * places}", F.abs(x).try_cast("long"))
    digits = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").when((F.abs(x) >= 2.0**53) & (F.abs(x) < 2.0**63), whole).otherwise(F.format_string(f"%.{places}f", exact_round(x, places)))
    return F.when(x.isNotNull(), F.concat(F.when(minus, "-").otherwise(""), digits))


def factors(pace: Column, trend: Column, insulin: Column, carbs: Column, stress: Column, activity: Column) -> Column:
    """Active factors in order of weight, joined by commas."""
    return F.array_join(F.filter(F.array(
        F.when(pace == "rapid", F.when(trend == "rising", "tren cepat meningkat").otherwise("tren cepat menurun")),
        F.when(insulin >= FACTORS["insulin"], F.concat(F.lit("insulin aktif "), fixed(insulin, 1), F.lit(" unit"))),
        F.when(carbs >= FACTORS["carbs"], F.concat(F.lit("karbohidrat belum terserap "), fixed(carbs, 0), F.lit(" g"))),
        F.when(stress >= FACTORS["stress"], F.concat(F.lit("stres tinggi ("), fixed(stress, 0), F.lit("/10)"))),
        F.when(activity < FACTORS["idle"], "aktivitas fisik rendah").when(activity >= FACTORS["active"], F.concat(F.lit("aktivitas tinggi ("), fixed(activity, 0), F.lit(" menit)"))),
    ), lambda x: x.isNotNull()), ", ")


def interval_risks(conditions: Column, risk: Column) -> Column:
    """Conditions that only the interval reaches, named, joined by commas."""
    base = F.regexp_replace(risk, "^critical_", "")
    terms = F.create_map(*[F.lit(x) for kv in RISK_TERMS.items() for x in kv])
    return F.array_join(F.transform(F.filter(conditions, lambda c: c.isin(*RISK_TERMS) & (c != base)), lambda c: terms[c]), ", ")


def query_text(current: Column, predicted: Column, horizon: Column, trend: Column, pace: Column, risk: Column, label: Column, conditions: Column, lower: Column, upper: Column, insulin: Column, carbs: Column, stress: Column, activity: Column, question: Column) -> Column:
    """The retrieval query of a forecast: core statement, risk, interval risks, factors, question (fixed wording)."""
    names = F.create_map(*[F.lit(x) for kv in TREND_NAMES.items() for x in kv])
    change = predicted - current
    sign = F.when(change >= 0, "+").otherwise("")
    minutes = horizon.cast("string")
    extra, why = interval_risks(conditions, risk), factors(pace, trend, insulin, carbs, stress, activity)
    return F.concat_ws(
        " ",
        F.concat(F.lit("Prediksi glukosa "), minutes, F.lit(" menit ke depan: "), fixed(predicted, 1), F.lit(" mg/dL (dari "), fixed(current, 1), F.lit(" mg/dL, perubahan "), sign, fixed(change, 1), F.lit(" mg/dL, tren "), names[trend], F.lit(").")),
        F.concat(F.lit("Status risiko prediksi: "), label, F.lit(".")),
        F.when((extra != "") & lower.isNotNull() & upper.isNotNull(), F.concat(F.lit("Interval prediksi "), fixed(lower, 0), F.lit("-"), fixed(upper, 0), F.lit(" mg/dL masih mencakup risiko "), extra, F.lit("; sertakan penanganannya."))),
        F.when(why != "", F.concat(F.lit("Faktor kontribusi: "), why, F.lit("."))),
        question,
    )


def strategy_question(strategy: str, predicted: Column, horizon: Column, trend_name: Column, label: Column) -> Column:
    """The clinical question behind a query, by strategy (fixed wording)."""
    p, h = fixed(predicted, 0), horizon.cast("string")
    return {
        "risk": F.concat(F.lit("Apa risiko klinis utama dari prediksi glukosa "), p, F.lit(" mg/dL dengan tren "), trend_name, F.lit("? Seberapa mendesak penanganannya?")),
        "intervention": F.concat(F.lit("Tindakan apa yang harus dilakukan segera untuk kondisi prediksi "), label, F.lit(" ini sebelum glukosa mencapai "), p, F.lit(" mg/dL?")),
        "monitoring": F.concat(F.lit("Parameter apa yang harus dipantau dalam "), h, F.lit(" menit ke depan untuk kondisi prediksi "), p, F.lit(" mg/dL ini?")),
        "comprehensive": F.concat(F.lit("Berikan penilaian risiko, tindakan pencegahan, dan protokol pemantauan untuk kondisi prediksi glukosa "), p, F.lit(" mg/dL ("), label, F.lit(") dalam "), h, F.lit(" menit ke depan. Sertakan rekomendasi yang bisa dilakukan dokter maupun pasien.")),
    }[strategy]


def topic_tag(risk: Column) -> Column:
    """The topic that retrieval is narrowed to, null for a normal forecast."""
    return F.when(risk.endswith("hypoglycemia"), "hipoglikemia").when(risk.endswith("hyperglycemia"), "hiperglikemia")


#: Actions of the three levels, and the sentence every answer ends with.
ACTIONS = {
    "BAHAYA": ["Lakukan tatalaksana segera sesuai protokol klinis.", "Pantau ulang glukosa dalam interval singkat.", "Segera lakukan evaluasi dokter sebelum keputusan lanjutan."],
    "HATI-HATI": ["Perkuat hidrasi dan review asupan karbohidrat.", "Tambahkan aktivitas ringan bila aman.", "Pantau glukosa ulang dan konsultasikan hasil ke dokter."],
    "": ["Lanjutkan monitoring rutin dan pola hidup stabil.", "Pertahankan aktivitas fisik terjadwal.", "Tetap lakukan evaluasi berkala bersama dokter."],
}
DISCLAIMER = "Keputusan medis final tetap pada dokter"


def actions(predicted: Column) -> Column:
    """The three actions of a forecast's level."""
    of = lambda k: F.array(*map(F.lit, ACTIONS[k]))
    return F.when(predicted < 70, of("BAHAYA")).when(predicted > 180, of("HATI-HATI")).otherwise(of(""))


def key_factors(glucose: Column, stress: Column, activity: Column) -> Column:
    found = F.filter(F.array(F.when(stress >= 7, "stres tinggi"), F.when(activity < 15, "aktivitas fisik rendah"), F.when(glucose > 150, "glukosa awal tinggi")), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("kondisi metabolik saat ini")))


def with_disclaimer(text: Column) -> Column:
    """The text, with the disclaimer behind it unless it is there already."""
    return F.when(F.lower(text).contains(DISCLAIMER.lower()), text).otherwise(F.concat(F.trim(text), F.lit(f" Catatan: {DISCLAIMER}.")))


def advice(predicted: Column, current: Column, stress: Column, activity: Column) -> Column:
    """One advisory text: summary, key factors, actions, disclaimer."""
    summary = F.concat(F.lit("Prediksi "), fixed(predicted, 1), F.lit(" mg/dL dari baseline "), fixed(current, 1), F.lit(" mg/dL."))
    return with_disclaimer(F.concat_ws(" ", summary, F.concat(F.array_join(key_factors(current, stress, activity), ", "), F.lit(".")), F.array_join(actions(predicted), " ")))


#: Thresholds that need no source, units, and the words of the direction check.
STANDARD = ("70", "80", "180", "250", "54", "15", "100", "120", "0", "1", "2", "3", "4", "5")
UNITS = r"mg/dl|unit|u\b|iu|gram|g\b|menit|jam|%"
GIVE = r"berikan|beri\b|tambahkan|tambah\b|naikkan|tingkatkan|suntikkan|suntik\b|injeksikan|konsumsi|makan\b|lakukan koreksi dengan"
INSULIN, INSULIN_CONTEXT = "insulin|bolus", "pengguna insulin|terapi insulin|pemantauan|pantau|edukasi|riwayat|regimen"
SUGAR, SUGAR_LEVEL = r"karbohidrat|glukosa oral|jus\b|permen|makanan manis|snack|gula", r"gula\s*darah"
DESCRIBES = "karena|akibat|disebabkan|menunjukkan|menandakan|terjadi|kemungkinan|risiko|penyebab|faktor|belum ters|yang cepat|tren"
FORBIDS = "hentikan|jangan|tunda|kurangi|hindari|batasi|tanpa|stop|tidak|air putih"


def numbers(text: Column, units: str = UNITS) -> Column:
    """Numbers with a unit, decimal commas as points."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(\d+(?:[.,]\d+)?)\s*(?:{units})"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")))


def plain_number(number: Column) -> Column:
    """Without zeros behind a decimal point."""
    return F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)


def grounded(number: Column, context: Column, state: Column) -> Column:
    """The number is a standard threshold, one of the patient's own (an array of texts), or stands whole in the context."""
    short = plain_number(number)
    padded = F.concat(F.lit(" "), F.coalesce(context, F.lit("")), F.lit(" "))
    spot = F.concat(F.lit(r"(?s).*[^0-9]"), F.replace(short, F.lit("."), F.lit(r"\.")), F.lit(r"[^0-9].*"))
    return short.isin(*STANDARD) | number.isin(*STANDARD) | F.array_contains(state, short) | F.array_contains(state, number) | F.regexp_like(padded, spot)


def wrong_direction(text: Column, condition: Column) -> Column:
    """Sentences that tell to give insulin at low, or sugar at high glucose; explanations and warnings are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda s, words: s.rlike(f"({words})")
    tells = lambda s: has(s, GIVE) & ~has(s, FORBIDS) & ~has(s, DESCRIBES)
    sentences = F.transform(F.split(low, r"[.\n•]\s*"), lambda s: F.trim(s))
    insulin = F.filter(sentences, lambda s: tells(s) & has(s, INSULIN) & ~has(s, INSULIN_CONTEXT))
    sugar = F.filter(sentences, lambda s: tells(s) & has(F.regexp_replace(s, SUGAR_LEVEL, "kadar"), SUGAR))
    return F.when(condition == "hypoglycemia", insulin).when(condition == "hyperglycemia", sugar).otherwise(F.array().cast("array<string>"))


def safety(df: DataFrame) -> DataFrame:
    """Roll-up of answers with ``n_numbers, n_grounded, n_wrong, disclaimer``: percentages over all, never by zero."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.agg(F.count("*").alias("cases"), total("n_numbers").alias("numbers"), (100.0 * total("n_grounded") / F.greatest(total("n_numbers"), F.lit(1))).alias("traceable"), total("n_wrong").alias("wrong"), (100.0 * F.count_if("disclaimer") / F.greatest(F.count("*"), F.lit(1))).alias("disclaimers"))


def coverage(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("double") for w in words), F.lit(0.0)) / len(words)
