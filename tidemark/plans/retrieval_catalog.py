"""Queries over texts, states and results: retrieval, conditioned queries, safety checks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import metrics, text, twin
from .catalog import _NORM, _P, _R, _STATES, _TOK, _W, _ZONE, ON, _states, pairs, query, r6, readings, rounded, table

_LIG = "text"
for _a, _b in text.LIGATURES:
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"
_CLEAN = f"""array_to_string(list_filter(list_transform(string_split(regexp_replace({_LIG}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: NOT regexp_matches(x, '\\.{{4,}}\\s*\\d+\\s*$|(?i:diabetesjournals\\.org|downloaded from http|article-pdf|by guest on|diabetes care volume \\d+,\\s*supplement)')), chr(10))"""


@query(f"SELECT doc_id, md5({_NORM.format(_CLEAN)}) AS h FROM documents")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_lines(F.col("text"))).alias("h"))


def _topk(where: str) -> str:
    return f"""WITH p AS (SELECT * FROM documents WHERE {where}), c AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM p) GROUP BY ALL), q AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark) GROUP BY ALL),
z AS (SELECT item_id, count(*) AS k FROM q GROUP BY 1), o AS (SELECT item_id, doc_id, sum(least(c.n, q.n)) AS o FROM c JOIN q USING (t) GROUP BY ALL), s AS (SELECT b.item_id, p.doc_id, coalesce(o / k, 0.0) AS similarity FROM benchmark b CROSS JOIN p LEFT JOIN o ON o.item_id = b.item_id AND o.doc_id = p.doc_id LEFT JOIN z ON z.item_id = b.item_id)
SELECT item_id, doc_id, round(similarity, 9) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM s) WHERE rank <= 4"""


@query(_topk("true"))
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.keyword_topk(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id"), "similarity", places=9)


@query(_topk("lang = 'de' AND list_contains([source, lang], 'de')"))
def keyword_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("tags", F.array("source", "lang"))
    return rounded(text.keyword_topk(docs, table(spark, d, "benchmark"), "doc_id", "item_id", where=text.matches({"lang": "de", "tags[]": "de"})), "similarity", places=9)


_SCORES = {c: " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{x}') THEN {v} ELSE 0 END" for x, v in ws) for c, ws in text.CLASS_WORDS.items()}
_BEST = "greatest(" + ", ".join(_SCORES) + ")"


@query(f"""WITH d AS (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' ketoasidosis' WHEN 1 THEN ' HbA1c dan glukagon 15-15' WHEN 2 THEN ' hypoglycemia > 250' WHEN 3 THEN ' target glikemik' ELSE '' END AS text FROM conversations), s AS (SELECT conv_id, turn, {', '.join(f'{e} AS {c}' for c, e in _SCORES.items())} FROM d)
SELECT conv_id, turn, CASE WHEN {_BEST} = 0 THEN 'lain' {' '.join(f"WHEN {c} = {_BEST} THEN '{c}'" for c in _SCORES)} END AS topic FROM s""")
def topic_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 5
    tail = F.when(t == 0, " ketoasidosis").when(t == 1, " HbA1c dan glukagon 15-15").when(t == 2, " hypoglycemia > 250").when(t == 3, " target glikemik").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", text.best_topic(text.topic_scores(F.concat("text", tail), text.CLASS_WORDS), "lain").alias("topic"))


_FORECAST = f"""fc AS (SELECT v.event_id, v.patient_id, CAST(floor(p + 60) AS DOUBLE) AS c, CAST(floor(y * 2 + 30) AS DOUBLE) AS g, CAST(event_id % 6 AS DOUBLE) AS ins, CAST(event_id % 40 AS DOUBLE) AS carbs, event_id % 11 AS stress, event_id % 90 AS act FROM v),
k AS (SELECT *, g - c AS d, CASE WHEN g < 54 THEN 'critical_hypoglycemia' WHEN g < 70 THEN 'hypoglycemia' WHEN g > 250 THEN 'critical_hyperglycemia' WHEN g > 180 THEN 'hyperglycemia' ELSE 'normal' END AS risk FROM fc),
n AS (SELECT *, replace(risk, 'critical_', '') AS base, CASE WHEN abs(d) < 10 THEN 'stabil' WHEN d > 0 THEN 'meningkat' ELSE 'menurun' END AS trend, {", ".join(f"CASE risk {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.RISK_NAMES.items())} END AS label" for _ in "x")} FROM k)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    f = pairs(spark, d).select("event_id", F.floor(F.col("p") + 60).cast("double").alias("c"), F.floor(F.col("y") * 2 + 30).cast("double").alias("g"), (i % 6).cast("double").alias("insulin"), (i % 40).cast("double").alias("carbs"), (i % 11).alias("stress"), (i % 90).alias("activity"))
    change = F.col("g") - F.col("c")
    f = f.withColumns({"risk": rules.risk(F.col("g")), "trend": rules.trend(change), "pace": rules.pace(change), "lower": F.col("g") - 30, "upper": F.col("g") + 30})
    return f.withColumns({"label": rules.risk_name(F.col("risk")), "conditions": rules.conditions(F.col("risk"), F.col("lower"), F.col("upper"))})


@query(f"""WITH {_P}, {_FORECAST} SELECT event_id, concat_ws(' ', 'Prediksi glukosa 30 menit ke depan: ' || printf('%.1f', g) || ' mg/dL (dari ' || printf('%.1f', c) || ' mg/dL, perubahan ' || CASE WHEN d >= 0 THEN '+' ELSE '' END || printf('%.1f', d) || ' mg/dL, tren ' || trend || ').',
'Status risiko prediksi: ' || label || '.',
nullif('Interval prediksi ' || printf('%.0f', g - 30) || '-' || printf('%.0f', g + 30) || ' mg/dL masih mencakup risiko ' || concat_ws(', ', CASE WHEN g - 30 < 70 AND base <> 'hypoglycemia' THEN 'hipoglikemia (glukosa di bawah 70 mg/dL)' END, CASE WHEN g + 30 > 180 AND base <> 'hyperglycemia' THEN 'hiperglikemia (glukosa di atas 180 mg/dL)' END) || '; sertakan penanganannya.', 'Interval prediksi ' || printf('%.0f', g - 30) || '-' || printf('%.0f', g + 30) || ' mg/dL masih mencakup risiko ; sertakan penanganannya.'),
nullif('Faktor kontribusi: ' || concat_ws(', ', CASE WHEN abs(d) >= 30 THEN CASE WHEN d > 0 THEN 'tren cepat meningkat' ELSE 'tren cepat menurun' END END, CASE WHEN ins >= 1 THEN 'insulin aktif ' || printf('%.1f', ins) || ' unit' END, CASE WHEN carbs >= 10 THEN 'karbohidrat belum terserap ' || printf('%.0f', carbs) || ' g' END, CASE WHEN stress >= 7 THEN 'stres tinggi (' || stress || '/10)' END, CASE WHEN act < 15 THEN 'aktivitas fisik rendah' WHEN act >= 60 THEN 'aktivitas tinggi (' || act || ' menit)' END) || '.', 'Faktor kontribusi: .'),
CASE event_id % 3 WHEN 0 THEN 'Apa risiko klinis utama dari prediksi glukosa ' || printf('%.0f', g) || ' mg/dL dengan tren ' || trend || '? Seberapa mendesak penanganannya?' WHEN 1 THEN 'Tindakan apa yang harus dilakukan segera untuk kondisi prediksi ' || label || ' ini sebelum glukosa mencapai ' || printf('%.0f', g) || ' mg/dL?' ELSE 'Parameter apa yang harus dipantau dalam 30 menit ke depan untuk kondisi prediksi ' || printf('%.0f', g) || ' mg/dL ini?' END) AS query,
CASE base WHEN 'hypoglycemia' THEN 'hipoglikemia' WHEN 'hyperglycemia' THEN 'hiperglikemia' END AS tag FROM n""")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    f, thirty = forecasts(spark, d), F.lit(30)
    name = F.create_map(*[F.lit(x) for kv in text.TREND_NAMES.items() for x in kv])[F.col("trend")]
    ask = lambda s: text.strategy_question(s, F.col("g"), thirty, name, F.col("label"))
    question = F.when(F.col("event_id") % 3 == 0, ask("risk")).when(F.col("event_id") % 3 == 1, ask("intervention")).otherwise(ask("monitoring"))
    q = text.query_text(F.col("c"), F.col("g"), thirty, *map(F.col, ("trend", "pace", "risk", "label", "conditions", "lower", "upper", "insulin", "carbs", "stress", "activity")), question)
    return f.select("event_id", q.alias("query"), text.topic_tag(F.col("risk")).alias("tag"))


@query(f"""WITH {_P}, {_FORECAST} SELECT event_id, trim('Prediksi ' || printf('%.1f', g) || ' mg/dL dari baseline ' || printf('%.1f', c) || ' mg/dL. ' || coalesce(nullif(concat_ws(', ', CASE WHEN stress >= 7 THEN 'stres tinggi' END, CASE WHEN act < 15 THEN 'aktivitas fisik rendah' END, CASE WHEN c > 150 THEN 'glukosa awal tinggi' END), ''), 'kondisi metabolik saat ini') || '. ' || CASE WHEN g < 70 THEN '{" ".join(text.ACTIONS["BAHAYA"])}' WHEN g > 180 THEN '{" ".join(text.ACTIONS["HATI-HATI"])}' ELSE '{" ".join(text.ACTIONS[""])}' END) || ' Catatan: {text.DISCLAIMER}.' AS advice FROM n""")
def advisory_rows(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).select("event_id", text.advice(F.col("g"), F.col("c"), F.col("stress"), F.col("activity")).alias("advice"))


@query("""SELECT doc_id, 'q' || doc_id || CASE WHEN n_chars % 300 < 70 THEN '. Konteks pasien: ' || CASE WHEN doc_id % 11 >= 7 THEN 'hipoglikemia, stress tinggi.' ELSE 'hipoglikemia.' END WHEN n_chars % 300 > 180 THEN '. Konteks pasien: ' || CASE WHEN doc_id % 11 >= 7 THEN 'hiperglikemia, stress tinggi.' ELSE 'hiperglikemia.' END WHEN doc_id % 11 >= 7 THEN '. Konteks pasien: stress tinggi.' ELSE '' END AS query,
replace(lower('Aktivitas ' || coalesce(lang, 'x')), ' ', '_') AS subdomain, doc_id || '_ch_000' AS chunk_id FROM documents""")
def enhanced_queries(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    m = text.metadata(F.col("source"), F.concat(F.lit("Aktivitas "), F.coalesce("lang", F.lit("x"))), key, F.lit(0))
    docs = table(spark, d, "documents").withColumn("m", m)
    return docs.select("doc_id", text.enhance_query(F.concat(F.lit("q"), key), F.col("n_chars") % 300, F.col("doc_id") % 11).alias("query"), "m.subdomain", "m.chunk_id")


@query(r"""WITH s AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS v FROM documents), e AS (SELECT doc_id, source, v, unnest(range(1, len(v) + 1, 780)) AS st FROM s), c AS (SELECT doc_id, source, CAST(st // 780 AS INT) AS pos, array_to_string(v[st:st + 899], ' ') AS chunk FROM e)
SELECT doc_id, md5(string_agg((pos + 1) || '. ' || chunk || ' [' || coalesce(source, 'Manual KB') || ', ' || CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE 'N/A' END || ', Hal. ' || doc_id || '_ch_' || lpad(CAST(pos AS VARCHAR), 3, '0') || ']', chr(10) || chr(10) ORDER BY pos)) AS context FROM c GROUP BY doc_id""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("year", F.when(F.col("doc_id") % 2 == 0, 2024))
    chunks = text.numbered_chunks(text.word_chunks(docs, "text"), "doc_id")
    chunks = chunks.select("doc_id", "source", "year", F.col("chunk").alias("text"), F.col("chunk_id").alias("page"), (F.col("pos") + 1).alias("rank"))
    return text.with_citations(chunks, "doc_id", "rank").select("doc_id", F.md5("context").alias("context"))


_SAY = ["Berikan insulin 4 unit sekarang.", "Jangan berikan insulin. Pantau gula darah tiap 15 menit.", "Konsumsi jus 15,50 g", "Beri insulin pada pengguna insulin", "Gula darah naik karena makan karbohidrat", "Tambahkan gula pada gula darah tinggi\\nminum 2 jam", "Kadar 70.0 mg/dL dan 300 mg/dL; keputusan medis final tetap pada dokter"]
_ANSWER = "CASE turn % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SAY)) + " END"
_ANSWERS = "a AS (SELECT conv_id, turn, text || '. ' || replace(" + _ANSWER + ", '\\n', chr(10)) AS t, CASE conv_id % 3 WHEN 0 THEN 'hypoglycemia' WHEN 1 THEN 'hyperglycemia' ELSE 'normal' END AS cond FROM conversations)"
_NUMS = f"list_transform(regexp_extract_all(t, '(?i)(\\d+(?:[.,]\\d+)?)\\s*(?:{text.UNITS})', 1), lambda x: replace(x, ',', '.'))"


def answers(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(s.replace("\\n", "\n")) for s in _SAY]), (F.col("turn") % 7 + 1).cast("int"))
    cond = F.when(F.col("conv_id") % 3 == 0, "hypoglycemia").when(F.col("conv_id") % 3 == 1, "hyperglycemia").otherwise("normal")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(". "), said).alias("t"), cond.alias("cond"))


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, array_to_string({_NUMS}, ';') AS numbers FROM a")
def number_extract(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("conv_id", "turn", F.array_join(text.numbers(F.col("t")), ";").alias("numbers"))


def _wrong(kind: str) -> str:
    say = f"regexp_matches(x, '{text.GIVE}') AND NOT regexp_matches(x, '{text.FORBIDS}') AND NOT regexp_matches(x, '{text.DESCRIBES}')"
    if kind == "hypo":
        return f"{say} AND regexp_matches(x, '{text.INSULIN}') AND NOT regexp_matches(x, '{text.INSULIN_CONTEXT}')"
    return f"{say} AND regexp_matches(regexp_replace(x, '{text.SUGAR_LEVEL}', 'kadar', 'g'), '{text.SUGAR}')"


_SENTENCES = "list_transform(regexp_split_to_array(lower(t), '[.\\n•]\\s*'), lambda x: trim(x))"
_WRONG = f"CASE cond WHEN 'hypoglycemia' THEN len(list_filter({_SENTENCES}, lambda x: {_wrong('hypo')})) WHEN 'hyperglycemia' THEN len(list_filter({_SENTENCES}, lambda x: {_wrong('hyper')})) ELSE 0 END"
_COVER = "(CAST(contains(lower(t), 'insulin') AS INT) + CAST(contains(lower(t), 'the') AS INT) + CAST(contains(lower(t), 'gula') AS INT)) / 3.0"


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, CAST({_WRONG} AS INT) AS n_wrong, round({_COVER}, 6) AS coverage FROM a")
def direction_check(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("conv_id", "turn", F.size(text.wrong_direction(F.col("t"), F.col("cond"))).alias("n_wrong"), r6(text.coverage(F.col("t"), ["insulin", "the", "gula"])).alias("coverage"))


_SHORT = "CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') ELSE x END"
_STD = ", ".join(f"'{n}'" for n in text.STANDARD)
_GROUNDED = f"list_filter({_NUMS}, lambda x: ({_SHORT}) IN ({_STD}) OR x IN ({_STD}) OR x = '300' OR regexp_matches(' sumber: 1500 dan 15.5 g ', '[^0-9]' || replace(({_SHORT}), '.', '\\.') || '[^0-9]'))"


@query(f"""WITH {_ANSWERS}, c AS (SELECT len({_NUMS}) AS n, len({_GROUNDED}) AS g, {_WRONG} AS w, contains(lower(t), '{text.DISCLAIMER.lower()}') AS s FROM a)
SELECT CAST(count(*) AS BIGINT) AS cases, CAST(sum(n) AS BIGINT) AS numbers, round(100.0 * sum(g) / greatest(sum(n), 1), 6) AS traceable, CAST(sum(w) AS BIGINT) AS wrong, round(100.0 * count(*) FILTER (WHERE s) / greatest(count(*), 1), 6) AS disclaimers FROM c""")
def safety_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    ok = F.filter(text.numbers(t), lambda x: text.grounded(x, F.lit("sumber: 1500 dan 15.5 g"), F.array(F.lit("300"))))
    cases = answers(spark, d).select(F.size(text.numbers(t)).alias("n_numbers"), F.size(ok).alias("n_grounded"), F.size(text.wrong_direction(t, F.col("cond"))).alias("n_wrong"), F.lower(t).contains(text.DISCLAIMER.lower()).alias("disclaimer"))
    return rounded(text.safety(cases), "traceable", "disclaimers")


@query(f"WITH {_P}, {_FORECAST} SELECT event_id, label, CASE WHEN risk LIKE 'critical%' THEN risk WHEN stress % 4 = 0 THEN 'hypoglycemia' WHEN stress % 4 = 1 THEN 'hyperglycemia' WHEN stress % 4 = 2 THEN 'normal' ELSE risk END AS risk_by_class FROM n")
def class_override(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("hypo", "hyper", "normal", "what"))), (F.col("stress") % 4 + 1).cast("int"))
    return forecasts(spark, d).select("event_id", "label", rules.with_class(F.col("risk"), kind).alias("risk_by_class"))


@query("WITH " + _STATES + """ SELECT patient_id, printf('%.1f', CAST(floor(glucose) AS DOUBLE)) || ' mg/dL' AS current_glucose, printf('%.2f', insulin) || ' units' AS insulin_active, printf('%.1f', carbs) || ' grams' AS carbs_active, printf('%.0f', stress) || '/10' AS stress_level, printf('%.0f', activity) || ' minutes' AS activity_level FROM b""")
def state_summary(spark: SparkSession, d: str) -> DataFrame:
    s = twin.normalise_state(_states(spark, d)).withColumn("glucose", F.floor("glucose").cast("double"))
    return twin.summary(s)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, ts, event_id, event_type, value FROM events),
k AS (SELECT *, CASE WHEN event_type = 'view' THEN 1 END AS wg, CASE WHEN event_type = 'click' THEN 1 END AS wc FROM e),
f AS (SELECT *, arg_max(struct_pack(v := value), struct_pack(t := ts, i := event_id)) FILTER (WHERE wg = 1) OVER w AS g, arg_max(struct_pack(v := CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END), struct_pack(t := ts, i := event_id)) FILTER (WHERE wc = 1) OVER w AS c FROM k WINDOW w AS (PARTITION BY patient_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, g.v AS current_glucose, c.v AS carbs_on_board, lag(g) OVER (PARTITION BY patient_id ORDER BY ts, event_id) .v AS previous_glucose FROM f""")
def state_history(spark: SparkSession, d: str) -> DataFrame:
    events = readings(spark, d).withColumns({"g": F.col("glucose"), "c": F.when(F.col("event_id") % 4 != 0, F.col("glucose"))})
    out = twin.state_history(events, "patient_id", ON, {"current_glucose": "g", "carbs_on_board": "c"}, {"current_glucose": F.col("channel") == "view", "carbs_on_board": F.col("channel") == "click"})
    return out.select("event_id", "current_glucose", "carbs_on_board", F.col("previous.current_glucose").alias("previous_glucose"))


@query(f"""WITH {_P}, c AS (SELECT {_ZONE.format("y")} AS t, {_ZONE.format("p")} AS c, abs(y - p) >= 30 AS far FROM v)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(t = c AS INT)), 6) AS accuracy, CAST(count(*) FILTER (WHERE far) AS BIGINT) AS n_divergent, round(coalesce(avg(CAST(t = c AS INT)) FILTER (WHERE far), 0), 6) AS divergent_accuracy FROM c""")
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).select(rules.zone(F.col("y")).alias("t"), rules.zone(F.col("p")).alias("c"), (F.abs(F.col("y") - F.col("p")) >= 30).alias("far"))
    return rounded(metrics.accuracy(df, "t", "c", F.col("far")), "accuracy", "divergent_accuracy")


_KINDS = {"baseline": "1.645 * s", "absolute": "25.0", "normalised": "2.5 * s"}


@query(f"WITH {_P}, s AS (SELECT *, 5.0 + event_id % 9 AS s FROM v) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, round(100.0 * avg(CAST(y BETWEEN p - {h} AND p + {h} AS INT)), 4) AS coverage, round(avg(2 * {h}), 6) AS width FROM s" for k, h in _KINDS.items()))
def interval_builders(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).withColumn("s", F.lit(5.0) + F.col("event_id") % 9)
    q = {"baseline": F.lit(0.0), "absolute": F.lit(25.0), "normalised": F.lit(2.5)}
    ends = {k: metrics.interval(k, F.col("p"), F.col("s"), q[k]) for k in _KINDS}
    rows = df.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), lo.alias("lo"), hi.alias("hi")) for k, (lo, hi) in ends.items()])).alias("i")).select("y", "i.*")
    return rows.groupBy("kind").agg(F.round(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int")) * 100.0, 4).alias("coverage"), r6(F.avg(F.col("hi") - F.col("lo"))).alias("width"))


@query(f"""WITH {_P}, e AS (SELECT round(y - p, 3) AS d FROM v WHERE round(y - p, 3) <> 0), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM e)
SELECT CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus, CAST(count(*) AS BIGINT) AS n FROM k""")
def wilcoxon_stat(spark: SparkSession, d: str) -> DataFrame:
    return metrics.signed_rank(pairs(spark, d).select(F.round(F.col("y") - F.col("p"), 3).alias("d")), "d")


@query(f"""WITH {_R}, m AS (SELECT unnest(['now', 'last', 'mean3']) AS mode), v AS (SELECT patient_id, event_id, glucose AS a, lag(glucose) {_W} AS b, avg(glucose) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c, lead(glucose, 6) {_W} AS y FROM r),
x AS (SELECT mode, y, CASE mode WHEN 'now' THEN a WHEN 'last' THEN b ELSE c END AS p FROM v, m WHERE y IS NOT NULL AND b IS NOT NULL) SELECT mode, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 6) AS mae FROM x GROUP BY 1""")
def case_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every case under every mode of a short list, written as an array that each row unfolds."""
    from .catalog import w

    v = readings(spark, d).withColumns({"y": F.lead("glucose", 6).over(w()), "b": F.lag("glucose").over(w()), "c": F.avg("glucose").over(w().rowsBetween(-2, 0))}).where("y is not null and b is not null")
    modes = F.array(*[F.struct(F.lit(k).alias("mode"), F.col(c).alias("p")) for k, c in (("now", "glucose"), ("last", "b"), ("mean3", "c"))])
    return v.select("y", F.explode(modes).alias("m")).groupBy("m.mode").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("m.p")))).alias("mae"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), c AS (SELECT q.vec_id AS q, q.label AS ql, r.label AS rl, r.vec_id, round(list_cosine_similarity(q.x, r.x), 9) AS s FROM e q JOIN e r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM c), t AS (SELECT unnest([1, 3, 5, 10]) AS k),
h AS (SELECT t.k, q, max(CAST(ql = rl AS INT)) AS hit, sum(CAST(ql = rl AS INT)) / t.k AS precision FROM k JOIN t ON rank <= t.k GROUP BY 1, 2) SELECT k, round(avg(hit), 6) AS hit_rate, round(avg(precision), 6) AS precision FROM h GROUP BY 1""")
def topk_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Rank metrics for several k, from one search of the largest k."""
    from .catalog import _near

    labels = table(spark, d, "embeddings").select("vec_id", "label")
    got = _near(spark, d, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rows = got.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, (1, 3, 5, 10))), lambda k: k >= F.col("rank")))).withColumn("hit", (F.col("label") == F.col("own")).cast("int"))
    per = rows.groupBy("k", "query_id").agg(F.max("hit").alias("hit"), (F.sum("hit") / F.col("k")).alias("precision"))
    return per.groupBy("k").agg(r6(F.avg("hit")).alias("hit_rate"), r6(F.avg("precision")).alias("precision"))
