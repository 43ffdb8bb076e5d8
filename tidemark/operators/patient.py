"""Patients' states made of forecasts: key fallbacks, bounds and all derived fields; the texts that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .text import TREND_NAMES, exact_round, factors, fixed, interval_risks

#: Fields with the names they go by, first found first, and their defaults.
FIELDS = {
    "current_glucose": (("current_glucose", "glucose"), 100.0),
    "predicted_glucose": (("predicted_glucose",), 100.0),
    "insulin_on_board": (("insulin", "insulin_on_board"), 0.0),
    "carbs_on_board": (("carbs", "carbs_on_board"), 0.0),
    "activity_level": (("activity", "activity_level"), 0.0),
    "stress_level": (("stress", "stress_level"), 5.0),
}
#: The classifier's names of conditions, in order of what is seen to first.
CONDITIONS = ("hypoglycemia", "hyperglycemia", "normal")
#: The fields that a state is exported with, and those that answers are made of.
EXPORTED = ("patient_id", "current_glucose", "predicted_glucose", "prediction_horizon_minutes", "glucose_delta", "trend_direction", "trend_label", "trend_rate", "risk_level", "risk_label", "urgency", "insulin_on_board", "carbs_on_board", "activity_level", "stress_level", "timestamp")
CONTEXT = ("current_glucose", "insulin_on_board", "carbs_on_board", "activity_level", "stress_level")


def patient_states(df: DataFrame, horizon: int = 60) -> DataFrame:
    """All columns of ``df`` with a patient's state and what follows from it.

    A field comes from the first column of its names that has a value, else its default; a table need not have any of
    them. Glucose is kept within 20 and 600, stress within 1 and 10, the others at 0 or more. Risks follow the forecast, or the
    column ``predicted_condition`` where that names a condition and the forecast is not critical; ``predicted_lower`` and
    ``predicted_upper`` add conditions that the interval reaches.
    """
    has = {c.lower() for c in df.columns}
    given = lambda name, none: F.col(name) if name in has else none

    def field(name: str) -> Column:
        names, default = FIELDS[name]
        return F.coalesce(*[F.col(n).cast("double") for n in names if n in has], F.lit(default))

    null = F.lit(None).cast("double")
    df = df.withColumns({
        "patient_id": F.coalesce(given("patient_id", null).cast("string"), F.lit("unknown")),
        "current_glucose": rules.clamp(field("current_glucose"), 20.0, 600.0),
        "predicted_glucose": rules.clamp(field("predicted_glucose"), 20.0, 600.0),
        "prediction_horizon_minutes": F.coalesce(given("prediction_horizon_minutes", null).cast("int"), F.lit(horizon)),
        "insulin_on_board": F.greatest(F.lit(0.0), field("insulin_on_board")),
        "carbs_on_board": F.greatest(F.lit(0.0), field("carbs_on_board")),
        "activity_level": F.greatest(F.lit(0), field("activity_level").cast("int")),
        "stress_level": rules.clamp(field("stress_level").cast("int"), 1, 10),
        "predicted_lower": given("predicted_lower", null).cast("double"),
        "predicted_upper": given("predicted_upper", null).cast("double"),
        "predicted_condition": given("predicted_condition", null).cast("string"),
        "timestamp": given("timestamp", null).cast("string"),
    })
    change = F.col("predicted_glucose") - F.col("current_glucose")
    df = df.withColumn("glucose_delta", F.when(change < 0, -exact_round(change, 2)).otherwise(exact_round(change, 2)))
    d, raw = F.col("glucose_delta"), rules.risk(F.col("predicted_glucose"))
    df = df.withColumns({"trend_direction": rules.trend(d), "trend_rate": rules.pace(d), "risk_level": F.when(~raw.startswith("critical") & F.col("predicted_condition").isin(*CONDITIONS), F.col("predicted_condition")).otherwise(raw)})
    named = F.create_map(*[F.lit(x) for kv in TREND_NAMES.items() for x in kv])
    return df.withColumns({
        "trend_label": named[F.col("trend_direction")],
        "risk_label": rules.risk_name(F.col("risk_level")),
        "anticipated_conditions": rules.conditions(F.col("risk_level"), F.col("predicted_lower"), F.col("predicted_upper")),
        "urgency": rules.urgency(F.col("risk_level"), F.col("trend_rate"), F.col("stress_level")),
    })


def exported(kind: str = "state") -> Column:
    """A state (:func:`patient_states`) as a struct: ``state`` with all fields that are exported, ``context`` with those that answers need."""
    return F.struct(*(EXPORTED if kind == "state" else CONTEXT))


def risk_level(predicted: Column) -> Column:
    """The three levels of a forecast, named."""
    return F.when(predicted < 70, "BAHAYA - Hipoglikemia").when(predicted > 180, "HATI-HATI - Hiperglikemia").otherwise("AMAN")


def conditioned_query(question: Column) -> Column:
    """The retrieval query of a state: forecast, risk, risks of the interval, factors, question (fixed wording)."""
    c = F.col
    extra = interval_risks(c("anticipated_conditions"), c("risk_level"))
    why = factors(c("trend_rate"), c("trend_direction"), c("insulin_on_board"), c("carbs_on_board"), c("stress_level"), c("activity_level"))
    plus = F.when(c("glucose_delta") >= 0, "+").otherwise("")
    return F.concat_ws(
        " ",
        F.concat(F.lit("Prediksi glukosa "), c("prediction_horizon_minutes").cast("string"), F.lit(" menit ke depan: "), fixed(c("predicted_glucose"), 1), F.lit(" mg/dL (dari "), fixed(c("current_glucose"), 1), F.lit(" mg/dL, perubahan "), plus, fixed(c("glucose_delta"), 1), F.lit(" mg/dL, tren "), c("trend_label"), F.lit(").")),
        F.concat(F.lit("Status risiko prediksi: "), c("risk_label"), F.lit(".")),
        F.when((extra != "") & c("predicted_lower").isNotNull() & c("predicted_upper").isNotNull(), F.concat(F.lit("Interval prediksi "), fixed(c("predicted_lower"), 0), F.lit("-"), fixed(c("predicted_upper"), 0), F.lit(" mg/dL masih mencakup risiko "), extra, F.lit("; sertakan penanganannya."))),
        F.when(why != "", F.concat(F.lit("Faktor kontribusi: "), why, F.lit("."))),
        question,
    )


def context_block() -> Column:
    """The block of a state's numbers that goes before an answer (fixed wording)."""
    c = F.col
    pace = F.when(c("trend_rate") == "rapid", "PERUBAHAN CEPAT — intervensi mungkin diperlukan segera").when(c("trend_rate") == "moderate", "perubahan moderat — pantau lebih sering").otherwise("perubahan lambat — monitoring rutin")
    line = lambda name, *parts: F.concat(F.lit(f"  {name}: "), *parts)
    plus = F.when(c("glucose_delta") >= 0, "+").otherwise("")
    return F.concat_ws(
        "\n",
        F.lit("=== KONTEKS PREDIKSI GLUKOSA (PREDICTION-CONDITIONED RAG) ==="),
        line("Pasien ID        ", c("patient_id")),
        line("Glukosa sekarang ", fixed(c("current_glucose"), 1), F.lit(" mg/dL")),
        line("Glukosa prediksi ", fixed(c("predicted_glucose"), 1), F.lit(" mg/dL   (+"), c("prediction_horizon_minutes").cast("string"), F.lit(" menit)")),
        line("Perubahan        ", plus, fixed(c("glucose_delta"), 1), F.lit(" mg/dL ("), c("trend_label"), F.lit(", "), pace, F.lit(")")),
        line("Status risiko    ", c("risk_label")),
        line("Urgensi          ", F.upper("urgency")),
        F.lit("---"),
        line("Insulin on board ", fixed(c("insulin_on_board"), 2), F.lit(" unit")),
        line("Carbs on board   ", fixed(c("carbs_on_board"), 1), F.lit(" g")),
        line("Aktivitas hari ini", c("activity_level").cast("string"), F.lit(" menit")),
        line("Tingkat stres    ", c("stress_level").cast("string"), F.lit("/10")),
        F.lit("============================================================="),
    )


def metadata_tags() -> Column:
    """Filters for retrieval as a map: the kind of diabetes, and the topic of a low or high forecast."""
    topic = F.when(F.col("risk_level").endswith("hypoglycemia"), "hipoglikemia").when(F.col("risk_level").endswith("hyperglycemia"), "hiperglikemia")
    base = F.create_map(F.lit("jenis_dm"), F.lit("dm_tipe2"))
    return F.when(topic.isNull(), base).otherwise(F.map_concat(base, F.create_map(F.lit("topik"), topic)))


def question_payload(query: Column, predicted: Column, risk: Column | None = None) -> Column:
    """A clinician's question with a state's numbers; without a forecast its place holds a question mark (fixed wording)."""
    c = F.col
    shown = F.when(predicted.isNull() | (predicted == 0), "?").otherwise(fixed(predicted, 1))
    number = lambda x: F.regexp_replace(F.format_string("%s", x.cast("double")), "^null$", "N/A")
    whole = lambda x: x.cast("int").cast("string")
    return F.concat(
        F.lit("Pertanyaan klinisi: "), query, F.lit("\nData pasien: glukosa="), number(c("current_glucose")), F.lit(" mg/dL, stress="), whole(c("stress_level")), F.lit("/10, aktivitas="), whole(c("activity_level")),
        F.lit(" menit, insulin_on_board="), number(c("insulin_on_board")), F.lit(" unit, carbs_on_board="), number(c("carbs_on_board")), F.lit(" gram.\nPrediksi 1 jam: "), shown, F.lit(" mg/dL, Risk: "), F.coalesce(risk, F.lit("N/A")) if risk is not None else F.lit("N/A"), F.lit("."),
    )


def template_answer(predicted: Column, current: Column, stress: Column) -> Column:
    """The answer that needs no language model: status, forecast, stress, advice, and whose decision it is (fixed wording)."""
    advice = F.when(predicted < 70, "Segera lakukan aturan 15-15 dan evaluasi klinis.").when(predicted > 180, "Pantau ulang glukosa dalam 1 jam dan tinjau asupan serta aktivitas.").otherwise("Lanjutkan monitoring rutin dan pertahankan pola sehat.")
    note = F.when(stress >= 7, "Stres tinggi berpotensi meningkatkan glukosa.").otherwise("Tingkat stres relatif terkontrol.")
    return F.concat(F.lit("Status: "), risk_level(predicted), F.lit(". Prediksi 1 jam ke depan "), fixed(predicted, 1), F.lit(" mg/dL dari kondisi saat ini "), fixed(current, 1), F.lit(" mg/dL. "), note, F.lit(" Rekomendasi: "), advice, F.lit(" Catatan: keputusan medis final tetap pada dokter."))


#: What a query says of each condition, in the order in which several are said.
PHRASES = {
    "hipoglikemia": "Hipoglikemia, gula darah rendah di bawah 70 mg/dL. Penyebab, gejala, dan penanganan segera (aturan 15-15).",
    "hiperglikemia": "Hiperglikemia, gula darah tinggi di atas 180 mg/dL. Penyebab, gejala, dan penanganan.",
    "normal": "Gula darah dalam rentang normal/target. Target kontrol glikemik dan pemantauan rutin diabetes.",
}


def condition_of(glucose: Column) -> Column:
    return F.when(glucose < 70, "hipoglikemia").when(glucose > 180, "hiperglikemia").otherwise("normal")


def phrases_of(conditions: Column) -> Column:
    """The phrases of an array of conditions, in their fixed order, each once."""
    return F.concat_ws(" ", *[F.when(F.array_contains(conditions, c), p) for c, p in PHRASES.items()])


def comparison_query(mode: str, glucose: Column, lower: Column | None = None, upper: Column | None = None, condition: Column | None = None) -> Column:
    """The query of a case under one way of conditioning it, for comparisons (fixed wording).

    ``now`` and ``point`` say the condition of a glucose value, present or forecast; ``interval`` also those that the interval
    reaches; ``classifier`` says the classifier's condition; ``combined`` that one and the interval's.
    """
    value = fixed(glucose, 0)
    reach = lambda own: F.array(own, F.when(lower < 70, "hipoglikemia"), F.when(upper > 180, "hiperglikemia"))
    if mode in ("now", "point"):
        return F.concat(F.lit("Kadar glukosa darah "), value, F.lit(" mg/dL"), F.lit(" (prediksi 30 menit ke depan)" if mode == "point" else ""), F.lit(". "), phrases_of(F.array(condition_of(glucose))))
    if mode == "classifier":
        return F.concat(F.lit("Kadar glukosa darah diprediksi "), value, F.lit(" mg/dL (30 menit ke depan). "), phrases_of(F.array(condition)))
    if mode in ("interval", "combined"):
        own = condition_of(glucose) if mode == "interval" else condition
        return F.concat(F.lit("Kadar glukosa darah diprediksi "), value, F.lit(" mg/dL (interval 95%: "), fixed(lower, 0), F.lit("-"), fixed(upper, 0), F.lit(" mg/dL, 30 menit ke depan). "), phrases_of(reach(own)))
    raise ValueError(f"no such mode: {mode}")
