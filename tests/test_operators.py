import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import contract, features, metrics, splits, temporal, text, twin
from tidemark.sources import readers

TS = "2024-01-01 00:{:02d}:00"


def test_metrics_and_error_zones(spark):
    df = spark.createDataFrame(list(zip([100.0, 120.0, 150.0, 180.0, 200.0], [105.0, 115.0, 155.0, 175.0, 195.0], strict=True)), "t double, p double")
    m = metrics.all_metrics(df, "t", "p").first()
    assert (m.rmse, m.mae) == (5, 5) and math.isclose(m.mape, 3.5555555556, rel_tol=1e-9) and m.zone_ab >= 90
    cases = {(60, 65): "A", (100, 119): "A", (100, 150): "B", (60, 200): "C", (200, 60): "C", (60, 100): "D", (250, 150): "D", (100, 60): "E", (100, 200): "E", (200, 300): "E"}
    df = spark.createDataFrame([(float(a), float(b), z) for (a, b), z in cases.items()], "t double, p double, z string")
    assert df.where(rules.error_zone(F.col("t"), F.col("p")) != F.col("z")).count() == 0


def test_zone_bounds(spark):
    df = spark.createDataFrame([(69.9, "hypo"), (70.0, "normal"), (180.0, "normal"), (180.1, "hyper"), (None, "normal")], "g double, z string")
    assert df.where(rules.zone(F.col("g")) != F.col("z")).count() == 0


def test_windows_stay_within_patients(spark):
    rows = [(p, TS.format(5 * i), 100.0 + i + 10 * (p == "P2")) for p in ("P1", "P2") for i in range(3)]
    df = spark.createDataFrame(rows, "patient_id string, timestamp string, glucose double")
    out = features.windows(df, "patient_id", ["timestamp"], ["glucose"], "glucose", 2, 1).orderBy("patient_id").collect()
    assert [(r.y, r.anchor, len(r.x)) for r in out] == [(102, 101, 2), (112, 111, 2)]
    with pytest.raises(ValueError):
        features.windows(df, "patient_id", ["timestamp"], ["glucose"], "glucose", 0, 1)


def test_interpolation(spark):
    df = spark.createDataFrame([("P1", 1, None), ("P1", 2, 10.0), ("P1", 3, None), ("P1", 4, 40.0), ("P2", 1, None)], "p string, i int, v double")
    assert [r.f for r in features.interpolate(df, "p", ["i"], "v", "f").orderBy("p", "i").collect()] == [10, 10, 25, 40, None]


def test_decay_matches_a_loop_over_blocks(spark):
    values = [float(i * 7 % 5) for i in range(3000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "p string, i int, v double")
    got = [r.d for r in features.decay_accumulate(df, "p", ["i"], "v", "d").orderBy("i").collect()]
    x = 0.0
    for v, g in zip(values, got, strict=True):
        x = v + math.exp(-5 / 240) * x
        assert math.isclose(x, g, rel_tol=1e-9)


def test_asof_boundaries(spark):
    base = spark.createDataFrame([("p", "2024-01-01 00:00:00", 1), ("p", "2024-01-01 00:05:00", 2), ("p", "2024-01-01 00:15:00", 3)], "p string, t string, id long").withColumn("t", F.col("t").cast("timestamp"))
    events = spark.createDataFrame([("p", "2024-01-01 00:02:30", 10, 4.0), ("p", "2024-01-01 00:07:31", 11, 5.0), ("p", "2024-01-01 00:15:00", 12, 6.0), ("q", "2024-01-01 00:15:00", 13, 7.0)], "p string, t string, id long, v double").withColumn("t", F.col("t").cast("timestamp"))
    out = temporal.align_sum(base, events, "p", "t", "v", "id", "id", 150_000_000).orderBy("id").collect()
    assert [(r.aligned_sum, r.present) for r in out] == [(4, 1), (0, 0), (6, 1)]


def test_contract(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "x", "1", "NaN", "2"), (None, "2024-01-01", "1", "1", "1", "1"), ("2", "nope", "1", "1", "1", "1")], "patient_id string, timestamp string, glucose string, carbs string, insulin string, activity string")
    out = contract.validate(df).collect()
    assert len(out) == 1 and out[0].glucose is None and out[0].insulin is None and out[0].stress == 0
    with pytest.raises(ValueError, match="glucose"):
        contract.validate(df.drop("glucose"))


def test_twin(spark):
    state = spark.createDataFrame([(100.0, 0.0, 0.0, 5.0, 0.0)], "glucose double, insulin double, carbs double, stress double, activity double")
    out = twin.what_if(state, [{"carbs": 45.0, "minutes": 120}, {"activity": 30.0, "minutes": 120}, {"stress": 3.0, "minutes": 120}]).orderBy("scenario")
    assert [r.projected for r in out.collect()] == [390, 40, 132]
    for bad, error in (({"minutes": 0}, ValueError), ({"carbs": -1}, ValueError), ("x", TypeError)):
        with pytest.raises(error):
            twin.check_scenario(bad)
    h = spark.createDataFrame([(0.0, 10.0, 50.0), (2.0, 5.0, None), (1.5, None, 25.0), (5.0, 0.0, 0.0)], "h double, iob double, cob double")
    got = h.select(rules.insulin_on_board(F.col("h"), F.lit(10.0)).alias("i"), rules.carbs_on_board(F.col("h"), F.lit(50.0)).alias("c"), "iob", "cob").collect()
    assert all((r.iob is None or math.isclose(r.i, r.iob)) and (r.cob is None or math.isclose(r.c, r.cob)) for r in got)


def test_fold_keeps_explicit_nulls(spark):
    e = spark.createDataFrame([("p", 1, 123.0, True), ("p", 2, None, True), ("p", 3, 9.0, False)], "p string, seq int, v double, has boolean")
    assert twin.fold_events(e, "p", ["seq"], {"g": "v"}, {"g": F.col("has")}).first().g is None


def test_conformal_and_ranks(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "e double")
    assert [metrics.order_statistic(df, "e", a).first().q for a in (0.1, 0.05)] == [19, 19]
    one = spark.createDataFrame([(["a", "b", "c", "d", "e"], "a")], "t array<string>, x string")
    assert round(one.select(metrics.rank_metrics(F.col("t"), F.col("x"), 5)["ndcg"]).first()[0], 3) == 0.339


def test_splitter_covers_text():
    body = "\n\n".join(f"part {i} " + "".join(f"w{i}x{j} " for j in range(i * 13 % 90)) for i in range(40))
    parts = text.split_recursively(body, 200, 30)
    assert all(len(p) <= 200 for p in parts)
    at = 0
    for p in parts:  # each piece starts at or before where the last one ended
        i = body.find(p)
        assert 0 <= i <= at
        at = i + len(p)
    assert at == len(body)


def test_chunk_sizes_equal_the_splitter(spark):
    import random

    rng = random.Random(5)
    seps = ["\n## ", "\n### ", "\n\n", "\n", " ", " ", " ", "\n\n\n", ""]
    bodies = ["".join("é日w"[rng.randint(0, 2)] * rng.randint(0, rng.choice([8, 8, 60, 2500])) + rng.choice(seps) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    rows = [(i, b) for i, b in enumerate([*bodies, "", " ", "x" * 4000, "\n\n", "word " * 3000])] + [(99, None)]
    sizes = {500: 65, 900: 117, 1500: 195, 30: 30}
    got = {}
    for r in text.chunk_sizes(spark.createDataFrame(rows, "id int, `t` string"), "t", sizes).select("id", "size", "pos", "chunk").orderBy("pos").collect():
        got.setdefault((r.id, r.size), []).append(r.chunk)
    for i, b in rows:
        for size, overlap in sizes.items():
            assert got.get((i, size), []) == text.split_recursively(b or "", size, overlap), (i, size)


def test_greedy_thin_and_sample(spark):
    df = spark.createDataFrame([("p", i) for i in (1, 3, 7, 8, 13, 14)], "p string, i long")
    assert sorted(r.i for r in features.greedy_thin(df, "p", "i", 6).collect()) == [1, 7, 13]
    assert splits.balanced_sample(df, "p", "i", 2, 1).count() == 2


def test_direction(spark):
    rows = [("Berikan insulin sekarang.", "hypoglycemia", 1), ("Jangan berikan insulin.", "hypoglycemia", 0), ("Berikan edukasi pengguna insulin", "hypoglycemia", 0), ("Konsumsi jus.", "hyperglycemia", 1), ("Tambahkan pantauan gula darah", "hyperglycemia", 0), ("Gula naik karena makan karbohidrat", "hyperglycemia", 0), ("Berikan insulin", "normal", 0), (None, "hypoglycemia", 0)]
    df = spark.createDataFrame(rows, "t string, c string, n int")
    assert df.where(F.size(text.wrong_direction(F.col("t"), F.col("c"))) != F.col("n")).count() == 0


def test_grounded_numbers(spark):
    rows = [("70", "", True), ("70.0", "", True), ("33", "a 33 b", True), ("33", "a 333 b", False), ("15.50", "x15.5g", True), ("9", "", False), ("9", "9", True), ("6", "", True), ("77", None, False)]
    df = spark.createDataFrame(rows, "n string, c string, ok boolean")
    assert df.where(text.grounded(F.col("n"), F.col("c"), F.array(F.lit("6"))) != F.col("ok")).count() == 0


def test_reading_table_from_xml(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "559-ws-training.xml").write_text("""<?xml version="1.0"?><patient id="559"><glucose_level><event ts="01-01-2024 00:00:00" value="100"/><event ts="01-01-2024 00:05:00" value="-1"/><event ts="01-01-2024 00:10:00" value="120"/><event ts="bad" value="5"/></glucose_level>
<finger_stick><event ts="01-01-2024 00:07:00" value="90"/></finger_stick><meal><event ts="01-01-2024 00:02:30" carbs="30"/><event ts="01-01-2024 00:01:00" carbs="5"/></meal><basal><event ts="01-01-2024 00:01:00" value="1.2"/></basal><bolus><event ts_begin="01-01-2024 00:09:00" dose="2.5"/></bolus><stressors><event ts="01-01-2024 00:10:30"/></stressors></patient>""")
    events = readers.read_patients(spark, str(tmp_path / "in"))
    got = sorted(temporal.assemble(events).collect(), key=lambda r: r.timestamp)
    assert [(r.patient_id, r.glucose, r.carbs, r.bolus_dose, r.basal_rate, r.stress, r.meal_type) for r in got] == [("patient_559", 100.0, 35.0, 0.0, 0.0, 0, "meal"), ("patient_559", 120.0, 0.0, 2.5, 1.2, 1, "none")]
    assert abs(got[1].insulin - 2.6) < 1e-9
    assert [r.glucose for r in temporal.assemble(events, base="finger_stick").collect()] == [90.0]


def test_fill_missing_leaves_no_gap(spark):
    rows = [("a", 3, 102.0, None), ("a", 1, None, "x"), ("a", 2, 101.0, None), ("b", 1, 10.0, None), ("b", 2, None, "y")]
    out = features.fill_missing(spark.createDataFrame(rows, "p string, t int, g double, s string"), "p", ["t"], ["g"], ["s"])
    assert sorted(tuple(r) for r in out.select("p", "t", "g", "s").collect()) == [("a", 1, 101.0, "x"), ("a", 2, 101.0, "x"), ("a", 3, 102.0, "x"), ("b", 1, 10.0, "y"), ("b", 2, 10.0, "y")]


def test_decay_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 7)
    df = spark.createDataFrame([("p", i, float(i % 5)) for i in range(100)], "p string, i int, v double")
    got = [r.d for r in features.decay_accumulate(df, "p", ["i"], "v", "d", 60.0).orderBy("i").collect()]
    expected, now = [], 0.0
    for i in range(100):
        now = now * np.exp(-5 / 60) + i % 5
        expected.append(now)
    assert np.allclose(got, expected)


def test_running_counts(spark):
    df = spark.createDataFrame([(float(x % 37), 1) for x in range(500)], "v double, c long").groupBy("v").agg(F.sum("c").alias("c"))
    got = {r.v: r.upto for r in metrics.running(df, "v", ranges=8).collect()}
    assert got == {float(v): sum(1 for x in range(500) if x % 37 <= v) for v in range(37)}
    assert metrics.running(df.limit(0), "v").count() == 0


def test_normal_tail_and_zero_differences(spark):
    from math import erfc, sqrt

    df = spark.createDataFrame([(z,) for z in (0.0, 0.5, 1.96, -3.0)], "z double")
    assert all(abs(r.p - erfc(abs(r.z) / sqrt(2))) < 3e-7 for r in df.select("z", metrics.normal_tail(F.col("z")).alias("p")).collect())
    assert metrics.signed_rank_p(spark.createDataFrame([(0.0,), (0.0,)], "d double"), "d").first().p == 1.0
    up = spark.createDataFrame([(float(i),) for i in range(1, 21)], "d double")
    assert metrics.signed_rank_p(up, "d").first().p < 1e-3


@pytest.mark.parametrize("leaf_rows", [64, 4096])
def test_bootstrap_with_replacement(spark, leaf_rows, monkeypatch):
    monkeypatch.setattr(splits, "LEAF_ROWS", leaf_rows)
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(2000)] + [(5000, None)], "i long, v double")
    got = splits.bootstrap(df, "v", "i", 5000).collect()
    assert len(got) == 5000 and {r.times for r in got} == {2000}
    means = np.array([r["mean"] for r in got])
    assert abs(means.mean() - 4.5) < 0.005 and abs(means.std() - np.sqrt(8.25 / 2000)) < 0.003
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert abs(lo - (4.5 - 1.96 * np.sqrt(8.25 / 2000))) < 0.01 and abs(hi - (4.5 + 1.96 * np.sqrt(8.25 / 2000))) < 0.01
    again = [r["mean"] for r in splits.bootstrap(df.repartition(7), "v", "i", 5000).collect()]
    assert np.allclose(sorted(means), sorted(again))
    other = [r["mean"] for r in splits.bootstrap(df, "v", "i", 5000, seed=1).collect()]
    assert not np.allclose(sorted(means), sorted(other))
    # one heavy row: the number of its copies is binomial
    heavy = df.where("v is not null").withColumn("v", (F.col("i") == 7).cast("double"))
    copies = np.array([r["mean"] for r in splits.bootstrap(heavy, "v", "i", 5000).collect()]) * 2000
    assert abs((copies < 0.5).mean() - np.exp(-1)) < 0.03 and abs(copies.mean() - 1) < 0.06 and abs(copies.var() - 1) < 0.1


def test_bootstrap_of_few_rows(spark):
    few = spark.createDataFrame([(1, 3.0), (1, 3.0)], "i long, v double")
    assert {(r["mean"], r.times) for r in splits.bootstrap(few, "v", "i", 10).collect()} == {(3.0, 2)}
    assert all(r["mean"] is None for r in splits.bootstrap(few.limit(0), "v", "i", 10).collect())


def test_poisson_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(2000)], "i long, v double")
    means = [r["mean"] for r in splits.poisson_bootstrap(df, "v", "i", 300).collect()]
    assert len(means) == 300 and abs(np.mean(means) - 4.5) < 0.02 and abs(np.std(means) - np.sqrt(8.25 / 2000)) < 0.012
    again = [r["mean"] for r in splits.poisson_bootstrap(df.repartition(7), "v", "i", 300).collect()]
    assert np.allclose(sorted(means), sorted(again))


def test_sources_and_streams(spark, tmp_path):
    from tidemark.sources import readers
    from tidemark.streaming import events

    (tmp_path / "a.xml").write_text('<patient id="1"><meal><event ts="01-02-2024 08:00:00" carbs="30"/><event ts="bad" carbs="1"/><event ts="01-02-2024 09:00:00" carbs=""/></meal></patient>')
    assert sorted(r.value for r in readers.read_channel(spark, str(tmp_path / "a.xml"), "meal").collect()) == [0, 30]
    (tmp_path / "kb.json").write_text('[{"text": "a b", "topic": "T"}, {"text": " "}, {"text": "c", "chunk_id": "k"}]')
    assert [tuple(r) for r in readers.load_manual(spark, str(tmp_path / "kb.json")).collect()] == [("manual_doc_0", "a b", "manual", "T"), ("k", "c", "manual", "topic_2")]
    (tmp_path / "r.csv").write_text("patient_id,timestamp,glucose,carbs,insulin,activity\n1,2024-01-01,100,1,1,1\n")
    df, used = readers.load_preferred(spark, str(tmp_path / "none.csv"), str(tmp_path / "r.csv"))
    assert used.endswith("r.csv") and df.count() == 1
    with pytest.raises(FileNotFoundError):
        readers.load_preferred(spark, str(tmp_path / "none.csv"))
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = events.read_events(spark, "/root/testdata/sf0.001", source.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.run_once(events.latest_state(stream, "user_id", "ts", ["value"]), "states", str(tmp_path / "ck"))
    assert out.agg(F.sum("n_events")).first()[0] == source.count()


def test_sources_by_name_and_chunks(spark, tmp_path):
    import os

    from tidemark.sources import readers, writers

    line = "patient_id,timestamp,glucose,carbs,insulin,activity\n{},2024-01-01,100,1,1,1\n"
    (tmp_path / "d").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.latest_dataset(spark, str(tmp_path / "d"))
    for i, name in enumerate(["new.csv", "old.csv", "ohio_t1dm_merged.csv"]):
        (tmp_path / "d" / name).write_text(line.format(name))
        os.utime(tmp_path / "d" / name, (1000 - i, 1000 - i))
    of = lambda name: readers.load_source(spark, str(tmp_path / "d"), name).first().patient_id
    assert (of("latest_generated"), of("ohio_t1dm"), of("old.csv")) == ("new.csv", "ohio_t1dm_merged.csv", "old.csv")
    (tmp_path / "d" / "dummy_diabetes_data.csv").write_text(line.format("dummy"))
    assert of("latest_generated") == "dummy"
    chunks = spark.createDataFrame([("c1", "a", "s", "t"), ("c2", "b\nc", "s", None)], "chunk_id string, text string, source string, topic string")
    writers.write_chunks(chunks, str(tmp_path / "c"))
    assert sorted(readers.load_chunks(spark, str(tmp_path / "c")).collect()) == sorted(chunks.collect())
    (tmp_path / "c.json").write_text('[{"chunk_id": "x",\n "text": "y"}]')
    assert readers.load_chunks(spark, str(tmp_path / "c.json")).first().text == "y"
    states = spark.createDataFrame([("p1", 5.0), ("p2", None)], "patient_id string, iob double")
    writers.write_twins(states, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in readers.load_twins(spark, str(tmp_path / "t"), "patient_id string, iob double").select("patient_id", "iob").collect()) == [("p1", 5.0), ("p2", None)]


def test_forests_from_a_configuration(spark, tmp_path):
    from tidemark.operators import ml
    from tidemark.streaming import events

    rows = [(f"p{p}", datetime(2024, 1, 1) + timedelta(minutes=5 * i), None if i == 7 else 110.0 + 45 * math.sin(i / 6 + p), float(i % 9 == 0) * 30, float(i % 11 == 0)) for p in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "patient_id string, timestamp timestamp, glucose double, carbs double, insulin double")
    config = {"model": {"features": ["glucose"], "engineered_features": ["glucose", "glucose_delta", "iob", "cob", "hour_sin"], "use_engineered": True, "feature_engineering": {"insulin_tau_min": 240, "trend_steps": 3}, "predict_delta": True, "sequence_length": 6, "default_horizon": 3, "random_forest": {"n_estimators": 8, "max_depth": 6}}}
    plan, model, scores = ml.train_from_config(df, config)
    assert (plan.horizon, plan.length, plan.trees, len(model.trees)) == (3, 6, 8, 8) and ml.ForestPlan.of(config, 6).horizon == 6
    row = scores.first()
    assert row.n == 2 * (60 - 6 - 3 + 1) and row.rmse < 15
    ml.save_model(model, plan, scores, str(tmp_path / "m"))
    again, same = ml.load_model(spark, str(tmp_path / "m"))
    assert same == plan
    plain = ml.ForestPlan(["glucose"], length=6, horizon=3, trees=8, depth=6)
    df = df.where("glucose is not null")
    win = ml.forecast_windows(df, plain).cache()
    forest = ml.fit_forest(win, "dy", 8, 6)
    newest = ml.predict_newest(forest, df, plain).collect()
    assert len(newest) == 6 and all(r.sigma >= 0 and 60 < r.yhat < 160 for r in newest)
    folds = ml.cross_validate(df, plain, folds=3).collect()
    assert sorted((r.fold, r.n) for r in folds) == [(f, 2 * (59 - 6 - 3 + 1)) for f in range(3)]
    sweep = ml.weight_sweep(win.where("patient_id < 'p4'"), win.where("patient_id >= 'p4'"), plain, (3.0, 10.0)).collect()
    assert {(r.weight, r.threshold) for r in sweep} == {(w, t) for w in (3.0, 10.0) for t in (70.0, 80.0)} and all(r.tp + r.fn + r.fp + r.tn == 2 * 51 for r in sweep)
    with pytest.raises(ValueError):
        ml.train(df.where("patient_id = 'p1'"), plain)
    win.select("patient_id", "x", "y", "anchor", "v").drop("v").write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "w")).schema).parquet(str(tmp_path / "w"))
    events.score_batches(stream, lambda b: ml.predict(forest, ml.flat(b, plain.features), plain).select("patient_id", "y", "yhat"), str(tmp_path / "scored"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "scored")).count() == win.count()
