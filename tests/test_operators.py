import json
import os
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe import rules
from lumenframe.api import Engine, NotFound, build_profile
from lumenframe.config import DEFAULT, Config
from lumenframe.functions import scalars
from lumenframe.operators import context, geo, models, neighbours, points, profile, quantiles, sampling, series, times
from lumenframe.plans import analysis, explain
from lumenframe.sources.readers import TableError, clean_names, json_safe, read_table, url_filename, with_row_index
from lumenframe.sources.sinks import checked
from lumenframe.streaming.counters import frozen_limits, outside, windowed_counts


def test_rolling_is_the_same_across_blocks(spark):
    x = np.random.default_rng(1).normal(size=300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos bigint, x double")
    for w in (7, 8, 31):
        got = {r["pos"]: (r["x_med"], r["x_mad"]) for r in series.rolling(df, "x", w, size=64).collect()}
        med = pd.Series(x).rolling(w, center=True, min_periods=1).median()
        mad = (pd.Series(x) - med).abs().rolling(w, center=True, min_periods=1).median()
        assert np.allclose([got[i][0] for i in range(300)], med) and np.allclose([got[i][1] for i in range(300)], mad)


def test_positions_and_runs_cross_partitions(spark):
    df = spark.createDataFrame([(f"{i:04d}", float(0.9 if 60 <= i < 70 or i in (3, 4) else 0.1)) for i in range(200)], "k string, s double").repartition(7)
    placed = series.positioned(df, [F.col("k")])
    assert [r["pos"] for r in placed.orderBy("k").collect()] == list(range(200))
    assert [tuple(r)[:3] for r in series.high_runs(placed, "s", size=64).collect()] == [(60, 69, 10)]
    few = series.positioned(df.limit(5), [F.col("k")])
    assert series.high_runs(few, "s").count() == 0


def test_fences_need_a_spread(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(20)] + [(20, None), (21, float("inf"))], "id int, x double")
    got = points.flagged(df, ["x"])
    assert got.filter("point").count() == 0 and got.filter("x is null").count() == 0


def test_small_groups_say_nothing(spark):
    rows = [("a", float(i)) for i in range(30)] + [("a", 1e6)] + [("b", 1.0)] * 7
    df = spark.createDataFrame(rows, "g string, x double").withColumn("id", F.monotonically_increasing_id())
    assert context.contextual(df, "id", ["g"], ["x"]).count() == 0  # one valid group only
    more = df.unionByName(df.filter("g = 'b'"))
    assert context.contextual(more, "id", ["g"], ["x"]).count() == 1


def test_models_find_the_odd_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(400)] + [(400, 30.0, -30.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    config = Config(trees=40)
    iso = models.isolation_scores(df, "id", ["a", "b"], config)
    first = {r["id"]: r["iso_score"] for r in iso.collect()}
    assert max(first, key=first.get) == 400 and all(0 < v < 1 for v in first.values())
    assert first == {r["id"]: r["iso_score"] for r in models.isolation_scores(df.repartition(5), "id", ["a", "b"], config).collect()}
    lof = {r["id"]: r["lof"] for r in models.local_outlier_factor(df, "id", ["a", "b"], config).collect()}
    assert max(lof, key=lof.get) == 400 and lof[400] > 1.5
    sampled = models.local_outlier_factor(df, "id", ["a", "b"], Config(lof_rows=200, lof_switch=300)).filter("id = 400").first()["lof"]
    assert sampled > 1.5


def test_places_are_parsed_once(spark, monkeypatch):
    rows = [(i, 40 + i % 9 / 100, str(-74 + i % 7 / 100)) for i in range(200)] + [(200, float("nan"), "1"), (201, float("inf"), "1"), (202, 95.0, "1"), (203, None, "1"), (204, 40.0, "x"), (205, -33.9, " 151.2 ")]
    df = spark.createDataFrame(rows, "id int, lat double, lon string")
    plans, own = [], geo.quantiles

    def seen(of, *rest):
        plans.append(of._jdf.queryExecution().optimizedPlan().toString())
        return own(of, *rest)

    monkeypatch.setattr(geo, "quantiles", seen)
    assert geo.distances(df, "lat", "lon").count() == 201
    assert [r["id"] for r in geo.outliers(df, "lat", "lon").collect()] == [205]
    assert len(plans) == 4 and not any("RLIKE" in p for p in plans)  # every scan of a search reads numbers, not texts
    assert geo.outliers(df.limit(5), "lat", "lon").count() == 0


@pytest.mark.parametrize("shape", ["normal", "grid", "copies", "few"])
def test_rows_are_judged_in_place(spark, shape, monkeypatch):
    rng = np.random.default_rng(21)
    x = {"normal": rng.normal(size=(900, 3)), "grid": rng.integers(0, 6, (900, 3)), "copies": np.vstack([np.ones((450, 2)), rng.integers(0, 30, (450, 2))]), "few": rng.normal(size=(60, 2))}[shape].astype(np.float32).astype(float)
    columns = list("abc")[: x.shape[1]]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    config = Config(lof_switch=50, lof_rows=len(x) // 2)
    train = sorted(r["id"] for r in models.hash_sample(df, "id", config.lof_rows, config.seed).collect())
    k = 20
    far = lambda y, z: np.sqrt(sum((y[:, None, j] - z[None, :, j]) ** 2 for j in range(x.shape[1])))
    d = far(x, x[train])
    d[train, np.arange(len(train))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist, dist[train, -1][near]).mean(1) + 1e-10)
    searches, own = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda q, *a, **b: searches.append(q.count()) or own(q, *a, **b))
    got = {r["id"]: r["lof"] for r in models.local_outlier_factor(df, "id", columns, config).collect()}
    assert np.allclose([got[i] for i in range(len(x))], lrd[train][near].mean(1) / lrd, rtol=1e-6)
    assert searches == [len(train)]  # only rows of the sample are moved to meet each other


def brute_lof(x, k):
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    return near, lrd[near].mean(1) / lrd


@pytest.mark.parametrize("shape", ["normal", "copies", "few", "far"])
def test_neighbours_equal_brute_force(spark, shape, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 3))
    if shape == "copies":  # a third of all rows in one place, and a grid full of ties
        x[:500] = x[0]
        x[500:1200] = rng.integers(0, 6, (700, 3))
    if shape == "few":
        x = x[:9]
    if shape == "far":
        x[:40] *= 1e4
    monkeypatch.setattr(neighbours, "VISITORS", 100)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, c double").repartition(5)
    k = min(20, len(x) - 1)
    near, lof = brute_lof(x, k)
    got = {r["key"]: [p["nb"] for p in r["near"]] for r in neighbours.nearest(df, df, "id", ["a", "b", "c"], k, same=True).collect()}
    assert got == {i: n.tolist() for i, n in enumerate(near)}
    factors = {r["id"]: r["lof"] for r in models.local_outlier_factor(df, "id", ["a", "b", "c"]).collect()}
    assert np.allclose([factors[i] for i in range(len(x))], lof, rtol=1e-6)


@pytest.mark.parametrize("shape", ["normal", "copies", "ties", "skewed", "one_place"])
def test_all_rows_judge_each_other_across_cells(spark, shape, monkeypatch):
    rng = np.random.default_rng(31)
    x = {"normal": rng.normal(size=(1500, 2)), "copies": np.repeat(rng.normal(size=(40, 2)), 25, axis=0), "ties": rng.integers(0, 14, (1500, 2)).astype(float), "skewed": np.exp(3 * rng.normal(size=(1200, 3))), "one_place": np.ones((70, 2))}[shape]
    x = x[rng.permutation(len(x))]
    rows = [(f"k{i:05}", *map(float, r)) for i, r in enumerate(x)]
    odd = [("n1", None, 1.0), ("n2", float("nan"), 1.0), ("n3", float("inf"), 1.0)]
    columns = list("abc")[: x.shape[1]]
    df = spark.createDataFrame(rows + [(*r, 1.0)[: 1 + len(columns)] for r in odd], "id string, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    lof = brute_lof(x, 20)[1]
    for cell, visitors in ((1 << 14, 20_000), (30, 7), (6, 20_000)):  # the last: cells of fewer rows than a row has neighbours
        monkeypatch.setattr(neighbours, "CELL", cell)
        monkeypatch.setattr(neighbours, "VISITORS", visitors)
        got = {r["id"]: r["lof"] for r in models.local_outlier_factor(df, "id", columns).collect()}
        assert len(got) == len(rows) + 3 and all(got[k] == 1.0 for k in ("n1", "n2", "n3"))
        assert np.allclose([got[r[0]] for r in rows], lof, rtol=1e-6), (cell, visitors)


def test_factors_do_not_switch_with_the_size_of_a_table(spark):
    # beyond 120 000 rows, and with two far places of 15 rows each, of which a sample would hold fewer
    base = spark.range(121_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("b"))
    far = spark.range(30).select((F.col("id") + 121_000).alias("id"), (F.lit(1e5) + F.col("id") % 2 * 1e4).alias("a"), F.lit(1e5).alias("b"))
    df = base.unionByName(far)
    got = {r["id"]: r["lof"] for r in models.local_outlier_factor(df, "id", ["a", "b"]).filter("id >= 121000 or id % 40000 = 7").collect()}
    x = np.array([(r["a"], r["b"]) for r in df.orderBy("id").collect()])
    k, held = 20, {}

    def near(i):
        if i not in held:
            d = np.sqrt(((x[i] - x) ** 2).sum(1))
            d[i] = np.inf
            at = np.argsort(d, kind="stable")[:k]
            held[i] = at, d[at]
        return held[i]

    density = lambda i: 1 / (np.mean([max(d, near(j)[1][-1]) for j, d in zip(*near(i))]) + 1e-10)
    some = [121_000, 121_001, 7, 40_007]
    assert np.allclose([got[i] for i in some], [np.mean([density(j) for j in near(i)[0]]) / density(i) for i in some], rtol=1e-6)


def test_types(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02d}", "x" * 30 + " y", i % 3 == 0, [1], float(i % 5)) for i in range(60)], "my_id int, day_text string, note string, flag boolean, nested array<int>, v double")
    assert profile.semantic_types(df) == {"my_id": "id-like", "day_text": "date", "note": "text", "flag": "numeric", "nested": "unsupported", "v": "numeric"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' id ,id, name\n1,1.5,"x, y"\n2,NA,null\n')
    df = read_table(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "bigint"), ("id.1", "double"), ("name", "string")] and df.filter("name is null").count() == 1
    (tmp_path / "b.tsv").write_text("a\tb\ntrue\tq\nfalse\tr\n")
    assert read_table(spark, str(tmp_path / "b.tsv")).dtypes == [("a", "boolean"), ("b", "string")]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "z"}\n')
    assert read_table(spark, str(tmp_path / "c.jsonl")).columns == ["a", "b"]
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r["row_index"] for r in with_row_index(read_table(spark, str(tmp_path / "d.json"))).collect()] == [0, 1]
    (tmp_path / "e.csv").write_text("a,b\n")
    for bad in ("e.csv", "f.pdf"):
        with pytest.raises(TableError):
            read_table(spark, str(tmp_path / bad))
    assert url_filename("https://h.example/x/y.csv?z=1") == "y.csv" and url_filename("https://h.example/get?file=t.json") == "t.json"
    with pytest.raises(TableError):
        url_filename("ftp://h.example/x.csv")


def test_engine(spark, tmp_path):
    rows = [(i, float(i % 7), "a" if i % 2 else "b ", f"{i % 90 + 1}") for i in range(200)] + [(500, 900.0, "B", "x")]
    df = spark.createDataFrame(rows, "row_key bigint, item_count double, kind string, mixed string")
    e = Engine(spark, Config(trees=20))
    d = e.register("<t>", df.unionByName(df.filter("row_key = 3")))
    got = d.analyze(10, ["absent"])
    assert got["profile"]["duplicate_rows"] == 1 and got["anomalies"]["records"][0]["record"].startswith('{"row_key":500')
    assert got["anomalies"]["auto_fix_plan"][0]["columns"] == ["absent"] and "&lt;t&gt;" in d.report(10)
    assert d.repaired().count() == 201
    d.write(str(tmp_path / "out"), 10, ["absent"])
    back = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert back["anomalies"]["records"][0]["affected_columns"] == got["anomalies"]["records"][0]["affected_columns"] and back["profile"]["row_count"] == 202
    with pytest.raises(TableError, match="profile.row_count"):
        checked({**got, "profile": {k: v for k, v in got["profile"].items() if k != "row_count"}})
    with pytest.raises(NotFound):
        e.get("none")
    with pytest.raises(ValueError):
        d.anomalies(0)


def jobs_of(spark, act):
    tag = f"t{np.random.default_rng().integers(2**60)}"
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))


def test_profile_takes_as_many_jobs_for_few_as_for_many_columns(spark, tmp_path):
    rng = np.random.default_rng(14)
    wide = pd.DataFrame({f"{k}{i}": v() for i in range(6) for k, v in (("n", lambda: rng.normal(size=3000)), ("c", lambda: rng.choice(list("abc"), 3000)), ("d", lambda: np.repeat("05-Jan-2024", 3000)), ("s", lambda: np.where(rng.random(3000) < 0.97, None, "x")))})
    spark.createDataFrame(wide.astype({c: object for c in wide if c[0] != "n"})).repartition(2).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    need = Config(distinct="by need")  # exact counts of all columns take a scan for each
    few = jobs_of(spark, lambda: build_profile(df.select("n0", "c0", "d0", "s0"), need))
    assert jobs_of(spark, lambda: build_profile(df, need)) <= few + 2


def test_distinct_by_need_gives_the_same_profile(spark):
    rng = np.random.default_rng(15)
    n = 20_000
    data = pd.DataFrame({"one": 1, "thirty": rng.integers(0, 30, n), "half": rng.integers(0, n, n).astype(str), "key_id": np.arange(n) * 7, "text": [f"a long text of its own {i}" for i in range(n)], "few": rng.choice(["a", "b", None], n)})
    df = spark.createDataFrame(data.astype({"few": object}).where(data.notna(), None))
    exact, sketched = (build_profile(df, Config(distinct=d)) for d in ("exact", "by need"))
    assert any(not h["unique_exact"] for h in sketched["column_health"])
    for a, b in zip(exact["column_health"], sketched["column_health"], strict=True):
        assert a["unique_exact"] and (a["unique_count"] == b["unique_count"] if b["unique_exact"] else abs(a["unique_count"] / b["unique_count"] - 1) < 0.03)
        assert {**a, "unique_count": 0, "unique_exact": 0} == {**b, "unique_count": 0, "unique_exact": 0}
    assert {k: v for k, v in exact.items() if k != "column_health"} == {k: v for k, v in sketched.items() if k != "column_health"}


def test_tables_go_with_their_owner(spark, monkeypatch):
    base = spark.conf.get("spark.checkpoint.dir")
    left = lambda: {d for d in os.listdir(base) if d.startswith("owned-")}
    before = left()
    rows = [(i, float(i % 7), "ab"[i % 2], f"2024-01-{i % 28 + 1:02d}") for i in range(300)] + [(500 + i, 900.0 + 99 * i, "a", "2024-02-01") for i in range(6)]
    d = Engine(spark, Config(trees=10)).register("t", spark.createDataFrame(rows, "row_key bigint, v double, kind string, day_text string"))
    first = d.anomalies(3)
    assert len(left() - before) == 1 and len(first["records"]) == 3  # what the lists are made from
    monkeypatch.setattr(analysis, "judged", None)  # no detector runs again
    assert len(d.anomalies(50)["records"]) > 3 and d.anomalies(3)["records"] == first["records"]
    d.close()
    assert left() == before


def test_rows_are_numbered_by_file(spark, tmp_path):
    for kind in ("parquet", "csv", "json"):
        want = []
        for i, size in enumerate((5, 400, 3)):  # not the order of sizes, by which scans are packed
            frame = spark.range(1000 * i, 1000 * i + size).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t")).coalesce(1)
            frame.write.mode("append").format(kind).save(str(tmp_path / f"{kind}-{i}"))
            part = next(f for f in os.listdir(tmp_path / f"{kind}-{i}") if f.startswith("part-"))
            (tmp_path / kind).mkdir(exist_ok=True)
            os.rename(tmp_path / f"{kind}-{i}" / part, tmp_path / kind / f"{i}-{part}")
            want += [f"t{1000 * i + j}" for j in range(size)]
        df = spark.read.schema("id bigint, t string").format(kind).load(str(tmp_path / kind))
        before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
        got = with_row_index(df.select("t")).orderBy("row_index").collect()
        assert [r["t"] for r in got] == want and [r["row_index"] for r in got] == list(range(len(want)))
        assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before  # nothing was written


def test_sampled_analysis_is_within_its_intervals(spark):
    n = 12_000
    k = F.col("id")
    df = spark.range(n).select((k * 3 % 5000 % 997).cast("double").alias("v"), F.when(k % 7 == 0, "no date").otherwise("2024-01-05").alias("day_text"), F.when(k % 3 == 0, F.concat(F.lit("x"), k % 9)).otherwise((k % 90).cast("string")).alias("mixed"),
                               F.when(k % 11 != 0, (k % 13).cast("double")).alias("w"), F.floor(k / 3).alias("third"))
    df = df.unionByName(df.filter("third % 4 = 0")).repartition(3)
    d = Engine(spark, Config(trees=10, sample_least=1000)).register("t", df)
    p, a = (d.sampled(5, rows=2000)[x] for x in ("profile", "anomalies"))
    meta, total = a["analysis_metadata"], df.count()
    assert (meta["analysis_mode"], meta["sampled_rows"], p["row_count"], a["total_rows"]) == ("sampled", 2000, total, total)
    truth = {"invalid_dates.day_text": df.filter("day_text = 'no date'").count(), "type_mismatch_counts.mixed": df.filter("mixed like 'x%'").count(), "duplicate_rows": total - df.distinct().count()}
    for path, value in truth.items():
        low, high = meta["intervals"][path]
        assert low <= value <= high and high - low < 0.5 * total
    assert p["missing_values"]["w"]["count"] == df.filter("w is null").count() == a["quality_anomalies"]["missing_values"]["count"]
    assert a["quality_anomalies"]["duplicates"]["count"] == p["duplicate_rows"] and all(low <= high for low, high in meta["intervals"].values())
    assert next(h for h in p["column_health"] if h["column"] == "w")["missing_pct"] == p["missing_values"]["w"]["pct"]
    assert sampling.scaled(5, 100, 100) == (5, 5, 5) and sampling.scaled(0, 100, 10_000)[:2] == (0, 0)
    d.close()


def test_names_and_previews():
    assert clean_names([" a", "a", "a.1", "B", "b "]) == ["a", "a.2", "a.1", "B", "b.1"]
    odd = {"x": float("nan"), "y": [Decimal("1.5"), b"\x01", None], "z": pd.Timestamp("2024-01-05"), "i": float("-inf")}
    assert json_safe(odd) == {"x": None, "y": [1.5, "01", None], "z": "2024-01-05T00:00:00", "i": None}


def test_places_are_judged_by_the_raw_table(spark):
    rows = [(i, 40 + i % 9 / 10, -74.0, 1.0 if i % 4 else None) for i in range(200)] + [(200 + i, None, None, 2.0) for i in range(100)] + [(400, -33.0, 151.0, None)]
    df = spark.createDataFrame(rows, "id bigint, latitude double, longitude double, v double")
    got = analysis.judged(df, "id", ["latitude", "longitude", "v"], None, None, ("latitude", "longitude"), Config(trees=10)).filter(F.array_contains("types", "geospatial")).collect()
    assert [r["id"] for r in got] == [400] and "times)" in got[0]["why"][0]["detail"] + got[0]["why"][-1]["detail"]
    listed = analysis.suspicious(df, "id", ["latitude", "longitude", "v"], None, None, ("latitude", "longitude"), Config(trees=10), top_n=1).first()
    assert json.loads(listed["record"]) == {"id": 400, "latitude": -33.0, "longitude": 151.0, "v": None}  # as it stands in the table


def test_repairs_parse_dates_and_drop_missing(spark):
    df = spark.createDataFrame([(float(i), "5-Jan-2024" if i else "none") for i in range(99)] + [(float("nan"), "6-Jan-2024")], "v double, day_text string")
    p = build_profile(df)
    out = rules.apply_fixes(df, rules.fix_plan(p, {"records": []}), p)
    assert out.count() == 99 and dict(out.dtypes)["day_text"] == "timestamp" and out.filter("day_text is null").count() == 1


def test_rules_without_issues():
    g = {"latitude_column": None, "longitude_column": None}
    p = {"column_types": {}, "missing_values": {}, "duplicate_rows": 0, "invalid_dates": {}, "constant_columns": [], "high_cardinality_columns": [], "skewed_numeric_columns": {}, "outlier_counts": {}, "type_mismatch_counts": {}, "geospatial_summary": g}
    assert rules.fix_plan(p, {"suspicious_count": 0})[0]["issue"] == "no issues"
    assert rules.recommendations(p, {"suspicious_count": 0}) == ["No suspicious rows were found."]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(500).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 30).alias("ts"), F.when(F.col("id") % 9 != 0, F.col("id").cast("double")).alias("x")).repartition(3).write.parquet(src)
    batch = spark.read.parquet(src)
    want = {tuple(r) for r in windowed_counts(batch, "ts", ["x"]).collect()}
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = windowed_counts(stream, "ts", ["x"]).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counted").collect()} == want
    limits = frozen_limits(batch, ["x"])
    assert outside(batch.withColumn("x", F.col("x") * 10), limits).count() > 0


def test_times_of_many_spellings(spark):
    good = ["2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05 10:00", "2024-01-05 10:00:00.25", "1/5/2024", "01/05/2024 10:00:00", "Jan 5, 2024", "5 January 2024", "2024/01/05", "05.01.2024",
            "2001", "Jan 5 2024", "5-Jan-2024", "05-Jan-24", "1/5/24", "Fri, 05 Jan 2024 10:00:00 GMT", "1/5/2024 10:00 AM", "Jan 5, 2024 10:00", "20240105T100000", "2024.01.05", "January 2024", "13/1/2024", "13:45"]  # a time alone is one of today
    bad = ["not a date", "2024-02-30", "", "99/99/2024", "9999-12-31"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "t string")
    parsed = {r["t"]: r["p"] for r in df.select("t", times.parsed_time(F.col("t")).alias("p")).collect()}
    assert all(parsed[x] is not None for x in good) and all(parsed[x] is None for x in bad)
    assert all(parsed[x] == pd.to_datetime(x, format="mixed", utc=True).tz_localize(None) for x in good if x != "13:45")
    assert tuple(profile.invalid_dates(df, "t").first()) == ("t", len(bad), len(good) + len(bad))
    years = spark.createDataFrame([(1990 + i % 30, f"{i % 28 + 1:02d}-Jan-2024", float(i % 7)) for i in range(200)], "model_year int, day_text string, v double")
    assert profile.semantic_types(years) == {"model_year": "date", "day_text": "date", "v": "numeric"}
    assert times.counted(years, ["model_year", "day_text"]) == {"model_year": (200, 200), "day_text": (200, 200)} and times.best_time(years, ["day_text"]) == "day_text"
    assert dict(times.ordered(times.ordered(years, "model_year"), "day_text").dtypes) == {"model_year": "int", "day_text": "timestamp", "v": "double"}
    assert times.best_time(df.withColumn("u", F.lit("x")), ["u", "t"]) == "t" and times.best_time(df, []) is None


def test_selected_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    data = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.5, 0.0, rng.pareto(1, n)), "d": rng.integers(0, 9000, n).astype(float), "e": 1.5, "f": np.nan})
    data.loc[rng.random(n) < 0.3, "d"] = np.nan
    df = spark.createDataFrame(data).repartition(5)
    ps = (0.0, 0.001, 0.25, 0.5, 0.9, 0.995, 1.0)
    for size, kept in ((1000, 20_000), (64, 50)):  # small sketches take more rounds, to the same values
        got, extra = quantiles.quantiles(df, {c: F.col(c) for c in data}, ps, {"n": F.count(F.lit(1))}, k=size, kept=kept)
        assert extra == {"n": n} and got["f"] == [None] * len(ps)
        for c in "abcde":
            assert np.allclose(got[c], data[c].quantile(list(ps)), rtol=1e-12, atol=0)
    assert quantiles.medians(df.limit(0), {"a": F.col("a")}) == {"a": None}


def test_a_sketch_that_misses_is_found_out(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    wrong = iter([(700.0, 710.0), (20.0, 30.0)])
    real = quantiles._ends
    monkeypatch.setattr(quantiles, "_ends", lambda *a: F.array(*map(F.lit, w)) if (w := next(wrong, None)) else real(*a))
    assert quantiles.quantiles(df, {"x": F.col("x")}, (0.5,), kept=100)[0] == {"x": [499.5]}


def test_runs_merge_as_a_tree(spark):
    rng = np.random.default_rng(9)
    high = rng.random(600) < 0.8
    high[100:300] = True  # over many blocks
    df = spark.createDataFrame([(i, 0.9 if h else 0.1) for i, h in enumerate(high)], "pos bigint, s double")
    want, i = [], 0
    while i < 600:
        j = i
        while j < 600 and high[j]:
            j += 1
        if j - i >= 3:
            want.append((i, j - 1, j - i))
        i = max(j, i + 1)
    for size, fan in ((8, 2), (8, 5), (64, 1000)):
        assert sorted(tuple(r)[:3] for r in series.high_runs(df, "s", size=size, fan=fan).collect()) == want


def test_series_engine_equals_pandas(spark):
    rng = np.random.default_rng(10)
    n, w = 400, 9
    x = pd.DataFrame({"a": rng.normal(size=n).cumsum(), "b": np.sin(np.arange(n) * 2 * np.pi / 12) + rng.normal(size=n) * 0.1, "c": 3.0})
    x.loc[[50, 200], "a"] += 40
    x.loc[[130, 131], "b"] -= 6
    df = spark.createDataFrame([(i, f"k{i}", *map(float, r)) for i, r in enumerate(x.values)], "pos bigint, key string, a double, b double, c double")
    s = series.Series(df, ["a", "b", "c"], w, size=64)
    for c in "abc":
        st = s.stats()[c]
        assert st["n"] == n and np.isclose(st["sd"], x[c].std(ddof=0)) and np.isclose(st["step_sd"], x[c].diff().fillna(0).std(ddof=0))
        for k, r in st["lags"].items():
            assert (r is None and c == "c") or np.isclose(r, x[c].corr(x[c].shift(k)), atol=1e-5)
    assert s.season("b") == 12 and s.season("c") is None
    want = set()
    for c in "abc":
        v = x[c]
        med = v.rolling(w, center=True, min_periods=1).median()
        mad = (v - med).abs().rolling(w, center=True, min_periods=1).median()
        limit = np.maximum(6 * mad, 1.5 * v.std(ddof=0))
        want |= {(i, c, "spike" if v[i] > med[i] else "dip") for i in np.flatnonzero((v - med).abs() > limit)}
        d = v.diff().fillna(0)
        med = d.rolling(w, center=True, min_periods=1).median()
        mad = (d - med).abs().rolling(w, center=True, min_periods=1).median()
        want |= {(i, c, "trend") for i in np.flatnonzero((d - med).abs() > np.maximum(6 * mad, 2 * d.std(ddof=0))) if i > 3}
        if s.season(c):
            e = (v - v.shift(s.season(c))).abs()
            want |= {(i, c, "seasonal") for i in np.flatnonzero(e > max(e.median() + 6 * (e - e.median()).abs().median(), 2.5 * e.std(ddof=0)))}
    got = s.events().collect()
    assert {(r["pos"], r["column"], r["kind"]) for r in got} == want and len(got) == len(want) and all(r["key"] == f"k{r['pos']}" for r in got)


def test_contexts_in_two_scans(spark):
    rng = np.random.default_rng(11)
    data = pd.DataFrame({"id": range(500), "g": rng.choice(list("abc"), 500), "h": rng.choice(["x", None], 500), "u": rng.normal(size=500), "v": rng.normal(size=500)})
    data.loc[7, "u"], data.loc[9, "v"] = 50.0, -40.0
    df = spark.createDataFrame(data.astype({"h": object}).where(data.notna(), None), "id bigint, g string, h string, u double, v double")
    want = set()
    for c in "gh":
        of = data[c].fillna("nan")
        for v in "uv":
            z = ((data[v] - data.groupby(of)[v].transform("mean")) / data.groupby(of)[v].transform("std")).abs()
            want |= {(int(i), c, v, round(z[i], 6)) for i in np.flatnonzero(z > 3.2)}
    got = lambda: {tuple(r) for r in context.contextual(df, "id", ["g", "h"], ["u", "v"]).collect()}
    assert got() == want
    limit, context.BROADCAST_GROUPS = context.BROADCAST_GROUPS, 0
    try:
        assert got() == want
    finally:
        context.BROADCAST_GROUPS = limit


def test_castable_share_is_of_all_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (None,)], "lat double")
    assert profile.geo_scores(df, ["lat"]).first()["castable"] == 0.5
    assert profile.pick_coordinates(profile.geo_scores(df, ["lat"]).collect()) == (None, None)


def test_flags_and_counts_go_beyond_the_lists(spark):
    rows = [(i, float(i % 2) if i % 11 else 90.0 + i) for i in range(4000)]
    df = spark.createDataFrame([(i, f"{2000 + i // 336}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}", v) for i, v in rows], "row_index bigint, day string, v double").withColumn("day", F.col("day").cast("date"))
    events = analysis.events_of(df, "row_index", ["v"], "day")
    spikes = events.filter("kind = 'spike'").count()
    assert spikes > DEFAULT.events_per_type and analysis.listed(events, ["v"]).filter("kind = 'spike'").count() == DEFAULT.events_per_type
    assert [r["kind"] for r in analysis.listed(events, ["v"]).collect()] == sorted((r["kind"] for r in analysis.listed(events, ["v"]).collect()), key=analysis.KINDS.index)
    got = analysis.judged(df, "row_index", ["v"], "day", events=events)
    assert got.count() == 4000 and got.filter(F.array_contains("types", "spike")).count() == spikes
    assert got.filter(F.array_contains("types", "spike") & ~F.array_contains("affected", "v")).count() == 0


def test_rows_events_and_groups_are_explained(spark):
    rows = [(f"{2020 + i // 336}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}", float(i % 5), "a" if i % 2 else "b") for i in range(300)]
    rows[150] = (rows[150][0], 4000.0, "a")
    df = spark.createDataFrame(rows, "day string, amount double, kind string").withColumn("day", F.col("day").cast("date"))
    e = Engine(spark, Config(trees=20))
    d = e.register("t", df)
    got = d.anomalies(10)
    top = got["records"][0]
    assert "IQR" in top["methods"] and "z-score" in top["methods"] and top["reasons"][0].startswith("amount = 4,000.0 outside [") and "z-score" in top["reasons"][0]
    assert top["explanation"].startswith("Found as point") and "Signals: IQR" in top["explanation"] and "Time (day): 2020-" in top["explanation"] and top["time_details"]
    event = next(x for x in got["time_series_events"] if x["kind"] == "spike")
    assert event["row_index"] == top["key"] and event["prev_value"] == 4.0 and event["delta_from_prev"] == 3996.0 and event["pct_from_prev"] == 99900.0 and event["prev_timestamp"] < event["timestamp"]
    assert event["threshold_ratio"] == round(round(event["deviation"], 6) / round(event["threshold"], 6), 6) and event["message"].startswith("amount rose to 4,000.0, usual 3.000")  # of 2 3 4 4000 1 2 3
    for g in got["anomaly_groups"]:
        assert g["count"] == sum(g["severity_breakdown"].values()) or g["category"] == "data_quality"
        assert len(g["samples"]) <= 8 and len(g["signals"]) <= 6 and all(s["explanation"] for s in g["samples"])
    assert got["suspicious_count"] == sum(g["count"] for g in got["anomaly_groups"] if g["category"] != "data_quality")
    assert "rose to" in d.report(10)


def test_figures_for_people(spark):
    want = {1234567.891: "1,234,567.9", -1000.0: "-1,000.0", 123.456: "123.46", -1.23456: "-1.235", 0.0: "0.0000", 0.12345: "0.1235", float("nan"): "n/a", float("inf"): "n/a", None: "n/a"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", explain.metric(F.col("x")).alias("m"), explain.percent(F.col("x")).alias("p")).collect()
    assert [r["m"] for r in got] == list(want.values()) and got[2]["p"] == "123.46%" and got[8]["p"] == "n/a"
    odd = spark.createDataFrame([(3.0, 0.0), (3.0, -2.0), (None, 1.0), (1.0, float("nan"))], "a double, b double").select(explain.share(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in odd] == [None, 250.0, None, None]


def test_json_of_columns_and_limits(spark, tmp_path):
    def read(text, **given):
        p = tmp_path / f"t{len(list(tmp_path.iterdir()))}.json"
        p.write_text(text)
        return [tuple(r) for r in read_table(spark, str(p), **given).collect()]

    assert read('{"a": [1, 2, null], "b": ["x", "y", "z"]}') == [(1, "x"), (2, "y"), (None, "z")]
    assert read('\n{"a": {"0": 1, "1": 2.5, "10": 3}, "b": {"0": "x", "10": "z"}}') == [(1.0, "x"), (2.5, None), (3.0, "z")]
    assert read('[{"a": [1, 2]}]') == [([1, 2],)] and read('{"a": 1}') == [(1,)]
    big = '[{"a": "' + "x" * 200_000 + '"}]'
    assert len(read(big, max_mb=0.5)) == len(read(big)) == len(read(big, max_mb=-1)) == 1
    with pytest.raises(TableError):
        read(big, max_mb=0.1)


def test_row_index_is_the_reading_order(spark):
    df = spark.range(1000, numPartitions=7).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("a b"))
    got = with_row_index(df.filter("n % 5 <> 0"))
    assert got.columns == ["n", "a b", "row_index"]
    assert [r["row_index"] for r in got.orderBy("n").collect()] == list(range(800))
    assert with_row_index(df.limit(0)).count() == 0


def test_forest_paths_from_tables_are_those_of_walks(monkeypatch):
    rng = np.random.default_rng(4)
    for width in (1, 2, 5):
        pool = rng.normal(size=(256, width)).astype(np.float32)
        pool[:40] = pool[0]
        forest = [models.grow(pool, np.random.default_rng(i), 8) for i in range(12)] + [models.grow(pool[:1], rng, 8)]
        cuts = np.concatenate([f[1] for f in forest])
        x = np.concatenate([pool.astype(float), rng.normal(size=(500, width)) * 3, rng.choice(cuts, (500, width)), np.full((1, width), np.nan), np.full((1, width), np.inf)])
        walked = sum(np.array([_leaf(r, f) for r in x]) for f in forest)
        for cells in (0, 200, models.CELLS):
            monkeypatch.setattr(models, "CELLS", cells)
            paths = models._Paths(forest, width)
            assert np.array_equal(paths.total(x), walked)
        monkeypatch.undo()
        assert width > 2 or all(len(tree) == 2 for tree in models._Paths(forest, width).trees)  # no walks for few columns


def _leaf(row, tree):
    feature, cut, left, right, path = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] if row[feature[at]] <= cut[at] else right[at]
    return path[at]
