
import datetime as dt
import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.functions.windows import next_values, prefix_sums
from tenure.operators import encode as K
from tenure.operators import members as M
from tenure.operators import metrics as MT
from tenure.operators import sampling as SMP
from tenure.operators import timeseries as TS
from tenure.sources.fixtures import LOG_FIRST_DAY, Tables

from adf_plain import adf_one
from conftest import rows


def test_prefix_sums_equal_brute_force(spark):
    rnd = random.Random(7)
    data = [(g, i, rnd.randint(0, 9)) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(data, "g int, k int, v int")
    got = {(r["g"], r["k"]): r["v_cum"] for r in rows(prefix_sums(df, ["k"], ["v"], group_cols=["g"], num_ranges=5))}
    for g in range(3):
        acc = 0
        for i in range(200):
            acc += data[g * 200 + i][2]
            assert got[(g, i)] == acc


@pytest.fixture(scope="module")
def many(spark):
    """100,000 distinct keys with a payload column, far beyond what a range sampler holds."""
    return spark.range(100_000).select(((F.col("id") * 7919) % 100_003).alias("k"), (F.col("id") % 10).alias("v"),
                                       F.md5(F.col("id").cast("string")).alias("payload"))


@pytest.mark.parametrize("partitions", [4, 8, 200])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_running_sums_do_not_depend_on_the_plan(spark, many, partitions, reuse):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = prefix_sums(many, ["k"], ["v"]).select("k", "v", "v_cum", "payload").toPandas().sort_values("k")
        assert len(got) == 100_000 and (got["v"].cumsum() == got["v_cum"]).all()
        positions = SMP.numbered_keys(many, "payload").agg(F.countDistinct("position"), F.max("position")).first()
        assert tuple(positions) == (100_000, 99_999)
        codes = K.label_encode(many, "payload", "code").agg(F.countDistinct("code"), F.max("code")).first()
        assert tuple(codes) == (100_000, 99_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_auc_and_roc_with_many_scores(spark, many):
    scored = many.select("payload", (F.col("k") / 100_003).alias("p1"),
                         (F.col("k") * (F.col("v") + 3) % 11 < 4).cast("int").alias("is_churn"))
    pdf = scored.toPandas()
    ranks = pdf["p1"].rank().to_numpy()
    pos = pdf["is_churn"].to_numpy() == 1
    brute = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert math.isclose(rows(MT.roc_auc(scored))[0]["roc_auc"], brute, rel_tol=1e-12)
    pts = MT.roc_points(scored).toPandas().sort_values(["fpr", "tpr"])
    assert len(pts) == 100_001 and (pts["tpr"].diff().dropna() >= 0).all()


def test_groups_with_null_keep_their_running_sums(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5), ("a", None, 1)], "g string, k int, v int")
    got = {(r["g"], r["k"]): r["v_cum"] for r in rows(prefix_sums(df, ["k"], ["v"], group_cols=["g"]))}
    assert got == {(None, 1): 2, (None, 2): 5, ("a", None): 1, ("a", 1): 6}


def test_null_is_no_category(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "msno long, c string")
    assert {r["msno"]: r["c_code"] for r in rows(K.label_encode(df, "c"))} == {1: 0, 2: None, 3: 1}
    assert {(r["msno"], r["feature"]) for r in rows(K.one_hot_long(df, ["c"]))} == {(1, "c@1"), (3, "c@2")}


def test_one_hot_keeps_64_bit_ids_apart(spark):
    df = spark.createDataFrame([(1, 2**53, "x", 0.5), (2, 2**53 + 1, "y", 0.25), (3, 7, "x", None)],
                               "msno long, id long, t string, d double")
    got = {(r["msno"], r["feature"]) for r in rows(K.one_hot_long(df, ["id", "t", "d"]))}
    assert got == {(1, "id@2"), (2, "id@3"), (3, "id@1"), (1, "t@1"), (2, "t@2"), (3, "t@1"), (1, "d@2"), (2, "d@1")}


def test_stream_on_a_folder_table_equals_batch(spark, tmp_path):
    from tenure.streaming.log_filter import run_folder, stream_keep_users
    events = spark.range(3000).selectExpr("id", "id % 50 AS user_id")
    folder = str(tmp_path / "events.parquet")
    events.repartition(6).write.parquet(folder)
    users = spark.createDataFrame([(3,), (7,), (49,)], "user_id long")
    for files in (None, 1):
        sink, ckpt = run_folder(spark, "folder_test")
        got = stream_keep_users(spark, folder, events.schema, users, "user_id", sink, ckpt, max_files_per_trigger=files)
        assert sorted(r.id for r in got.collect()) == sorted(i for i in range(3000) if i % 50 in (3, 7, 49))


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    """A run that stopped between a batch's write and its commit, then new files: every row is there once."""
    from tenure.streaming.log_filter import run_folder, stream_keep_users
    events = spark.range(4000).selectExpr("id", "id % 50 AS user_id")
    folder = str(tmp_path / "events.parquet")
    events.where("id < 2000").repartition(4).write.parquet(folder)
    users = spark.createDataFrame([(3,), (7,), (49,)], "user_id long")
    sink, ckpt = run_folder(spark, "restart_test")
    first = stream_keep_users(spark, folder, events.schema, users, "user_id", sink, ckpt, max_files_per_trigger=1).count()
    assert first == sum(1 for i in range(2000) if i % 50 in (3, 7, 49))
    done = ckpt.removeprefix("file:")
    last = max(int(f) for f in os.listdir(f"{done}/commits") if f.isdigit())
    stopped = str(tmp_path / "stopped")
    shutil.copytree(done, stopped, ignore=lambda d, names: [f for f in names if d.endswith("commits") and f.strip(".").split(".")[0] == str(last)])
    assert last >= 3 and not os.path.exists(f"{stopped}/commits/{last}")
    events.where("id >= 2000").repartition(3).write.mode("append").parquet(folder)
    got = stream_keep_users(spark, folder, events.schema, users, "user_id", sink, stopped, max_files_per_trigger=1)
    assert sorted(r.id for r in got.collect()) == [i for i in range(4000) if i % 50 in (3, 7, 49)]
    assert os.path.exists(f"{stopped}/commits/{last}")


def test_next_values_cross_range_borders(spark):
    rnd = random.Random(3)
    data = [(g, k, rnd.choice([None, 1, 2])) for g in ("a", None) for k in rnd.sample(range(1000), 90)]
    df = spark.createDataFrame(data, "g string, k int, v int").repartition(5)
    for ranges in (1, 4, 40):
        got = {(r["g"], r["k"]): r["next_v"] for r in rows(next_values(df, "k", ["v"], ["g"], num_ranges=ranges))}
        for g in ("a", None):
            run = sorted((k, v) for h, k, v in data if h == g)
            assert [got[g, k] for k, _ in run] == [v for _, v in run[1:]] + [None]
    assert next_values(df.limit(0), "k", ["v"], ["g"]).count() == 0


def test_dropped_points_lie_between_equal_steps(spark):
    rnd = random.Random(11)
    data = [(rnd.randint(0, 60) / 60, int(rnd.random() < 0.5)) for _ in range(70)] + [(2 + i / 8, 0) for i in range(9)]
    scored = spark.createDataFrame(data, "p1 double, is_churn int")
    every = sorted((r.tpr, r.fpr, r.threshold) for r in MT.roc_points(scored).where("threshold is not null").collect())
    every.sort(key=lambda p: -p[2])
    pos, neg = sum(y for _, y in data), sum(1 - y for _, y in data)
    fps, tps = [round(p[1] * neg) for p in every], [round(p[0] * pos) for p in every]
    keep = [i == 0 or i == len(every) - 1 or fps[i + 1] - 2 * fps[i] + fps[i - 1] != 0 or tps[i + 1] - 2 * tps[i] + tps[i - 1] != 0
            for i in range(len(every))]
    got = MT.roc_points(scored, drop_collinear=True).where("threshold is not null").collect()
    assert sorted(r.threshold for r in got) == sorted(p[2] for p, k in zip(every, keep) if k)
    assert 2 < len(got) < len(every)


def test_distinct_sketch_error(spark):
    df = spark.range(200_000).selectExpr("id", "cast(id % 7 as int) AS few", "cast(id % 50000 as string) AS text",
                                         "if(id % 3 = 0, null, id / 2.0) AS half", "cast(null as string) AS none",
                                         "date_add(date'2000-01-01', cast(id % 900 as int)) AS day")
    exact = {r.column_name: r.n_distinct for r in M.column_distinct_profile(df).collect()}
    about = {r.column_name: r.n_distinct for r in M.column_distinct_sketch(df).collect()}
    assert set(about) == set(df.columns) and about["few"] == 7 and about["none"] == 1 and about["day"] == 900
    assert max(abs(about[c] - n) / n for c, n in exact.items()) < 4 * 0.0065
    assert {r.n_distinct for r in M.column_distinct_sketch(df.limit(0)).collect()} == {0}


def test_calendar_follows_the_data(spark):
    from tenure.operators import eda as D
    logs = spark.createDataFrame([(1, dt.date(2023, 12, 30), 2), (2, dt.date(2024, 3, 1), 3)], "msno long, date date, num_100 long")
    first, n = D.calendar_of(logs)
    assert (first, n) == (dt.date(2023, 12, 30), 63)
    filled = D.calendar_fill(logs, logs.select("msno"), first, n)
    assert filled.count() == 126 and filled.agg(F.sum("num_100")).first()[0] == 5
    assert D.calendar_fill(logs.limit(0), logs.select("msno"), *D.calendar_of(logs.limit(0))).count() == 0


def test_off_one_machine_a_checkpoint_folder_is_required():
    from types import SimpleNamespace
    from tenure.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                         getConf=lambda: SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_auc_brute_force_and_symmetry(spark):
    rnd = random.Random(3)
    data = [(i, rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(300)]   # many ties
    df = spark.createDataFrame(data, "msno long, is_churn int, p1 double")
    auc = rows(MT.roc_auc(df))[0]["roc_auc"]
    pos = [p for _, y, p in data if y == 1]
    neg = [p for _, y, p in data if y == 0]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, brute, rel_tol=1e-12)
    flipped = rows(MT.roc_auc(df.withColumn("p1", -F.col("p1"))))[0]["roc_auc"]
    assert math.isclose(auc + flipped, 1.0, rel_tol=1e-12)
    pts = rows(MT.roc_points(df), ["fpr", "tpr"])
    assert pts[0]["fpr"] == 0.0 and pts[-1]["fpr"] == 1.0 and pts[-1]["tpr"] == 1.0


def test_samples_exact_and_subset(spark, sf_dir):
    tr = Tables(spark, sf_dir).train
    s = SMP.sample_exact(tr, 40)
    assert s.count() == 40 and s.join(tr, ["msno", "is_churn"], "left_anti").count() == 0
    st = SMP.stratified_sample(tr, "is_churn", {1: 10, 0: 1000})
    counts = {r["is_churn"]: r["count"] for r in st.groupBy("is_churn").count().collect()}
    assert counts[1] == 10 and counts[0] == tr.filter("is_churn = 0").count()   # capped at population
    assert rows(SMP.sample_exact(tr, 40), ["msno"]) == rows(SMP.sample_exact(tr, 40), ["msno"])
    in_order = [r.msno for r in tr.orderBy(SMP.hash_key("msno")).collect()]
    for first, n in ((0, 97), (0, 10**6), (5, 20), (0, 1), (len(in_order) - 3, 10), (len(in_order) + 1, 5), (3, 0)):
        cut = [r.msno for r in SMP.sample_slice(tr, first, n).collect()]
        assert sorted(cut) == sorted(in_order[first:first + n])
    wr = SMP.sample_with_replacement(tr, 60)
    assert 0 < wr.count() <= 60 and wr.join(tr, "msno", "left_anti").count() == 0


def test_decomposition_adds_up(spark, sf_dir):
    series = TS.daily_series(Tables(spark, sf_dir).user_logs, LOG_FIRST_DAY, 30)
    for m in (6, 7):
        d = TS.seasonal_decompose(series, m).filter(F.col("trend").isNotNull())
        bad = d.filter(F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("observed")) > 1e-9)
        assert d.count() > 0 and bad.count() == 0
        # seasonal components of a user sum to ~0 over one period
        s = d.groupBy("msno", (F.col("t") % m).alias("ph")).agg(F.first("seasonal").alias("s")) \
             .groupBy("msno").agg(F.sum("s").alias("tot"))
        assert s.filter(F.abs("tot") > 1e-9).count() == 0


def test_adf_on_random_walk_and_stationary_series():
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=200))
    noise = rng.normal(size=200)
    s_walk, _, n1 = adf_one(walk)
    s_noise, _, n2 = adf_one(noise)
    assert s_noise < -3.5 < s_walk          # white noise rejects a unit root, the walk does not
    assert n1 <= 199 and n2 <= 199
    stat, lag, nobs = adf_one(np.zeros(30))
    assert stat is None                     # singular: no statistic


def test_lag_selected_adf_equals_plain_regressions(spark):
    rng = np.random.default_rng(5)
    made = {f"walk{n}": np.cumsum(rng.normal(size=n)) + 1e4 for n in (9, 25, 60, 137)}
    made |= {f"ar{n}": rng.poisson(3, n) + np.roll(rng.poisson(3, n), 2) * 2.0 for n in (14, 30, 100)}
    made["weekly"] = np.tile([0.0, 5, 1, 0, 2, 0, 9], 20) + rng.normal(size=140) * 0.1
    odd = {"flat": np.full(30, 4.0), "one": np.array([3.0]), "two": np.array([3.0, 1.0]), "late": np.eye(30)[29],
           "early": np.eye(30)[1], "line": np.arange(30.0)}
    data = [(k, t, float(v)) for k, x in (made | odd).items() for t, v in enumerate(x)] + [("nulls", t, None) for t in range(20)]
    df = spark.createDataFrame(data, "msno string, t int, num_25 double").repartition(7)
    got = {r["msno"]: r for r in rows(TS.unit_root_adf(df))}
    assert set(got) == set(made) | set(odd) | {"nulls"}
    for k, x in made.items():
        stat, lag, nobs = adf_one(x)
        assert (got[k]["used_lag"], got[k]["nobs"]) == (lag, nobs), k
        assert math.isclose(got[k]["adf_stat"], stat, rel_tol=1e-6), k
        assert math.isclose(got[k]["crit_5"], sum(b / nobs ** i for i, b in enumerate(TS.ADF_CRIT_CONSTANT["5%"])))
    for k in ("flat", "one", "two", "line", "nulls"):
        assert got[k]["adf_stat"] is None, k
    assert got["one"]["nobs"] == 0 and got["one"]["crit_5"] is None
    assert TS.unit_root_adf(df.limit(0)).count() == 0


def test_lag0_matches_numpy(spark):
    x = np.array([3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7])
    df = spark.createDataFrame([(1, int(t), float(v)) for t, v in enumerate(x)], "msno long, t int, num_25 double")
    r = rows(TS.unit_root_lag0(df))[0]
    dx, xl = np.diff(x), x[:-1]
    X = np.column_stack([np.ones(len(xl)), xl])
    beta, res, _, _ = np.linalg.lstsq(X, dx, rcond=None)
    s2 = res[0] / (len(dx) - 2)
    se = math.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1])
    assert math.isclose(r["adf_stat"], beta[1] / se, rel_tol=1e-9)


def test_streaming_equals_batch(spark, sf_dir):
    from tenure.plans.registry import load_all
    q = load_all()
    streamed = q["stream_filter_append"].build(spark, sf_dir)
    t = Tables(spark, sf_dir)
    users = SMP.stratified_sample(t.train, "is_churn", {1: 300, 0: 600}).select(F.col("msno").alias("user_id"))
    batch = t.raw("events").join(users, "user_id", "left_semi")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_csv_roundtrip_with_dirty_dates(spark, tmp_path):
    from tenure.sources import io
    p = str(tmp_path / "m.csv")
    with open(p, "w") as f:
        f.write("msno,city,bd,gender,registered_via,registration_init_time\n")
        f.write("a,1,30,male,7,20160105\nb,2,,,,20161399\n")
    got = {r["msno"]: r for r in rows(io.read_retention_csv(spark, p, "members"))}
    assert got["a"]["registration_init_time"] == dt.date(2016, 1, 5)
    assert got["b"]["registration_init_time"] is None and got["b"]["gender"] is None


def _decompose_numpy(x, m):
    """Additive decomposition by the textbook definition (centred MA, phase means)."""
    n, h = len(x), m // 2
    trend = np.full(n, np.nan)
    if m % 2 == 0:
        w = np.r_[0.5, np.ones(m - 1), 0.5] / m
    else:
        w = np.ones(m) / m
    for t in range(h, n - h):
        trend[t] = float(np.dot(w, x[t - h:t + h + 1]))
    det = x - trend
    phase = np.array([np.nanmean(det[p::m]) for p in range(m)])
    phase -= phase.mean()
    seasonal = np.array([phase[t % m] for t in range(n)])
    return trend, seasonal, x - trend - seasonal


def test_decomposition_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, size=30).astype(float)
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=t), t, float(v))
                                for t, v in enumerate(x)], "msno long, date date, t int, num_25 double")
    for m in (6, 7):
        trend, seasonal, resid = _decompose_numpy(x, m)
        got = sorted(TS.seasonal_decompose(df, m).collect(), key=lambda r: r.t)
        for r in got:
            if np.isnan(trend[r.t]):
                assert r.trend is None and r.resid is None
            else:
                assert math.isclose(r.trend, trend[r.t], abs_tol=1e-9)
                assert math.isclose(r.resid, resid[r.t], abs_tol=1e-9)
            assert math.isclose(r.seasonal, seasonal[r.t], abs_tol=1e-9)


def test_adf_lag0_agrees_with_regr_aggregates(spark, sf_dir):
    series = TS.daily_series(Tables(spark, sf_dir).user_logs, LOG_FIRST_DAY, 30)
    adf = {r.msno: r for r in TS.unit_root_adf(series).collect()}
    lag0 = {r.msno: r for r in TS.unit_root_lag0(series).collect()}
    checked = 0
    for k, r in adf.items():
        if r.used_lag == 0 and r.adf_stat is not None and lag0[k].adf_stat is not None:
            assert math.isclose(r.adf_stat, lag0[k].adf_stat, rel_tol=1e-7)
            assert r.nobs == lag0[k].nobs
            checked += 1
    assert checked > 0
