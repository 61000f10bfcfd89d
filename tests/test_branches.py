"""Hand-made rows for branches the synthetic tables do not reach (FIXTURES.md §4)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tenure.functions.bins import equal_width_bin, explicit_bin
from tenure.operators import eda as D
from tenure.operators import intervals as I
from tenure.operators import logs as L
from tenure.operators import members as M
from tenure.operators import transactions as X

from conftest import rows

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


TX_SCHEMA = ("msno long, payment_method_id int, payment_plan_days int, plan_list_price double, "
             "actual_amount_paid double, is_auto_renew int, transaction_date date, "
             "membership_expire_date date, is_cancel int, seq1 long, seq2 int")
LOG_SCHEMA = ("msno long, date date, num_25 long, num_50 long, num_75 long, num_985 long, "
              "num_100 long, num_unq long, total_secs double")


def tx_rows(spark, data):
    return spark.createDataFrame(data, TX_SCHEMA)


def log_rows(spark, data):
    return spark.createDataFrame(data, LOG_SCHEMA)


def test_single_transaction_and_negative_days_left(spark):
    t = tx_rows(spark, [
        (1, 3, 30, 10.0, 10.0, 1, day(10), day(5), 1, 1, 1),     # expiry before purchase
    ])
    p = rows(X.tx_profile(t))[0]
    assert (p["upgrades"], p["downgrades"], p["consistent"]) == (0.0, 1.0, 0.0)
    # (datediff(expire, tx) + 1) / (plan + 1) = (-5 + 1) / 31
    assert math.isclose(p["percent_time_left_when_cancelled"], -4 / 31)
    assert p["cancelled_counts"] == 1 and p["is_cancel"] == 1


def test_no_cancels_gives_zero_and_mode_ties_smallest(spark):
    t = tx_rows(spark, [
        (2, 7, 30, 1.0, 1.0, 0, day(1), day(30), 0, 1, 1),
        (2, 5, 90, 1.0, 1.0, 0, day(2), day(30), 0, 2, 1),
        (2, 7, 90, 1.0, 1.0, 0, day(3), day(30), 0, 3, 1),
        (2, 5, 30, 1.0, 1.0, 0, day(4), day(30), 0, 4, 1),
    ])
    p = rows(X.tx_profile(t))[0]
    assert p["cancelled_counts"] == 0 and p["percent_time_left_when_cancelled"] == 0.0
    assert p["frequent_payment_method"] == 5 and p["frequent_payment_plan"] == 30
    # plans 30 -> 90 -> 90 -> 30: one up, one same, one down
    assert (p["upgrades"], p["downgrades"], p["consistent"]) == (1 / 3, 1 / 3, 1 / 3)


def test_plan_changes_across_many_buckets_equal_plain_lag(spark):
    # one hot user spread over ~40 buckets plus a few small users
    data = []
    plans = [30, 90, 30, 30, 7, 410, 410, 30]
    for i in range(400):
        data.append((1, 1, plans[i % len(plans)] + (i % 3), 1.0, 1.0, 0, day(3 * i), day(3 * i + 30), 0, i, 1))
    for u in range(2, 6):
        for i in range(5):
            data.append((u, 1, 10 * ((i * u) % 4), 1.0, 1.0, 0, day(50 * i), day(50 * i), 0, i, 1))
    t = tx_rows(spark, data)
    got = {r["msno"]: r for r in rows(X.plan_change_shares(t))}
    for days in (1, 30, 10_000):
        assert got == {r["msno"]: r for r in rows(X.plan_change_shares(t, bucket_days=days))}
    from pyspark.sql import Window
    w = Window.partitionBy("msno").orderBy(*X.TX_ORDER)
    ref = (t.withColumn("prev", F.lag("payment_plan_days").over(w)).groupBy("msno")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("payment_plan_days") > F.col("prev")).alias("up"),
                 F.count_if(F.col("payment_plan_days") < F.col("prev")).alias("down")))
    for r in rows(ref):
        g = got[r["msno"]]
        assert math.isclose(g["upgrades"], r["up"] / (r["n"] - 1))
        assert math.isclose(g["downgrades"], r["down"] / (r["n"] - 1))
        assert math.isclose(g["upgrades"] + g["downgrades"] + g["consistent"], 1.0)


def test_z_boundary_branches(spark):
    bounds = spark.createDataFrame(
        [(1, day(0), day(5)), (2, day(0), day(5)), (3, day(3), day(5)), (4, day(0), day(5)),
         (5, day(0), day(5))],
        "msno long, first_transaction_date date, last_transaction_date date")
    logs = log_rows(spark, [
        (1, day(2), 1, 1, 1, 1, 1, 1, 1.0),        # user 1: nothing after day 5 -> 5
        (2, day(9), 1, 1, 1, 1, 1, 1, 1.0),        # user 2: after only -> hist empty -> 1
        (3, day(1), 1, 1, 1, 1, 1, 1, 1.0),        # user 3: before the first tx (not hist)
        (3, day(7), 2, 1, 1, 1, 1, 1, 1.0),
        (4, day(1), 3, 1, 1, 1, 1, 1, 1.0),        # user 4: one hist row -> std NULL -> 0
        (4, day(8), 5, 1, 1, 1, 1, 1, 1.0),
        (5, day(1), 2, 1, 1, 1, 1, 1, 1.0),        # user 5: std 0, means differ -> inf -> 5
        (5, day(2), 2, 1, 1, 1, 1, 1, 1.0),
        (5, day(9), 4, 1, 1, 1, 1, 1, 1.0),
    ])
    z = {r["msno"]: r for r in rows(L.z_boundary(bounds, logs))}
    assert z[1]["status"] == "cur_empty" and z[1]["z_25"] == 5.0
    assert z[2]["status"] == "hist_empty" and z[2]["z_secs"] == 1.0
    assert z[3]["status"] == "hist_empty"
    assert z[4]["status"] == "std_null" and z[4]["z_25"] == 0.0
    assert z[5]["z_25"] == 5.0 and z[5]["z_50"] == 0.0   # inf -> 5; NaN (0/0) -> 0
    assert z[5]["status"] == "std_zero"
    open_ = {r["msno"]: r for r in rows(L.z_boundary(bounds, logs, lower_bound=False, inf_value=10.0))}
    assert open_[3]["status"] == "std_null" and open_[5]["z_25"] == 10.0


def test_z_trailing_branches(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "msno long")
    last = day(29)
    logs = log_rows(spark, [
        (2, day(10), 1, 1, 1, 1, 1, 1, 2.0),       # only in the long window -> current empty -> 3
        (3, day(10), 1, 1, 1, 1, 1, 1, 2.0),
        (3, day(28), 3, 1, 1, 1, 1, 1, 6.0),
    ])
    z = {r["msno"]: r for r in rows(L.z_trailing(users, logs, last, 30, 14, "3014"))}
    assert z[1]["z_25_3014"] == 5.0 and z[1]["z_secs_3014"] == 1.0 and z[1]["status"] == "hist_empty"
    assert z[2]["z_25_3014"] == 3.0 and z[2]["status"] == "cur_empty"
    # user 3: hist mean 2, std sqrt(2); current mean 3 -> z = 1/sqrt(2)
    assert math.isclose(z[3]["z_25_3014"], 1 / math.sqrt(2))


def test_login_diff_uses_own_last_day(spark):
    logs = log_rows(spark, [(1, day(d), 1, 1, 1, 1, 1, 1, 1.0) for d in (0, 10, 20, 25, 29)])
    r = rows(L.login_diff(logs))[0]
    # end = day 29: last 30 days hold 5 rows, last 14 days hold 3 rows
    assert math.isclose(r["login_diff_3014"], 5 / 30 - 3 / 14)
    assert math.isclose(r["login_diff_147"], 3 / 14 - 2 / 7)


def test_interval_open_ends_and_empty_interval(spark):
    t = spark.createDataFrame([(1, 10, day(2), day(6)), (1, 11, day(6), day(7)), (2, 12, day(0), day(9))],
                              "msno long, tx_id long, transaction_date date, membership_expire_date date")
    logs = log_rows(spark, [(1, day(d), d, 0, 0, 0, 0, 0, float(d)) for d in range(0, 10)])
    got = {r["tx_id"]: r for r in rows(I.interval_log_means(t, logs))}
    assert got[10]["num_25"] == 4.0            # days 3, 4, 5 only
    assert got[11]["num_25"] is None           # (6, 7) holds no day
    assert got[12]["num_25"] is None           # user without logs
    fm = rows(I.first_model_rows(t, logs))
    assert [r["tx_id"] for r in fm] == [10]


def test_interval_means_match_brute_force_on_stacked_hot_user(spark):
    # User 1 holds most transactions, many on the same day with overlapping
    # intervals; one reversed and one empty interval; a NULL metric value.
    import random
    rnd = random.Random(7)
    tx = [(1, 100 + i, day(rnd.randrange(0, 40)), day(rnd.randrange(0, 60))) for i in range(300)]
    tx += [(1, 1, day(5), day(5)), (1, 2, day(9), day(3)), (2, 3, day(1), day(30)), (3, 4, day(1), day(9))]
    t = spark.createDataFrame(tx, "msno long, tx_id long, transaction_date date, "
                                  "membership_expire_date date")
    log_data = [(1, day(d), d, 1, 2, 3, 4, d % 5, None if d == 12 else d * 1.37) for d in range(0, 50)]
    log_data += [(2, day(d), 2 * d, 0, 0, 0, 0, 1, 0.01 * d) for d in range(3, 20, 2)]
    logs = log_rows(spark, log_data)
    expect = {}
    for u, k, lo, hi in tx:
        inside = [r for r in log_data if r[0] == u and lo < r[1] < hi]
        means = []
        for j in range(2, 9):
            vals = [r[j] for r in inside if r[j] is not None]
            means.append(sum(vals) / len(vals) if vals else None)
        expect[k] = means
    got = {r["tx_id"]: r for r in rows(I.interval_log_means(t, logs))}
    assert got.keys() == expect.keys()
    for k, means in expect.items():
        for m, e in zip(["num_25", "num_50", "num_75", "num_985", "num_100", "num_unq",
                         "total_secs"], means):
            g = got[k][m]
            assert (g is None and e is None) or math.isclose(g, e, rel_tol=1e-12), (k, m)


def test_interval_means_keep_odd_values_in_their_own_intervals(spark):
    inf, nan = float("inf"), float("nan")
    t = spark.createDataFrame(
        [(1, 1, day(0), day(3)), (1, 2, day(0), day(5)), (1, 3, day(3), day(7)), (1, 4, day(2), day(20)),
         (1, 5, day(40), day(90)), (1, 6, None, day(9)), (1, 7, day(2), None), (None, 8, day(0), day(9)),
         (1, 9, day(-30), day(2)), (1, 9, day(-30), day(2))],
        "msno long, tx_id long, transaction_date date, membership_expire_date date")
    value = {1: 2.0, 2: 4.0, 4: inf, 6: -inf, 15: nan, 60: 8.0}
    logs = log_rows(spark, [(1, day(d), 1, 0, 0, 0, 0, 0, v) for d, v in value.items()]
                    + [(None, day(1), 1, 0, 0, 0, 0, 0, 1.0)])
    got = rows(I.interval_log_means(t, logs, carry=["transaction_date"]))
    assert len(got) == 10 and "transaction_date" in got[0]
    secs = {r["tx_id"]: r["total_secs"] for r in got}
    assert secs[1] == 3.0 and secs[2] == inf and math.isnan(secs[3]) and math.isnan(secs[4])
    assert secs[5] == 8.0 and secs[9] == 2.0 and secs[6] is secs[7] is secs[8] is None


def test_interval_lookups_join_two_rows_a_transaction(spark):
    """Long intervals of one user: nothing is joined but the transactions' own two look-ups."""
    t = spark.range(400).selectExpr("1L AS msno", "id AS tx_id", "date'2017-01-01' AS transaction_date",
                                    "date_add(date'2017-01-01', 300 + cast(id % 50 as int)) AS membership_expire_date")
    logs = log_rows(spark, [(1, day(d), 1, 0, 0, 0, 0, 0, 1.0) for d in range(300)])
    plan = I.interval_log_means(t, logs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "Join Inner" not in plan
    points = t.select("msno", F.lit(day(9)).alias("date"))
    assert [(r.num_25, r.total_secs) for r in I.running_sums(logs, points).collect()] == [(10, 10.0)]


def test_member_cleaning(spark):
    m = spark.createDataFrame([(1, 1, 0, None, 3, 20160101), (2, 1, 95, "male", 3, 20160230),
                               (3, 1, 40, "female", 3, 20150228)],
                              "msno long, city int, bd int, gender string, registered_via int, "
                              "registration_init_time int")
    got = {r["msno"]: r for r in rows(M.member_clean(m, dt.date(2017, 2, 28)))}
    assert got[1]["bd"] == 26 and got[1]["gender"] == "Not_given"
    assert got[2]["bd"] == 26 and got[2]["registration_date"] is None   # dirty date -> NULL
    assert got[3]["associated_time"] == 731


def test_bins_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (1.0,)], "v double")
    b, lo, hi = equal_width_bin(df, "v", 5)
    got = [r[0] for r in df.select(b).orderBy("v").collect()]
    assert got == [1, 1, 2, 5]                 # min in bin 1; 0.2 on an edge -> right-closed
    const = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    b2, _, _ = equal_width_bin(const, "v", 10)
    assert {r[0] for r in const.select(b2).collect()} == {5}
    ages = spark.createDataFrame([(0,), (12,), (13,), (80,), (81,)], "bd int")
    got = [r[0] for r in ages.select(explicit_bin("bd", D.AGE_EDGES)).collect()]
    assert got == [None, 1, 2, 6, None]


def test_zero_totals_and_missing_labels(spark):
    logs = log_rows(spark, [(1, day(0), 0, 0, 0, 0, 0, 0, 0.0), (1, day(1), 2, 0, 0, 0, 2, 3, 1.0),
                            (9, day(0), 1, 0, 0, 0, 1, 1, 1.0)])
    train = spark.createDataFrame([(1, 1)], "msno long, is_churn int")
    r = rows(D.repeat_listening(logs, train))
    assert len(r) == 1 and r[0]["is_churn"] == 1          # user 9 has no label: dropped
    assert math.isclose(r[0]["mean_of_mean"], 0.25)       # 0/0 skipped; (4-3)/4
    tx = tx_rows(spark, [(1, 1, 30, 10.0, 5.0, 0, day(0), day(30), 0, 1, 1),
                         (1, 1, 30, 10.0, 10.0, 0, day(1), day(30), 0, 2, 1),
                         (7, 1, 30, 10.0, 5.0, 0, day(1), day(30), 0, 3, 1)])   # 7: no label
    dc = rows(D.discount_churn(tx, train))
    assert dc == [{"no_discount_transactions": 1, "n_retained": 0, "n_churned": 1, "churn_rate": 100.0}]


def test_histogram_numpy_rules(spark):
    vals = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,), (3.5,), (-1.0,)], "r double")
    edges = spark.createDataFrame([(0,), (1,), (3,)], "e int")
    got = rows(D.rate_histogram(vals, "r", edges, "e"), ["bin"])
    assert [(g["bin"], g["n"]) for g in got] == [(1, 1), (2, 3)]   # 3.0 in the closed last bin


def test_user_rows_lookup_ordered_head(spark, sf_dir):
    from tenure.operators.universe import user_rows
    from tenure.sources.fixtures import Tables
    tx = Tables(spark, sf_dir).tx
    some = tx.select("msno").first()["msno"]
    got = user_rows(tx, some, X.TX_ORDER, n=3).collect()
    allr = user_rows(tx, some, X.TX_ORDER).collect()
    assert 0 < len(got) <= 3 and got == allr[:len(got)]
    keys = [tuple(r[c] for c in X.TX_ORDER) for r in allr]
    assert keys == sorted(keys) and {r["msno"] for r in allr} == {some}
