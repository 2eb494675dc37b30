"""Operators against brute force on small generated fixtures."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vendorlytics.operators.allocation import allocate
from vendorlytics.operators.conditional_distinct import conditional_distinct_counts
from vendorlytics.operators.heavy import heavy_keys, left_join_apart
from vendorlytics.operators.live_periods import expand_months, running_live
from vendorlytics.operators.locf import locf
from vendorlytics.operators.union import union_distinct
from vendorlytics.operators.working_days import working_days

from conftest import rows

D0 = dt.date(2023, 1, 1)


def test_working_days_equals_band_join(spark):
    rnd = random.Random(7)
    cal = []
    for i in range(60):
        d = D0 + dt.timedelta(days=i)
        if i % 11 == 5:
            continue  # a gap in the calendar counts as non-working
        cal.append((d, 1 if d.day in (1, 15) else 0, d.isoweekday()))
    if True:
        cal.append((D0 + dt.timedelta(days=3), 0, 3))  # duplicate date row
    intervals = []
    for k in range(40):
        key = None if k == 39 else f"t{k % 25}"
        for _ in range(rnd.randint(1, 4)):
            s = D0 + dt.timedelta(days=rnd.randint(-5, 62))
            e = s + dt.timedelta(days=rnd.randint(-1, 9))
            intervals.append((key, s, e if rnd.random() > 0.05 else None))
    intervals.append(("holiday", dt.date(2023, 1, 15), dt.date(2023, 1, 15)))  # nothing counted -> absent
    cdf = spark.createDataFrame(cal, "dt date, holiday_flag int, day int")
    idf = spark.createDataFrame(intervals, "k string, s date, e date")
    got = working_days(idf, "k", "s", "e", cdf, "dt", (F.col("holiday_flag") == 0) & (F.col("day") != 7), "n")

    working = {}
    for d, h, wd in cal:
        working[d] = working.get(d, False) or (h == 0 and wd != 7)
    want = {}
    for key, s, e in intervals:
        if s is None or e is None:
            continue
        days = want.setdefault(key, set())
        d = s
        while d <= e:
            if working.get(d):
                days.add(d)
            d += dt.timedelta(days=1)
    expected = sorted(((k, len(v)) for k, v in want.items() if v), key=lambda t: (t[0] is None, str(t[0])))
    assert rows(got, "k", "n") == expected


def test_conditional_distinct_equals_direct(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(12)]), rnd.choice(["x", "y", None]),
             rnd.randint(0, 9)) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, id int, s string, v int")
    got = conditional_distinct_counts(df, ["g"], "id", {"nx": F.col("s") == "x", "ny": F.col("s") == "y"},
                                      sums={"tv": F.col("v")}, avgs={"av": F.col("v")}, distinct_name="n")
    direct = df.groupBy("g").agg(
        F.count_distinct(F.when(F.col("s") == "x", F.col("id"))).alias("nx"),
        F.count_distinct(F.when(F.col("s") == "y", F.col("id"))).alias("ny"),
        F.sum("v").alias("tv"), F.avg("v").alias("av"), F.count_distinct("id").alias("n"))
    cols = ("g", "nx", "ny", "tv", "n")
    assert rows(got, *cols) == rows(direct, *cols)
    a = {r["g"]: r["av"] for r in got.collect()}
    b = {r["g"]: r["av"] for r in direct.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_two_level_locf_equals_single_window(spark):
    rnd = random.Random(11)
    vals = []
    for pos in range(500):
        r = rnd.random()
        vals.append((pos * 3, None if r < 0.7 else f"v{pos}"))
    vals[0] = (0, None)  # leading NULL stays NULL
    df = spark.createDataFrame(vals, "pos long, t string")
    got = locf(df, "pos", "t", block_size=17)
    single = df.withColumn("t", F.last("t", ignorenulls=True).over(
        Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got, "pos", "t") == rows(single, "pos", "t")


def test_allocation_marks_first_rows_in_status_order(spark):
    data = [("o1", "s", 1, "a"), ("o1", "s", 0, "b"), ("o1", "s", -1, "c"), ("o1", "s", 1, "d"),
            ("o2", "s", 1, "e"), (None, "s", 1, "f"), ("o3", "s", 0, "g")]
    df = spark.createDataFrame(data, "o string, k string, code int, id string")
    claims = spark.createDataFrame([("o1", "s", 2), ("o2", "s", 5), (None, "s", 1)], "o string, k string, q long")
    got = allocate(df, claims, ["o", "k"], "code", "q", ["id"], "out")
    assert rows(got, "id", "out") == [("a", 1), ("b", -1), ("c", -1), ("d", 1), ("e", -1), ("f", 1), ("g", 0)]


def test_month_expansion_equals_theta_join(spark):
    items = spark.createDataFrame([("a", "2022-11"), ("b", "2023-05"), ("c", None), ("d", "2023-09"),
                                   ("e", "2021-01"), ("f", ""), ("g", "2023")], "sku string, start string")
    months = spark.createDataFrame([(m,) for m in ("2022-10", "2022-12", "2023-01", "2023-03", "2023-06",
                                                   "2023-07", None)], "m string")
    got = expand_months(items, "start", months, "m", "2023-06", "month")
    theta = (items.join(months, F.col("start") <= F.col("m"))
             .where((F.col("m") <= "2023-06") & F.col("m").isNotNull()).select("sku", F.col("m").alias("month")))
    assert rows(got, "sku", "month") == rows(theta, "sku", "month")


def test_union_distinct_by_position_with_cast(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "awb long, o string")
    b = spark.createDataFrame([("1", "x"), ("2", None)], "awb_text string, order_no string")
    got = union_distinct([a, b], ["AWB", "OrderNo"], ["string", "string"])
    assert rows(got) == [("1", "x"), ("2", None)]


def test_locf_in_levels_equals_single_window(spark):
    rnd = random.Random(4)
    data = [(p, rnd.choice([None, None, None, None, f"v{p}"])) for p in range(2000) if rnd.random() < 0.7]
    data = [(p, None if p < 40 or 900 < p < 1500 else v) for p, v in data]  # whole blocks and groups without a value
    df = spark.createDataFrame(data, "pos long, t string").repartition(5)
    want, last = [], None
    for p, v in sorted(data):
        last = v if v is not None else last
        want.append((p, last))
    # Blocks of 3 rows, summaries of 5: 2000 positions need three levels above the rows and more.
    for levels in (5, 6):
        got = sorted((r.pos, r.t) for r in locf(df, "pos", "t", block_size=3, fan_out=5, levels=levels).collect())
        assert got == want
    plan = locf(df, "pos", "t")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_locf_beyond_its_levels_is_an_error(spark):
    df = spark.createDataFrame([(0, "a"), (30, None)], "pos long, t string")
    assert locf(df, "pos", "t", block_size=3, fan_out=11, levels=1).count() == 2
    with pytest.raises(Exception, match="position beyond"):
        locf(df, "pos", "t", block_size=3, fan_out=10, levels=1).collect()


def live_fixture(spark):
    rnd = random.Random(9)
    months = ["2023-01", "2023-02", "2023-04", "2023-05", "2023-06", "2023-08"]  # gaps
    items = [(rnd.choice(["a", "b", None]), rnd.choice([None, *(f"s{i}" for i in range(12))]),
              rnd.choice([None, "", "2022-11", "2023-02", "2023-03", "2023-06", "2023-07", "2023-09", "zz"]),
              rnd.choice([None, Decimal("1.50"), Decimal("2.25")])) for _ in range(120)]
    sold = [(m, s, rnd.choice([None, 1, 5]), Decimal(rnd.randrange(400)) / 4) for m in [*months, "2023-03", None]
            for s in [*(f"s{i}" for i in range(0, 12, 2)), None]]
    return (spark.createDataFrame(items, "g string, sku string, start string, price decimal(24,6)"), items,
            spark.createDataFrame([(m,) for m in [*months, months[0], None]], "m string"), months,
            spark.createDataFrame(sold, "month string, id string, units long, lp decimal(38,6)"), sold)


def test_running_live_equals_the_theta_join(spark):
    items, item_rows, months, month_list, sold, sold_rows = live_fixture(spark)
    got = running_live(items, "start", months, "m", "2023-06", "month", ["g"], "sku", "skus", {"avg": "price"},
                       sold, "month", "id", {"units": "units", "value": "lp"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    by_key = {(m, s): (u, v) for m, s, u, v in sold_rows if m and s}
    want = {}
    for g, sku, start, price in item_rows:
        for m in month_list:
            if start is not None and start <= m <= "2023-06":
                ids, prices, total = want.setdefault((g, m), (set(), [], [0, 0]))
                ids.update({sku} - {None})
                prices += [price] if price is not None else []
                units, value = by_key.get((m, sku), (None, None))
                total[0] += units or 0
                total[1] += value or 0
    want = {k: (len(ids), float(sum(ps)) / len(ps) if ps else None, *total) for k, (ids, ps, total) in want.items()}
    assert {(r.g, r.month): (r.skus, r.avg, r.units, r.value) for r in got.collect()} == want


def test_expand_months_compares_text_without_a_nested_loop(spark):
    items, item_rows, months, month_list, _, _ = live_fixture(spark)
    got = expand_months(items, "start", months, "m", "2023-06", "month")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = Counter((g, s, b, m) for g, s, b, _ in item_rows for m in month_list if b is not None and b <= m <= "2023-06")
    assert Counter((r.g, r.sku, r.start, r.month) for r in got.collect()) == want


def hot_lines(spark, n=3000):
    """Lines of which a third has no order and a third one order."""
    rnd = random.Random(2)
    data = [(rnd.choice([None, "hot", f"o{rnd.randrange(300)}"]), rnd.choice([None, "a", "b", "c"]), rnd.choice([-1, 0, 1]),
             f"i{i}", i % 7) for i in range(n)]
    claims = [("hot", "a", 40), ("hot", "b", 5), ("hot", "zz", 1), (None, "a", 9), ("o1", None, 9),
              *((f"o{i}", s, rnd.randrange(1, 4)) for i in range(0, 300, 3) for s in "ab")]
    return (spark.createDataFrame(data, "o string, k string, code int, id string, v int").repartition(6),
            spark.createDataFrame(claims, "o string, k string, q long"), data, claims)


def plain_allocation(data, claims):
    want, groups, totals = {}, {}, Counter()
    for o, k, code, i, v in data:
        groups.setdefault((o, k), []).append((code, i))
        if o is not None:
            totals[o] += v
    quantity = {(o, k): q for o, k, q in claims if o is not None and k is not None}
    for key, lines in groups.items():
        for n, (code, i) in enumerate(sorted(lines)):
            want[i] = -1 if n < quantity.get(key, 0) else code
    return want, totals


@pytest.mark.parametrize("heavy", [(), ("hot", "o1")])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_allocation_and_totals_on_one_exchange(spark, heavy, broadcast):
    rows, claims, data, claim_rows = hot_lines(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = allocate(rows, claims, ["o", "k"], "code", "q", ["id"], "out", totals={"t": F.sum("v")}, heavy=heavy, keep_salt=True)
        grouped = got.groupBy("o", "id", "out", "t", "_salt").agg(F.sum("v").alias("v"))
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        out = {r.id: (r.out, r.t) for r in grouped.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want, totals = plain_allocation(data, claim_rows)
    assert out == {i: (want[i], totals[o] if o is not None else None) for o, _, _, i, _ in data}
    if not heavy:  # the lines are exchanged once: by order, for claims, ranks, totals and the grouping
        assert plan.count("REPARTITION_BY_COL") == 1
        above = plan[:plan.index("Join")]
        assert "Window" in above and "Aggregate" in above and "Exchange" not in above
        assert plan.count("Exchange hashpartitioning") <= 3  # the lines' and the claims' two


@pytest.mark.parametrize("heavy", [(), ("hot", "o1")])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_allocation_in_parts(spark, heavy, broadcast):
    """Rows with a group, without one and of heavy groups as a list; the first is grouped where it stands."""
    rows, claims, data, claim_rows = hot_lines(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        parts = allocate(rows, claims, ["o", "k"], "code", "q", ["id"], "out", totals={"t": F.sum("v")}, heavy=heavy,
                         keep_salt=True, parts=True)
        plan = parts[0].groupBy("o", "id", "out", "t", "_salt").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
        collected = [[tuple(r) for r in x.select("id", "out", "t", "o").collect()] for x in parts]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want, totals = plain_allocation(data, claim_rows)
    assert sorted(r[:3] for part in collected for r in part) == sorted(
        (i, want[i], totals[o] if o is not None else None) for o, _, _, i, _ in data)
    assert len(parts) == 2 + bool(heavy) and all(r[3] is None for r in collected[1])
    assert "Exchange" not in plan[:plan.index("Window")]


@pytest.mark.parametrize("heavy", [(), ("hot", "none such")])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_join_apart_equals_the_plain_join(spark, heavy, broadcast):
    rows, _, _, _ = hot_lines(spark)
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("o1", 4), ("o2", None)], "o string, d int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = left_join_apart(rows, dim, "o", ["id"], heavy, spread=8)
        plan = got._jdf.queryExecution().executedPlan().toString()
        have, want = Counter(map(tuple, got.select("id", "o", "d").collect())), Counter(map(tuple, rows.join(dim, "o", "left").select("id", "o", "d").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert have == want
    assert ("Generate explode" in plan) == bool(heavy)
    if broadcast == "-1":
        assert all("_salt" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_heavy_keys_names_keys_above_the_share(spark):
    rows, _, _, _ = hot_lines(spark)
    found = heavy_keys(rows, ["o", "k"], share=0.2)
    assert found["o"] == ["hot"] and sorted(found["k"]) == ["a", "b", "c"]
    assert heavy_keys(rows.limit(0), ["o"]) == {"o": []}
