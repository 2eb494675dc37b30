"""Rows left out before an exchange, and exchanges that branches share."""

import random

import pytest
from pyspark.sql import functions as F

from vendorlytics.operators import prefilter
from vendorlytics.operators.shared import shared
from vendorlytics.plans import scorecard

from conftest import rows


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_no_match_is_lost_and_others_go(spark, bits, monkeypatch):
    monkeypatch.setattr(prefilter, "BITS", bits)
    r = random.Random(3)
    left = spark.createDataFrame([(r.choice([None, f"k{i % 900}"]), i) for i in range(3000)], "k string, `a b` int")
    keys = [f"k{i}" for i in range(100, 130)] * 2 + [None, "other"]
    kept = spark.createDataFrame([(k, 1) for k in keys], "k string, x int")
    got = prefilter.may_match(left, "k", kept)
    assert got.columns == left.columns
    want = rows(left.join(kept.select("k").distinct(), "k", "left_semi"))
    assert rows(got.join(kept.select("k").distinct(), "k", "left_semi")) == want
    assert got.count() < (left.count() if bits == 64 else len(want) + 5)
    assert prefilter.may_match(left, "k", kept.where("false")).count() == 0


def test_branches_share_the_exchanges_below(spark):
    """Two readers of different columns: the grouping's exchange is planned once (before: once for each)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
        plans = []
        for wrap in (shared, lambda df: df):
            table = wrap(lines.groupBy("g").agg(F.sum("v").alias("v"), F.sum("w").alias("w")))
            both = table.select("g", "v").join(table.select("g", "w").withColumnRenamed("g", "h"), F.col("g") == F.col("h"))
            assert [tuple(x) for x in both.select("g", "v", "w").orderBy("g").collect()] == rows(lines.groupBy("g").agg(F.sum("v"), F.sum("w")))
            plans.append(both._jdf.queryExecution().executedPlan().toString())
        assert "ReusedExchange" in plans[0] and "ReusedExchange" not in plans[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_column_beside_keeps_the_dealing(spark):
    """Rows that stand by a column still do behind ``shared``, and both readers have the join's two exchanges (before:
    each reader of other columns had its own)."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        left = spark.range(500).select((F.col("id") % 50).cast("string").alias("o"), "id", (F.col("id") + 1).alias("v"))
        right = spark.range(50).select(F.col("id").cast("string").alias("o"), (F.col("id") * 3).alias("w"))
        lines = shared(left.join(right, "o"), "o")
        assert lines.columns == ["o", "id", "v", "w"]
        both = lines.groupBy("o").agg(F.sum("v").alias("v")).join(lines.groupBy("o").agg(F.max("w").alias("w")), "o")
        assert rows(both) == rows(left.join(right, "o").groupBy("o").agg(F.sum("v").alias("v"), F.max("w").alias("w")))
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("- Exchange hashpartitioning") + plan.count("ReusedExchange") == 4 and plan.count("ReusedExchange") == 2


def _tables(spark):
    """Two orders a day over three months; NULL and repeated ids in every link table."""
    r = random.Random(4)
    orders = [(i, f"2023-{i % 3 + 9:02d}-{i % 28 + 1:02d} 10:00:00", f"n{i}", r.choice(["cancelled", "completed"]), None) for i in range(90)]
    orders += [(None, "2023-10-05 10:00:00", "none", "completed", None), (2, "2023-10-06 10:00:00", "again", "completed", None)]
    items = [(f"i{k}", r.choice([None, r.randrange(95)]), r.randrange(9), 10, 1 + k % 3, 7) for k in range(400)] + [(None, 1, 1, 5, 1, 2)]
    link = lambda p: [(r.choice([None, f"i{r.randrange(420)}"]), r.choice([None, f"{p}{r.randrange(200)}"])) for _ in range(500)]
    t = {"orders": (orders, "id long, created_at string, order_number string, status string, deleted_at string"),
         "order_items": (items, "id string, order_id long, product_variant_id long, variant_price int, quantity int, variant_inventory_cost_price int"),
         "product_variants": ([(i, i // 2, f"s{i}", 3, None) for i in range(8)], "id long, product_id long, sku string, inventory_quantity int, deleted_at string"),
         "products": ([(i, i % 3, "x", None) for i in range(4)], "id long, supplier_id long, published_at string, deleted_at string"),
         "suppliers": ([(i, f"v{i}", None) for i in range(3)], "id long, display_name string, deleted_at string"),
         "return_items": (link("r"), "order_item_id string, return_id string"),
         "returns": ([(r.choice([None, f"r{i % 190}"]), r.choice([None, True, False]), "why", r.choice(["RETURNED_TO_ORIGIN", "x"])) for i in range(210)],
                     "id string, manufacturer_mistake boolean, reason string, shipment_tracking_status string"),
         "shipping_order_items": (link("p"), "order_item_id string, shipping_package_id string"),
         "shipping_packages": ([(r.choice([None, f"p{i % 190}"]), "2023-10-08 10:00:00", f"t{i}", "delivered") for i in range(210)],
                               "id string, dispatched_at string, tracking_number string, courier_status string")}
    out = {n: spark.createDataFrame(*x) for n, x in t.items()}
    for n, c in (("orders", "created_at"), ("shipping_packages", "dispatched_at")):
        out[n] = out[n].withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out


@pytest.mark.parametrize("dedupe", [False, True])
def test_extract_with_and_without_the_prefilter(spark, dedupe, monkeypatch):
    """The plain joins' rows, with the exchanges of items and links after the filter (before: whole tables)."""
    t = _tables(spark)
    p = scorecard.P.ScorecardParams(month_from="2023-10", month_to="2023-10")
    tables = [t[n] for n in ("orders", "order_items", "product_variants", "products", "suppliers", "return_items", "returns",
                             "shipping_order_items", "shipping_packages")]
    extract = scorecard.order_extract(*tables, p, dedupe_items=dedupe)
    assert extract._jdf.queryExecution().optimizedPlan().toString().count("bitmap_construct_agg") >= 5
    got = rows(extract)
    monkeypatch.setattr(scorecard, "may_match", lambda df, key, kept: df)
    assert got == rows(scorecard.order_extract(*tables, p, dedupe_items=dedupe)) and len(got) > 50
