import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vendorlytics.sources import readers, schemas, sinks


def test_conform_casts_and_requires_columns(spark):
    df = spark.createDataFrame([("1", "x", "2", "Wrong Dispatch", "extra")], "order_number string, sku string, "
                               "qnt string, `vv reason` string, z string").toDF(
        "Order Number", "SKU", "QNT", "VV Reason", "z")
    out = readers.conform(df, schemas.RETURNS)
    assert out.columns == ["Order Number", "SKU", "QNT", "VV Reason"]
    assert dict(out.dtypes)["QNT"] == "bigint"
    with pytest.raises(ValueError):
        readers.conform(df.drop("SKU"), schemas.RETURNS)


def test_tsv_export_header_and_empty_nulls(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="vl-test-"), "card")
    sinks.write_tsv(spark.createDataFrame([("V1", None, 2)], "display_name string, lp double, s int"), out,
                    single_file=True)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert text.splitlines() == ["display_name\tlp\ts", "V1\t\t2"]


def test_sales_sheet_rename_by_header(spark):
    base = tempfile.mkdtemp(prefix="vl-test-")
    header = [src for src, _ in schemas.SALES_SHEET_COLUMNS]
    types = {f.name: f.dataType.simpleString() for f in schemas.SALES_ITEMS.fields}
    sample = {"string": "x", "int": "1", "bigint": "1", "timestamp": "2023-06-01 10:00:00"}
    values = [sample.get(types.get(dst, "string"), "1.5") for _, dst in schemas.SALES_SHEET_COLUMNS]
    values[header.index("Packet Number")] = "3"
    values[header.index("Item Type EAN")] = "12.50"
    values[header.index("Order Date as dd/mm/yyyy hh:MM:ss")] = "02/06/2023 10:30:00"
    path = os.path.join(base, "sales.csv")
    with open(path, "w") as fh:
        fh.write(",".join(f'"{h}"' for h in header) + "\n" + ",".join(values) + "\n")
    df = readers.read_sales_sheet(spark, path)
    r = df.collect()[0]
    assert r["UnitsSold"] == 3 and float(r["ListingPrice"]) == 12.5
    assert (r["OrderDate"].day, r["OrderDate"].month) == (2, 6)       # day-first text
    assert r["DispatchDate"].year == 2023                              # ISO text


def test_partitioned_table_round_trip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="vl-test-"), "mart")
    df = spark.createDataFrame([("2023-05", 1), ("2023-06", 2)], "Month string, v int")
    sinks.write_table(df, out, partition_by=("Month",))
    back = spark.read.parquet(out).where(F.col("Month") == "2023-06")
    assert [r["v"] for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(Month" in back._jdf.queryExecution().executedPlan().toString()


def test_proxy_ids_are_unique_and_skus_grow_with_parts(spark):
    from pyspark.sql import functions as F
    from vendorlytics.sources.proxies import sales_tables, scorecard_tables
    from vendorlytics.sources.testdata import DriverTables

    seen = {}
    for sf in ("0.001", "0.01"):
        t = DriverTables(spark, f"/root/testdata/sf{sf}")
        s, m = scorecard_tables(t), sales_tables(t)
        lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().count()
        assert s["order_items"].select("id").distinct().count() == lines
        packages = s["shipping_packages"].agg(F.count("id"), F.countDistinct("id")).first()
        assert packages[0] == packages[1]
        seen[sf] = m["sales_items"].select("SellerSKU").distinct().count()
        assert m["listing_master"].count() == m["item_master_2"].count() == m["metafields"].count() == t["part"].count()
        assert m["pincodes"].count() == t["nation"].count()
    assert seen["0.01"] > 5 * seen["0.001"]


def test_jdbc_reader_options(monkeypatch):
    from vendorlytics.sources import readers, schemas

    class Reader:
        def __init__(self):
            self.asked = {}

        def format(self, name):
            self.asked["format"] = name
            return self

        def options(self, **more):
            self.asked.update(more)
            return self

        def option(self, key, value):
            self.asked[key] = value
            return self

        def load(self):
            return self.asked

    class Session:
        read = Reader()

    monkeypatch.setattr(readers, "conform", lambda df, schema: df)
    asked = readers.read_jdbc_table(Session(), "orders", schemas.ORDERS, {"url": "jdbc:x"}, "id", 0, 100, 4)
    assert asked == {"format": "jdbc", "url": "jdbc:x", "dbtable": "orders", "partitionColumn": "id",
                     "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    Session.read = Reader()
    assert readers.read_jdbc_query(Session(), "select 1", {"url": "jdbc:x"}) == {
        "format": "jdbc", "url": "jdbc:x", "query": "select 1"}


def test_unreadable_sheet_timestamp_fails_and_blank_is_null(spark):
    import pytest
    from vendorlytics.sources.readers import sheet_timestamp

    ok = spark.createDataFrame([("05/03/2023 10:00:00",), ("2023-03-05 10:00:00",), ("",), (None,)], "t string")
    got = [r[0] for r in ok.select(sheet_timestamp("t")).collect()]
    assert got[0] == got[1] and got[2:] == [None, None]
    with pytest.raises(Exception, match="unreadable timestamp in t: soon"):
        spark.createDataFrame([("soon",)], "t string").select(sheet_timestamp("t")).collect()


def test_text_predicates_are_disjoint_and_complete():
    import duckdb

    keys = ["", "a", "a'b", "B", "b", "it's", "z", "é", "日", "10", "9", None, "a", None]
    con = duckdb.connect()
    con.execute('CREATE TABLE t("my ""key" VARCHAR)')
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in keys])
    for parts in (1, 2, 3, 5, 40):
        wheres = readers.text_predicates('my "key', readers.text_bounds(keys, parts))
        assert len(wheres) <= parts
        found = [con.execute(f'SELECT "my ""key" FROM t WHERE {w}').fetchall() for w in wheres]
        assert sorted((r[0] for rows in found for r in rows), key=str) == sorted(keys, key=str)
    # Bounds that the database orders otherwise still cover every key once.
    wheres = readers.text_predicates('my "key', ["z", "a", "é"])
    n = [con.execute(f"SELECT count(*) FROM t WHERE {w}").fetchone()[0] for w in wheres]
    assert readers.text_predicates("k", []) == ["1 = 1"] and sum(n) == len(keys)


def test_jdbc_by_text_reads_one_range_a_connection(monkeypatch):
    asked = {}

    class Session:
        class read:
            @staticmethod
            def jdbc(url, table, predicates, properties):
                asked.update(url=url, table=table, predicates=predicates, properties=properties)

    monkeypatch.setattr(readers, "conform", lambda df, schema: df)
    readers.read_jdbc_by_text(Session(), "order_items", schemas.ORDER_ITEMS, {"url": "jdbc:x", "user": "u"}, "id", ["k", "p"])
    assert asked == {"url": "jdbc:x", "table": "order_items", "properties": {"user": "u"},
                     "predicates": ["(\"id\" < 'k' OR \"id\" IS NULL)", "\"id\" >= 'k' AND \"id\" < 'p'", "\"id\" >= 'k' AND \"id\" >= 'p'"]}


def test_rejects_add_up_and_fail_on_a_rate(spark):
    from vendorlytics.sources.rejects import ingest, split_rejects

    data = [("O1", "a", "3", "x"), ("O2", "a", " ", None), ("O3", None, "three", "x"), ("O4", "b", "4 ", ""), ("O5", "c", "1e", "y"), (None, None, None, None)]
    raw = spark.createDataFrame(data, "`Order Number` string, SKU string, QNT string, `VV Reason` string")
    good, bad = split_rejects(raw, schemas.RETURNS)
    assert [f.dataType for f in good.schema.fields] == [f.dataType for f in schemas.RETURNS.fields]
    assert sorted((r["Order Number"] or "", r.QNT) for r in good.collect()) == [("", None), ("O1", 3), ("O2", None), ("O4", 4)]
    assert sorted((r.faults[0]["column"], r.faults[0]["text"]) for r in bad.collect()) == [("QNT", "1e"), ("QNT", "three")]
    path = os.path.join(tempfile.mkdtemp(prefix="vl-test-"), "returns")
    ok, out = ingest(raw, schemas.RETURNS, path, max_share=0.4)
    assert ok.count() + out.count() == len(data) and out.count() == 2 and ok.columns == good.columns
    with pytest.raises(ValueError, match="2 of 6 rows"):
        ingest(raw, schemas.RETURNS, path, max_share=0.3)
    empty_ok, empty_out = ingest(raw.limit(0), schemas.RETURNS, path)
    assert empty_ok.count() == empty_out.count() == 0


def test_rejects_of_a_wide_sheet_of_computed_columns_are_planned_quickly(spark):
    """The rejected rows' filter must not be rewritten in terms of the columns' expressions: its
    inferred constraints doubled with each column (45 here; before: no plan, driver memory)."""
    from vendorlytics.sources.rejects import split_rejects

    from pyspark.sql import types as T

    names = [f"c{i}" for i in range(45)]
    numbers = spark.range(4).select(*[(F.col("id") * 10 + i).cast("string").alias(n) for i, n in enumerate(names)])
    raw = numbers.withColumn("c7", F.when(F.col("c0") == "20", "n/a").otherwise(F.col("c7")))
    good, bad = split_rejects(raw, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    assert [(r["column"], r["text"]) for r in bad.select(F.explode("faults").alias("f")).select("f.*").collect()] == [("c7", "n/a")]
    assert sorted(r["c44"] for r in good.collect()) == [44, 54, 74]
