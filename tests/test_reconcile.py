"""Each check must catch its own kind of fault, and nothing else."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from datamove.operators import reconcile

SCHEMA = "id int, amt decimal(19,4), name string, d double"
ROWS = [(i, Decimal(i) / 4, f"n{i}", i * 0.5) for i in range(1, 41)]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def failing(source, target, **options):
    return [r["check"] for r in reconcile.compare_table(source, target, **options).orderBy("check_no").collect() if not r.match]


def test_checks_and_match(spark, source):
    rows = reconcile.compare_table(source, source.repartition(7)).orderBy("check_no").collect()
    assert [r["check"] for r in rows] == ["row_count", "sum(id)", "sum(amt)", "sum(d)", "cast_nulls", "row_checksum(4 columns)"]
    assert all(r.match for r in rows) and rows[1].source == 820


def test_numbers_compare_by_value(source):
    wider = source.select(F.col("id").cast("bigint"), F.col("amt").cast("double"), F.col("name").alias("NAME"), F.col("d").cast("decimal(10,1)"))
    assert failing(source, wider) == []


def test_each_fault_has_its_check(source):
    one = F.col("id") == 7
    assert failing(source, source.withColumn("name", F.when(one, "x").otherwise(F.col("name")))) == ["row_checksum(4 columns)"]
    assert failing(source, source.withColumn("amt", F.when(one, F.col("amt") + 1).otherwise(F.col("amt")))) == ["sum(amt)", "row_checksum(4 columns)"]
    swapped = source.withColumn("amt", F.when(F.col("id") == 1, Decimal("0.5")).when(F.col("id") == 2, Decimal("0.25")).otherwise(F.col("amt")))
    assert failing(source, swapped) == ["row_checksum(4 columns)"]  # sums agree
    assert failing(source, source.where("id <> 40")) == ["row_count", "sum(id)", "sum(amt)", "sum(d)", "row_checksum(4 columns)"]
    assert failing(source, source.where("id <> 40"), checksum=False) == ["row_count", "sum(id)", "sum(amt)", "sum(d)"]


def test_lost_in_cast_is_seen(spark, source):
    nan = source.withColumn("d", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("d")))
    null = source.withColumn("d", F.when(F.col("id") != 3, F.col("d")))
    assert failing(nan, null) == ["cast_nulls", "row_checksum(4 columns)"]  # NaN is no NULL


def test_value_moved_to_another_column(spark):
    a = spark.createDataFrame([(1, "x", None)], "id int, a string, b string")
    b = spark.createDataFrame([(1, None, "x")], "id int, a string, b string")
    assert failing(a, b) == ["row_checksum(3 columns)"]


def test_large_values_do_not_overflow(spark):
    big = spark.createDataFrame([(2**62,), (2**62,), (2**62,), (-5,)], "k bigint")
    row = reconcile.compare_table(big, big).where("check = 'sum(k)'").first()
    assert row.match and row.source == 3 * 2**62 - 5


def test_empty_tables_match(spark, source):
    assert failing(source.limit(0), source.limit(0)) == []


def test_column_differences_do_not_fail(source):
    assert failing(source.withColumn("legacy", F.lit(1)), source) == []
    assert reconcile.column_differences(source.withColumn("Legacy", F.lit(1)), source) == {"only_in_source": ["legacy"], "only_in_target": []}


def test_equal_values(spark):
    rows = spark.createDataFrame([("5.5", "5.50"), (None, None), ("1", None), ("a", "a"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(reconcile.equal_values(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False]


def test_keyed_differences(spark, source):
    target = source.where("id > 2").withColumn("name", F.when(F.col("id") == 5, "x").otherwise(F.col("name"))).union(
        spark.createDataFrame([(99, Decimal(1), "new", 0.0)], SCHEMA))
    got = {r.id: r.difference for r in reconcile.reconcile_rows(source, target, ["id"]).collect()}
    assert got == {1: "missing_in_target", 2: "missing_in_target", 5: "changed", 99: "missing_in_source"}
    assert {r["column"]: r.mismatches for r in reconcile.reconcile_columns(source, target, ["id"]).collect()} == {"amt": 0, "name": 1, "d": 0}


def test_repeated_keys_are_compared_as_groups(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c")]
    a = spark.createDataFrame(rows, "k int, v string")
    assert reconcile.reconcile_rows(a, spark.createDataFrame(rows[::-1], "k int, v string"), ["k"]).isEmpty()
    b = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [(r.k, r.difference, r.in_source, r.in_target) for r in reconcile.reconcile_rows(a, b, ["k"]).collect()] == [(1, "changed", 3, 3)]


def test_hot_key_holding_a_third_of_the_rows(spark):
    base = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))
    changed = base.withColumn("v", F.when(F.col("v") == "3", "x").otherwise(F.col("v")))
    assert [(r.k, r.difference) for r in reconcile.reconcile_rows(base, changed, ["k"]).collect()] == [(0, "changed")]


def test_digits_after_the_sixth_decimal_are_compared(spark):
    rows = lambda x: spark.sql(f"SELECT 1 AS id, CAST('{x}' AS DECIMAL(38,10)) AS amount")
    same, other = (reconcile.compare_table(rows("1.0000001234"), rows(x)).collect() for x in ("1.0000001234", "1.0000004321"))
    assert all(r.match for r in same) and not all(r.match for r in other)


def sql_row(spark, **columns):
    return spark.sql("SELECT 1 AS id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()))


@pytest.mark.parametrize("left,right,same", [
    ("CAST(1.0000001 AS DOUBLE)", "CAST(1.0000004 AS DOUBLE)", False),
    ("CAST('1.0000001234' AS DECIMAL(38,10))", "CAST('1.0000004321' AS DECIMAL(20,10))", False),
    ("CAST('1.0000001234' AS DECIMAL(38,10))", "CAST('1.0000001234' AS DECIMAL(20,12))", True),
    ("CAST('12.3' AS DECIMAL(38,30))", "CAST('12.30' AS DECIMAL(38,2))", True),  # no common decimal holds both
    ("CAST('12.3' AS DECIMAL(38,30))", "CAST('12.31' AS DECIMAL(38,2))", False),
    ("CAST(12.34 AS DOUBLE)", "CAST(12.34 AS DECIMAL(12,4))", True), ("CAST(12.34 AS DOUBLE)", "CAST(12.3401 AS DECIMAL(12,4))", False),
    ("CAST(1e20 AS DOUBLE)", "CAST('100000000000000000000' AS DECIMAL(38,4))", True), ("CAST(-2.5e-9 AS DOUBLE)", "CAST('-0.0000000025' AS DECIMAL(20,12))", True),
    ("CAST(-2.5e-9 AS DOUBLE)", "CAST('0.0000000025' AS DECIMAL(20,12))", False), ("CAST(0.1 AS FLOAT)", "CAST(0.1 AS DECIMAL(5,2))", True),
    ("CAST(0.1 AS FLOAT)", "CAST(CAST(0.1 AS FLOAT) AS DOUBLE)", True), ("CAST(0.1 AS FLOAT)", "CAST(0.1 AS DOUBLE)", False),
    ("CAST(7 AS INT)", "CAST(7 AS DOUBLE)", True), ("CAST(700 AS BIGINT)", "CAST('700.00' AS DECIMAL(12,2))", True),
    ("CAST(-0.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)", True), ("CAST(0 AS INT)", "CAST(-0.0 AS DOUBLE)", True), ("CAST('NaN' AS DOUBLE)", "CAST('NaN' AS FLOAT)", True),
    ("CAST('NaN' AS DOUBLE)", "CAST(NULL AS DOUBLE)", False), ("CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)", False),
])
def test_numbers_are_compared_by_all_their_digits(spark, left, right, same):
    a, b = sql_row(spark, v=left), sql_row(spark, v=right)
    checks = {r["check"]: r.match for r in reconcile.compare_table(a, b).collect()}
    assert checks["row_checksum(2 columns)"] is same
    assert reconcile.reconcile_rows(a, b, ["id"]).isEmpty() is same
    assert reconcile.reconcile_columns(a, b, ["id"]).first().mismatches == (0 if same else 1)


@pytest.mark.parametrize("kind", ["bigint", "date", "string", "two"])
def test_descent_finds_what_the_whole_comparison_finds(spark, kind, tmp_path):
    key = {"bigint": "id * 7 - 1000", "date": "date_from_unix_date(CAST(id AS INT))", "string": "concat('k', id)", "two": "id DIV 10"}[kind]
    base = spark.range(0, 60_000, 1, 6).selectExpr(f"{key} AS k", "id % 10 AS k2", "CAST(id AS STRING) AS v")
    other = (base.where("v <> '123'").withColumn("v", F.when(F.col("v") == "40000", "x").otherwise(F.col("v")))
             .unionByName(base.where("v = '59999'").withColumn("v", F.lit("59999"))))
    for name, df in (("a", base), ("b", other)):
        df.write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    keys = ["k", "k2"] if kind == "two" else ["k"]
    trace = []
    got = reconcile.reconcile_descent(a, b, keys, leaf_rows=40, trace=trace)
    want = sorted(map(tuple, reconcile.reconcile_rows(a, b, keys).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 3
    assert len(trace) > 1 and sum(t["rows"] for t in trace[1:]) < 0.05 * 120_000
    if kind == "bigint":
        assert "GreaterThanOrEqual(k" in got._jdf.queryExecution().toString()
    assert reconcile.reconcile_descent(a, a, keys).isEmpty()


def test_descent_of_odd_tables(spark):
    rows = [(None, "a"), (None, "b"), (-(2**63), "c"), (2**63 - 1, "d"), (5, "e"), (5, "f")]
    a = spark.createDataFrame(rows, "k bigint, v string")
    b = spark.createDataFrame([(None, "a"), (None, "x"), (-(2**63), "c"), (2**63 - 1, "y"), (5, "f"), (5, "e")], "k bigint, v string")
    order = lambda df: sorted(map(str, df.collect()))
    for one, two in ((a, b), (b, a), (a, a.limit(0)), (a.limit(0), a), (a.limit(0), a.limit(0)), (a.where("k IS NULL"), b.where("k IS NULL"))):
        assert order(reconcile.reconcile_descent(one, two, ["k"], leaf_rows=1)) == order(reconcile.reconcile_rows(one, two, ["k"]))
    many = spark.range(5000).selectExpr("id * 1000 AS k", "id AS v")  # every range differs
    trace = []
    assert reconcile.reconcile_descent(many, many.withColumn("v", F.col("v") + 1), ["k"], leaf_rows=1, trace=trace).count() == 5000
    assert len(trace) == 1
