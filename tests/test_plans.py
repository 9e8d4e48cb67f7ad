"""The physical plans are the ones meant."""

from pyspark.sql import functions as F

from datamove.operators import latest, patterns, reconcile
from datamove.queries import QUERIES
from datamove.queries.base import changed_orders, read
from datamove.session import SPREAD_BYTES, spread_over_cores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = formatted(QUERIES["filter_predicates"](spark, folder))
    assert "PushedFilters: [" in text and "Not(EqualTo(o_orderstatus,P))" in text and "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def test_keyed_differences_need_one_shuffle_and_no_join(spark, folder):
    orders = read(spark, folder, "orders")
    text = plan(reconcile.reconcile_rows(orders, changed_orders(orders), ["o_orderkey"]))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_profiles_exchange_one_row_per_partition(spark, folder):
    orders = read(spark, folder, "orders")
    text = plan(reconcile.profile(orders, ["o_orderkey"], ["o_orderkey", "o_orderpriority"], {"o_orderkey"}))
    for line in text.splitlines():
        if "Exchange" in line:
            below = text.splitlines()[text.splitlines().index(line) + 1]
            assert "partial_" in below


def test_latest_keeps_one_row_per_key_before_the_shuffle(spark, folder):
    text = plan(latest.latest_per_key(read(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_small_merge_does_not_shuffle_the_target(spark, folder):
    target = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    source = target.where("o_orderkey < 100")
    s = {"o_orderstatus": F.col("s.o_orderstatus")}
    merged = lambda limit: plan(patterns.merge_upsert(target, source, ["o_orderkey"], ["o_orderstatus"], s, {**s, "o_orderkey": F.col("s.o_orderkey")}, limit=limit))
    assert "SortMergeJoin" not in merged(1 << 30) and "FullOuter" in merged(0)


def test_joins_on_checked_keys_shuffle_each_side_once(spark, folder):
    assert plan(QUERIES["snapshot_changes"](spark, folder)).count("Exchange") == 2
    assert plan(QUERIES["merge_upsert_shuffled"](spark, folder)).count("Exchange") == 2


def test_no_query_makes_pairs(spark, folder):
    for name in ("cross_join_values", "compare_table", "monthly_sales_fiscal", "demo_sales_totals", "corpus_missing"):
        text = plan(QUERIES[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_large_sides_are_not_broadcast(spark, folder):
    rows = spark.range(100_000_000).withColumnRenamed("id", "customer_id")
    ref = spark.range(50_000_000).selectExpr("id AS customer_id", "id AS customer_key")
    assert "BroadcastHashJoin" not in plan(patterns.lookup(rows, ref, ["customer_id"], ["customer_key"]))


def test_spread_partitions_do_not_grow_with_the_input(spark):
    for size in (SPREAD_BYTES, 12 * SPREAD_BYTES):  # planned as 8 bytes a row
        rows = spark.range(size // 8)
        assert spread_over_cores(rows, "id").rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, size // SPREAD_BYTES)
