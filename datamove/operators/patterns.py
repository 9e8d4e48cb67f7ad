"""Write-side patterns of a warehouse load. Each takes frames and returns the table's new contents; the caller writes them
with one overwrite (to another place than the one being read)."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from datamove.functions import scalar
from datamove.operators.keys import complete, hot_keys, single_rows, spread
from datamove.session import BROADCAST_LIMIT, broadcast_if_small, cut_lineage, planned_bytes, written

SMALL_ROWS = 1_000_000  # of a source that is broadcast


def changed(columns: list[str], null_safe: bool) -> Column:
    """Any tracked column differs between `t` and `s`. As in SQL, NULL compares as unknown unless null_safe."""
    tests = [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) if null_safe else F.col(f"t.{c}") != F.col(f"s.{c}") for c in columns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], track: list[str], update: dict[str, Column],
                 insert: dict[str, Column], null_safe: bool = False, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """MERGE: a matched row with a tracked difference takes `update` (target column -> expression over t.* and s.*), a source
    row without a target takes `insert` (target column -> expression over s.*; other columns NULL). Duplicate source keys fail.

    The source is evaluated once, into a written table. While that is small it is broadcast and the target is not shuffled at all; a larger one is joined in a
    full outer join, both sides shuffled once on the keys. Before that, a sketch finds the target keys that would overload a task: their rows stay where
    they are and meet their source rows, one for each hot key and so at most MOST_HOT, as a broadcast.
    """
    source = written(source, "merge-source")
    size = planned_bytes(source)
    if size is not None and size <= limit and source.count() <= SMALL_ROWS:
        return _merge_small(target, source, keys, track, update, insert, null_safe)
    hot = hot_keys(target, keys)
    if not hot:
        return _merge_large(target, source, keys, track, update, insert, null_safe)
    is_hot = F.coalesce(F.xxhash64(*keys).isin(hot) & complete(keys), F.lit(False))
    return (_merge_large(target.where(~is_hot), source.where(~is_hot), keys, track, update, insert, null_safe)
            .unionByName(_merge_small(target.where(is_hot), source.where(is_hot), keys, track, update, insert, null_safe)))


def _merged_row(target: DataFrame, track: list[str], update: dict[str, Column], null_safe: bool, matched: Column) -> list[Column]:
    hit = matched & changed(track, null_safe)
    return [(F.when(hit, update[c]).otherwise(F.col(f"t.{c}")) if c in update else F.col(f"t.{c}"))
            .cast(target.schema[c].dataType).alias(c) for c in target.columns]


def _inserted_row(target: DataFrame, insert: dict[str, Column]) -> list[Column]:
    return [insert.get(c, F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns]


def _merge_large(target, source, keys, track, update, insert, null_safe) -> DataFrame:
    t = target.withColumn("_spread", spread(keys, target)).withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_spread", spread(keys, source))
    s = single_rows(s, keys, "_spread").alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in [*keys, "_spread"]]
    joined = t.join(s, on, "full")
    kept = _merged_row(target, track, update, null_safe, F.col("s._single").isNotNull())
    new = _inserted_row(target, insert)
    return joined.select(*[F.when(F.col("t._in_t").isNull(), n).otherwise(k).alias(c)
                           for c, n, k in zip(target.columns, new, kept)])


def _merge_small(target, source, keys, track, update, insert, null_safe) -> DataFrame:
    checked = single_rows(source, keys)
    s = F.broadcast(checked.alias("s"))
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    kept = target.alias("t").join(s, on, "left").select(
        *_merged_row(target, track, update, null_safe, F.col("s._single").isNotNull()))
    # The target keys that occur in the source: a narrow scan of the target filtered against the broadcast source keys.
    hit = target.select(*keys).join(F.broadcast(source.select(*keys)), keys, "left_semi").distinct()
    added = checked.where("_single").join(hit, keys, "left_anti").alias("s").select(*_inserted_row(target, insert))
    return kept.unionByName(added)


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE: rows where the condition is true take the new values."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def rows_affected(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("rows_affected"))


def update_from(df: DataFrame, lookup: DataFrame, keys: list[str], condition: Column, changes: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: `lookup` has one row per key (aggregate it first); rows that join and meet the condition change."""
    found = lookup.where(condition).select(*keys).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(broadcast_if_small(found), keys, "left")
    return update_where(joined, F.col("_hit"), changes).select(*df.columns)


def rolling_reload(target: DataFrame, fresh: DataFrame, day: str, start: date) -> DataFrame:
    """Delete the days from `start` on and put the fresh rows of those days in their place."""
    keep = target.where(~F.coalesce(F.col(day) >= F.lit(start), F.lit(False)))
    return keep.unionByName(fresh.where(F.col(day) >= F.lit(start)))


def archive_old(df: DataFrame, day: str, before: date, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): rows older than `before` move to the archive with a stamp."""
    old = F.coalesce(F.col(day) < F.lit(before), F.lit(False))
    return df.where(~old), df.where(old).withColumn("archived_at", stamp)


def dim_date(spark, start: date, end: date) -> DataFrame:
    """One row per day of the range."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    d = F.col("date")
    return days.select(scalar.date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"),
                       F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), scalar.fiscal_year(d).alias("fiscal_year"))


def missing_dates(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the dates that are not in the dimension yet."""
    return wanted.join(existing.select("date"), "date", "left_anti")


def surrogate_keys(new_rows: DataFrame, order: list[str], key: str, existing: DataFrame | None = None) -> DataFrame:
    """Dense keys after the largest existing one, in `order` (unique). The rows are range-sorted across the cluster and each
    partition counts on from the partitions before it: no task sees more than its own range.

    The sorted rows are checkpointed first, so that a recomputed partition can never be numbered differently.
    """
    start = F.lit(0).cast("bigint")
    if existing is not None:
        start = F.lit(existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).first()[0])
    placed = cut_lineage(new_rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    keyed = placed.join(F.broadcast(offsets), "_part")  # one row per partition of the sorted rows
    return keyed.withColumn(key, start + F.col("_offset") + F.col("_row") + 1).drop("_id", "_part", "_row", "_offset")


def lookup(df: DataFrame, reference: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """Lookup with no-match rows dropped: inner join to the reference set, looked-up value present."""
    ref = reference.select(*on, *take)
    return df.join(broadcast_if_small(ref), on, "inner").where(F.col(take[0]).isNotNull())


def lookup_unmatched(df: DataFrame, reference: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """The other output of the lookup: rows without a match."""
    ref = reference.where(F.col(take[0]).isNotNull()).select(*on)
    return df.join(broadcast_if_small(ref), on, "left_anti")


def daily_sales(orders: DataFrame, lines: DataFrame, cancelled: str) -> DataFrame:
    """Orders, quantity and amount per day and customer, without cancelled orders.

    Lines are summed per order before they meet the orders, so the join and the distinct count work on one row per order.
    orders: order_id, customer_id, order_date, status. lines: order_id, quantity, amount.
    """
    per_order = lines.groupBy("order_id").agg(F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount"))
    open_orders = orders.where(F.col("status") != cancelled).select("order_id", "customer_id", F.to_date("order_date").alias("order_date"))
    return (open_orders.join(per_order, "order_id").groupBy("order_date", "customer_id")
            .agg(F.countDistinct("order_id").alias("order_count"), F.sum("quantity").cast("bigint").alias("total_quantity"),
                 F.sum("amount").cast("decimal(38,4)").alias("total_amount")))


def sales_summary(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers, orders and amount per month and country; a NULL country is 'Unknown'."""
    dim = customers.select("customer_key", "country")
    return (fact.join(broadcast_if_small(dim), "customer_key")
            .groupBy(scalar.month_start(F.col("order_date")).alias("month_start"), F.coalesce("country", F.lit("Unknown")).alias("country"))
            .agg(F.countDistinct("customer_key").alias("customers"), F.sum("order_count").alias("orders"),
                 F.sum("total_amount").alias("amount")))


def _doubled(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(_key, above, dist, done) of every node whose parents all exist: its root and the steps up to it; done is false for nodes that lead into a cycle.

    Every round joins each unfinished node's ancestor to that one's own ancestor, so the steps double and a depth of d takes log2(d) rounds."""
    links = nodes.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"))
    root = F.col("_parent").isNull()
    state = cut_lineage(links.select("_key", F.when(root, F.col("_key")).otherwise(F.col("_parent")).alias("above"),
                                     F.when(root, 0).otherwise(1).cast("bigint").alias("dist"), root.alias("done")))
    open_nodes = state.where("NOT done").count()
    while open_nodes:
        up = state.select(F.col("_key").alias("above"), F.col("above").alias("_above"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        moved = (state.where("NOT done").join(up, "above")  # a node whose ancestor does not exist falls out
                 .select("_key", F.col("_above").alias("above"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done")))
        state = cut_lineage(state.where("done").unionByName(moved))
        left = state.where("NOT done").count()
        if left == open_nodes:
            break  # whoever is not at a root after as many steps as all paths have goes round in a circle
        open_nodes = left
    return state


def hierarchy_levels(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """START WITH parent IS NULL CONNECT BY: (key, root, level). Nodes that no root leads to are left out; hierarchy_cycles tells those in circles.

    With one parent per key, log2(depth) rounds of pointer doubling. Where a key has several parents, a row for each path: one join per level, and a path longer than
    the number of keys is a cycle and fails. Found rows are checkpointed, so there is no limit of rows or levels and no plan grows with the depth."""
    if nodes.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        found = _doubled(nodes.where(F.col(key).isNotNull()), key, parent).where("done")
        return found.select(F.col("_key").alias(key), F.col("above").alias("root"), (F.col("dist") + 1).cast("int").alias("level"))
    return _levels_of_paths(nodes, key, parent)


def hierarchy_cycles(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Keys, each with one parent, that lead round in a circle or into one: (key)."""
    return _doubled(nodes.where(F.col(key).isNotNull()), key, parent).where("NOT done").select(F.col("_key").alias(key))


def _levels_of_paths(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    links = nodes.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"))
    frontier = links.where("_parent is null").select(F.col("_key").alias("node"), F.col("_key").alias("root"), F.lit(1).alias("level"))
    found, level, longest = [], 0, links.select("_key").distinct().count()
    while not (frontier := cut_lineage(frontier)).isEmpty():
        level += 1
        if level > longest:
            raise ValueError(f"A path of {level} levels over {longest} keys: the hierarchy has a cycle.")
        found.append(frontier)
        frontier = (links.where("_parent is not null")
                    .join(frontier.select(F.col("node").alias("_parent"), "root"), "_parent")
                    .select(F.col("_key").alias("node"), "root", F.lit(level + 1).alias("level")))
    empty = frontier.limit(0)
    return reduce(DataFrame.unionByName, found, empty).withColumnRenamed("node", key)


def last_days(as_of: date, days: int) -> date:
    return as_of - timedelta(days=days)
