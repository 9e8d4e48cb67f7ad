"""Ordered lists of a group's values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datamove.session import cut_lineage


def ordered_text(df: DataFrame, keys: list[str], run: Column | None, order: list[str], value: Column, separator: str = ",",
                 sums: dict[str, Column] | None = None) -> DataFrame:
    """`value` of every group, in `order`, joined to one text (column `joined`), and the group's `sums`.

    A group is cut into runs that rise with the order; each run is sorted and joined by itself, so a group holding much of the data is sorted in many tasks and only
    its finished texts meet. `run` names them (for example the month of a date); None cuts by a range sort over keys and order, which bounds
    every run by one of its partitions, whatever the values.
    """
    sums = sums or {}
    rows = df.select(*keys, *order, value.cast("string").alias("_value"), *([run.alias("_run")] if run is not None else []), *[c.alias(n) for n, c in sums.items()])
    if run is None:  # written before it is grouped: a recomputed range could be cut elsewhere
        rows = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_run", F.spark_partition_id()))
    items = F.array_sort(F.collect_list(F.struct(*order, "_value")))
    runs = rows.groupBy(*keys, "_run").agg(F.array_join(F.transform(items, lambda x: x["_value"]), separator).alias("_text"), *[F.sum(n).alias(n) for n in sums])
    whole = F.array_sort(F.collect_list(F.struct("_run", "_text")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(whole, lambda x: x["_text"]), separator).alias("joined"), *[F.sum(n).alias(n) for n in sums])
