from datetime import date

import pytest
from pyspark.sql import functions as F

from datamove.operators.keys import hot_keys as hot
from datamove.operators import latest, lists, patterns

LIMITS = pytest.mark.parametrize("limit", [0, 1 << 30], ids=["shuffled", "broadcast"])


def merge(spark, target, source, limit, null_safe=False):
    t, s = spark.createDataFrame(target, "k int, a string, b int"), spark.createDataFrame(source, "k int, a string, b int")
    values = {"a": F.col("s.a"), "b": F.col("s.b")}
    out = patterns.merge_upsert(t, s, ["k"], ["a", "b"], values, {**values, "k": F.col("s.k")}, null_safe, limit)
    return sorted((tuple(r) for r in out.collect()), key=str)


@LIMITS
def test_merge_updates_inserts_and_keeps(spark, limit):
    got = merge(spark, [(1, "x", 1), (2, "y", 2), (3, "z", 3)], [(2, "new", 2), (3, "z", 3), (4, "w", 4)], limit)
    assert got == [(1, "x", 1), (2, "new", 2), (3, "z", 3), (4, "w", 4)]


@LIMITS
def test_merge_twice_changes_nothing(spark, limit):
    source = [(2, "new", 2), (4, "w", 4)]
    once = merge(spark, [(1, "x", 1), (2, "y", 2)], source, limit)
    assert merge(spark, once, source, limit) == once


@LIMITS
def test_merge_null_in_a_tracked_column(spark, limit):
    assert merge(spark, [(1, "x", None)], [(1, "x", 5)], limit) == [(1, "x", None)]  # unknown, so no update
    assert merge(spark, [(1, "x", None)], [(1, "x", 5)], limit, null_safe=True) == [(1, "x", 5)]


@LIMITS
def test_merge_null_keys_never_match(spark, limit):
    got = merge(spark, [(None, "t", 1)], [(None, "s", 2), (None, "s", 3)], limit)
    assert got == [(None, "s", 2), (None, "s", 3), (None, "t", 1)]


@LIMITS
@pytest.mark.parametrize("key", [1, 7], ids=["matched", "unmatched"])
def test_merge_fails_on_a_repeated_source_key(spark, limit, key):
    with pytest.raises(Exception, match="More than one source row for key"):
        merge(spark, [(1, "x", 1)], [(key, "a", 1), (key, "b", 2)], limit)


def test_merge_with_a_hot_target_key(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would all be joined into one task
    try:
        n = 60_000
        target = spark.range(0, n, 1, 6).selectExpr("CASE WHEN id % 3 = 0 THEN -7 ELSE id END AS k", "CAST(id AS STRING) AS a", "id AS b")
        read = []
        source = spark.range(0, 40_000, 1, 4).selectExpr("CASE WHEN id = 0 THEN -7 WHEN id = 5 THEN NULL ELSE id + 30000 END AS k", "'new' AS a", "id AS b")
        kept, seen = patterns.written, []
        monkeypatch.setattr(patterns, "written", lambda df, name: seen.append(name) or kept(df, name))
        monkeypatch.setattr(patterns, "hot_keys", lambda df, keys: read.append(hot(df, keys)) or read[-1])
        values = {"a": F.col("s.a"), "b": F.col("s.b")}
        out = patterns.merge_upsert(target, source, ["k"], ["a"], values, {**values, "k": F.col("s.k")}, limit=0)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert len(read[0]) == 1 and seen == ["merge-source"]
        assert sizes[-1] < 3 * sizes[len(sizes) // 2]
        rows = {r.k: r.a for r in source.collect()}
        t = [tuple(r) for r in target.collect()]
        have = {r[0] for r in t}
        want = [(k, "new" if k in rows else a) for k, a, _ in t] + [(k, "new") for k in rows if k is None or k not in have]
        assert sorted(map(str, want)) == sorted(str((r.k, r.a)) for r in out.collect())
        plain = patterns._merge_large(target, source, ["k"], ["a"], values, {**values, "k": F.col("s.k")}, False)
        assert sorted(map(str, plain.collect())) == sorted(map(str, out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_surrogate_keys_are_dense_and_continue(spark):
    new = spark.range(1000).select((999 - F.col("id")).alias("id")).repartition(7)
    existing = spark.createDataFrame([(41,), (17,)], "sk bigint")
    rows = patterns.surrogate_keys(new, ["id"], "sk", existing).collect()
    assert sorted(r.sk for r in rows) == list(range(42, 1042)) and all(r.sk == r.id + 42 for r in rows)
    assert sorted(r.sk for r in patterns.surrogate_keys(new.limit(3), ["id"], "sk").collect()) == [1, 2, 3]


def test_rolling_reload_is_repeatable(spark):
    t = spark.createDataFrame([(date(2024, 1, d), 1) for d in range(1, 11)], "d date, n int")
    fresh = spark.createDataFrame([(date(2024, 1, d), 2) for d in range(5, 11)], "d date, n int")
    once = patterns.rolling_reload(t, fresh, "d", date(2024, 1, 8))
    twice = patterns.rolling_reload(once, fresh, "d", date(2024, 1, 8))
    assert sorted(once.collect()) == sorted(twice.collect()) and once.where("n = 2").count() == 3


def test_archive_moves_rows_once(spark):
    t = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 3, 1),), (None,)], "d date")
    kept, old = patterns.archive_old(t, "d", date(2024, 2, 1), F.lit(date(2024, 4, 1)))
    assert (kept.count(), [tuple(r) for r in old.collect()]) == (2, [(date(2024, 1, 1), date(2024, 4, 1))])


def test_dim_date_adds_missing_days_only(spark):
    wanted = patterns.dim_date(spark, date(2024, 2, 28), date(2024, 4, 2))
    first = patterns.missing_dates(wanted.limit(0), wanted)
    assert first.count() == 35 and patterns.missing_dates(first, wanted).isEmpty()
    row = first.where("date = DATE '2024-04-01'").first()
    assert (row.date_key, row.quarter, row.month_name, row.fiscal_year) == (20240401, 2, "April", 2025)


def test_updates_treat_unknown_as_no(spark):
    t = spark.createDataFrame([(1, None), (2, "O"), (3, "F")], "k int, s string")
    got = {r.k: r.s for r in patterns.update_where(t, F.col("s") == "O", {"s": F.lit("C")}).collect()}
    assert got == {1: None, 2: "C", 3: "F"}
    assert patterns.rows_affected(t, F.col("s") == "O").first()[0] == 1


def test_lookup_splits_the_rows(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    ref = spark.createDataFrame([(1, 100), (2, None)], "id int, sk int")
    assert [tuple(r) for r in patterns.lookup(rows, ref, ["id"], ["sk"]).collect()] == [(1, 100)]
    assert sorted((r[0] for r in patterns.lookup_unmatched(rows, ref, ["id"], ["sk"]).collect()), key=str) == [2, None]


def test_hierarchy_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (9, None)], "k int, p int")
    got = {r.k: (r.root, r.level) for r in patterns.hierarchy_levels(nodes, "k", "p").collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 3), 9: (9, 1)}
    with pytest.raises(ValueError, match="cycle"):
        patterns.hierarchy_levels(spark.createDataFrame([(1, None), (2, 1), (2, 3), (3, 2)], "k int, p int"), "k", "p")


def test_deep_hierarchy_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = patterns.cut_lineage
    monkeypatch.setattr(patterns, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    chain = spark.range(2000).selectExpr("id AS k", "IF(id = 0, NULL, id - 1) AS p")
    odd = spark.createDataFrame([(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5000), (6000, 7777), (6001, 6000), (None, 1), (8000, 8000)], "k bigint, p bigint")
    nodes = chain.unionByName(odd)
    got = {r.k: (r.root, r.level) for r in patterns.hierarchy_levels(nodes, "k", "p").collect()}
    assert got == {i: (0, i + 1) for i in range(2000)} and len(rounds) <= 14  # one to begin with, 11 to the depth, one that finds circles alone
    assert sorted(r.k for r in patterns.hierarchy_cycles(nodes, "k", "p").collect()) == [5000, 5001, 5002, 5003, 8000]
    assert patterns.hierarchy_levels(nodes.limit(0), "k", "p").count() == 0


def test_a_group_with_half_the_rows_is_sorted_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 8000, 1, 5).selectExpr("IF(id % 2 = 0, 'hot', CAST(id % 10 AS STRING)) AS g", "(id * 7919) % 8000 AS o", "CAST(1 AS BIGINT) AS n")
        runs = []
        cut = lists.cut_lineage
        lists.cut_lineage = lambda df: runs.append(cut(df)) or runs[-1]
        got = {r.g: (r.joined, r.n) for r in lists.ordered_text(rows, ["g"], None, ["o"], F.col("o"), sums={"n": F.col("n")}).collect()}
    finally:
        lists.cut_lineage = cut
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        want.setdefault(r.g, []).append(str(r.o))
    assert got == {g: (",".join(v), len(v)) for g, v in want.items()}
    assert runs[0].where("g = 'hot'").select("_run").distinct().count() >= 2


def test_latest_per_key_with_a_hot_key(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    got = {r.k: r.t for r in latest.latest_per_key(rows, ["k"], ["t"]).collect()}
    assert got[0] == 8997 and len(got) == 6001
