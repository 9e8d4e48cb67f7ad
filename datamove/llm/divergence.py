"""Source divergence audit: how far apart the sources of a language are in their use of terms.

Texts are read once: every task counts terms by (language, source), and only these counts are shuffled. The terms a language keeps get dense
ids from a distributed sort. Each source becomes sorted (term id, count) arrays, cut into blocks of ids so that no task holds a whole vocabulary. For every
unordered pair of sources and block, both arrays are co-grouped in one task: a galloping intersection of the shorter with the longer array finds the
overlap, and overlapping, one-sided and absent terms are priced apart. The price is symmetric, so a pair's sum serves both of its directions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from datamove.llm.written import written
from datamove.operators.patterns import surrogate_keys

FEWEST_DOCUMENTS, SMOOTHING, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
BLOCK_TERMS = 1 << 15
FLUSH_TERMS, LOOK_EVERY, LONG_TEXT, RUN = 400_000, 256, 1 << 20, 1 << 16
COARSE = 64
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # over lower-cased UTF-8: letters A-Z and everything beyond ASCII
COUNTS = "lang string, source string, term string, occurrences long, documents long"


def terms_of(text: bytes):
    """Runs of the text's terms, each of bounded length."""
    lowered = text.lower()  # of bytes: A-Z only
    if len(lowered) < LONG_TEXT:
        yield _TERM.findall(lowered)
        return
    found = (m.group() for m in _TERM.finditer(lowered))
    while run := list(islice(found, RUN)):
        yield run


def _count(batches):
    """Occurrences and documents by language, source and term; a null term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush():
        for (lang, source), (occurrences, documents) in groups.items():
            n = len(occurrences) + 1
            terms = pa.array([None, *occurrences], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array([0, *occurrences.values()], pa.int64()),
                 pa.array([0, *(documents[t] for t in occurrences)], pa.int64())], ["lang", "source", "term", "occurrences", "documents"])
        groups.clear()

    for batch in batches:
        for i, (lang, source, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()),
                                                      strict=True)):
            occurrences, documents = groups[lang, source]
            seen: set[bytes] = set()
            for run in terms_of(text.as_py()):
                occurrences.update(run)
                seen.update(run)
            documents.update(seen)
            if i % LOOK_EVERY == 0 and sum(len(o) for o, _ in groups.values()) > FLUSH_TERMS:
                yield from flush()
    yield from flush()


def share(count: np.ndarray | int, total: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * v)), exactly: a long division by thousands. Denominators stay below 9e15."""
    rest = np.asarray(count, np.int64) + SMOOTHING
    whole, out = max(1, total + SMOOTHING * v), np.zeros_like(rest)
    if whole >= 2**63 // 1000:
        raise ValueError("More than 9e15 terms in one group")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """For each of the sorted needles, the place of the first value of the sorted hay that is not smaller. Every COARSE-th needle is looked up in the whole hay,
    the needles behind it gallop on from there: steps double until they pass the needle, then the last step is halved."""
    coarse = np.searchsorted(hay, needles[::COARSE])
    low = np.repeat(coarse, COARSE)[: len(needles)]
    step = np.ones(len(needles), np.int64)
    smaller = lambda at: (at < len(hay)) & (hay[np.minimum(at, len(hay) - 1)] < needles)
    if not len(hay):
        return low
    going = smaller(low)
    high = low.copy()
    while going.any():  # hay[low] < needle for those that go on
        high = np.where(going, np.minimum(low + step, len(hay)), high)
        on = going & smaller(high)
        low, step, going = np.where(on, high, low), np.where(on, step * 2, step), on
    while (high - low > 1).any():
        middle = (low + high) // 2
        less = smaller(middle) & (high - low > 1)
        low, high = np.where(less, middle, low), np.where(~less & (high - low > 1), middle, high)
    return high


def price(ids_a: np.ndarray, counts_a: np.ndarray, n_a: int, ids_b: np.ndarray, counts_b: np.ndarray, n_b: int, v: int, in_block: int) -> int:
    """Sum of |p - q| over the `in_block` kept terms of a block, from both sides' sorted ids and counts of the terms that occur."""
    if len(ids_a) > len(ids_b):
        ids_a, counts_a, n_a, ids_b, counts_b, n_b = ids_b, counts_b, n_b, ids_a, counts_a, n_a
    place = gallop(ids_a, ids_b)
    common = (place < len(ids_b)) & (ids_b[np.minimum(place, len(ids_b) - 1)] == ids_a) if len(ids_b) else np.zeros(len(ids_a), bool)
    rest_b = np.ones(len(ids_b), bool)
    rest_b[place[common]] = False
    none_a, none_b = int(share(0, n_a, v)), int(share(0, n_b, v))
    p_a = share(counts_a, n_a, v)
    overlap = np.abs(p_a[common] - share(counts_b[place[common]], n_b, v)).sum()
    only_a = np.abs(p_a[~common] - none_b).sum()
    only_b = np.abs(share(counts_b[rest_b], n_b, v) - none_a).sum()
    absent = in_block - len(ids_a) - int(rest_b.sum())
    return int(overlap) + int(only_a) + int(only_b) + absent * abs(none_a - none_b)


def _pair(key: tuple[pa.Scalar, ...], low: pa.Table, high: pa.Table) -> pa.Table:
    sides = []
    for side in (low, high):
        entries = side["entries"].combine_chunks().values
        sides += [entries.field("id").to_numpy(), entries.field("count").to_numpy(), side["n"][0].as_py()]
    value = price(*sides, low["v"][0].as_py(), low["in_block"][0].as_py())
    return pa.table({"lang": [key[0].as_py()], "low": [key[1].as_py()], "high": [key[2].as_py()], "value": pa.array([value], pa.int64())})


def exact_share(count: str, n: str, v: str) -> Column:
    """`share` as a column; a language without kept terms has no such row."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTHING} AS DECIMAL(19, 0)) "
                  f"DIV CAST({n} + {SMOOTHING} * {v} AS DECIMAL(19, 0))").cast("long")


def audit(docs: DataFrame) -> DataFrame:
    """-> (lang, source, part, item, value, rank). Part `pair`: each other source of the language and the sum of |p - q| over the kept terms; part
    `term`: the at most 50 terms that the source uses more than its language, and by how much.

    Null text, language or source counts as ''. Groups without terms have pairs with every other source of their language; a language that keeps no term has pairs
    of value 0; the only source of a language has no pairs. Repeated rows count each, a null id is nothing special, other columns are ignored, an empty
    table gives no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = written(rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term")
                      .agg(F.sum("occurrences").alias("count"), F.sum("documents").alias("documents")), "divergence-counts")
    by_lang = (counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("documents").alias("documents"))
               .where(F.col("documents") >= FEWEST_DOCUMENTS).drop("documents"))
    kept = surrogate_keys(by_lang, ["lang", "term"], "term_id")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    entries = written(counted.where("term IS NOT NULL").join(kept, ["lang", "term"])
                      .select("lang", "source", "term", "term_id", "count", "lang_count"), "divergence-entries")
    groups = written(counted.select("lang", "source").distinct()
                     .join(entries.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
                     .join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")]), "divergence-groups")

    block = (F.col("term_id") / BLOCK_TERMS).cast("long")
    blocks = kept.groupBy("lang", block.alias("block")).agg(F.count("*").alias("in_block"))
    arrays = (entries.groupBy("lang", "source", block.alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").alias("id"), "count"))).alias("entries")))
    cells = (groups.join(blocks, "lang", "left").withColumns({"block": F.coalesce("block", F.lit(-1)), "in_block": F.coalesce("in_block", F.lit(0))})
             .join(arrays, ["lang", "source", "block"], "left")
             .select("lang", "source", "block", "in_block", "n", "v",
                     F.coalesce("entries", F.array().cast("array<struct<id: bigint, count: bigint>>")).alias("entries")))
    others = groups.select(F.col("lang").alias("other_lang"), F.col("source").alias("other"))
    paired = cells.join(others, (F.col("lang") == F.col("other_lang")) & (F.col("source") != F.col("other")))
    key = ["lang", "low", "high", "block"]
    # own aliases on either side: both come from the same rows
    side = lambda where, low, high: paired.where(where).select(*[F.col(c).alias(n) for c, n in (
        ("lang", "lang"), (low, "low"), (high, "high"), ("block", "block"), ("in_block", "in_block"), ("n", "n"), ("v", "v"), ("entries", "entries"))])
    priced = (side("source < other", "source", "other").groupBy(*key).cogroup(side("source > other", "other", "source").groupBy(*key))
              .applyInArrow(_pair, "lang string, low string, high string, value long")
              .groupBy("lang", "low", "high").agg(F.sum("value").alias("value")))
    pairs = priced.select("lang", F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")),
                                                    F.struct(F.col("high").alias("source"), F.col("low").alias("item")))).alias("p"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = pairs.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(ranked))
    gain = exact_share("`count`", "n", "v") - exact_share("lang_count", "lang_n", "v")
    term_part = (entries.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain.alias("value"))
                 .where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= MOST_TERMS))
    return pair_part.unionByName(term_part)
