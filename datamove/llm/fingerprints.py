"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once. The hash space is cut into bins and every bin keeps its least value; an empty bin copies a filled
one, found by a fixed random sequence of its own (optimal densification). The low-order bits of all bins, packed, are the fingerprint. Two
fingerprints' likeness is the share of equal bins, corrected for the equality of unrelated low-order bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from datamove.llm.words import mix, shingle_sets

BINS, BITS, WIDTH = 256, 8, 5  # eight bits: one byte a bin
_U = np.uint64
_SHIFT = _U(64 - BINS.bit_length() + 1)
# attempt j of bin i looks at bin _TRIES[i, j]
_TRIES = (mix(np.arange(BINS * BINS, dtype=_U) + _U(0x2545F4914F6CDD1D)) % _U(BINS)).astype(np.int64).reshape(BINS, BINS)
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
SLICE_CHARS = 1 << 20


def fingerprint(hashes: np.ndarray) -> np.ndarray | None:
    """Of the sorted distinct shingle hashes of a text; None for the empty set."""
    if not len(hashes):
        return None
    at = (hashes >> _SHIFT).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    least, filled = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    least[at[first]] = (hashes[first] & _U((1 << BITS) - 1)).astype(np.uint8)
    filled[at[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        hit = filled[_TRIES[empty]]
        found = hit.any(axis=1)
        source = _TRIES[empty, hit.argmax(axis=1)]
        source[~found] = at[first][0]  # 256 tries without a filled bin: the first filled one
        least[empty] = least[source]
    return least


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """0 to 1. Two empty sets are alike, an empty and another one are not."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1.0 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1.0 - chance))


def fingerprints(texts: list[str]) -> Iterator[np.ndarray | None]:
    yield from (fingerprint(s) for s in shingle_sets(pa.array(texts, pa.large_string()), WIDTH))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is held against the one behind it in its bucket. A copy only ends its bucket."""
    import hashlib

    held: list[tuple] = []  # (bucket, doc_id, text, copy)

    def rows(last: bool):
        n = len(held) if last else len(held) - 1
        pairs = [(a, b) for a, b in zip(held[:n], held[1 : n + 1]) if not a[3] and a[0] == b[0]]
        prints = dict(zip(range(len(held)), fingerprints([h[2] for h in held])))
        index = [i for i, (a, b) in enumerate(zip(held[:n], held[1 : n + 1])) if not a[3] and a[0] == b[0]]
        texts = [edited(a[2], b[2]) for a, b in pairs]
        made = list(fingerprints(texts))
        packed = lambda p: "" if p is None else p.tobytes().hex()
        return pa.RecordBatch.from_arrays([
            pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string()),
            pa.array([packed(prints[i]) for i in index], pa.string()), pa.array([packed(p) for p in made], pa.string()),
            pa.array([likeness(prints[i], p) for i, p in zip(index, made)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in index], pa.float64())],
            [c.split(" ")[0] for c in SCHEMA.split(", ")])

    size = 0
    for batch in batches:
        columns = [batch.column(c) for c in ("bucket", "doc_id", "text", "copy")]
        for i in range(batch.num_rows):
            bucket, doc_id, text, copy = (c[i].as_py() for c in columns)
            held.append((bucket, doc_id, text or "", copy))
            size += len(text or "")
            if size >= SLICE_CHARS and len(held) > 1:
                yield rows(last=False)
                del held[:-1]
                size = len(held[0][2])
    yield rows(last=True)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and their likeness to each other and to the next document's.

    The next document has the next smaller id (equal ids: by descending text); after the last comes the first. A null text is empty. Null ids
    come last. Repeated rows are kept. Other columns are ignored; an empty table gives no rows; a single document follows itself.

    Ids are cut at quantiles that are ids of the table, so a bucket's first document is known beforehand and a copy of it ends the bucket
    before: one exchange of the texts, no join, no global sort.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("cuts"), F.max("doc_id").alias("most")).first()
    cuts = sorted(set(found["cuts"] or []) - {found["most"]}, reverse=True)
    table = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(table, lambda c: F.col("doc_id") <= c)))
    most = F.lit(found["most"]).cast("long")
    own = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("copy"))
    before = F.when(F.array_contains(table, F.col("doc_id")), F.struct((F.col("b") - 1).alias("bucket"), F.lit(True).alias("copy")))
    around = F.when(F.col("doc_id").eqNullSafe(most), F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("copy")))
    # of rows that end the same bucket, those of the next bucket come before the first of all: only the last bucket gets both kinds, and it has no next
    rows = (docs.withColumn("b", bucket.cast("int")).withColumn("x", F.explode(F.filter(F.array(own, before, around), lambda s: s.isNotNull())))
            .select("doc_id", "text", "x.bucket", "x.copy"))
    return (rows.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
            .mapInArrow(_compare, SCHEMA))
