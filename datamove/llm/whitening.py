"""Whitening of embeddings: exact covariance, float32 eigenvectors refined in higher precision.

The covariance is gathered in integers. A first pass sums every dimension; a second one multiplies the entries, centred by the rounded mean, in blocks
whose products are exact, and the rest of the mean is taken off as a fraction, so that no digit is lost at any number of rows. Only sums of products,
whose number depends on the dimension alone, reach the driver. There, float32 eigenvectors of the covariance are corrected by Ogita-Aishima steps (matrix
products in extended precision, each about doubling the right digits). Eigenvalues closer than a step can tell apart form clusters: the
covariance is projected on a cluster's vectors, that small matrix's own eigenvectors turn them, and the steps go on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from datamove.llm.written import written

FACTOR, SHIFT = 64, 1_000_000
LARGEST = 2.0**55  # of an entry, so that its long exists
COMPONENTS = 32
BLOCK_ROWS, LIMB_BITS, FLUSH_BLOCKS = 4096, 18, 1024  # products of limbs, summed over a block, stay below 2**53; over FLUSH_BLOCKS blocks, below 2**63
MOST_STEPS = 30
FLAT = 1e-15  # an eigenvalue of less than this share of the trace is no variance
WIDE = np.longdouble


def _entries(column: pa.Array, only: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, x) of the usable vectors, by dimension."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in [only] if only else np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        if not len(at):
            continue
        c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
        usable = (np.isfinite(c) & (np.abs(c) < LARGEST)).all(axis=1)
        yield length, at[usable], np.floor(FACTOR * c[usable]).astype(np.int64) + SHIFT


def _sums(batches):
    """Number of vectors and sum of every dimension, by dimension of the vectors."""
    sums: dict[int, list] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for length, at, x in _entries(batch.column("embedding")):
            halves = (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            sums[length] = [sums[length][0] + len(at), sums[length][1] + halves]
    for length, (n, total) in sums.items():
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                 pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["size", "dim", "n", "total"])


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb[k] * 2**(LIMB_BITS * k), each limb below 2**LIMB_BITS in size."""
    out = []
    while np.abs(y).max(initial=0) >= 1 << LIMB_BITS:
        out.append((y & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        y = y >> LIMB_BITS
    return [*out, y.astype(np.float64)]


def _products(size: int, centre: np.ndarray):
    """Sums of products of every two dimensions, exact, by limb."""
    upper = np.triu_indices(size)

    def run(batches):
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((size, size), np.int64))
        blocks = 0

        def flush():
            for k, product in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                                                  pa.array(np.full(len(upper[0]), k), pa.int32()), pa.array(product[upper])], ["i", "j", "k", "value"])
            sums.clear()

        for batch in batches:
            for _, _, x in _entries(batch.column("embedding"), size):
                for first in range(0, len(x), BLOCK_ROWS):
                    parts = limbs(x[first : first + BLOCK_ROWS] - centre)
                    for a, left in enumerate(parts):
                        for b, right in enumerate(parts):
                            sums[a + b] += (left.T @ right).astype(np.int64)
                    blocks += 1
                    if blocks % FLUSH_BLOCKS == 0:
                        yield from flush()
        yield from flush()
    return run


def _wide(x: int) -> WIDE:
    """A Python integer in extended precision."""
    high, low = x >> 60, x & ((1 << 60) - 1)
    return np.array(low, np.int64).astype(WIDE) + (_wide(high) if abs(high) >> 60 else np.array(high, np.int64).astype(WIDE)) * WIDE(2) ** 60


def _close(values: np.ndarray, within: float) -> list[np.ndarray]:
    """Runs of positions whose values follow each other by at most `within`."""
    order = np.argsort(values)
    return [run for run in np.split(order, np.flatnonzero(np.diff(values[order]) > within) + 1) if len(run) > 1]


def refined_eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric matrix in extended precision -> eigenvalues, falling, and eigenvectors as columns."""
    scale = np.abs(a).max(initial=WIDE(0))
    one = np.eye(len(a), dtype=WIDE)
    if not scale:
        return np.zeros(len(a), WIDE), one
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    size_a, before = np.sqrt((a * a).sum()), np.inf
    finest = np.sqrt(np.finfo(WIDE).eps) * size_a  # over smaller gaps the rounding of a step alone would cost right digits
    for _ in range(MOST_STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else its rounding, divided by a small gap, would bend right angles
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        wrong = np.sqrt((off * off).sum()) + size_a * np.sqrt((r * r).sum())
        if wrong < 1e-15 and wrong >= before / 2:  # as right as extended precision can tell
            break
        before, within = wrong, max(finest, 2 * wrong)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > within
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        for run in _close(values, within):
            middle = values[run].mean()
            small = x[:, run].T @ (a @ x[:, run]) - middle * (x[:, run].T @ x[:, run])
            size = np.abs(small).max()
            if size:  # turned within the cluster; equal eigenvalues leave nothing to turn
                q = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(WIDE)
                x[:, run] = x[:, run] @ (q + q @ (np.eye(len(run), dtype=WIDE) - q.T @ q) / 2)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def covariance(n: int, total: list[int], centre: list[int], products: np.ndarray) -> np.ndarray:
    """From the exact sums of products of (x - centre), as Python integers in the upper half."""
    size = len(total)
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]
    out = np.zeros((size, size), WIDE)
    squared = _wide(n * n)
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = _wide(n * products[i, j] - rest[i] * rest[j]) / squared
    return out


def _exact_squares(z: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null where it exceeds a long."""
    if (np.square(z.astype(np.float64)).sum(axis=1) < 2.0**62).all():
        return np.square(z).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in z]
    return [s if s < 2**63 else None for s in exact]


def _deviations(x: np.ndarray, n: int, centre: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    y = x - centre
    if n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max(initial=0)) < 1 << 62:
        return n * y - rest
    return y.astype(object) * n - rest.astype(object)


def _whiten(n: int, centre: np.ndarray, rest: np.ndarray, turn: np.ndarray):
    size, wide = len(centre), turn.shape[1]

    def moments(batches):
        first, second = np.zeros(wide), np.zeros((wide, wide))
        for batch in batches:
            for _, _, x in _entries(batch.column("embedding"), size):
                y = _deviations(x, n, centre, rest).astype(np.float64) / n @ turn
                first += y.sum(axis=0)
                second += y.T @ y
        table = np.vstack([second, first])
        i, j = np.indices(table.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(table.ravel())], ["i", "j", "value"])

    def rows(batches):
        for batch in batches:
            for _, at, x in _entries(batch.column("embedding"), size):
                for a in range(0, len(at), BLOCK_ROWS):
                    z = _deviations(x[a : a + BLOCK_ROWS], n, centre, rest)
                    here = pa.array(np.repeat(at[a : a + BLOCK_ROWS], wide))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(here), pa.array(np.tile(np.arange(1, wide + 1), len(z)), pa.int32()), pa.array(np.full(len(z) * wide, n)),
                         pa.array(_exact_squares(z), pa.int64()).take(pa.array(np.repeat(np.arange(len(z)), wide))),
                         pa.array((z.astype(np.float64) / n @ turn).ravel())], ["vec_id", "component", "n", "deviation", "whitened"])
    return moments, rows


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """-> one row per vector and component, up to `components`: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or empty, or holds null, non-finite or (2**55 and more) unrepresentable entries are dropped, so are those of another
    dimension than most vectors have (the larger one of a tie). Repeated vectors count each, a null id is kept, other columns are ignored, no usable
    vector gives no rows. A component without variance has whitened null and takes no part in identity_error, which is null if no component
    has any. A deviation beyond the range of a long is null.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sums = written(vectors.select("embedding").mapInArrow(_sums, "size int, dim int, n long, total decimal(38, 0)")
                   .groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "whitening-sums")
    most = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    size, n = most["size"], most["n"]
    total = [int(r["total"]) for r in sums.where(F.col("size") == size).orderBy("dim").collect()]  # one row per dimension
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]
    summed = (vectors.select("embedding").mapInArrow(_products(size, np.array(centre, np.int64)), "i int, j int, k int, value long")
              .groupBy("i", "j", "k").agg(F.sum(F.col("value").cast("decimal(20, 0)")).alias("value")).collect())  # by dimensions, whatever the rows
    products = np.zeros((size, size), object)
    for i, j, k, value in summed:
        products[i, j] += int(value) << (LIMB_BITS * k)
    v = covariance(n, total, centre, products)
    values, turned = refined_eigenvectors(v)
    trace = np.trace(v)
    shown = min(components, size)
    varies = values[:shown] > FLAT * trace
    explained = (np.maximum(values[:shown], 0) / trace).astype(np.float64) if trace > 0 else np.zeros(shown)
    turn = (turned[:, :shown] / np.sqrt(np.where(varies, values[:shown], 1))).astype(np.float64)
    moments, rows = _whiten(n, np.array(centre, np.int64), np.array(rest, np.int64), turn)

    found = np.zeros((shown + 1, shown))
    measured = vectors.select("embedding").mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    for i, j, value in measured.collect():  # at most 33 x 32 rows
        found[i, j] = value
    mean = found[-1] / n
    off = np.abs(found[:-1] / n - np.outer(mean, mean) - np.eye(shown))[np.ix_(varies, varies)]
    error = float(off.max()) if varies.any() else None

    known = F.array(*[F.lit(float(e)) for e in explained])
    out = vectors.mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double")
    flat = [c + 1 for c in np.flatnonzero(~varies).tolist()]
    whitened = F.when(~F.col("component").isin(flat), F.col("whitened")) if flat else F.col("whitened")
    return out.withColumns({"whitened": whitened, "explained": F.element_at(known, F.col("component")), "identity_error": F.lit(error).cast("double")})
