"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three letters are hashed into a fixed number of features. Document frequencies are counted over all training rows. The
weights are learned by follow-the-regularised-leader with elastic-net penalties on a bounded sample, and the softmax gets a temperature that
fits probabilities to held-back sample rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from datamove.llm.toxicity import fold

FEATURES, LONGEST = 1 << 15, 3
SAMPLE_ROWS = 600  # rows of each language that the weights are fitted on, chosen by hash
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.05, 0.01
SLICE_CHARS = 1 << 20
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(texts: list[str]):
    """For each text: (feature numbers, counts), or None without a letter. Everything but letters is one blank; n-grams cross it at word ends only."""
    table = _letter_table()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size < SLICE_CHARS:
            size += len(texts[last])
            last += 1
        lowered = [" " + t.lower() + " " for t in texts[first:last]]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.cumsum([0, *map(len, lowered)])
        letter = table[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of blanks only the first stays
        points, letter = np.where(letter, points, 32)[keep].astype(np.uint32), letter[keep]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        h = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
        hashed, valid = [h], [letter]
        for k in range(1, LONGEST):
            h = (h[:-1] * np.uint32(0x85EBCA6B) + points[k:]) * np.uint32(0xC2B2AE35)
            hashed.append(h)
            valid.append(letter[: len(h)] | letter[k:])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if not letter[a:b].any():
                yield None
                continue
            counts = np.zeros(FEATURES, np.int64)
            for k, (h, v) in enumerate(zip(hashed, valid, strict=True)):
                end = max(a, b - k)
                counts += np.bincount((h[a:end][v[a:end]] >> np.uint32(32 - 15)).astype(np.int64), minlength=FEATURES)
            at = np.flatnonzero(counts)
            yield at, counts[at]
        first = last


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum() or 1.0)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature

    def predict(self, found) -> tuple[str, float]:
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        at, counts = found
        z = tfidf(at, counts, self.idf) @ self.weights[at] / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def _frequencies(batches):
    seen, rows = np.zeros(FEATURES, np.int64), 0
    for b in batches:
        for found in features([t or "" for t in b.column("text").to_pylist()]):
            if found is not None:
                seen[found[0]] += 1
                rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], ["feature", "n"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates; every fifth row is held back for the temperature. rows: (features, tf-idf, language)."""
    z, n, w = (np.zeros((FEATURES, languages)) for _ in range(3))
    fit, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(fit)):
            at, x, y = fit[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            s = x @ wi
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    scores, right = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), languages), np.array([y for *_, y in held], int)

    def loss(t):
        s = scores / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(right)), right]).mean())
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
    return w, float(min(grid, key=loss)) if len(held) else 1.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a language whose fold (crc32 of the id, modulo 3) is not 1. No such row: every text is `und`."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(fold("doc_id", 3) != 1)
    order = Window.partitionBy("lang").orderBy("h")
    chosen = (known.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id", F.lit(11)))
              .withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_ROWS).select("doc_id", "lang"))
    # SAMPLE_ROWS rows a language, chosen without their texts
    sample = known.where("text IS NOT NULL").join(F.broadcast(chosen), ["doc_id", "lang"]).orderBy(F.xxhash64("doc_id"), "text").select("text", "lang").toArrow()
    seen = known.where("text IS NOT NULL").select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = seen.column("feature").to_numpy(), seen.column("n").to_numpy()
    rows = int(n[at == -1].sum())
    frequency = np.zeros(FEATURES)
    frequency[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    languages = sorted(set(sample.column("lang").to_pylist()))
    made = [(f[0], tfidf(*f, idf), languages.index(y)) for f, y in zip(features(sample.column("text").to_pylist()), sample.column("lang").to_pylist(), strict=True) if f]
    weights, temperature = train(made, len(languages)) if made else (np.zeros((FEATURES, 0)), 1.0)
    return Model(languages if made else [], weights.astype(np.float32), idf.astype(np.float32), temperature)


def _predict(model):
    def run(batches):
        own = model.value if hasattr(model, "value") else model
        for b in batches:
            found = [own.predict(f) for f in features([t or "" for t in b.column("text").to_pylist()])]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                                             [*rest, "lang_pred", "score"])
    return run


def predict_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, lang_pred, score) of each whole text; `und` and 0 for a null text or one without a letter. Repeated rows and null ids are kept;
    other columns are ignored; an empty table gives no rows. The model (FEATURES weights a language) is broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with at least this probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [sent.value.predict(f) for f in features([t or "" for t in b.column("text").to_pylist()])]
            yield b.filter(pa.array([x != UNKNOWN and p >= least for x, p in found], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
