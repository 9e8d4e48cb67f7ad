"""LM scoring by a hidden Markov language model over word classes.

The most frequent words are classes of their own; all others fall into classes by their last three bytes; a class's probability is shared out
among its words by their counts, with one slot for unknown ones. Latent states emit classes. Baum-Welch adds up the expected counts of all training
texts across partitions. Its first passes are incremental: every task deals its texts into PARTS parts, a part's new counts take the place of its old ones and the model
is set anew after each part, so that one pass over the texts moves it PARTS times; the last passes count all texts under one model. A text's score is its exact likelihood by the scaled
forward recursion over the whole text, times its words' shares.

Word counts, document texts and dictionaries stay distributed: texts are dealt into blocks of about BLOCK_BYTES; each block asks for the counts of
its own distinct words and gets them back as its dictionary. Only the model goes through the driver: its size is fixed by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from datamove.llm.toxicity import fold
from datamove.llm.words import _LOWER, as_long, slices, span_hashes, text_buffers, word_spans
from datamove.session import cut_lineage, scratch_path

STATES, FREQUENT, ENDINGS = 6, 4095, 2048
CLASSES = 1 + FREQUENT + ENDINGS  # class 0: the end of a text
RUN = 128  # tokens of a training run
PARTS, PART_PASSES, ROUNDS = 8, 2, 3
CUTS = 64  # thresholds tried at once in the search for the most frequent words
BLOCK_BYTES = 12 << 20
FLUSH_WORDS = 1 << 21
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: first row, row after the last, word hashes, ending class of each word (0 to ENDINGS - 1), words of each row."""
    data, offsets = text_buffers(column)
    for first, last in slices(offsets):
        low = _LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, text = word_spans(low, offsets[first : last + 1] - offsets[first])
        ending = np.zeros(len(starts), np.int64)
        for k in (1, 2, 3):
            at = np.maximum(ends - k, starts)
            ending = ending * 257 + np.where(ends - k >= starts, low[at], 0) if len(low) else ending
        yield first, last, span_hashes(low, starts, ends), (ending * 2654435761 % (1 << 32)) * ENDINGS >> 32, np.bincount(text, minlength=last - first)


def _add_up(word, other, n):
    order = np.argsort(word, kind="stable")
    word, other, n = word[order], other[order], n[order]
    first = np.ones(len(word), bool)
    first[1:] = word[1:] != word[:-1]
    at = np.flatnonzero(first)
    return word[at], other[at], np.add.reduceat(n, at) if len(at) else n


def _counts(batches):
    held, size = [], 0

    def flush():
        word, ending, n = _add_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([as_long(word), pa.array(ending.astype(np.int32)), pa.array(n)], ["word", "ending", "n"])
    for b in batches:
        for *_, words, ending, _ in words_of(b.column("text")):
            held.append(_add_up(words, ending, np.ones(len(words), np.int64)))
            size += len(held[-1][0])
            if size >= FLUSH_WORDS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _requests(batches):
    """The distinct words of each block; a task's rows come block by block."""
    block, held, size = None, [], 0

    def flush():
        words = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int32)), as_long(words)], ["block", "word"])
    for b in batches:
        blocks = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z == a:
                continue
            if held and blocks[a] != block:
                yield flush()
                held, size = [], 0
            block = int(blocks[a])
            for *_, words, _, _ in words_of(b.column("text").slice(a, z - a)):
                held.append(np.unique(words))
                size += len(held[-1])
                if size >= FLUSH_WORDS:
                    held = [np.unique(np.concatenate(held))]
                    size = 0
    if held:
        yield flush()


class Classes:
    """Word -> class, bounded by FREQUENT."""

    def __init__(self, frequent: np.ndarray):
        self.words = np.sort(frequent.astype(np.uint64))

    def of(self, words: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = ending + 1 + FREQUENT
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            own = self.words[at] == words
            out = np.where(own, at + 1, out)
        return out.astype(np.int64)


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, run_start: np.ndarray):
        self.start, self.move, self.emit, self.run_start = start, move, emit, run_start  # emit: CLASSES x STATES

    @staticmethod
    def first(seed: int = 5) -> Hmm:
        r = np.random.default_rng(seed)
        emit = r.gamma(1.0, size=(CLASSES, STATES)) + 0.5
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        even = np.full(STATES, 1 / STATES)
        return Hmm(even, move, emit / emit.sum(axis=0), even)

    def again(self, counts: np.ndarray, prior: np.ndarray) -> Hmm:
        """From expected counts: rows 0-CLASSES-1 emissions, then moves, then starts of texts and of runs. prior: share of each class in all tokens; every
        state keeps a little of it, so no class is impossible."""
        emit = counts[:CLASSES] + 50 * prior[:, None]
        move, start, run = counts[CLASSES : CLASSES + STATES] + 0.1, counts[-2] + 0.1, counts[-1] + 0.1
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), run / run.sum())

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each class sequence, by the scaled forward recursion over all of it; texts advance side by side."""
        length = np.array([len(t) for t in texts])
        order = np.argsort(-length, kind="stable")
        out, total = np.zeros(len(texts)), np.zeros(len(texts))
        flat, first = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(length[order])])[:-1]
        falling = length[order]
        a = None
        active = len(texts)
        for t in range(int(falling[0]) if len(falling) else 0):
            while falling[active - 1] <= t:
                active -= 1
            e = self.emit[flat[first[:active] + t]]
            a = (self.start * e) if a is None else (a[:active] @ self.move) * e
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[:active] += np.log10(scale)
        out[order] = total
        return out

    def expected(self, runs: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Expected counts of padded runs (n x RUN, class numbers) by the scaled forward-backward recursion. begins: the run starts a text."""
        n, steps = runs.shape
        by_step = np.ascontiguousarray(runs.T)  # a step's runs lie side by side
        emit = self.emit[by_step]  # steps x n x states
        alpha, scale = np.empty_like(emit), np.empty((steps, n, 1))
        alive = (np.arange(steps)[:, None] < lengths[None, :])[:, :, None].astype(float)
        for t in range(steps):
            a = np.where(begins[:, None], self.start, self.run_start) if t == 0 else alpha[t - 1] @ self.move
            a *= emit[t]
            np.sum(a, axis=1, keepdims=True, out=scale[t])
            np.divide(a, scale[t], out=alpha[t])
        counts = np.zeros((CLASSES + STATES + 2, STATES))
        beta, moves, ahead = np.ones((n, STATES)), np.zeros((STATES, STATES)), self.move.T.copy()
        for t in range(steps - 1, -1, -1):
            if t:
                b = emit[t] * beta
                b *= alive[t] / scale[t]  # past a run's end nothing is added up
                moves += alpha[t - 1].T @ b
            alpha[t] *= beta
            alpha[t] *= alive[t]  # from here on: the states' probability at t, given the whole run
            if t:
                beta = np.where(alive[t] > 0, b @ ahead, 1.0)
        counts[CLASSES : CLASSES + STATES] = moves * self.move
        flat = by_step.ravel()
        for k in range(STATES):
            counts[:CLASSES, k] = np.bincount(flat, weights=alpha[:, :, k].ravel(), minlength=CLASSES)
        counts[-2] += alpha[0, begins].sum(axis=0)
        counts[-1] += alpha[0, ~begins].sum(axis=0)
        return counts


def cut_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences -> runs of RUN tokens, padded with class 0; their lengths; which start a text."""
    parts = [(t[i : i + RUN], i == 0) for t in texts for i in range(0, len(t), RUN)]
    runs = np.zeros((len(parts), RUN), np.int64)
    for row, (p, _) in zip(runs, parts, strict=True):
        row[: len(p)] = p
    return runs, np.array([len(p) for p, _ in parts], np.int64), np.array([b for _, b in parts], bool)


def _sequences(classes):
    """Class numbers of each text with its end, as 16-bit numbers; a task deals its texts to the parts in turn."""
    def run(batches):
        done = 0
        for b in batches:
            for first, last, words, ending, counts in words_of(b.column("text")):
                number = classes.value.of(words, ending).astype("<u2")
                bounds = np.concatenate([[0], np.cumsum(counts)])
                part = np.arange(done, done + last - first) % PARTS
                done += last - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number[i:j].tobytes() + b"\0\0" for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                     pa.array(part.astype(np.int32))], ["classes", "part"])
    return run


def _expect(model):
    """One row for each class, state and start with its expected counts over the task's texts."""
    def run(batches):
        total, held, size = np.zeros((CLASSES + STATES + 2, STATES)), [], 0
        for b in batches:
            for x in b.column("classes"):
                held.append(np.frombuffer(x.as_py(), "<u2"))
                size += len(held[-1])
                if size >= 1 << 18:
                    total += model.value.expected(*cut_runs(held))
                    held, size = [], 0
        if held:
            total += model.value.expected(*cut_runs(held))
        at = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(STATES))], ["place", *(f"s{k}" for k in range(STATES))])
    return run


def counts_under(sequences: DataFrame, model: Hmm) -> np.ndarray:
    """Expected counts of all texts of the frame; at most CLASSES + STATES + 2 rows reach the driver, whatever the texts."""
    sent = sequences.sparkSession.sparkContext.broadcast(model)
    found = sequences.select("classes").mapInArrow(_expect(sent), "place long, " + ", ".join(f"s{k} double" for k in range(STATES)))
    summed = np.zeros((CLASSES + STATES + 2, STATES))
    for r in found.groupBy("place").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).collect():
        summed[r["place"]] = r[1:]
    return summed


def baum_welch(sequences: DataFrame, prior: np.ndarray) -> Hmm:
    """(classes, part) -> the model trained on all of them."""
    model, of_part = Hmm.first(), {}
    for _ in range(PART_PASSES):
        for part in range(PARTS):
            of_part[part] = counts_under(sequences.where(F.col("part") == part), model)
            total = sum(of_part.values())
            if total.any():
                model = model.again(total, prior)
    for _ in range(ROUNDS):
        total = counts_under(sequences, model)
        if total.any():
            model = model.again(total, prior)
    return model


def most_frequent(counts: DataFrame, most: int) -> list:
    """Rows (word, ending, n) of at most `most` words: all whose count reaches a threshold, the smallest with so few words. Only numbers of words are asked for
    before the rows themselves."""
    low, high = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1  # the threshold lies in [low, high]
    while low < high:
        cuts = sorted({low + (high - low) * k // CUTS for k in range(CUTS)})
        found = counts.agg(*[F.count_if(F.col("n") >= c) for c in cuts]).first()
        fits = [c for c, words in zip(cuts, found, strict=True) if words <= most]
        above = [c for c, words in zip(cuts, found, strict=True) if words > most]
        low, high = (above[-1] + 1 if above else low), (fits[0] if fits else high)
    return counts.where(F.col("n") >= high).orderBy(F.desc("n"), "word").collect()


class Stats:
    """Of the training tokens: N, V, and of each class its tokens and distinct words (frequent classes: one word)."""

    def __init__(self, tokens: int, distinct: int, ends: int, frequent: dict[int, int], rare: dict[int, tuple[int, int]], words: np.ndarray):
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.total, self.words = np.zeros(CLASSES), np.zeros(CLASSES)
        self.total[0] = ends
        for i, w in enumerate(words.view(np.int64)):
            self.total[i + 1] = frequent[int(w)]
        for ending, (n, v) in rare.items():
            self.total[1 + FREQUENT + ending], self.words[1 + FREQUENT + ending] = n, v

    def share(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(word | class) for a word of count n (0: unknown)."""
        rare = classes > FREQUENT
        return np.where(rare, (n + 0.1) / (self.total[classes] + 0.1 * (self.words[classes] + 1)), 1.0)

    def base(self, n):
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _score(model, classes, stats):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        hmm, cls, st = model.value, classes.value, stats.value
        word, n = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
        order = np.argsort(word)
        word, n = word[order], n[order]
        sums, sequences = [], []
        for first, last, words, ending, counts in words_of(docs.column("text").combine_chunks()):
            number = cls.of(words, ending)
            c = np.zeros(len(words), np.int64)
            if len(word):
                at = np.minimum(np.searchsorted(word, words), len(word) - 1)
                c = np.where(word[at] == words, n[at], 0)
            text = np.repeat(np.arange(len(counts)), counts)
            add = lambda x: np.bincount(text, weights=x, minlength=len(counts))  # noqa: E731, B023
            sums.append(np.stack([counts + 1.0, add(c > 0) + (st.ends > 0), add(st.base(c)) + st.base(st.ends), add(np.log10(st.share(number, c)))]))
            sequences += [np.append(x, 0).astype(np.uint16) for x in np.split(number, np.cumsum(counts)[:-1])]
        rows = np.concatenate(sums, axis=1) if sums else np.zeros((4, 0))
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": rows[0].astype(np.int64),
                         "n_known": rows[1].astype(np.int64), "base_score": rows[2], "score": hmm.log10(sequences) + rows[3] if sequences else rows[3]})
    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Learns from rows whose fold (crc32 of the id, modulo 10) is not 0. A null text is empty: its one token is the end. Null ids and repeated rows are
    kept and counted each; other columns are ignored; an empty table gives no rows; without training rows all words are unknown.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held_out = fold("doc_id", 10) == 0
    training = rows.where(~held_out).select("text")

    counts = cut_lineage(training.mapInArrow(_counts, "word long, ending int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~held_out, 1)).alias("ends")).first()
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, FREQUENT)
    frequent = {r["word"]: r["n"] for r in top}
    classes = Classes(np.array(list(frequent), np.int64).view(np.uint64))
    by_ending = {r["ending"]: [r["n"], r["v"]] for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for r in top:
        by_ending[r["ending"]][0] -= r["n"]
        by_ending[r["ending"]][1] -= 1
    ends = size["ends"]
    stats = Stats((totals["n"] or 0) + ends, totals["v"] + (ends > 0), ends, frequent, by_ending, classes.words)

    sent = send(classes)
    path = scratch_path(spark, "hmm-classes")
    training.mapInArrow(_sequences(sent), "classes binary, part int").write.parquet(path)
    prior = (stats.total + 0.1) / (stats.total + 0.1).sum()
    model = baum_welch(spark.read.parquet(path), prior)

    n_blocks = max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES))
    placed = (rows.select("doc_id", "text", held_out.alias("held_out"), # with the input's split: a row that is repeated very often lies in many blocks
                          F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks)).cast("int").alias("block"))
              .repartition(n_blocks, "block").sortWithinPartitions("block"))
    asked = placed.mapInArrow(_requests, "block int, word long")
    known = asked.join(counts.select("word", "n"), "word").select("block", "word", "n")
    scored = placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score(send(model), sent, send(stats)), SCORE_SCHEMA)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")
