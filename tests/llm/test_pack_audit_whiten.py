"""Best-fit packing, source divergence and whitening against brute force, on odd rows and on given tables."""

import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from datamove.llm import best_fit, divergence, whitening
from datamove.llm.queries import ORACLE, QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def least_sequences(lengths, size):
    """The best packing, by trying all."""
    best = [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= lengths[i]}.values():
            place(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(room)])
        place(i + 1, [*room, size - lengths[i]])
    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_best_packing():
    rng = np.random.default_rng(5)
    met = 0
    for size in (10, 24):
        for _ in range(60):
            lengths = sorted(rng.integers(1, size + 1, rng.integers(1, 9)).tolist(), reverse=True)
            best, bound = least_sequences(lengths, size), best_fit.fewest(np.bincount(lengths, minlength=size + 1), size)
            assert bound <= best
            met += bound == best
            at, offsets, left = best_fit.best_fit_decreasing(np.array(lengths), size)
            assert best <= len(left) <= best * 1.5 + 1
            rooms = []  # the same, by looking at every open sequence
            for n, number in zip(lengths, at.tolist(), strict=True):
                fitting = [r for r in rooms if r >= n]
                if fitting:
                    assert rooms[number] == min(fitting)
                else:
                    assert number == len(rooms)
                    rooms.append(size)
                rooms[number] -= n
            assert rooms == left.tolist()
    assert met > 100
    table, full = best_fit.dual_feasible(12)
    for parts in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(1, 13), k) for k in range(1, 5)):
        if sum(parts) <= 12:
            assert (table[:, list(parts)].sum(axis=1) <= full).all()


def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    want = Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        want.update((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len({r.fewest_sequences for r in rows}) <= 1
    return len(sequences), rows[0].fewest_sequences if rows else 0


def test_best_fit_packing(spark, folder, odd_docs):
    rows = best_fit.pack_best_fit(odd_docs, BYTES).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert best_fit.pack_best_fit(odd_docs.limit(0), BYTES).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made, bound = check_packing(QUERIES["op11_best_fit"](spark, folder).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert bound <= made <= bound + 1


def test_exchange_closes_gaps(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(best_fit, "GROUP_PIECES", 8)
    made, bound = check_packing(best_fit.pack_best_fit(docs, BYTES).collect(), pairs)
    monkeypatch.setattr(best_fit, "MOST_ROUNDS", 0)
    alone, _ = check_packing(best_fit.pack_best_fit(docs, BYTES).collect(), pairs)
    assert bound <= made < alone


def brute_audit(rows):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", lowered)
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        own = {s: c for (g, s), c in groups.items() if g == lang}
        kept = [t for t, n in docs[lang].items() if n >= 30]
        p = {s: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept} for s, c in own.items()}
        all_of = sum(own.values(), Counter())
        q = {t: 1 + (10**9 * (all_of[t] + 5)) // (sum(all_of[x] for x in kept) + 5 * len(kept)) for t in kept}
        order = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in own:
            pairs = order([(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s])
            terms = order([(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]])[:50]
            out |= {(lang, s, "pair", i, v, r) for r, (i, v) in enumerate(pairs, 1)} | {(lang, s, "term", i, v, r) for r, (i, v) in enumerate(terms, 1)}
    return out


def test_divergence(spark, folder, odd_docs, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = [(f"Gemeinsam äther{i % 7} ÄTHER x{i % 3} " + "wort " * (i % 5), "de", f"s{i % 4}") for i in range(200)]
    made += [("only", "de", "rare"), (None, "de", "none"), ("a b", "xx", "alone"), ("c", None, None), ("c", None, "z"), ("é" * 10 + "\U0001f600-q", "de", "s1")] * 2
    more = spark.createDataFrame([(None, *r, 1) for r in made], "doc_id long, text string, lang string, source string, count int")
    for frame in (docs, more, odd_docs):
        rows = [tuple(r) for r in divergence.audit(frame).collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == brute_audit([(r.text, r.lang, r.source) for r in frame.collect()])
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    monkeypatch.setattr(divergence, "LONG_TEXT", 100)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 50)
    assert {tuple(r) for r in divergence.audit(more).collect()} == brute_audit(made)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    con.execute(ORACLE["op12_divergence"])
    names = [d[0] for d in con.description]
    found = QUERIES["op12_divergence"](spark, folder)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(con.fetchall())


def test_gallop_and_share():
    rng = np.random.default_rng(3)
    for few, many in ((0, 5), (5, 0), (1, 1), (3, 1000), (700, 900), (900, 10)):
        needles, hay = (np.sort(rng.choice(1200, k, replace=False)).astype(np.int64) for k in (few, many))
        assert divergence.gallop(needles, hay).tolist() == np.searchsorted(hay, needles).tolist()
    for count, total, v in ((0, 0, 1), (7, 10**15, 10**6), (10**15, 10**15, 3), (123456789, 987654321987, 77)):
        assert int(divergence.share(count, total, v)) == 1 + 10**9 * (count + 5) // (total + 5 * v)


def brute_covariance(x):
    """Exact covariance, as fractions."""
    n, columns = len(x), list(zip(*x, strict=True))
    sums = [sum(c) for c in columns]
    return [[Fraction(n * sum(a * b for a, b in zip(p, q, strict=True)) - sp * sq, n * n) for q, sq in zip(columns, sums, strict=True)]
            for p, sp in zip(columns, sums, strict=True)]


def test_whitening_of_the_table(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = QUERIES["op13_whitening"](spark, folder).collect()
    given = {r.vec_id: [int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in r.embedding] for r in vectors.collect()}
    n, x = len(given), np.array(list(given.values()), object)
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    sums = x.sum(axis=0)
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in given.items()}
    assert all(r.deviation == deviation[r.vec_id] for r in rows)
    v = np.array([[float(f) for f in row] for row in brute_covariance(x.tolist())])
    values, turned = np.linalg.eigh(v)
    values, turned = values[::-1], turned[:, ::-1]
    got = {(r.vec_id, r.component): r.whitened for r in rows}
    ids = list(given)
    centred = np.array([[(n * a - s) / n for a, s in zip(given[i], sums, strict=True)] for i in ids], float)
    for c in range(32):
        want, mine = centred @ turned[:, c] / np.sqrt(values[c]), np.array([got[i, c + 1] for i in ids])
        assert min(np.abs(want - mine).max(), np.abs(want + mine).max()) < 1e-9
    for r in rows:
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9
    white = np.array([[got[i, c + 1] for c in range(32)] for i in ids])
    error = np.abs(white.T @ white / n - np.outer(white.mean(0), white.mean(0)) - np.eye(32)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9 and abs(rows[0].identity_error - error) < 1e-9


def test_refined_eigenvectors_split_clusters():
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q + q @ (np.eye(24, dtype=np.longdouble) - q.T @ q) / 2
    values = np.concatenate([1 + np.arange(5) * 1e-9, 0.5 + np.arange(4) * 1e-12, [0.25] * 3, np.linspace(0.01, 0.2, 12)]).astype(np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined_eigenvectors(a)
    assert np.abs(np.sort(found) - np.sort(values)).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-17
    single = np.argsort(-values)[:5]  # told apart by 1e-9: eight digits more than double precision vectors of float32 would have
    for k, c in enumerate(single):
        assert min(np.abs(x[:, k] - q[:, c]).max(), np.abs(x[:, k] + q[:, c]).max()) < 1e-9
    zero, same = whitening.refined_eigenvectors(np.zeros((3, 3), np.longdouble))
    assert not zero.any() and (same == np.eye(3)).all()


@pytest.mark.parametrize("large", [1.0, 1e12])
def test_exact_products(spark, large):
    rng = np.random.default_rng(2)
    c = np.floor(rng.normal(size=(50, 3)) * large * 100)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<double>")
    x = [[int(64 * a) + 1_000_000 for a in v] for v in c.tolist()]
    rows = whitening.whiten(frame).collect()
    sums = [sum(col) for col in zip(*x, strict=True)]
    exact = [sum((50 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, e if e < 2**63 else None) for i, e in enumerate(exact)}
    assert rows[0].identity_error < 1e-12
    trace = sum(row[i] for i, row in enumerate(brute_covariance(x)))
    assert abs(sum(r.explained for r in rows) / 50 - 1) < 1e-12 and trace > 0


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, n long, dim int"
    rows = [(1, [1.0, 2.0], 1), (2, [3.0, -1.0], None), (3, None, 1), (4, [], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1),
            (8, [1.0, 2.0, 3.0], 1), (None, [0.5, 0.5], 1), (2, [3.0, -1.0], 1), (9, [1e30, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    found = whitening.whiten(frame).collect()
    assert Counter((r.vec_id, r.component) for r in found) == Counter({(i, c): 1 + (i == 2) for i in (1, 2, None) for c in (1, 2)})
    assert found[0].identity_error < 1e-12
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame.where("vec_id = 3")).count() == 0
    alone = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in alone] == [(None, 0, 0.0, None)] * 2
