"""The text operators against brute force, on odd rows and on a given table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from datamove.llm import fingerprints, hmm, language_id, ngram_join, packing, sharding, toxicity, trie_bpe
from datamove.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(params=["odd", "given"])
def table(request, odd_docs, docs):
    return odd_docs if request.param == "odd" else docs


def test_ngram_groups(table):
    for width, percent in ((3, 90), (5, 80)):
        rows = [(r.doc_id, shingles(r.text, width)) for r in table.collect()]
        label = list(range(len(rows)))
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows[:i]):
                if a and 100 * len(a & b) >= percent * len(a | b):
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
        least = defaultdict(lambda: None)
        for (d, _), x in zip(rows, label):
            if d is not None:
                least[x] = d if least[x] is None else min(least[x], d)
        want = Counter((d, len(s), least[x] if s else d) for (d, s), x in zip(rows, label))
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(table, width, percent).collect())
        assert got == want


def test_tile_keys_miss_no_pair():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in [5, 9, 10, 15, 22, 40, 200, 601]:
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(20):
                gone = rng.integers(0, n * (100 - percent) // 100 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, rng.integers(0, n // 10 + 1), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if ngram_join.linked(common, len(a) + len(b), percent) and not np.array_equal(a, b):
                    for left_out in (0, 0.1, 0.3, 0.5, 0.7, 1):  # shares of the shingles that count as common
                        frequent = np.sort(rng.permutation(np.union1d(a, b))[: int(left_out * len(np.union1d(a, b)))])
                        assert set(ngram_join.tile_keys(a, percent, frequent)) & set(ngram_join.tile_keys(b, percent, frequent))


def test_common_shingles_are_left_out(spark, monkeypatch):
    """A passage in many unrelated texts is found to be common, and leaving it out changes no link."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(map(str, rng.integers(0, 10**6, 40))) + " " + passage for _ in range(50)]
    texts += [t + " more" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = []
    keep = ngram_join._common
    monkeypatch.setattr(ngram_join, "_common", lambda shared: found.append(keep(shared)) or found[-1])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(docs, 5, 80).collect()}
    assert len(found[0]) == 56
    assert got == {i: i - 50 if i >= 50 else i for i in range(55)}


def test_fingerprints(table):
    rows = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""), reverse=True)
    got = defaultdict(list)
    for r in fingerprints.fingerprint_documents(table).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    errors, prints = [], {}
    for r, following in zip(rows, [*rows[1:], rows[0]]):
        text, after = r.text or "", following.text or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        match = [g for g in got[r.doc_id] if (g.n_chars, g.edited_sha256) == (len(text), sha(edited))]
        assert match
        assert prints.setdefault(text, match[0].fingerprint) == match[0].fingerprint
        a, b = shingles(text, 5), shingles(edited, 5)
        if len(a) > 30:
            errors.append(match[0].near_edited - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.06


def test_bpe(table):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for r in table.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in trie_bpe.encode_documents(table, WORD).collect()) == want


@pytest.mark.parametrize("text", ["", " ", "a  b", "ΣΑΣ İstanbul", "a\x1cb", "x 　y\x85z", "<|endoftext|>it's<|startoftext|> b", "é ́ x", "ab" * 400, "</w> x</w>y", "\x00 � ﬁ 각 ½"])
def test_bpe_odd_texts(text):
    library, own = Tokenizer.from_file(WORD), trie_bpe.tokenizer(WORD)
    ids = library.encode(text, add_special_tokens=False).ids
    (got,) = own.encode_batch([text])
    assert got == " ".join(map(str, ids)) and own.decode(got) == library.decode(ids, skip_special_tokens=False)
    plain = Tokenizer.from_file(BYTE)
    assert packing.encoder(BYTE).encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(table):
    library, rows = Tokenizer.from_file(BYTE), packing.pack(table, BYTE).collect()
    want, total = Counter(), 0
    for r in table.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.doc_id] += n
        total += n
    got, sequences = Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.05 * total + 1024 * 12


def test_sharding(table):
    rows, n = sharding.interleave(table).collect(), table.count()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert max(map(len, slots.values())) - min(len(slots.get(i, [])) for i in range(16)) <= 1
    per_source = Counter((r.shard, r.source_name) for r in rows)
    for source, of in Counter(r.source_name for r in rows).items():
        assert all(abs(per_source[i, source] - of / 16) <= 1.5 for i in range(16)), (source, n)


def test_hmm(table):
    rows = table.collect()
    train = [w for r in rows if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 for w in [*words(r.text), None]]
    c = Counter(train)
    base = lambda ws: sum(log10((c[w] + 0.1) / (len(train) + 0.1 * (len(c) + 1))) for w in ws)
    got = defaultdict(list)
    for r in hmm.score_documents(table).collect():
        got[r.doc_id].append(r)
        assert r.train_tokens == len(train) and np.isfinite(r.score) and r.score < 0
    for r in rows:
        ws = [*words(r.text), None]
        assert any(g.n_tokens == len(ws) and g.n_known == sum(c[w] > 0 for w in ws) and g.base_score == pytest.approx(base(ws)) for g in got[r.doc_id])


def test_hmm_score_is_the_forward_probability(table, monkeypatch):
    sent = []
    keep = hmm._score
    monkeypatch.setattr(hmm, "_score", lambda *a: sent.append([x.value for x in a]) or keep(*a))
    got = Counter((r.doc_id, round(r.score, 6)) for r in hmm.score_documents(table).collect())
    model, classes, stats = sent[0]
    counts = Counter(w for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 10 or r.doc_id is None for w in words(r.text))
    least = min((n for n in set(counts.values()) if sum(m >= n for m in counts.values()) <= hmm.FREQUENT), default=0)
    frequent = {w for w, n in counts.items() if n >= least}
    assert len(classes.words) == len(frequent)
    want = Counter()
    for r in table.collect():
        log, a = 0.0, None
        column = pa.array([r.text or ""])
        number, n = [], []
        for *_, hashed, ending, _ in hmm.words_of(column):
            number += classes.of(hashed, ending).tolist()
        for w, c in zip(words(r.text), number, strict=True):
            assert (c <= hmm.FREQUENT) == (w in frequent)
            n.append(counts[w])
        for c, m in zip([*number, 0], [*n, 0], strict=True):
            a = (model.start if a is None else a @ model.move) * model.emit[c]
            log += log10(a.sum())
            a = a / a.sum()
            if c > hmm.FREQUENT:
                log += log10((m + 0.1) / (stats.total[c] + 0.1 * (stats.words[c] + 1)))
        want[r.doc_id, round(log, 6)] += 1
    near = lambda x: sorted((d is None, d or 0, s) for (d, s), k in x.items() for _ in range(k))
    assert [x[:2] for x in near(got)] == [x[:2] for x in near(want)]
    assert np.allclose([x[2] for x in near(got)], [x[2] for x in near(want)], rtol=0, atol=1e-4)
    assert abs(sum(stats.words) - sum(1 for w in counts if w not in frequent)) < 1e-9


def test_hmm_trains_on_all_texts(docs, monkeypatch):
    seen = []
    keep = hmm.counts_under
    monkeypatch.setattr(hmm, "counts_under", lambda frame, model: seen.append(keep(frame, model)) or seen[-1])
    scored = hmm.score_documents(docs).collect()
    tokens = scored[0].train_tokens
    assert len(seen) == hmm.PARTS * hmm.PART_PASSES + hmm.ROUNDS
    for first in range(0, hmm.PARTS * hmm.PART_PASSES, hmm.PARTS):
        assert sum(c[: hmm.CLASSES].sum() for c in seen[first : first + hmm.PARTS]) == pytest.approx(tokens)
    assert all(c[: hmm.CLASSES].sum() == pytest.approx(tokens) for c in seen[-hmm.ROUNDS :])
    held = [(r.score, r.base_score) for r in scored if r.held_out]
    assert sum(s for s, _ in held) > sum(b for _, b in held)


def test_hmm_recursions():
    model, rng = hmm.Hmm.first(), np.random.default_rng(1)
    model.emit[:] = rng.random(model.emit.shape)
    text = rng.integers(0, hmm.CLASSES, 5).astype(np.uint16)
    a = model.start * model.emit[text[0]]
    for x in text[1:]:
        a = (a @ model.move) * model.emit[x]
    assert model.log10([text, text[:1]])[0] == pytest.approx(log10(a.sum()))
    counts = model.expected(*hmm.cut_runs([text, np.zeros(300, np.uint16)]))
    assert counts[: hmm.CLASSES].sum() == pytest.approx(305) and counts[hmm.CLASSES : -2].sum() == pytest.approx(4 + 297)


def brute_kept(rows, width, percent):
    """Rows of (id, text) that stay when one document of each linked group does."""
    label = list(range(len(rows)))
    sets = [shingles(t, width) for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    return label, sets


def test_null_ids_bridge(spark):
    base = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(base[k:] + [f"v{i}" for i in range(k)]) for k in (0, 15, 30))
    for bridge in (None, 2):
        docs = spark.createDataFrame([(1, a), (bridge, b), (3, c), (None, "other words here only"), (bridge, b)], "doc_id long, text string")
        found = {(r.doc_id, r.component_id) for r in ngram_join.ngram_groups(docs).collect()}
        assert {x for x in found if x[0]} | {(None, 1)} == {(1, 1), (3, 1), (None, 1)} | {(x, 1) for x in [bridge] if x}
        assert bridge or (None, 1) in found
        assert (None, None) in found
    kept = ngram_join.drop_linked(docs, 3, 90).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "other words here only"), (1, a)]


def test_long_texts_of_repeated_lines_count_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)
    rows = [(i, ("same line again and again " * 200) + f"end{i} of it") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tiles = []
    keep = ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda *a: tiles.append(keep(*a)) or tiles[-1])
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(docs, 3, 40).collect()}
    assert found == dict.fromkeys(range(30), 0)
    assert tiles[-1].groupBy("grp", "x", "y").agg({"n_bytes": "sum"}).agg({"sum(n_bytes)": "max"}).first()[0] < 30 * 5200 / 3


def test_one_of_each_linked_group_stays(table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    label, sets = brute_kept(rows, 5, 80)
    groups = defaultdict(set)
    for (d, t), x, s in zip(rows, label, sets, strict=True):
        if s:
            groups[x].add((d is None, d or 0, t))
    kept = Counter((r.doc_id, r.text) for r in ngram_join.drop_linked(table).collect())
    given = Counter(rows)
    assert all(n == given[k] for k, n in kept.items())
    assert Counter(k for k, s in zip(rows, sets, strict=True) if not s) == Counter({k: n for k, n in kept.items() if not shingles(k[1], 5)})
    for members in groups.values():
        stay = [m for m in members if kept[m[1] if not m[0] else None, m[2]]]
        assert len(stay) == 1 and stay[0][:2] == min(members)[:2]


def test_boundaries_by_merges_equal_merging_from_scratch():
    bpe = trie_bpe.TrieBpe(WORD)
    rng = np.random.default_rng(8)
    tokens = sorted(bpe.vocab)[::7]
    inner = [t for t in tokens if not t.endswith(bpe.end)]
    for left, right in zip(rng.choice(inner, 4000), rng.choice(tokens, 4000)):
        left, right = str(left), str(right)
        if bpe.merged(bpe.symbols(left)) == [left]:
            assert bpe.fits(left, right) == (bpe.merged(bpe.symbols(left) + bpe.symbols(right)) == [left, right])
    for n in range(1, 9):  # equal ranks on both sides of a boundary
        for word in ("a" * n, "ab" * n, "na" * n):
            assert [next(t for t, i in bpe.vocab.items() if i == x) for x in bpe.encode_words([word])[word]] == bpe.merged(bpe.symbols(word + bpe.end))


def test_language(table, folder, spark):
    model = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    rows, lang = language_id.predict_documents(table, model).collect(), {r.doc_id: r.lang for r in table.collect()}
    assert len(rows) == table.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (4, 5, 6) and lang[r.doc_id] in (None, "en") and "key" in table.columns)
    assert "key" not in table.columns or {r.doc_id for r in rows if r.lang_pred == "und"} >= {4, 5, 6}
    known = [r.lang_pred == lang[r.doc_id] for r in rows if lang[r.doc_id] and r.lang_pred != "und" and "key" not in table.columns]
    assert not known or np.mean(known) > 0.95


def test_toxicity(table, folder, spark):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = toxicity.score_documents(table, model).collect()
    assert len(rows) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_step_groups_hold_one_tier(docs):
    rows = packing.pack(docs, BYTE).select("step_group", "tier", "sequence_id").distinct().collect()
    tiers, windows = defaultdict(set), Counter()
    for r in rows:
        tiers[r.step_group].add(r.tier)
        windows[r.step_group] += 1
    assert len({r.tier for r in rows}) > 1 and all(len(t) == 1 for t in tiers.values())
    assert all(n * min(tiers[g]) <= packing.STEP_TOKENS for g, n in windows.items())


def test_prior_does_not_move_with_the_sample(spark, monkeypatch):
    texts = [("you idiot", 1)] * 40 + [("plain text", 1)] * 60 + [("you idiot", 0)] * 30 + [("plain text", 0)] * 870
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, toxic int")
    whole = toxicity.fit(docs.select("doc_id", "text"), docs)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    assert abs(toxicity.fit(docs.select("doc_id", "text"), docs).bias - whole.bias) < 0.8


def test_grammar_scopes():
    g = toxicity.Grammar(["blurgo*"])
    found = lambda t: {o for o, n in zip(toxicity.OUTPUTS, g.matches(t)) if n}
    assert found("you idiot") == {"Ig"} and found("he is not an idiot") == {"Ign"} and found("They said: idiot") == {"Igr"}
    assert found("blurgoran, blurgo") == {"I"} and found("a clean text") == set()


def test_empty_table(odd_docs, spark, folder):
    none, labels = odd_docs.where("false"), spark.read.parquet(f"{folder}/labels.parquet")
    for df in (ngram_join.ngram_groups(none), fingerprints.fingerprint_documents(none), trie_bpe.encode_documents(none, WORD), packing.pack(none, BYTE),
               sharding.interleave(none), hmm.score_documents(none), language_id.predict_documents(none, language_id.fit(none)),
               toxicity.score_documents(none, toxicity.fit(none, labels))):
        assert df.count() == 0


def test_registered_on_whole_tables(spark, folder):
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op7_language_id", "op8_toxicity"):
        assert QUERIES[name](spark, folder).count() == n


def test_shingles_shared_in_a_run_are_counted_in_place():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in rng.integers(1, 12, 60)] + [np.array([5, 2**64 - 1], np.uint64)] * 3
    found, texts = np.unique(np.concatenate(sets), return_counts=True)
    for least in (2, 3, 9):
        held = list(sets)
        got, n = ngram_join.shared_by(held, least)
        assert got.tolist() == found[texts >= least].tolist() and n.tolist() == texts[texts >= least].tolist() and not held
    assert [len(x) for x in ngram_join.shared_by([np.array([1], np.uint64)], 3)] == [0, 0]
