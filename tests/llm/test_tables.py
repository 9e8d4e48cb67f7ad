"""Vectors, URLs and the pipeline."""

import time
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from datamove.llm import embedding_dedup, graph, language_id, toxicity, url_rules
from test_documents import brute_kept


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    x[100:300] = x[5] + rng.normal(size=(200, 16)) * 0.15
    x[400:500] = x[6]
    x[600:650] = x[500:550] * 3 + rng.normal(size=(50, 16)) * 0.2
    label = [int(i % 3) for i in range(700)]
    for i in range(600, 650):
        label[i] = label[i - 100]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(700)]
    rows[10], rows[11], rows[12], rows[13], rows[14] = (10, None, 0), (11, [0.0] * 16, 0), (12, [float("nan")] * 16, 0), (13, rows[5][1], None), (14, [1.0, None], 1)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [i for i in range(700) if i not in (10, 11, 12, 13, 14)]
    y = np.array([np.float32(rows[i][1]) for i in good], float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = (y @ y.T >= 0.93) & (np.array([label[i] for i in good])[:, None] == np.array([label[i] for i in good])[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i in good])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (10, 11, 12, 13, 14))
    assert len(got) == 700 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _exact(spark, x):
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, [float(v) for v in y], 0) for i, y in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y @ y.T >= 0.93
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (least == label).all():
            break
        label = least
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_components_need_few_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    plans = []
    cut = graph.cut_lineage
    spark.sparkContext.setJobGroup("components", "components")
    try:
        graph.cut_lineage = lambda df: plans.append(df) or cut(df)
        found = {r.node: r.component for r in graph.components(edges).collect()}
    finally:
        graph.cut_lineage = cut
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    steps = len(plans) - 1
    assert len(tracker.getJobIdsForGroup("components")) <= 10 * (steps + 1)


def _two_groups(rng, size):
    centres = np.zeros((2, 64))
    centres[0, 0], centres[1, :2] = 1, (0.95, (1 - 0.95 ** 2) ** 0.5)
    return np.repeat(centres, size, axis=0) + rng.normal(size=(2 * size, 64)) * 0.1 / 64 ** 0.5


def test_links_between_dense_groups(spark):
    _exact(spark, _two_groups(np.random.default_rng(3), 120))


def test_dense_groups_and_rare_pairs_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x[700:720] = x[:20] + rng.normal(size=(20, 64)) * 0.2
    x[1000:1060] = 8 * _two_groups(rng, 30)
    for name, value in (("BLOCK", 32), ("TILE", 200), ("AUDITED", 100), ("LINKED", 8)):
        monkeypatch.setattr(embedding_dedup, name, value)
    monkeypatch.setattr(embedding_dedup, "WANTED_RECALL", 1.0)
    _exact(spark, x)


def test_audit_goes_on_until_links_are_seen(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 64))
    x[600:603] = x[:3] + rng.normal(size=(3, 64)) * 0.2
    for name, value in (("BLOCK", 8), ("NEIGHBOURS", 2), ("ROUNDS", 1)):  # few pairs are met by chance
        monkeypatch.setattr(embedding_dedup, name, value)
    _exact(spark, x)


def test_url_rules(spark):
    urls = ["http://x.COM/a", "https://example.com/en/1?q", "https://WWW.example.com/en/#x", "http://a.net/es/2", "http://a.net/espana/", "nothing", None, "http://com", "http://b.org/fr/3",
            "http://b.org/fr/4", "://c.net/fr/"]
    want = [("x.com", "/a", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("a.net", "/es/2", "net/es/", "block"),
            ("a.net", "/espana/", None, None), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, None), ("b.org", "/fr/3", None, "block"), ("b.org", "/fr/4", None, "block"), ("c.net", "/fr/", "net/fr/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(8, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.filter_urls(pages, labels).collect()}
    assert len(got) == len(urls)
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_rules.filter_urls(pages.where("false"), labels).count() == 0


def test_mined_rules_against_brute_force(spark):
    baskets = [(["a", "b"], "block"), (["a", "b", "c"], "block"), (["a"], "allow"), (["c"], "allow"), (["b"], "block"), (["a", "c"], "allow")]
    rules = {tuple(r.antecedent): (r.verdict, round(r.confidence, 6)) for r in url_rules.mine(spark.createDataFrame(baskets, "items array<string>, verdict string"), 0.1, 0.6).collect()}
    want = {}
    for items in {c for n in (1, 2, 3) for b, _ in baskets for c in combinations(sorted(b), n)}:
        holds = [v for b, v in baskets if set(items) <= set(b)]
        want.update({items: (v, round(holds.count(v) / len(holds), 6)) for v in set(holds) if holds.count(v) / len(holds) >= 0.6})
    best = {k: v for k, v in want.items() if not any(set(o) < set(k) and w[0] == v[0] and w[1] >= v[1] for o, w in want.items())}
    assert rules == best


def test_long_shared_paths_are_mined_in_bounded_work(spark):
    segments = [f"path:s{i}" for i in range(24)]
    rows = [(sorted(["site:a.org", *segments]), "block")] * 300 + [(sorted({"site:b.org", *segments} - {segments[i % 24]}), "allow") for i in range(480)]
    rows += [(["site:c.org", f"path:x{i % 9}"], "block" if i % 9 < 3 else "allow") for i in range(900)]
    start = time.perf_counter()
    rules = {tuple(r.antecedent): r.verdict for r in url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string")).collect()}
    assert time.perf_counter() - start < 60
    assert rules["site:a.org",] == "block" and rules["site:b.org",] == "allow" and rules["path:x1",] == "block" and rules["path:x5",] == "allow"
    same = [(["path:a", "path:bb", "path:c"], "block")] * 5 + [(["path:d"], "allow")] * 5
    assert [r.antecedent for r in url_rules.mine(spark.createDataFrame(same, "items array<string>, verdict string")).orderBy("verdict").collect()] == [["path:d"], ["path:a"]]


def test_rules_of_long_urls_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    baskets = [(sorted(str(x) for x in rng.choice(list("abcdefgh"), 2 + i % 6, replace=False)), "block" if rng.random() < 0.5 else "allow") for i in range(60)]
    labelled = spark.createDataFrame(baskets, "items array<string>, verdict string")
    want = {}
    for items in {c for n in (1, 2, 3) for b, _ in baskets for c in combinations(b, n)}:
        holds = [v for b, v in baskets if set(items) <= set(b)]
        want.update({(items, v): holds.count(v) / len(holds) for v in set(holds) if holds.count(v) >= 6 and holds.count(v) / len(holds) >= 0.6})
    best = {(k, v): c for (k, v), c in want.items() if not any(set(o) < set(k) and w == v and d >= c for (o, w), d in want.items())}
    for most in (0, 3, 5, 12):  # all baskets extended token by token, some, none
        monkeypatch.setattr(url_rules, "BASKET_ITEMS", most)
        rules = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_rules.mine(labelled, 0.1, 0.6).collect()}
        assert best and rules.keys() == best.keys() and all(abs(rules[k] - best[k]) < 1e-9 for k in best)


def test_tokens_beyond_twelve_of_a_url_are_mined(spark):
    # thirteen tokens, each in URLs of both verdicts; only the pair of the two that tell least decides
    rows = [(sorted([*(f"t{i:02}" for i in range(13) if i != j % 13), "y", "z"]), "block") for j in range(130)]
    rows += [(sorted([*(f"t{i:02}" for i in range(13) if i != j % 13), "yz"[j % 2]]), "allow") for j in range(260)]
    rules = {tuple(r.antecedent): r.verdict for r in url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string")).collect()}
    assert rules["y", "z"] == "block"


def test_each_of_equivalent_tokens_matches(spark):
    pages = spark.createDataFrame([(i, "http://a.org/long/b/c/" if i < 20 else "http://a.org/d/") for i in range(40)] + [(50, "http://e.org/long/"), (51, "http://e.org/b/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, int(i < 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.matched) for r in url_rules.filter_urls(pages, labels.withColumn("quality", F.lit(1)), default="none").collect()}
    assert got[50] == ("block", "path:long") and got[51] == ("block", "path:b")


def test_judgement_against_all_rules(spark, folder):
    pages, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "labels"))
    kept = []
    keep = url_rules.mine
    url_rules.mine = lambda labelled: kept.append(keep(labelled)) or kept[-1]
    try:
        rows = url_rules.filter_urls(pages, labels).collect()
    finally:
        url_rules.mine = keep
    rules = [(r.confidence, r.support, len(r.antecedent), r.verdict, set(r.antecedent)) for r in kept[0].collect()]
    items = {r.page_id: set(r.i) for r in pages.select("page_id", url_rules.tokens(*url_rules.host_and_path(F.col("url"))).alias("i")).collect()}
    assert rules
    for r in rows:
        if r.rule is None:
            fitting = [x for x in rules if x[4] <= items[r.page_id]]
            best = max(x[:3] for x in fitting) if fitting else None
            assert r.verdict in ({x[3] for x in fitting if x[:3] == best} if fitting else {"allow"})


def test_copies_are_dropped_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a), (1, a), (5, a + " end"), (5, b), (None, b + " end"), (None, c), (None, c + " end"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_copies(spark, docs, "").collect()))
    assert len(kept) == 5 and kept[0][1] in (c, c + " end") and kept[1:] == [(1, a), (1, a), (5, b), (7, "")]


def test_pipeline(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder)
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0.8 * docs.count() < len(kept) < docs.count()


def test_pipeline_against_brute_force(spark, folder, tmp_path):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    few = [tuple(r) for r in given.limit(60).collect()]
    few += [(1000 + i, few[i][1] + " one more word", *few[i][2:]) for i in range(8)]
    few += [(None, few[9][1], "en", "x", 1), few[10], (2001, None, None, None, None), (2002, "", "en", "x", 0), (2003, "you are an idiot", "en", "x", 1),
            (2004, "12 34", "en", "x", 5), (few[0][0], few[11][1], "en", "x", 3)]
    docs = spark.createDataFrame(few, given.schema).coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for place in (tmp_path, tmp_path / "none"):
        labels.write.parquet(f"{place}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = toxicity.fit(docs, labels)
    grammar = toxicity.Grammar(model.learned)
    clean = [tuple(r) for r in docs.collect() if np.log1p(grammar.matches(r.text or "")) @ model.weights + model.bias < 0]
    speaker = language_id.fit(spark.createDataFrame(clean, given.schema))
    known = [r for r, (lang, p) in zip(clean, map(speaker.predict, language_id.features([r[1] or "" for r in clean])), strict=True) if lang != "und" and p >= 0.3]
    label, sets = brute_kept([r[:2] for r in known], 5, 80)
    first = {}
    for r, x in zip(known, label, strict=True):
        first[x] = min(first.get(x, (True, 0)), (r[0] is None, r[0] or 0))
    stay = [r for r, x, s in zip(known, label, sets, strict=True) if not s or (r[0] is None, r[0] or 0) == first[x]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    want = sorted((r[0] is None, r[0] or 0, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in stay)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n for *_, n in want)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
