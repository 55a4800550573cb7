"""Jaccard join, components, toxicity and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cohortspark.llm import jaccard, toxicity
from cohortspark.llm.components import components
from tests.llm.test_dedup import lines_brute

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, threshold):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)) and 100 * len(a & b) >= threshold * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_query_against_all_pairs(spark, texts):
    got = jaccard.op7_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == brute(list(texts.items()), 4, 85)


def near_copies(seed, families=6, size=14, words=70):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = [f"w{x}" for x in rng.integers(0, 10**6, words + 40 * f)]
        for k in range(size):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 8)):
                text[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    return rows + [(i + 10_000, " ".join(f"s{x}" for x in range(i % 9))) for i in range(20)]


@pytest.mark.parametrize("n,threshold,block", [(4, 85, 1000), (5, 80, 4), (2, 60, 3)])
def test_near_copies(spark, monkeypatch, n, threshold, block):
    """Small blocks cut the families into several tiles."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = near_copies(threshold)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, threshold=threshold).collect()
    assert Counter(map(tuple, got)) == brute(rows, n, threshold)


def test_join_cases(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(map(tuple, jaccard.jaccard_components(odd_docs).collect())) == brute(rows, 5, 80)
    assert jaccard.jaccard_components(no_docs).collect() == []


@pytest.mark.parametrize("threshold", [60, 80, 85, 95])
def test_linked_sets_share_a_key(threshold):
    rng, pairs = np.random.default_rng(threshold), 0
    for _ in range(1500):
        size = int(rng.choice([2, 6, 7, 8, 9, 12, 15, 20, 31, 60, 150]))
        a = set(rng.integers(0, 1 << 62, size).tolist())
        out = rng.integers(0, size * (100 - threshold) // 100 + 1)
        b = set(list(a)[out:]) | set(rng.integers(0, 1 << 62, rng.integers(0, 1 + size * (100 - threshold) // 100)).tolist())
        if a != b and 100 * len(a & b) >= threshold * len(a | b):
            pairs += 1
            for share in (0, 3, 10):  # whatever counts as common
                common = np.array(sorted(x for x in a | b if x % 10 < share), np.uint64)
                keys = [jaccard.join_keys(np.array(sorted(s), np.uint64), threshold, common) for s in (a, b)]
                assert len(np.intersect1d(*keys))
    assert pairs > 100 or threshold == 95


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_stars_do_not_depend_on_batches():
    import pyarrow as pa

    rows = np.array(sorted((k, h) for k in range(9) for h in range(k % 4 + 1)), np.int64)

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size, c].copy()) for c in (0, 1)], names=["key", "h1"]) for i in range(0, len(rows), size)]
        return {tuple(r.values()) for b in jaccard.star_edges(iter(batches)) for r in b.to_pylist()}

    assert run(1) == run(3) == run(100)


def test_label_model_weighs_voters_by_accuracy_and_correlation():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    vote = lambda hit, miss: np.where(y, rng.random(4000) < hit, rng.random(4000) < miss).astype(float)
    good, noise = vote(0.7, 0.01), vote(0.3, 0.3)
    votes = np.stack([good, good, good, vote(0.6, 0.02), noise], 1)
    given = np.where(rng.random(4000) < 0.1, ~y, y).astype(int)  # annotations with a tenth of errors
    model, post = toxicity.fit_label_model(toxicity.Sparse.of(votes), given)
    assert abs(model.fire_toxic[0] - 0.7) < 0.06 and abs(model.fire_clean[0] - 0.01) < 0.02
    assert model.share[0] < 0.5 < 0.9 < model.share[3]
    assert ((post > 0.5) == y).mean() > (given == y).mean() + 0.02


def test_classifier_follows_soft_targets():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    w, b = toxicity.fit_classifier(toxicity.Sparse.of(x), 1 / (1 + np.exp(-(2 * x[:, 0] - 1))), ridge=1e-3)
    assert abs(w[0] - 2) < 0.05 and abs(w[1]) < 0.05 and abs(b + 1) < 0.05


def test_classifier_on_separable_repeated_columns():
    """Many equal columns that tell the classes apart without error: the weights stay small and the scores right."""
    rng = np.random.default_rng(4)
    y = (rng.random(6000) < 0.1).astype(float)
    word = [y * (rng.random(6000) < 0.5) for _ in range(10)]
    x = np.stack([c for c in word for _ in range(4)] + [c * rng.integers(0, 3, 6000) for c in word], 1)
    w, b = toxicity.fit_classifier(toxicity.Sparse.of(x), np.where(y > 0, 0.9999, 0.0001))
    scores = 1 / (1 + np.exp(-(x @ w + b)))
    hit = x.any(1)
    assert np.abs(w).max() < 50 and abs(b) < 50
    assert (scores[hit] > 0.5).all() and (scores[~hit] < 0.5).all()


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op6_weak_supervision(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(rows.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    seen = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    seen = seen[seen.held_out]
    assert (seen[seen.toxic == 1].predicted == 1).mean() > 0.85 and (seen[seen.predicted == 1].toxic == 1).mean() > 0.95


def test_held_out_labels_do_not_matter(spark, texts):
    ids = sorted(texts)
    docs = spark.createDataFrame([(i, ("you idiot moron " if i % 3 == 0 else "fine words ") + str(i)) for i in ids], "doc_id long, text string")
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, 1, int(i % 3 == 0) ^ (flip if i in out else 0)) for i in ids], "doc_id long, quality int, toxic int")
        model = toxicity.fit(docs, labels)
        scores.append(sorted(map(tuple, toxicity.score(docs, model).collect())))
    assert scores[0] == scores[1] and all((s > 0.5) == (i % 3 == 0) for i, s in scores[0])


def test_toxicity_cases(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, none)
    rows = toxicity.score(odd_docs, model, keep="rate").collect()
    assert len(rows) == odd_docs.count() and all(0 < r.rate < 0.5 for r in rows)
    bad = toxicity.score(spark.createDataFrame([(1, "You idiot, you moron!")], "doc_id long, text string"), model).first()
    assert bad.score > 0.5
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).collect() == []


def first_lines(rows, least):
    """Each shared line stays at its smallest (doc_id, position) only; equal rows count as copies."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    shared = {k for k in {key(x) for _, t in rows for x in (t or "").split("\n")} - {""} if len({(d, t) for d, t in rows if k in map(key, (t or "").split("\n"))}) >= least}
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        keep = []
        for line in (t or "").split("\n"):
            if key(line) not in shared or key(line) not in seen:
                keep.append(line)
            seen.add(key(line))
        out.append((d, "\n".join(keep)))
    return out


def test_pipeline_against_brute_force(spark, odd_docs, tmp_path):
    rows = [(i * 2, f"{'You idiot moron loser scum. ' * 3 if i % 7 == 0 else ''}{t}\nshared line\nown {i}") for i, (_, t) in enumerate(near_copies(3, 3, 6))]
    rows = [*rows, *[(5000 + i, t) for i, (_, t) in enumerate((r.doc_id, r.text) for r in odd_docs.collect())], (None, "stray")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int("idiot" in t)) for i, t in rows if i is not None and t and i < 200], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clean = [(i, t) for i, t in rows if "idiot" not in (t or "")]
    cut = first_lines(clean, 10)
    groups = {}
    for (d, _, c), n in brute(cut, 5, 80).items():
        groups[d] = c
    want = Counter((d, len(t.encode().split())) for d, t in cut if d is None or groups[d] == d)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    """Of 25 exact and of 25 near copies (one line of each differs) one document reaches packing with its full text."""
    body = "\n".join(f"line {i} of {t}" for i, (_, t) in enumerate(near_copies(5, 12, 1)))
    near = "\n".join(f"row {i} in {t}" for i, (_, t) in enumerate(near_copies(8, 12, 1)))
    rows = [(100 + i, body) for i in range(25)] + [(200 + i, f"{near}\nown {i}") for i in range(25)] + [(300, "alone")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cut = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()}
    assert cut[100] == body and cut[200] == f"{near}\nown 0" and {cut[100 + i] for i in range(1, 25)} == {""}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got[100] == len(body.split()) and got[200] == len(near.split()) + 2 and got[300] == 1
    assert [i for i, n in got.items() if n > 2] == [100, 200]


def test_stages_keep_the_columns(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "packing"]
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "n_tokens", "bucket", "pad_to", "batch", "slot"] and out.count() == docs.count()
