"""Toxicity against a plain re-implementation: voters by counting, dense EM, dense Newton, scores by loops."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import toxicity

WORD = re.compile(r"[^\W\d_]+")


def table(n=900, seed=4):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("tree", "river", "stone", "cloud", "paper", "glass") for b in ("side", "way", "work", "line", "house")]
    bad = ["grobnak", "zurtish", "idiot", "moron", "vexling", "krumpf"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 40))]
        for w in bad:
            if rng.random() < (0.45 if toxic else 0.01):
                words += [w] * rng.randrange(1, 4)
        rng.shuffle(words)
        docs.append((i, " ".join(words) + rng.choice(["", "!!!", "."])))
        labels.append((i, 1, int(toxic != (rng.random() < 0.05))))
    return docs, labels


def stems(word):
    return {f"={word}", *(word[:n] for n in range(4, min(8, len(word) - 1) + 1))}


def voters(rows):
    """The 400 voters of largest G among those that three toxic rows hold and that toxic rows hold half as often again as expected."""
    toxic, clean = Counter(), Counter()
    for text, y in rows:
        (toxic if y else clean).update({s for w in set(WORD.findall(text.lower())) for s in stems(w)})
    n, p = len(rows), sum(y for _, y in rows)
    term = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
    found = []
    for s, a in toxic.items():
        k, share = a + clean[s], p / n
        g = 2 * (term(a, k * share) + term(k - a, k * (1 - share)) + term(p - a, p - k * share) + term(n - p - k + a, (n - p) - k * (1 - share)))
        if a >= 3 and a > k * share * 1.5 and k < n and g >= 24:
            found.append((-g, s))
    chosen = [s for _, s in sorted(found)[:400]]
    return chosen + [f"={w}" for w in toxicity.LEXICON if f"={w}" not in chosen]


def features(text, names):
    counts = Counter(WORD.findall(text.lower()))
    hits = [sum(k for w, k in counts.items() if v in stems(w)) for v in names]
    patterns = [float(bool(p.search(text))) for p in toxicity._PATTERNS]
    return [float(h > 0) for h in hits] + [math.log(h) if h else 0.0 for h in hits] + patterns


def plain_em(votes, y):
    """y: 1, 0, or -1 without an annotation."""
    n, m = votes.shape
    post, share = np.select([y == 1, y == 0], [0.95, 0.05], 0.1), np.ones(m)
    silent = np.ones(m)
    for step in range(15):
        seen = np.flatnonzero(y >= 0) if step == 0 else np.arange(n)
        p, rows = post[seen], votes[seen]
        prior = min(max((p.sum() + 1) / (len(seen) + 10), 1e-4), 0.9)
        hit = np.clip((p @ rows + 1) / (p.sum() + 2), 1e-6, 1 - 1e-6)
        miss = np.clip(((1 - p) @ rows + 1) / ((1 - p).sum() + 2), 1e-6, 1 - 1e-6)
        if step in (1, 7):
            r = votes - np.outer(post, hit) - np.outer(1 - post, miss)
            sd = np.sqrt((r**2).mean(0)) + 1e-9
            corr = r.T @ r / n / np.outer(sd, sd)
            share = 1 / np.maximum(1, np.where(corr > 0.2, corr**2, 0).sum(1))
            silent = 1 / np.maximum(1, np.where(corr > 0.2, corr, 0).sum(1))
        odds = np.full(n, math.log(prior / (1 - prior)))
        for j in range(m):
            odds += np.where(votes[:, j] == 1, share[j] * math.log(hit[j] / miss[j]), silent[j] * math.log((1 - hit[j]) / (1 - miss[j])))
        given = y >= 0
        sens = min(max((post * (y == 1)).sum() / (post * given).sum(), 0.75), 0.995)
        spec = min(max(((1 - post) * (y == 0)).sum() / ((1 - post) * given).sum(), 0.75), 0.995)
        says = np.select([y == 1, y == 0], [math.log(sens / (1 - spec)), math.log((1 - sens) / spec)], 0.0)
        post = 1 / (1 + np.exp(-np.clip(np.clip(odds, -30, 30) + says, -30, 30)))
    return post


def plain_logistic(x, t):
    """Newton steps without blocks or sparsity, far past convergence."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1], 0.2), 1e-3]
    w = np.zeros(a.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (p - t) + penalty * w)
        w = w - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
    return w


def test_scores_equal_the_plain_version(spark):
    docs, labels = table()
    labels = [r for r in labels if r[0] % 3]  # every third document has no annotation
    truth = {i: y for i, _, y in labels}
    in_training = [(t, truth.get(i, -1)) for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    names = voters([(t, y) for t, y in in_training if y >= 0])
    x = np.array([features(t, names) for t, _ in in_training])
    y = np.array([y for _, y in in_training])
    n = len(names)
    post = plain_em(np.hstack([x[:, :n], x[:, 2 * n :]]), y)
    sure = (y >= 0) | (post < 0.1) | (post > 0.9)
    assert (y < 0).any() and not sure.all() and post[(y < 0) & sure].max() > 0.9
    assert ((post >= 0.5) != (y == 1))[y >= 0].any()  # the voters outvote wrong annotations
    w = plain_logistic(x[sure], post[sure])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(model.voters) == sorted(names)
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(np.array(features(t, names)) @ w[:-1] + w[-1]))), abs=1e-5)
    held = [(got[i] >= 0.5, y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.85


def test_sample_of_both_kinds(spark):
    docs = [(i, f"text {i}") for i in range(2000)] + [(7, "again"), (7, "again"), (None, "no id")]
    labels = [(i, 1, i % 2) for i in range(0, 1000)] + [(3, 1, 0), (None, 1, 1), (1500, 1, None), (9_999, 1, 1)]
    sample = lambda a, b: {
        r.doc_id: (r.toxic, r.text)
        for r in toxicity.fitting_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text", a, b).collect()
    }
    out = {i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = sample(10_000, 10_000)
    assert set(got) == set(range(2000)) - out and got[7][1] in ("text 7", "again")
    assert all(t == (i % 2 if i < 1000 else None) for i, (t, _) in got.items())
    few = sample(100, 200)
    assert 50 < sum(t is not None for t, _ in few.values()) < 160 and 80 < sum(t is None for t, _ in few.values()) < 260
    assert set(few.items()) <= set(got.items())
