"""Exact dedup and line dedup."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import lines
from cohortspark.llm.catalogue import ORACLES, QUERIES
from cohortspark.llm.exact import exact_dedup
from tests import compare as c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name, monkeypatch):
    monkeypatch.setitem(c.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(c.ORACLES, name, ORACLES[name])
    assert c.compare(spark, name, "/root/testdata/sf0.001") is None


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        low = min(ids) if ids else None
        kept = i == low if i is not None and low is not None else low is None
        out.append((i, low, len(groups[norm(t)]), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


def test_exact_cases(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(map(tuple, exact_dedup(odd_docs).collect())) == exact_brute(rows)


def test_exact_compares_content_when_digests_collide(odd_docs):
    """A digest of two bits puts different texts together; their content still parts them."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    weak = lambda text: F.unhex(F.lpad(F.conv((F.crc32(text.cast("binary")) % 4).cast("string"), 10, 16), 2, "0"))
    assert Counter(map(tuple, exact_dedup(odd_docs, digest=weak).collect())) == exact_brute(rows)


def test_exact_empty(no_docs):
    assert exact_dedup(no_docs).collect() == []


def lines_brute(rows, min_docs, min_chars=1, keep_first=False):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                found[key(x)].add((i, t or ""))
    hot = {k for k, v in found.items() if len(v) >= min_docs}
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if key(x) not in hot)) for i, t in rows)


@pytest.mark.parametrize("min_docs,min_chars,partitions", [(2, 1, 7), (3, 2, 1), (1, 1, 5)])
def test_lines_against_brute_force(spark, min_docs, min_chars, partitions):
    rows = [(i, "\n".join(f" Line {(i * j) % 11} \t" if (i + j) % 3 else "é" for j in range(i % 7))) for i in range(60)]
    rows += [(100 + i, "hot\nhot\nown %d" % i) for i in range(40)] + [(None, "hot\nx"), (3, None), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.line_dedup(docs, min_docs=min_docs, min_chars=min_chars, partitions=partitions)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == lines_brute(rows, min_docs, min_chars)


def test_lines_keep_first(spark):
    rows = [(i, f"same\nown {i}\nSAME ") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4, 9):
        got = {r.doc_id: r.text for r in lines.line_dedup(docs, min_docs=5, keep_first=True, partitions=parts).collect()}
        assert got == {i: f"same\nown {i}" if i == 0 else f"own {i}" for i in range(30)}


def test_lines_cases(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = lines.line_dedup(odd_docs, min_docs=2)
    assert got.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == lines_brute(rows, 2)
    assert lines.line_dedup(no_docs).collect() == []


def test_stream_does_not_depend_on_batches():
    rng = np.random.default_rng(0)
    rows = sorted({(int(h), int(h), int(d), 0, int(p), 9) for h, d, p in zip(rng.integers(0, 5, 300), rng.integers(0, 30, 300), rng.integers(0, 4, 300))})
    cols = [np.array(c, np.int32 if k > 3 else np.int64) for k, c in enumerate(zip(*rows))]
    names = ["h1", "h2", "doc", "ver", "pos", "n"]

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=names) for i in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in lines.stream_runs(8)(iter(batches)) for r in b.to_pylist()]
        return sorted(out)

    assert run(1) == run(7) == run(1000)


def test_bitmaps_are_compressed():
    keep = np.ones(5000, bool)
    keep[17] = False
    packed = lines._bitmap(keep)
    assert len(packed) < 100 and (lines.kept_lines(packed, 5000) == keep).all() and lines.kept_lines(None, 3).all()
