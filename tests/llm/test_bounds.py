"""What a task of the Jaccard join holds beside its rows, and that bounded pieces give the same result."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

from cohortspark.llm import jaccard


def _family(count: int, size: int, seed: int) -> list[np.ndarray]:
    """Sets that differ from one base in up to a seventh of their tokens."""
    rng = np.random.default_rng(seed)
    base, out = rng.integers(0, 1 << 63, size).astype(np.uint64), []
    for _ in range(count):
        tokens, at = base.copy(), rng.random(size) < 0.15 * rng.random()
        tokens[at] = rng.integers(0, 1 << 63, at.sum()).astype(np.uint64)
        out.append(np.unique(tokens))
    return out


def test_full_tile_is_compared_in_bounded_memory():
    sets = _family(2000, 500, 1)
    tracemalloc.start()
    root = jaccard.linked(sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(root) == 2000
    assert peak < 80_000_000  # the matrix of overlaps is 16 MB, the tokens are 8


def test_overlaps_in_pieces_are_exact():
    for sets in (_family(40, 700, 2), [*_family(20, 30, 3), *_family(300, 9, 4)], [np.array([i], np.uint64) for i in range(20)], [np.array([7], np.uint64)] * 20):
        plain = [set(s.tolist()) for s in sets]
        others = ~np.eye(len(sets), dtype=bool)  # with itself a set shares more than the tokens of others
        assert (jaccard._overlaps(sets) == np.array([[len(a & b) for b in plain] for a in plain]))[others].all()
        root = jaccard.linked(sets, 80)
        near = [[100 * len(a & b) >= 80 * len(a | b) for b in plain] for a in plain]
        lowest = list(range(len(sets)))
        while True:
            new = [min(lowest[j] for j in range(len(sets)) if near[i][j]) for i in range(len(sets))]
            if new == lowest:
                break
            lowest = new
        assert root.tolist() == lowest


def test_copies_for_tiles_leave_in_pieces():
    texts = [" ".join(f"w{i}x{j}" for j in range(300 + i)) for i in range(60)]
    nodes = [xxh3_128_digest(jaccard.shingle_set(t, 5).tobytes()) for t in texts]
    nodes[3] = b"another set under it"
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([9] * 60, pa.int64()), pa.array(nodes, pa.binary()), pa.array([120] * 60, pa.int32())], names=["text", "family", "node", "blocks"])
    pieces = list(jaccard.tile_copies(iter([batch]), 5))
    assert max(p.nbytes for p in pieces) < 5_000_000 < sum(p.nbytes for p in pieces)
    found = sorted((r["node"], r["ti"], r["tj"], r["tokens"]) for p in pieces for r in p.to_pylist())
    wanted = []
    for i, (text, node) in enumerate(zip(texts, nodes)):
        mine = int.from_bytes(node[8:], "little") % 120
        wanted += [(node, min(mine, o), max(mine, o), jaccard.shingle_set(text, 5).tobytes()) for o in range(120) if i != 3]
    assert found == sorted(wanted)
