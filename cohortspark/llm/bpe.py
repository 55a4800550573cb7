"""Byte-level BPE as a monoid over text spans (operator 5).

A span of text is encoded by halves: short spans directly, longer ones by joining
the results of their halves.  The join is associative, so any tree gives the same
ids, and it touches only a window at the seam:

* Splitting into pieces: a match of the pattern depends on the characters up to
  one behind its end, and on three from its start (contractions).  So only the last
  pieces of the left span can change.  From the first of them the joined text is
  split again until a piece ends where a piece of the right span starts; from
  there on the pieces are those of the right span.
* Inside a long piece: merges are re-done over the last tokens of the left half
  and the first of the right one, over growing windows, until the first and last
  token of the window come out as they went in.  A token sequence is the encoding
  of its bytes if and only if every two neighbours are the encoding of theirs, so
  then the tokens outside the window are final.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import col, table, whole

#: Characters of a span that is encoded directly, bytes of a piece that is, and cached pieces.
LEAF, SHORT, CACHED = 8192, 48, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class Span:
    """An encoded span: its bounds, its ids, and its last pieces (all that a later join can change)."""

    lo: int
    hi: int
    ids: list[int]
    tail: list[str]


class Codec:
    """Encoder and decoder for one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, short: int = SHORT):
        self.ranks, self.pattern, self.leaf, self.short = ranks, regex.compile(pattern), leaf, short
        self.tokens = {r: t for t, r in ranks.items()}
        self.none = max(self.tokens) + 1
        self.cache: dict[str, tuple[int, ...]] = {}

    # inside a piece

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) <= self.short:
            get, none = ranks.get, self.none
            parts = [data[i : i + 1] for i in range(len(data))]
            pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
            while pairs and (best := min(pairs)) < none:
                i = pairs.index(best)
                parts[i] += parts[i + 1]
                del parts[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(pairs):
                    pairs[i] = get(parts[i] + parts[i + 1], none)
            return [ranks[p] for p in parts]
        end = list(range(1, len(data) + 1))
        before = list(range(-1, len(data) - 1))
        alive = [True] * len(data)
        heap = [(r, i, i + 1, i + 2) for i in range(len(data) - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < len(data) and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= len(data) or not alive[j] or end[j] != k:
                continue
            alive[j], end[i] = False, k
            if k < len(data):
                before[k] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < len(data):
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def halves(self, data: bytes) -> list[int]:
        """A long piece by its halves."""
        if len(data) <= self.short:
            return self.merge(data)
        mid = len(data) // 2
        return self.join_tokens(self.halves(data[:mid]), self.halves(data[mid:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        tokens, size = self.tokens, 2
        while True:
            a, b = left[-size:], right[:size]
            window = self.merge(b"".join(map(tokens.__getitem__, a + b)))
            left_ok = size >= len(left) or (window[0] == a[0])
            right_ok = size >= len(right) or (window[-1] == b[-1])
            if left_ok and right_ok:
                return left[: len(left) - len(a)] + window + right[len(b) :]
            size *= 2

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            data = piece.encode()
            one = self.ranks.get(data)
            ids = (one,) if one is not None else tuple(self.halves(data))
        return ids

    # over pieces

    def encode_span(self, text: str, lo: int, hi: int) -> Span:
        if hi - lo <= self.leaf:
            pieces, cache = self.pattern.findall(text, lo, hi), self.cache
            if len(cache) >= CACHED:
                cache.clear()
            new = set(pieces).difference(cache)
            for p in new:
                cache[p] = self.piece(p)
            ids = list(chain.from_iterable(map(cache.__getitem__, pieces)))
            for p in new:
                if len(p) > self.short:  # so the cache is bounded in bytes too
                    del cache[p]
            return Span(lo, hi, ids, pieces[-8:])
        mid = (lo + hi) // 2
        return self.join(text, self.encode_span(text, lo, mid), self.encode_span(text, mid, hi))

    def join(self, text: str, left: Span, right: Span) -> Span:
        """The encoding of two neighbouring spans of ``text``."""
        if left.lo == left.hi or right.lo == right.hi:
            return left if right.lo == right.hi else right
        seam, tail, at, drop = left.hi, list(left.tail), left.hi, 0
        while tail and (at >= seam or at - len(tail[-1]) + 3 > seam or at + 1 > seam):
            last = tail.pop()
            at -= len(last)
            drop += len(self.piece(last))
        made: list[str] = []
        p, q, skip, match = at, seam, 0, self.pattern.match
        while p != q:
            if p < q:
                piece = match(text, p, right.hi).group()
                made.append(piece)
                p += len(piece)
            else:
                piece = match(text, q, right.hi).group()
                skip += len(self.piece(piece))
                q += len(piece)
        middle = chain.from_iterable(map(self.piece, made))
        ids = left.ids[: len(left.ids) - drop]
        ids.extend(middle)
        ids.extend(right.ids[skip:])
        kept, back = [], right.hi
        for piece in reversed(right.tail):  # the right tail from where the two splits agree
            back -= len(piece)
            if back < q:
                break
            kept.append(piece)
        return Span(left.lo, right.hi, ids, (tail + made + kept[::-1])[-8:] if len(kept) < 8 else kept[::-1])

    def encode(self, text: str) -> list[int]:
        return self.encode_span(text, 0, len(text)).ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, concatenated up a tree of halves."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[str, Codec] = {}


def _digest(ranks: dict[bytes, int], pattern: str) -> str:
    """Names a vocabulary and its pattern by their content."""
    h = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        h.update(f"\n{rank} {token.hex()}".encode())
    return h.hexdigest()


def _codec(name: str, shared, pattern: str) -> Codec:
    """The codec of this worker process for the vocabulary ``name``; its piece cache outlives the task."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(shared.value, pattern)
    return _CODECS[name]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the token ids of every whole text."""
    return _mapped(docs, ranks, pattern, id_col, text_col, "ids array<int>", lambda codec, ids: (np.asarray(ids, np.int32),), [pa.list_(pa.int32())])


def decode(tokens: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, bytes (binary) for (doc_id, ids) rows; null ids give no bytes."""
    shared, name = tokens.sparkSession.sparkContext.broadcast(ranks), _digest(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def _digests(codec: Codec, ids: list[int]) -> tuple:
    raw = np.asarray(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, without moving either out of the task.

    Cases: a null text is empty and has no tokens; any Unicode text can be encoded;
    a text of any length takes memory in proportion to itself; repeated rows and
    null ids give a row each; an empty table gives an empty result.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, ranks, pattern, id_col, text_col, schema, _digests, [pa.int64(), pa.string(), pa.string()])


def _mapped(docs, ranks, pattern, id_col, text_col, schema, make, kinds) -> DataFrame:
    # the vocabulary is bounded and read by the driver, so executors need no file
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), _digest(ranks, pattern)
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [make(codec, codec.encode(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    rows = docs.select(col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
