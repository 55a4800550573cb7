"""Exact n-gram Jaccard self-join by universe partitioning (operator 7)."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_128_digest

from cohortspark.llm.common import col, table, whole, written
from cohortspark.llm.components import components

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Documents and tokens of a verification block; weights, in keys, of a chance match and of emitted light segments.
BLOCK_DOCS, BLOCK_TOKENS, CHANCE, BLANK = 1000, 1_000_000, 50.0, 10_000.0
#: What a task holds at once beside a tile: columns and rows of a comparison, rows that links are read from, rows and bytes of copies sent to tiles.
HIT_COLUMNS, HIT_ROWS, NEAR_ROWS, PIECE_ROWS, PIECE_BYTES = 512, 256, 64, 128, 4_000_000
#: Bounds of the sample that tells common shingles.
SAMPLE_DOCS, MOST_COMMON = 6_000, 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, none give none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxh3_64_digest, words)), ">u8").astype(np.uint64)
    size, count = min(n, len(w)), max(1, len(w) - n + 1)
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = _mix(total + w[i : i + count] * _ODD[i % len(_ODD)])
    return np.unique(total)


@dataclass(frozen=True)
class Band:
    """How sets of sizes low..high are cut: segments, how many of them with deletions, light ones to spare."""

    low: int
    high: int
    segments: int
    deletions: int
    spare: int


@lru_cache(maxsize=8)
def bands(threshold: int, largest: int = 1 << 26) -> list[Band]:
    """Size bands and their allocation.

    Sets that link differ in size by the factor threshold at most, so their bands
    are the same or adjacent.  Each band is laid out for its own sets and for those
    of the band below.  Sets of sizes up to ``high`` that link differ in at most H
    tokens.  With the tokens hashed to m segments, of which q also match when one
    token is missing on one side, m + q > H makes some segment match: a segment that
    does not match accounts for one differing token, or two if it has deletions.
    Among the q that keep m + q = H + 1 the cheapest is taken: the keys a set emits
    plus the chance matches of its segments, which are likelier the shorter they are.

    Some segments match by chance: empty ones, and those of common shingles only.
    Whether a segment is of this light kind depends on its content, so equal
    segments are light together.  Without deletions m grows by ``spare``, and sets
    with no more light segments than that do not emit them: spare + 1 segments
    match, of which at most ``spare`` are light in such a set.  Sets with more
    emit theirs, and the empty ones only if those alone are more.
    """
    out, low = [], 1
    while low <= largest:
        high = low * 100 // threshold
        differ = (100 - threshold) * 2 * high // (100 + threshold)
        smaller = out[-1].low if out else low
        best = None
        plans = [(differ + 1 - q, q, 0) for q in range(1, min((differ + 1) // 2, 64) + 1)] + [(differ + 1 + e, 0, e) for e in range(min(2 * differ, 400) + 1)]
        for m, q, spare in plans:
            mean = m * math.exp(-0.9 * smaller / m) if m > 1 else 0.0
            blank = _more_than(spare, mean)  # chance that a set emits light segments
            cost = m + q * high / m + CHANCE * m * 2.0 ** (-high / m) + BLANK * blank
            if best is None or cost < best[0]:
                best = (cost, Band(low, high, m, q, spare))
        out.append(best[1])
        low = high + 1
    return out


def _more_than(k: int, mean: float) -> float:
    """The chance that a Poisson variable exceeds ``k``."""
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1.0 - total)


def band_keys(tokens: np.ndarray, common: np.ndarray, band: Band, number: int) -> np.ndarray:
    """The keys of one set in one band; ``common`` marks its common shingles."""
    m = band.segments
    segment = (tokens >> np.uint64(7)) % np.uint64(m)
    order = np.argsort(segment, kind="stable")
    part, mixed = segment[order], _mix(tokens[order] * _ODD[0])
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    sums = np.add.reduceat(mixed, starts)
    filled = part[starts]
    salt = np.uint64((number + 1) * int(_ODD[1]) % (1 << 64))
    full, blanks = _mix(sums + filled * _ODD[2] + salt), m - len(filled)
    heavy = np.add.reduceat((~common[order]).astype(np.int64), starts) > 0
    if not band.deletions and m - heavy.sum() <= band.spare:
        return full[heavy]
    keys = [full]
    if blanks and (band.deletions or blanks > band.spare):
        blank = np.setdiff1d(np.arange(m, dtype=np.uint64), filled)
        keys.append(_mix(blank * _ODD[2] + salt))
    if band.deletions:
        near = part < band.deletions
        which = np.searchsorted(filled, part[near])
        keys.append(_mix(sums[which] - mixed[near] + part[near] * _ODD[2] + salt))
    return np.concatenate(keys)


def join_keys(tokens: np.ndarray, threshold: int, common: np.ndarray | None = None) -> np.ndarray:
    """Two sets that link and are not equal have a key in common, whatever the shingles called common (sorted)."""
    size = len(tokens)
    if not size:
        return tokens
    plan = bands(threshold)
    own = bisect_right(plan, size, key=lambda b: b.low) - 1
    common = np.zeros(0, np.uint64) if common is None else common
    known = np.isin(tokens, common, assume_unique=True) if len(common) else np.zeros(size, bool)
    out = []
    for number in (own, own + 1):
        band = plan[number]
        if (100 - threshold) * 2 * band.high >= 100 + threshold:  # else only equal sets link
            out.append(band_keys(tokens, known, band, number))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def common_shingles(docs: DataFrame, id_col: str, text_col: str, n: int) -> np.ndarray:
    """Shingles that occur in three or more of about ``SAMPLE_DOCS`` documents; at most ``MOST_COMMON``.

    They only steer which segments are emitted; every choice of them gives the same links.
    """
    total = docs.count()
    cut = 1_000_000 if total <= SAMPLE_DOCS else max(1, int(1_000_000 * SAMPLE_DOCS / total))
    sample = docs.filter(F.pmod(F.xxhash64(col(id_col)), F.lit(1_000_000)) < cut).select(whole(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column(0)]
            tokens, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int64))], names=["token", "times"])

    rows = sample.mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).filter("times >= 3")
    top = rows.orderBy(F.desc("times"), "token").limit(MOST_COMMON).toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: int) -> DataFrame:
    """(doc_id, n_shingles, node, h1, keys): the 128-bit digest of the set and its join keys.

    Only the first document with a set emits its keys in each task, so copies reach
    the shuffle once per task.
    """
    rows = docs.select(col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        common = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sizes, nodes, keys = [], [], []
                for text in part.column(1):
                    tokens = shingle_set(text.as_py(), n)
                    node = xxh3_128_digest(tokens.tobytes())
                    sizes.append(len(tokens))
                    nodes.append(node)
                    keys.append(np.zeros(0, np.int64) if node in seen else join_keys(tokens, threshold, common).view(np.int64))
                    seen.add(node)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                        pa.array(np.frombuffer(b"".join(x[:8] for x in nodes), np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                    ],
                    names=["doc_id", "n_shingles", "node", "h1", "keys"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, h1 long, keys array<long>")


def star_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions sorted by (key, h1): an edge from each set of a key to its smallest one.

    The first and the last key of a partition may go on in its neighbours; their
    smallest sets come out with the key (kind 1) to be tied together later.
    """
    key = low = None

    def out(kind, k, u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(k), pa.array(u), pa.array(v)], names=["kind", "key", "u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        lows = h[starts].copy()
        if key is None:
            yield out(1, k[:1], h[:1], h[:1])
        elif key == k[0]:
            lows[0] = low
        mine = np.repeat(lows, np.diff(np.append(starts, len(k))))
        keep = mine != h
        if keep.any():
            pairs = np.unique(np.stack([h[keep], mine[keep]], 1), axis=0)
            yield out(0, np.zeros(len(pairs), np.int64), pairs[:, 0].copy(), pairs[:, 1].copy())
        key, low = k[-1], lows[-1]
    if key is not None:
        yield out(1, *[np.array([x], np.int64) for x in (key, low, low)])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens that every two sets share.  Beside this matrix and two copies of the tokens, only narrow pieces are held."""
    count = len(sets)
    flat = np.concatenate(sets)
    flat.sort()
    flat = np.unique(flat[1:][flat[1:] == flat[:-1]])  # the shared tokens; each is a column
    cells = []
    for i, s in enumerate(sets):
        at = np.searchsorted(flat, s)
        at = at[flat[np.minimum(at, len(flat) - 1)] == s] if len(flat) else at[:0]
        cells.append(at << 32 | i)
    cells = np.concatenate(cells)
    cells.sort()  # by column
    overlap = np.zeros((count, count), np.float32)
    for lo in range(0, len(flat), HIT_COLUMNS):
        a, b = np.searchsorted(cells, (lo << 32, (lo + HIT_COLUMNS) << 32))
        hit = np.zeros((count, HIT_COLUMNS), np.float32)
        hit[cells[a:b] & 0xFFFFFFFF, (cells[a:b] >> 32) - lo] = 1
        for at in range(0, count, HIT_ROWS):
            overlap[at : at + HIT_ROWS] += hit[at : at + HIT_ROWS] @ hit.T
    return overlap


def linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each set the position of a set of its component, by exact overlaps of all sets given."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if count <= 12:
        known = [set(s.tolist()) for s in sets]
        overlap = np.array([[len(a & b) for b in known] for a in known], np.int64)
    else:
        overlap = _overlaps(sets)
    root = np.full(count, -1)
    for i in range(count):
        if root[i] >= 0:
            continue
        root[i], reach = i, [i]
        while reach:
            near = np.zeros(count, bool)
            for at in range(0, len(reach), NEAR_ROWS):  # each row is looked at once: what it links with, a few rows at a time
                rows = reach[at : at + NEAR_ROWS]
                both = overlap[rows].astype(np.int64)
                near |= (100 * both >= threshold * (sizes[rows][:, None] + sizes[None, :] - both)).any(0)
            new = np.flatnonzero(near & (root < 0))
            root[new] = i
            reach = new.tolist()
    return root


def tile_copies(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A copy of each set (text, family, node, blocks) for every two blocks of its family it takes part in.

    The copies of a huge family's sets are many times the texts of a batch, so they leave in pieces.
    """
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def out(rows):
        made = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=["family", "ti", "tj", "node", "tokens"])

    for batch in batches:
        for lo in range(0, batch.num_rows, PIECE_ROWS):
            part, rows, held = batch.slice(lo, PIECE_ROWS), [], 0
            for text, family, node, count in zip(*(part.column(i).to_pylist() for i in range(4))):
                tokens = shingle_set(text, n)
                if xxh3_128_digest(tokens.tobytes()) != node:
                    continue  # another text under the same id
                mine, packed = int.from_bytes(node[8:], "little") % count, tokens.tobytes()
                for other in range(count):
                    rows.append((family, min(mine, other), max(mine, other), node, packed))
                    held += len(packed)
                    if held >= PIECE_BYTES:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)


def verified(tiles: DataFrame, threshold: int) -> DataFrame:
    """(u, v) edges of the exact links inside each tile; tiles are bounded by the block sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, group = None, {}

        def close():
            nodes = list(group)
            if len(nodes) > 1:
                root = linked([np.frombuffer(group[x], np.uint64) for x in nodes], threshold)
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([nodes[i] for i in moved], pa.binary()), pa.array([nodes[root[i]] for i in moved], pa.binary())], names=["u", "v"]
                    )

        for batch in batches:
            names = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for this, node, tokens in zip(names, batch.column(3).to_pylist(), batch.column(4)):
                if this != tile:
                    yield from close()
                    tile, group = this, {}
                group[node] = tokens.as_py()
        yield from close()

    by = ["family", "ti", "tj"]
    return tiles.repartition(*by).sortWithinPartitions(*by).select(*by, "node", "tokens").mapInArrow(run, "u binary, v binary")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; links are exact.

    Words are split at ASCII white space, A-Z in lower case.  Documents with equal
    sets form a class, and classes link when 100 * intersection >= threshold * union.
    Steps: every set emits the keys of its size band (:func:`bands`); keys are
    range-partitioned by (key, set), so a key that a third of all sets share spreads
    over many partitions; sets that meet at a key are tied to the smallest one, which
    makes families of candidates; each family is cut into blocks of bounded size and
    every two blocks are compared exactly; links are closed to components.

    Cases: null and empty texts have no shingles, link with nothing and are their
    own component; documents of fewer than n words have one shingle; repeated rows
    are copies; a null id takes part in its class and is the component_id only of
    components without another id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    digests = written(sketches(docs, id_col, text_col, n, threshold), "jaccard-digests")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = digests.select(F.explode("keys").alias("key"), "h1").repartitionByRange(parts, "key", "h1").sortWithinPartitions("key", "h1")
    stars = written(keyed.mapInArrow(star_edges, "kind int, key long, u long, v long"), "jaccard-stars")
    edges = stars.filter("kind = 0").select("u", "v")
    tops = stars.filter("kind = 1").select("key", "u")  # two rows per partition at most
    tied = tops.join(tops.groupBy("key").agg(F.min("u").alias("v")), "key").filter("u <> v").select("u", "v")
    families = components(edges.unionByName(tied))
    members = digests.join(families.select(F.col("node").alias("h1"), F.col("root").alias("family")), "h1")
    members = members.groupBy("family", "node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("tokens")).filter("docs > 1")
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    members = members.join(sizes.select("family", blocks.alias("blocks")), "family").withColumnRenamed("doc_id", "rep")

    texts = docs.select(col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    texts = texts.join(members, F.expr("doc_id <=> rep")).select("text", "family", "node", "blocks")
    tiles = texts.mapInArrow(partial(tile_copies, n=n), "family long, ti int, tj int, node binary, tokens binary")
    links = components(verified(tiles, threshold))
    classes = digests.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("lowest"))
    roots = classes.join(links, "node").groupBy("root").agg(F.min("lowest").alias("component"))
    joined = links.join(roots, "root").select("node", "component")
    named = classes.join(joined, "node", "left").select("node", F.coalesce("component", "lowest").alias("component"))
    return digests.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, threshold=85)
