"""Line dedup by a range-partitioned, streamed sort of line hashes (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cohortspark.llm.common import SPACES, col, fresh, table, whole, written

DROP, PENDING, SUMMARY = 0, 1, 2
_SPACES = SPACES.encode()
_FOUND = "kind int, h1 long, h2 long, doc long, ver long, pos int, n int, cnt long, head int"


def _identity(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document is a (doc_id, text) pair, as two longs; a null id differs from 0."""
    return F.coalesce(col(id_col).cast("long"), F.lit(0)), F.xxhash64(whole(text_col), col(id_col).isNull())


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, ver, pos, n): 128 hash bits per line key of enough characters."""
    doc, ver = _identity(id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for lo in range(0, len(texts), 512):
                hashes, rows, positions, sizes = [], [], [], []
                for i, text in enumerate(texts[lo : lo + 512], lo):
                    lines = text.split(b"\n")
                    for pos, line in enumerate(lines):
                        key = line.strip(_SPACES).lower()  # of bytes: A-Z only
                        if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                            hashes.append(xxh3_128_digest(key))
                            rows.append(i)
                            positions.append(pos)
                            sizes.append(len(lines))
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(positions, pa.int32()), pa.array(sizes, pa.int32())],
                    names=["h1", "h2", "doc", "ver", "pos", "n"],
                )

    rows = docs.select(doc.alias("doc"), ver.alias("ver"), whole(text_col).alias("text"))
    return rows.mapInArrow(cut, "h1 long, h2 long, doc long, ver long, pos int, n int")


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """True at the first row and where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def stream_runs(min_docs: int):
    """A map over partitions sorted by (h1, h2, doc, ver, pos).

    Counts the first occurrence in each document while the rows stream by.  The
    lines of a hash with enough documents come out as DROP rows at once; the first
    and the last hash of a partition may go on in its neighbours, so these yield a
    SUMMARY row with their count and first row, and PENDING rows while the count
    is short.  The rows of fewer than ``min_docs`` documents are held back.
    """
    names = ["h1", "h2", "doc", "ver", "pos", "n"]

    def out(kind: int, cols: list[np.ndarray], head: np.ndarray | None = None, cnt: int = 0) -> pa.RecordBatch:
        size = len(cols[0])
        head = np.zeros(size, bool) if head is None else head
        ends = [np.full(size, cnt, np.int64), head.astype(np.int32)]
        arrays = [np.full(size, kind, np.int32), *cols, *ends]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", *names, "cnt", "head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the open hash while it has too few documents
        over = None  # else (documents so far, last row's hash and document)
        first = None  # first row of the open hash
        opening = True  # the open hash is the partition's first
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            goes_on = over is not None and over[1][:2] == (cols[0][0], cols[1][0])
            if over is not None and not goes_on and opening:
                yield out(SUMMARY, first, cnt=over[0])
                opening = False
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            starts = np.flatnonzero(_changes(cols[:2]))
            ends = np.append(starts[1:], len(cols[0]))
            total = np.add.reduceat(_changes(cols[:4]).astype(np.int64), starts)
            head = np.zeros(len(cols[0]), bool)
            head[starts] = True
            if goes_on:
                total[0] += over[0] - (over[1] == tuple(c[0] for c in cols[:4]))
                head[0] = False
            enough = total >= min_docs
            mask = np.repeat(enough, ends - starts)
            if mask.any():
                yield out(DROP, [c[mask] for c in cols], head[mask])
            if not goes_on and held is None:
                first = [c[:1] for c in cols]
            if len(starts) > 1:
                if opening:
                    yield out(SUMMARY, first, cnt=total[0])
                    if not enough[0]:
                        yield out(PENDING, [c[: ends[0]] for c in cols])
                    opening = False
                first = [c[starts[-1] : starts[-1] + 1] for c in cols]
            over = (int(total[-1]), tuple(c[-1] for c in cols[:4])) if enough[-1] else None
            held = None if enough[-1] else [c[starts[-1] :] for c in cols]
        if first is not None:
            yield out(SUMMARY, first, cnt=over[0] if over else int(_changes(held[:4]).sum()))
            if held is not None:
                yield out(PENDING, held)

    return run


def _bitmap(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """The keep flags of a bitmap; without one every line stays."""
    if bitmap is None:
        return np.ones(n, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n].astype(bool)


def line_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines: doc, ver, n_lines, n_dropped, bitmap.

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case.  Keys of ``min_chars`` characters or more that ``min_docs`` documents or
    more contain lose all their lines, or with ``keep_first`` all but the first
    one in the order of (doc, ver, position).

    The hashes are range-partitioned by (hash, document) and sorted inside the
    partition by position, so a line that a third of all documents share spreads
    over many partitions; only its count is added up across their edges.
    ``doc`` and ``ver`` identify a document by its id and its text.
    """
    spark = docs.sparkSession
    rows = line_rows(docs, id_col, text_col, min_chars)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "h1", "h2", "doc", "ver").sortWithinPartitions("h1", "h2", "doc", "ver", "pos")
    found = written(rows.mapInArrow(stream_runs(min_docs), _FOUND), "line-runs")
    # at most two rows per partition
    edges = found.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(
        F.sum("cnt").alias("docs"), F.min(F.struct("doc", "ver", "pos")).alias("first")
    )
    edges = F.broadcast(edges)
    drops = found.filter(F.col("kind") != SUMMARY).join(edges, ["h1", "h2"], "left")
    drops = drops.filter((F.col("kind") == DROP) | (F.col("docs") >= min_docs))
    if keep_first:
        inner = F.col("docs").isNull() & (F.col("head") == 1)
        edge = F.col("docs").isNotNull() & (F.struct("doc", "ver", "pos") == F.col("first"))
        drops = drops.filter(~(inner | F.coalesce(edge, F.lit(False))))

    @F.pandas_udf("binary")
    def pack(positions: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, k in zip(positions, n):
            keep = np.ones(k, bool)
            keep[np.asarray(p, np.int64)] = False
            out.append(_bitmap(keep))
        return pd.Series(out)

    per = drops.groupBy("doc", "ver").agg(F.collect_set("pos").alias("positions"), F.max("n").alias("n_lines"))
    return per.select("doc", "ver", "n_lines", F.size("positions").alias("n_dropped"), pack("positions", "n_lines").alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cut to its kept lines, and two more columns: n_lines, n_dropped.

    The new columns get a leading underscore where ``docs`` has their names.
    """
    doc, ver, found, n_lines, n_dropped = fresh(docs, "doc", "ver", "bitmap", "n_lines", "n_dropped")
    lookup = bitmaps.select(*[F.col(c).alias(f) for c, f in (("doc", doc), ("ver", ver), ("bitmap", found), ("n_dropped", n_dropped))])
    a, b = _identity(id_col, text_col)

    @F.pandas_udf("string")
    def cut(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        def one(t, m):
            if m is None:
                return None
            lines = t.split("\n")
            return "\n".join([x for x, k in zip(lines, kept_lines(m, len(lines))) if k])

        return pd.Series([one(t, m) for t, m in zip(text, bitmap)], dtype=object)

    joined = docs.withColumns({doc: a, ver: b}).join(lookup, [doc, ver], "left")
    # only documents that lose lines send their text to Python
    shorter = cut(F.when(F.col(found).isNotNull(), whole(text_col)), F.col(found))
    kept = F.when(F.col(found).isNull(), whole(text_col)).otherwise(shorter)
    return joined.select(
        *[kept.alias(c) if c == text_col else col(c) for c in docs.columns],
        F.size(F.split(whole(text_col), "\n")).cast("long").alias(n_lines),
        F.coalesce(F.col(n_dropped), F.lit(0)).cast("long").alias(n_dropped),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that many documents share; see :func:`line_bitmaps`.

    Cases: a null or empty text is one empty line; it has no key of one character,
    so it stays, and the text of the result is empty, not null.  Rows that repeat
    a document (same id, same text) count once as a document and lose the same
    lines; a null id with a text is a document too.  A document whose lines all go
    has an empty text.  An empty table gives an empty result.
    """
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, **options), id_col, text_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s
), h AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id"""
