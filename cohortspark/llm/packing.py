"""Padding-optimal length buckets and token-budget batches (operator 4)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import col, numbered, table, whole

#: Lengths up to EXACT have a histogram cell each; beyond, every octave has CELLS cells.
EXACT, CELLS = 4096, 512


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens): words between ASCII white space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time, no second copy of a batch
            n = [len(t.as_py().split()) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def optimal_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bucket lengths that minimise total padding.

    ``cells``: (longest length, rows, sum of lengths) in order of length.  A bucket
    over cells i..j pads every row to the longest of cell j.  That cost makes the
    layers of the dynamic programme lower envelopes of lines, so each takes linear
    time; all numbers are integers.
    """
    if not cells:
        return []
    n = len(cells)
    count, total = [0], [0]
    for _, c, s in cells:
        count.append(count[-1] + c)
        total.append(total[-1] + s)
    best = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        new, pick = [None] * (n + 1), [0] * (n + 1)
        lines: deque[tuple[int, int, int]] = deque()  # slope, intercept, start
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i] + total[i], i)
                while len(lines) >= 2 and (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - line[0]) >= (line[1] - lines[-2][1]) * (lines[-2][0] - lines[-1][0]):
                    lines.pop()
                lines.append(line)
            if not lines:
                continue
            x = cells[j - 1][0]
            while len(lines) >= 2 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            slope, intercept, start = lines[0]
            new[j], pick[j] = slope * x + intercept + x * count[j] - total[j], start
        if best[n] is not None and new[n] is not None and new[n] >= best[n]:
            break
        choice.append(pick)
        best = new
    out, j = [], n
    for pick in reversed(choice):
        out.append(cells[j - 1][0])
        j = pick[j]
    return out[::-1]


def length_cell(n: Column) -> Column:
    """The histogram cell of a length; the number of cells does not grow with the rows."""
    octave = F.floor(F.log2(n.cast("double") / EXACT))
    start = EXACT * F.pow(F.lit(2.0), octave)
    return F.when(n <= EXACT, n).otherwise(EXACT + octave * CELLS + F.floor((n - start) / (start / CELLS))).cast("long")


def pack(lengths: DataFrame, budget: int = 16384, buckets: int = 8, block_rows: int = 20_000) -> DataFrame:
    """Batches of (doc_id, n_tokens) rows: with bucket, pad_to, batch, slot.

    One histogram over all rows, of at most ``EXACT`` + 512 cells per octave, goes
    to the driver; dynamic programming picks the bucket lengths.  In a bucket,
    rows in hash order fill batches of floor(budget / pad_to) rows, one row at
    least: a document longer than the budget is a batch of its own.  Batches are
    numbered from 0 in each bucket, by block offsets and never in one task.

    Cases: documents without words have length 0 and are packed like others;
    repeated rows are packed one by one; an empty table gives an empty result.
    """
    hist = lengths.groupBy(length_cell(F.col("n_tokens")).alias("cell")).agg(
        F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total")
    )
    cells = [(r["top"], r["n"], r["total"]) for r in hist.orderBy("cell").collect()]
    tops = optimal_boundaries(cells, buckets)
    rows_in = sum(c[1] for c in cells)
    bucket, pad = F.lit(max(0, len(tops) - 1)), F.lit(tops[-1] if tops else 0).cast("long")
    for k in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= tops[k], k).otherwise(bucket)
        pad = F.when(F.col("n_tokens") <= tops[k], F.lit(tops[k]).cast("long")).otherwise(pad)
    blocks = max(1, -(-rows_in // block_rows))
    rows = lengths.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), pad.alias("pad_to"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(blocks)))
    rows = numbered(rows, ["bucket"], "block", ["doc_id", "n_tokens"], {"seq": "1L"})
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("pad_to", F.lit(1)))).cast("long")
    return rows.select(
        "doc_id", "n_tokens", "bucket", "pad_to", F.floor(F.col("seq") / size).cast("long").alias("batch"), (F.col("seq") % size).alias("slot")
    )


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
