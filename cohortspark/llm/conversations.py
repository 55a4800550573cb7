"""Conversation structure repair by weighted CYK interval parsing (operator 11).

A repaired conversation's role initials read ``(s?(ua)+)?``.  Over the states of
that pattern (nothing said, after system, after user, after a closed pair) the
repair grammar in Chomsky normal form has a nonterminal ``p -> q`` for every two
states, the binary rules ``p->q = p->r r->q``, and for a row the terminal rules
keep, rerole and delete; insertions consume no row and enter every cell as a
closure.  A cell of a span holds, per nonterminal, the least (cost, audit).

Every ``p->q`` over a span divides at *every* inner place, through the state it has
there.  So all splits of a span give the same cell, and one split per span is
enough: the chart is filled bottom-up over spans of 1, 2, 4, ... rows, inside a
range partition first and then over the partitions that share a conversation.
Least (cost, audit) pairs may be joined because audits of equal cost over the same
rows never are one the beginning of the other: the longer would cost more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import SPACES, col, table, written

#: What the edits cost; a truncated row that is not deleted adds TRUNCATED.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials of roles, other ones, and what is wrong with a row; a symbol is initial * 3 + fault.
INITIALS, OTHER = "sua", 3
FINE, OPEN, GONE = 0, 1, 2
#: The states are 0 nothing said, 1 after system, 2 after user, 3 after a closed pair; 0 and 3 may end.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPANS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {s: i for i, s in enumerate(SPANS)}
#: Per nonterminal, the pairs it divides into.
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in SPANS]
#: Rows of a chart block that is remembered.
BLOCK = 8

Cell = tuple  # of (cost, audit) or None, in the order of SPANS


def join(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            x, y = a[i], b[j]
            if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                made = (x[0] + y[0], x[1] + y[1])
                if best is None or made < best:
                    best = made
        out.append(best)
    return tuple(out)


def _insertions() -> Cell:
    """The closure of insertions: the cell of a span without rows."""
    cell = tuple((0, "") if p == q else None for p, q in SPANS)
    once = [None] * len(SPANS)
    for (p, role), q in MOVES.items():
        if role != "s":
            once[_AT[p, q]] = (INSERT, "I")
    step = tuple(min(x, y) if x and y else x or y for x, y in zip(cell, once))
    while (longer := join(cell, step)) != cell:
        cell = longer
    return cell


EMPTY = _insertions()


@lru_cache(maxsize=None)
def leaf(symbol: int) -> Cell:
    """The cell of one row, with insertions on both sides."""
    initial, fault = INITIALS[symbol // 3] if symbol // 3 < OTHER else None, symbol % 3
    extra = TRUNCATED if fault == OPEN else 0
    cell = [(DELETE, "D") if p == q else None for p, q in SPANS]
    if fault != GONE:
        for (p, role), q in MOVES.items():
            edits = [(extra, "K")] * (role == initial) + [(RELABEL + extra, "R")] * (role != "s")
            cell[_AT[p, q]] = min([*edits, *filter(None, [cell[_AT[p, q]]])], default=None)
    return join(join(EMPTY, tuple(cell)), EMPTY)


def joined(cells: list[Cell]) -> Cell:
    """Neighbours joined in rounds; each round doubles the length of the spans."""
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


@lru_cache(maxsize=50_000)
def block(symbols: bytes) -> Cell:
    return joined([leaf(s) for s in symbols])


def parse(symbols: bytes) -> Cell:
    """The cell of a span of rows; takes 11 bytes a row."""
    return joined([block(symbols[i : i + BLOCK]) for i in range(0, len(symbols), BLOCK)])


def root(cell: Cell) -> tuple[int, str]:
    return min(filter(None, (cell[_AT[0, 0]], cell[_AT[0, 3]])))


# streams over sorted rows

_SEGMENT = (
    "part int, done boolean, lo long, hi long, turns long, head_turn long, tail_turn long, head int, tail int, "
    "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
)
_FIELDS = [f.split()[0] for f in _SEGMENT.split(", ")]


class Segment:
    """What is known of the rows of one conversation in one partition, or of several such spans joined."""

    __slots__ = (*_FIELDS[2:13], "symbols", "cell")

    def __init__(self):
        self.lo = self.hi = self.head_turn = self.tail_turn = self.head = self.tail = self.cell = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.symbols = bytearray()

    def add(self, turn: int | None, initial: int, n: int, fresh: bool, blank: bool, cut: bool) -> None:
        """A row that is there ``n`` times; ``fresh`` says that its role and text are new to the conversation."""
        if n == 0:
            return
        if self.tail is None:
            self.head, self.head_turn = initial, turn
        else:
            self.illegal += _illegal(self.tail, initial)
        self.illegal += (n - 1) * _illegal(initial, initial)
        if turn is not None:
            self.turns += self.hi is None or turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        self.tail, self.tail_turn = initial, turn
        again = 0 if blank else n - fresh
        self.blank += n if blank else 0
        self.duplicate += again
        self.truncated += 0 if blank or not fresh else cut
        if not blank and fresh:
            self.symbols.append(initial * 3 + (OPEN if cut else FINE))
        self.symbols += bytes([initial * 3 + GONE]) * (n if blank else again)

    def follow(self, other: Segment) -> None:
        """Statistics of this span and the next one; cells are joined apart."""
        if other.tail is None:
            return
        if self.tail is not None:
            self.illegal += _illegal(self.tail, other.head)
        else:
            self.head, self.head_turn = other.head, other.head_turn
        self.turns += other.turns - (self.hi is not None and other.lo == self.hi)
        self.lo = other.lo if self.lo is None else self.lo
        self.hi = self.hi if other.hi is None else other.hi
        self.tail, self.tail_turn = other.tail, other.tail_turn
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def row(self, part: int, done: bool) -> tuple:
        cell = self.cell or parse(bytes(self.symbols))
        cells = [root(cell)] if done else cell
        return (part, done, *[getattr(self, f) for f in _FIELDS[2:13]], [c and c[0] for c in cells], [c and c[1] for c in cells])


def _illegal(a: int, b: int) -> bool:
    """Whether neighbours of these initials are none of su, ua, au."""
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


def _rows_out(convs: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.int32(), pa.bool_(), *[pa.int64()] * 5, *[pa.int32()] * 2, *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["conv", *_FIELDS])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a sorted partition; the first and the last one may go on in other partitions."""
    now, conv, first, part, kind, convs, rows = None, None, True, 0, None, [], []
    for batch in batches:
        kind = batch.column(0).type
        for c, part, *row in zip(*[x.to_pylist() for x in batch.columns]):  # noqa: B020
            if now is None or c != conv:
                if now is not None:
                    convs.append(conv)
                    rows.append(now.row(part, not first))
                    first = False
                now, conv = Segment(), c
            now.add(*row)
        if len(rows) >= 1000:
            yield _rows_out(convs, rows, kind)
            convs, rows = [], []
    if now is not None:
        yield _rows_out([*convs, conv], [*rows, now.row(part, False)], kind)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one conversation that lie in neighbouring partitions, joined in their order."""
    kind, conv, spans = None, None, []

    def done() -> pa.RecordBatch:
        whole, cells = Segment(), []
        for s in spans:
            given = Segment()
            for f in _FIELDS[2:13]:
                setattr(given, f, s[f])
            whole.follow(given)
            cells.append(tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"])))
        whole.cell = joined(cells)
        return _rows_out([conv], [whole.row(0, True)], kind)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for s in batch.to_pylist():
            if spans and s["conv"] != conv:
                yield done()
                spans = []
            conv = s["conv"]
            spans.append(s)
    if spans:
        yield done()


# Spark jobs


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, n: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, n) of a table of conversation rows; null roles and texts count as one space.

    ``n`` says how often a row is there; 0 keeps only the conversation known.
    """
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    return rows.select(
        col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"),
        (F.lit(1) if n is None else n).cast("long").alias("n"),
    )


def _digest(c: str) -> Column:
    return F.unhex(F.md5(F.col(c).cast("binary")))


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def diagnose(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of :func:`turns` rows.

    Only digests of the texts travel.  Equal rows are counted, then the first turn
    of each (conversation, role, text) is found by groupings with map-side combine;
    range partitions of the sorted rows spread a conversation of any length, each
    partition parses its span, and spans of one conversation are joined by their
    cells.  That ends in a table of the shared folder.
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    light = rows.select(
        "conv", F.when(F.col("n") > 0, F.col("turn")).alias("turn"), F.when(F.col("n") > 0, F.col("role")).otherwise("").alias("role"),
        F.when(F.col("n") > 0, _digest("text")).alias("digest"), "n",
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    light = light.groupBy("conv", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = light.filter("n > 0").groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv", "role", "digest")]).agg(F.min(place).alias("first"))
    same = light["conv"].eqNullSafe(first["f_conv"]) & (light["role"] == first["f_role"]) & (light["digest"] == first["f_digest"])
    initial = F.lit(OTHER)
    for i, c in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == c, i).otherwise(initial)
    marked = light.join(first, same, "left").withColumn("fresh", F.coalesce(F.col("first.turn").eqNullSafe(F.col("turn")) & F.col("first").isNotNull(), F.lit(False)))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    laid = marked.repartitionByRange(_width(rows), *order).sortWithinPartitions(*order)
    laid = laid.select("conv", F.spark_partition_id().alias("part"), "turn", initial.alias("initial"), "n", "fresh", "blank", "cut")
    kind = rows.schema["conv"].dataType.simpleString()
    found = written(laid.mapInArrow(_segments, f"conv {kind}, {_SEGMENT}"), "conversations")
    # at most two rows per partition
    apart = found.filter("NOT done").repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_merged, f"conv {kind}, {_SEGMENT}")
    all_ = found.filter("done").unionByName(apart)
    # differences beyond a long stay at its end
    gaps = F.least(F.col("hi").cast("decimal(38,0)") - F.col("lo") + 1 - F.col("turns"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    return all_.select(
        "conv", F.when(F.col("lo").isNull(), 0).otherwise(gaps).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"),
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each conversation's audit, applied to its rows; the audit comes before the rows."""
    conv, audit, at, state, place, kind = None, "", 0, 0, 0, None
    out: list[tuple] = []

    def say(edit: str, role: str, text: str) -> None:
        nonlocal place, state
        out.append((conv, place, edit, role, text))
        state, place = MOVES[state, role[:1]], place + 1

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            say("I", _next(state), "")
            at += 1

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv", "place", "edit", "role", "text"]
        )

    for batch in batches:
        kind = batch.column(0).type
        for lo in range(0, batch.num_rows, 256):
            for c, new, role, text, n in zip(*[x.to_pylist() for x in batch.slice(lo, 256).columns]):
                if new is not None:  # a conversation begins
                    insert()
                    conv, audit, at, state, place = c, new, 0, 0, 0
                    continue
                for _ in range(n):
                    insert()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        say(edit, role if edit == "K" else _next(state), text)
            yield flush()
    if kind is not None:
        insert()
        yield flush()


def _next(state: int) -> str:
    return "assistant" if state == 2 else "user"


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv, place (from 0), edit, role, text, sorted inside partitions.

    The audit of a conversation is sorted before its rows, so a task streams with
    one audit and one batch in memory, whatever the length of a conversation.
    """
    texts = rows.filter("n > 0").select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", _digest("text").alias("digest"), "text", "n")
    heads = audits.select("conv", "audit")
    both = texts.unionByName(heads, allowMissingColumns=True).repartition("conv")
    both = both.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "digest")
    kind = rows.schema["conv"].dataType.simpleString()
    return both.select("conv", "audit", "role", "text", "n").mapInArrow(_apply, f"conv {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv and sha256 of the newline-joined ``role:text`` of :func:`repaired` rows, which must keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, conv, kind, out = None, None, None, []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())], names=["conv", "sha"])
            out.clear()
            return made

        for batch in batches:
            kind = batch.column(0).type
            for c, place, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if place == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    sha, conv = hashlib.sha256(), c
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield flush()
        if sha is not None:
            out.append((conv, sha.hexdigest()))
            yield flush()

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, sha string")


def damage(rows: DataFrame) -> DataFrame:
    """``turns`` of the table ``conversations`` after the damage that the crc32 of ``conv_id:turn`` decides."""
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    hurt = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )
    return turns(hurt, "conv_id", "turn", "role", "text", F.col("n"))


def op11_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of every conversation.

    Cases: a null conv_id is a conversation of its own; null turns come first and
    count for no gap; null roles and texts are one space; a role that begins with
    none of s, u, a (an empty one too) can be reroled or deleted; rows of one turn
    are taken by role, then by the MD5 of the text, and repeated rows are
    duplicates; of very long conversations an audit has one byte a row and must fit
    a string; a gap beyond a long is the largest long; no rows give no rows.
    """
    rows = damage(table(spark, sf_dir, "conversations"))
    found = diagnose(rows)
    shas = digests(repaired(rows, found)).withColumnRenamed("conv", "conv_")
    nothing = hashlib.sha256().hexdigest()
    return found.join(shas, found["conv"].eqNullSafe(shas["conv_"]), "left").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"),
    )
