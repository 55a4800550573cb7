"""Merkle fingerprints of documents (operator 8); DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import SPACE_CLASS, col, table, whole, written

#: Words with the white space behind them; a run of 16 bytes or more without white
#: space (unspaced scripts, long tokens) is cut too, behind every byte 7 modulo 16.
_RUN_ENDS = "".join(f"\\x{b:02x}" for b in range(256) if b % 16 == 7)
_WORDS = f"(?<=[{SPACE_CLASS}])(?![{SPACE_CLASS}])|(?<=[{_RUN_ENDS}])(?<=[^{SPACE_CLASS}]{{16}})"
#: One word in so many ends its passage.
PASSAGE_WORDS = 3
#: Ends a passage; no byte read as a Latin-1 character equals it.
_END = "\u0100"
#: A paragraph whose digest begins with one of these ends its section.
SECTION_ENDS = "[0-3]"
#: The key of rows without an id; no id may have this value.
NO_ID = -(1 << 63)


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def paragraph_digests(text: Column) -> Column:
    """SHA-256 of each paragraph (line) in order; the leaves of the tree."""
    return F.transform(paragraphs(text), lambda p: F.sha2(p.cast("binary"), 256))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sections(leaves: Column) -> Column:
    """The sections in order: digest, and the positions (from 0) of their first and last paragraph.

    A section goes up to a paragraph whose digest closes it, or to the end.
    """

    def made(leaves: Column, ends: Column) -> Column:
        first = lambda j: F.coalesce(F.get(ends, j - 1) + 1, F.lit(0))
        digest = lambda e, j: F.sha2(F.array_join(F.slice(leaves, first(j) + 1, e - first(j) + 1), ",").cast("binary"), 256)
        return F.transform(ends, lambda e, j: F.struct(digest(e, j).alias("digest"), first(j).alias("first"), e.alias("last")))

    closes = lambda leaves, i: (i == F.size(leaves) - 1) | F.substring(F.get(leaves, i), 1, 1).rlike(SECTION_ENDS)
    ends = lambda leaves: F.filter(F.sequence(F.lit(0), F.size(leaves) - 1), lambda i: closes(leaves, i))
    return _let(leaves, lambda x: _let(ends(x), lambda e: made(x, e)))


def section_digests(leaves: Column) -> Column:
    """SHA-256 of each section."""
    return F.transform(sections(leaves), lambda s: s["digest"])


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ",").cast("binary"), 256)


def passage_hashes(text: Column) -> Column:
    """The distinct 32-bit hashes of the passages inside the paragraphs, as 8 hex digits each.

    A passage ends with its paragraph, behind a word whose hash says so, and at the
    cuts inside a long run without white space.  The rule looks at the content only,
    so an edit moves no passage end elsewhere, and at bytes, so it fits any script.
    Empty passages do not count; an empty text has none.
    """
    words = F.split(F.decode(text.cast("binary"), "ISO-8859-1"), _WORDS)
    ends = lambda w: (F.pmod(F.xxhash64(w), F.lit(PASSAGE_WORDS)) == 0) | ~F.substring(w, -1, 1).rlike(f"[{SPACE_CLASS}]")
    marked = F.array_join(F.transform(words, lambda w: F.when(ends(w), F.concat(w, F.lit(_END))).otherwise(w)), "")
    passages = F.array_remove(F.split(F.translate(marked, "\n", _END), _END), "")
    return F.array_distinct(F.transform(passages, lambda p: F.lpad(F.hex(F.pmod(F.xxhash64(p), F.lit(1 << 32))), 8, "0")))


def fingerprint(text: Column) -> Column:
    """``root:passages``: the root decides equality, the passages the likeness."""
    return F.concat(root(section_digests(paragraph_digests(text))), F.lit(":"), F.array_join(passage_hashes(text), ""))


def _passages(print_: Column) -> Column:
    # Spark's split keeps an empty string behind the last cut
    return F.array_remove(F.split(F.substring_index(print_, ":", -1), "(?<=\\G.{8})"), "")


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal roots, else the share of equal passages in the larger of two fingerprints."""
    x, y = _passages(a), _passages(b)
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(share)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of ``a`` that ``b`` lacks at any place.

    ``a`` and ``b`` are arrays of paragraph digests.  Moves and counts do not show
    here; :func:`differing_branches` finds them.
    """
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~F.array_contains(b, F.get(a, i)))


def _unlike(a: Column, b: Column) -> Column:
    """Two sorted arrays in a struct (a, b): the entries in which two sequences differ, one array a side.

    The sequences are arrays of structs (digest, at); the results hold the ``at``.
    The k-th copies of a digest on both sides are partners.  What has no partner
    differs; so do the remaining ones where, in the order of their side, the digests
    at the same place are unequal (moves).  Equal sequences alone give two empty
    arrays.  The cost is that of a sort.
    """
    entry = lambda side: lambda x: F.struct(x["digest"].alias("digest"), F.lit(side).alias("side"), x["at"].alias("at"))
    both = F.sort_array(F.concat(F.transform(a, entry(0)), F.transform(b, entry(1))))

    def runs(both: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(both), F.lit(1))),
            lambda k: (k == 1) | (F.get(both, k - 1)["digest"] != F.get(both, k - 2)["digest"]),
        )
        end = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(both) + 1)
        return _let(starts, lambda s: F.transform(s, lambda k, j: F.slice(both, k, end(s, j) - k)))

    def parted(run: Column) -> Column:
        n = F.size(F.filter(run, lambda x: x["side"] == 0))
        k = F.least(n, F.size(run) - n)
        lone = F.concat(F.slice(run, k + 1, n - k), F.slice(run, n + k + 1, F.size(run) - n - k))
        return F.struct(lone.alias("lone"), F.slice(run, F.lit(1), k).alias("a"), F.slice(run, n + 1, k).alias("b"))

    def partners(parts: Column, side: str) -> Column:
        flat = F.flatten(F.transform(parts, lambda p: p[side]))
        return F.sort_array(F.transform(flat, lambda x: F.struct(x["at"].alias("at"), x["digest"].alias("digest"))))

    def moved(parts: Column) -> Column:
        pairs = F.arrays_zip(partners(parts, "a").alias("a"), partners(parts, "b").alias("b"))
        return F.filter(pairs, lambda x: x["a"]["digest"] != x["b"]["digest"])

    def out(parts: Column) -> Column:
        lone = F.flatten(F.transform(parts, lambda p: p["lone"]))
        one = lambda lone, off, n, side: F.sort_array(
            F.concat(F.transform(F.filter(lone, lambda x: x["side"] == n), lambda x: x["at"]), F.transform(off, lambda x: x[side]["at"]))
        ).alias(side)
        return _let(lone, lambda lone: _let(moved(parts), lambda off: F.struct(one(lone, off, 0, "a"), one(lone, off, 1, "b"))))

    return _let(both, lambda both: _let(F.transform(runs(both), parted), out))


def differing_branches(a: Column, b: Column) -> Column:
    """Where the trees of two arrays of paragraph digests differ, from the sections down.

    A struct of four sorted arrays of positions (from 0): a_sections, a_paragraphs,
    b_sections, b_paragraphs.  The digests of the sections are compared first; only
    the paragraphs of differing sections are compared with each other, by count and
    place (:func:`_unlike`).  All four are empty for equal trees; unequal ones always
    have a differing section and a differing paragraph on one side at least.
    """
    numbered = lambda s: F.transform(s, lambda x, i: F.struct(x["digest"].alias("digest"), i.alias("at")))

    def inside(leaves: Column, parts: Column, which: Column) -> Column:
        at = F.flatten(F.transform(which, lambda i: F.sequence(F.get(parts, i)["first"], F.get(parts, i)["last"])))
        return F.transform(at, lambda i: F.struct(F.get(leaves, i).alias("digest"), i.alias("at")))

    def below(a: Column, b: Column, x: Column, y: Column, at: Column) -> Column:
        found = _unlike(inside(a, x, at["a"]), inside(b, y, at["b"]))
        return _let(
            found,
            lambda f: F.struct(
                at["a"].alias("a_sections"), f["a"].alias("a_paragraphs"), at["b"].alias("b_sections"), f["b"].alias("b_paragraphs")
            ),
        )

    top = lambda a, b, x, y: _let(_unlike(numbered(x), numbered(y)), lambda at: below(a, b, x, y, at))
    return _let(a, lambda a: _let(b, lambda b: _let(sections(a), lambda x: _let(sections(b), lambda y: top(a, b, x, y)))))


def tree(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``merkle``: root, sections, paragraphs (digests)."""
    leaves = paragraph_digests(whole(text_col))
    made = F.struct(root(section_digests(leaves)).alias("root"), section_digests(leaves).alias("sections"), leaves.alias("paragraphs"))
    return docs.withColumn("merkle", made)


def successors(ids: DataFrame, blocks: int | None = None) -> DataFrame:
    """(key, next_key) for the distinct values of ``key``, in descending order and round again.

    Range partitions of about equal counts order the keys, however they lie in
    their range.  They are written once, so that both sides below see the same
    blocks; the highest key of each block closes the gap to the block above it.
    ``blocks`` is the number of shuffle partitions unless given.
    """
    spark = ids.sparkSession
    parts = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(ids.select("key").distinct().repartitionByRange(parts, "key").withColumn("block", F.spark_partition_id()), "keys")
    tops = rows.groupBy("block").agg(F.max("key").alias("top"))
    # one row per block
    below = tops.select("block", F.lead("top", 1).over(Window.orderBy(F.desc("block"))).alias("below"), F.max("top").over(Window.partitionBy()).alias("high"))
    inside = F.lead("key").over(Window.partitionBy("block").orderBy(F.desc("key")))
    return rows.withColumn("inside", inside).join(F.broadcast(below), "block").select("key", F.coalesce("inside", "below", "high").alias("next_key"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, their likeness, and where their trees differ.

    The edited text is the document with its last floor(n_chars / 3) code points
    replaced by the first as many of the next document in descending id order.

    Cases: a null text is empty.  A null id ranks below all others.  Rows that
    share an id have the same next document; as next document such an id stands
    for its smallest beginning.  A single document is its own next document.  An
    empty table gives an empty result.
    """
    # both sides of the joins below read the same (key, text) rows, so one shuffle of the texts serves both
    rows = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), whole(text_col).alias("text"))
    sizes = rows.select("key", F.char_length("text").alias("n"))
    follow = successors(sizes.select("key"))
    # what the next document must give: its fingerprint, and as many characters as the longest row of the id can take
    need = sizes.groupBy("key").agg(F.max(F.floor(F.col("n") / 3)).alias("take")).join(follow, "key")
    giving = need.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), "take")
    heads = (
        rows.join(giving, "key")
        .select("for_key", F.substring("text", F.lit(1), F.col("take").cast("int")).alias("head"), fingerprint(F.col("text")).alias("next_print"))
        .groupBy(F.col("for_key").alias("key"))
        .agg(F.min(F.struct("head", "next_print")).alias("given"))
    )
    n, k = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("given.head", F.lit(1), k))
    doc_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    made = rows.join(heads, "key").select(doc_id, n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("given.next_print").alias("next_print"))
    made = made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print",
        differing_branches(paragraph_digests(F.col("text")), paragraph_digests(F.col("edited"))).alias("differing"),
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
        "differing",
    )


def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
