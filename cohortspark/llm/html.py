"""Main text of web pages by the maximum-scoring subsequence (operator 10)."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import col, table, whole

#: Elements whose content is no text, elements that end by themselves, and elements that break a block.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "head", "title", "xmp"}
LITERAL = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
#: Parts of a class, id or role that say the same by themselves, and those that do so only
#: beside parts that name a place or a shape: social-links, but not social-science.
FIRM = set(
    "advert adverts advertisement advertisements advertising breadcrumb breadcrumbs captcha contentinfo disqus gdpr masthead nav navbar "
    "newsletter paywall popup promoted sidebar sponsored subscribe".split()
)
LOOSE = set(
    "ad ads alert banner comment comments complementary consent cookie cookies footer header menu modal navigation notice notices promo related "
    "replies respond search share sharing social sponsor subscription toolbar widget".split()
)
SHAPES = set(
    "a and area article articles author back bar block body bottom box btn button buttons center close col column container content "
    "count desktop dialog dropdown entry fb feed field fixed form frame global google group head icon icons id info inline inner input item "
    "items js label layer law left link links list main media meta mobile more news outer overlay page panel policy post posts primary reader "
    "reply results right row secondary section side signup site slot small sticky stories text the this thread title toggle top unit user "
    "wrap wrapper zone".split()
)
#: What an open <head> can hold; anything else ends it.
IN_HEAD = {"head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}
ARTICLE = {"article", "main"}
PAGE = {"html", "body", *ARTICLE}
PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt", "figcaption"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS, _CAMEL = re.compile(r"[^a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

#: Weights without labelled pages: log odds that a token of the kind is inside the article.
DEFAULT_WEIGHTS = {"w:boiler": -4.0, "w:link": -1.0, "w:article": 3.0, "w:paragraph": 2.0, "w:bare": 0.25}
TAG_WEIGHT, TAG_FLOOR, CLASS_BOUND = -0.1, -1.0, 4.0
#: A class name gets a weight if at least so many labelled pages have words inside it.
CLASS_PAGES = 20


def n_words(text: str) -> int:
    """White-space words; of scripts without spaces two characters count as a further word."""
    return len(text.split()) + (0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)


def names_boiler(names: str) -> bool:
    """Whether one of the space-separated class names, ids or roles names boilerplate."""
    for name in names.split():
        parts = {part for part in _PARTS.split(_CAMEL.sub("-", name).lower()) if part}
        if parts & FIRM or (parts & LOOSE and parts <= LOOSE | SHAPES):
            return True
    return False


class Token:
    """A tag or a run of text, with what encloses it: boilerplate, class names outside an article, the innermost element with such names."""

    __slots__ = ("kind", "text", "words", "boiler", "block", "at", "classes", "element")

    def __init__(self, kind: str, text: str, words: int, boiler: bool, block: bool, at: int = 0, open_: "Open | None" = None):
        self.kind, self.text, self.words, self.boiler, self.block, self.at = kind, text, words, boiler, block, at
        self.classes, self.element = (open_.classes, open_.element) if open_ else (frozenset(), 0)


class Open:
    """An open element: its name, whether it opens boilerplate, the class names around and of it, its number if it has any."""

    __slots__ = ("name", "boiler", "own", "classes", "number", "element")

    def __init__(self, name: str, boiler: bool, own: frozenset, number: int):
        self.name, self.boiler, self.own, self.number = name, boiler, own, number

    def under(self, parent: "Open | None") -> "Open":
        around, element = (parent.classes, parent.element) if parent else (frozenset(), 0)
        if self.name in ARTICLE:  # a marked article is not judged by class names learned outside
            self.classes, self.element = frozenset(), 0
        else:
            self.classes, self.element = around | self.own if self.own else around, self.number or element
        return self


def tokens(page: str, parents: list[int] | None = None) -> Iterator[Token]:
    """Tags and text runs of a page in order.

    A stack of open elements tells what encloses a run.  An end tag closes its
    element and all inside it; one without an open element is ignored, and so an
    element that nothing closes reaches to the end of its parent.  Text, or a tag that
    it cannot hold, ends an open <head>.  ``parents`` receives, for each numbered
    element, the number of the one around it (0: none).
    """
    parents = [0] if parents is None else parents
    stack: list[Open] = []
    boiler = raw = at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        start, piece, at = at, m.group(), m.end()
        if piece[0] != "<" or piece == "<":
            if stack and stack[-1].name == "head" and piece.strip():
                boiler, raw = boiler - stack.pop().boiler, raw - 1
            if raw:
                continue
            names = {o.name for o in stack}
            kind = "boiler" if boiler else "article" if names & ARTICLE else "link" if "a" in names else "paragraph" if names & PARAGRAPH else "bare"
            yield Token(f"w:{kind}", piece, n_words(piece), boiler > 0, False, start, stack[-1] if stack else None)
            continue
        tag = _TAG.match(piece)
        if tag is None:
            if piece.startswith("<![CDATA[") and not raw:
                inner = piece[9:].removesuffix("]]>")
                yield Token("w:boiler" if boiler else "w:bare", entities.escape(inner), n_words(inner), boiler > 0, False, start, stack[-1] if stack else None)
            continue
        name = tag.group(1).lower()
        closed, inside = [], boiler > 0
        if piece[1] == "/":
            if any(o.name == name for o in stack):
                while not closed or closed[-1].name != name:
                    closed.append(stack.pop())
        elif name not in VOID and not piece.endswith("/>"):
            head = next((i for i, o in enumerate(stack) if o.name == "head"), None)
            if name == "body":
                closed, stack = stack, []
            elif head is not None and name not in IN_HEAD and not any(o.name in RAW for o in stack[head + 1 :]):
                closed, stack = stack[head:], stack[:head]
            elif name in ("p", "li"):  # an open one ends here; inline elements inside stay open
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in BLOCKS:
                        if stack[i].name == name:
                            closed.append(stack.pop(i))
                            for j in range(i, len(stack)):
                                stack[j].under(stack[j - 1] if j else None)
                        break
            found = [(kind.lower(), "".join(g)) for kind, *g in _NAMED.findall(piece)] if "=" in piece else []
            is_boiler = name in BOILER and not (name == "header" and any(o.name in ARTICLE for o in stack))
            is_boiler |= name not in PAGE and any(names_boiler(v) for _, v in found)
            own = frozenset(w for kind, v in found if kind == "class" for w in v.lower().split()) if name not in PAGE else frozenset()
            around = stack[-1] if stack else None
            number = 0
            if own and not any(o.name in ARTICLE for o in stack):
                number = len(parents)
                parents.append(around.element if around else 0)
            stack.append(Open(name, is_boiler, own if number else frozenset(), number).under(around))
            boiler += is_boiler
            raw += name in RAW
            if name in LITERAL:  # its content is no markup
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = end.start() if end else at if name == "title" else len(page)
        for o in closed:
            boiler -= o.boiler
            raw -= o.name in RAW
        yield Token(f"t:{name}" if name in BLOCKS else "t:inline", "", 0, inside or boiler > 0, name in BLOCKS, start, stack[-1] if stack else None)


def labelled_counts(page: str) -> Counter:
    """(kind, inside) counts of a page that labels itself by one closed <article>; empty for others.

    Words count under their kind, under ``words``, and under ``c:name`` for each class
    name around them.  A name of an element around the article has its words on both sides.
    """
    low = page.lower()
    if low.count("<article") != 1 or low.count("</article>") != 1:
        return Counter()
    lo, hi = low.index("<article"), low.index("</article>")
    out: Counter = Counter()
    around: frozenset = frozenset()
    for t in tokens(page):
        inside = lo <= t.at < hi
        if t.at < lo:
            around = t.classes
        kind = "w:paragraph" if t.kind == "w:article" else t.kind
        out[(kind, inside)] += t.words if t.words else 1
        if t.words:
            out[("words", inside)] += t.words
            for name in around if inside else t.classes:
                out[(f"c:{name}", inside)] += t.words
    return out


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of being inside, against the mean of all tokens; words in an article stay positive and tags negative.

    Weights of class names are log odds against the mean of all words.
    """
    plain = {k: n for k, n in counts.items() if k[0] != "words" and not k[0].startswith("c:")}
    inside = sum(n for (_, i), n in plain.items() if i) + 1.0
    outside = sum(n for (_, i), n in plain.items() if not i) + 1.0
    out = dict(DEFAULT_WEIGHTS)
    for kind in {k for k, _ in counts} - {"words"}:
        a, b = counts.get((kind, True), 0) + 0.5, counts.get((kind, False), 0) + 0.5
        if kind.startswith("c:"):
            value = math.log(a / (counts.get(("words", True), 0) + 1.0)) - math.log(b / (counts.get(("words", False), 0) + 1.0))
            out[kind] = max(-CLASS_BOUND, min(CLASS_BOUND, value))
            continue
        value = max(-4.0, min(4.0, math.log(a / inside) - math.log(b / outside)))
        if kind.startswith("t:"):  # so few tags do not outweigh a short heading between them
            out[kind] = min(-0.1, max(value, TAG_FLOOR))
        else:
            out[kind] = min(value, -0.1) if kind == "w:boiler" else value
    out["w:article"] = max(out["w:article"], out["w:paragraph"])
    out["w:paragraph"] = max(out["w:paragraph"], 0.25)
    return out


def fit_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", max_pages: int = 2000) -> dict[str, float]:
    """Token weights from pages that mark their article themselves.

    At most about ``max_pages`` different pages, chosen by a hash of id and content, are
    read for this.  Class names of fewer than ``CLASS_PAGES`` of them get no weight.
    """
    n = pages.count()
    share = 1.0 if n <= max_pages else max_pages / n
    body = pages.select(whole(html_col).alias("html"), F.xxhash64(col(id_col), whole(html_col)).alias("row"))
    sample = body.filter(F.pmod("row", F.lit(1_000_000)) < int(share * 1_000_000)).dropDuplicates(["row"]).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                counts = labelled_counts(page.as_py())
                total.update(counts)
                seen.update({(kind, inside): 1 for kind, inside in counts})
        if total:
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for (k, _), _ in rows]), pa.array([i for (_, i), _ in rows]), pa.array([n for _, n in rows], pa.int64()), pa.array([seen[k] for k, _ in rows], pa.int64())],
                names=["kind", "inside", "n", "pages"],
            )

    found = sample.mapInArrow(count, "kind string, inside boolean, n long, pages long").groupBy("kind", "inside").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    frequent = found.groupBy("kind").agg(F.max("pages").alias("pages"), F.collect_list(F.struct("inside", "n")).alias("sides"))
    frequent = frequent.filter(~F.startswith("kind", F.lit("c:")) | (F.col("pages") >= CLASS_PAGES))
    rows = frequent.select("kind", F.inline("sides")).collect()
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in rows})


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest sum, by one linear scan; (0, 0) if none is positive."""
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    return lo, hi


def score(t: Token, weights: dict[str, float]) -> float:
    """Words count each, tags once.  Text of a known boilerplate element counts once
    however long it is: it is left out anyway, and must not part the article around it."""
    if t.boiler:
        return weights["w:boiler"] / 16 if t.words else 0.0
    if t.kind[0] == "t":
        return weights.get(t.kind, TAG_WEIGHT)
    named = sum(weights.get(f"c:{name}", 0.0) for name in t.classes) if t.classes else 0.0
    return (weights.get(t.kind, TAG_WEIGHT) + max(-CLASS_BOUND, min(CLASS_BOUND, named))) * t.words


def cut_out(parts: list[Token], parents: list[int], weights: dict[str, float]) -> None:
    """Nested maximum sums: an element whose class names have weights below zero is left out
    as boilerplate if the sum of all it holds, without what is left out inside it, is negative."""
    sums, low = [0.0] * len(parents), [False] * len(parents)
    for t in parts:
        if t.element:
            sums[t.element] += score(t, weights)
            low[t.element] |= any(weights.get(f"c:{name}", 0.0) < 0 for name in t.classes)
    cut = [False] * len(parents)
    for i in range(len(parents) - 1, 0, -1):
        cut[i] = low[i] and sums[i] < 0
        if not cut[i]:
            sums[parents[i]] += sums[i]
    for i in range(1, len(parents)):
        cut[i] |= cut[parents[i]]
    for t in parts:
        t.boiler |= cut[t.element]


def extract(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, one per line; boilerplate inside the region is left out.

    A page's header is left out; a <header> inside a marked article holds its title and stays.
    """
    parents = [0]
    parts = list(tokens(page, parents))
    cut_out(parts, parents, weights)
    lo, hi = best_region([score(t, weights) for t in parts])
    while lo > 0 and hi > lo and not parts[lo].block and not parts[lo - 1].block:  # to the edges of blocks
        lo -= 1
    while hi > lo and hi < len(parts) and not parts[hi].block:
        hi += 1
    blocks, text = [], []
    for t in [*parts[lo:hi], Token("t:end", "", 0, False, True)]:
        if t.block:
            line = " ".join(entities.unescape("".join(text)).split())
            blocks += [line] if line else []
            text = []
        elif t.kind[0] == "w" and not t.boiler:
            text.append(t.text)
    return "\n".join(blocks)


def main_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Cases: null, empty and tagless html; pages without any positive word give an
    empty text; unclosed and stray tags are tolerated; a page of any length is read
    whole; repeated rows give a row each; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", whole(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op10_max_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit_weights(pages))
