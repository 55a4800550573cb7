"""Toxicity by weak supervision (operator 6)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import col, table, whole

#: Hand-written lexicon; each entry votes by itself.
LEXICON = (
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown fool dumb ugly hate kill stfu shut bitch bastard "
    "asshole shit fuck crap damn retard cretin vermin filth garbage freak creep coward liar pig rat"
).split()
#: Hand-written patterns over the text as it stands.
PATTERNS = {
    "insult address": r"(?i)\byou(?:'re| are| all)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|fool|pig|rat)s?\b",
    "shouting": r"\b(?:\p{Lu}{3,}\b\W+){4}",
    "bang run": r"[!?]{3,}",
    "masked word": r"\b\p{L}+[*#@$]{2,}\p{L}*",
    "go away": r"(?i)\b(?:shut up|go to hell|drop dead|get lost|screw you)\b",
    "second person": r"(?i)\byou(?:r|rs)?\b",
}
#: Bounds of what is fitted: rows with and without an annotation, lexicon voters, shortest and longest stem.
MAX_LABELLED, MAX_UNLABELLED, MAX_VOTERS, STEM_MIN, STEM_MAX = 12_000, 12_000, 400, 4, 8
#: The least G statistic of a lexicon voter: what chance does not reach among many thousand words.
LEAST_G = 24.0
#: Rows added to each side of a firing rate (Laplace), and the doubt beyond which a row without annotation teaches the classifier nothing.
SMOOTH, DOUBT = 1.0, 0.1
#: Words whose voters a worker remembers.
KNOWN_WORDS = 150_000
_WORD = regex.compile(r"\p{L}+")
_PATTERNS = [regex.compile(p) for p in PATTERNS.values()]


def stems(word: str) -> list[str]:
    """What a lexicon voter can look for: the word ("=word") and its stems ("stem")."""
    return [f"={word}", *[word[:n] for n in range(STEM_MIN, min(STEM_MAX, len(word) - 1) + 1)]]


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Lexicon voters, and the linear classifier over voter strengths and patterns."""

    voters: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def lookup(self) -> dict[str, int]:
        return {v: i for i, v in enumerate(self.voters)}


def strengths(text: str, lookup: dict[str, int], known: dict[str, tuple[int, ...]]) -> dict[int, float]:
    """Sparse features of a whole text: for each voter that fires 1, and the log of its count; patterns behind them.

    Feature i says that voter i fires, feature n + i how often; ``known`` keeps the voters of words seen before.
    """
    n, counts = len(lookup), Counter()
    for word, k in words_of(text).items():
        hit = known.get(word)
        if hit is None:
            hit = tuple(lookup[s] for s in stems(word) if s in lookup)
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = hit
        for i in hit:
            counts[i] += k
    out = {}
    for i, k in counts.items():
        out[i], out[n + i] = 1.0, float(np.log(k))
    for j, p in enumerate(_PATTERNS):
        if p.search(text):
            out[2 * n + j] = 1.0
    return out


# the label model


@dataclass
class Sparse:
    """Rows of few values, by row: row ``i`` holds ``at[ends[i]:ends[i+1]]`` and ``value[...]``.

    The dense matrix never exists whole; what needs it takes blocks of ``BLOCK`` rows.
    """

    ends: np.ndarray
    at: np.ndarray
    value: np.ndarray
    width: int

    BLOCK = 512

    @staticmethod
    def of(dense: np.ndarray) -> Sparse:
        row, at = np.nonzero(dense)
        return Sparse(np.r_[0, np.cumsum(np.bincount(row, minlength=len(dense)))], at, dense[row, at], dense.shape[1])

    @property
    def rows(self) -> int:
        return len(self.ends) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.ends))

    def part(self, columns: np.ndarray) -> Sparse:
        """The given columns only, numbered in their order."""
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        keep = place[self.at] >= 0
        return Sparse(np.r_[0, np.cumsum(keep)][self.ends], place[self.at[keep]], self.value[keep], len(columns))

    def only(self, wanted: np.ndarray) -> Sparse:
        """The rows where ``wanted`` holds."""
        keep = wanted[self.row_of()]
        return Sparse(np.r_[0, np.cumsum(np.diff(self.ends)[wanted])], self.at[keep], self.value[keep], self.width)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_of(), self.value * weights[self.at], self.rows)

    def summed(self, by_row: np.ndarray) -> np.ndarray:
        """Per column, the values weighted by row."""
        return np.bincount(self.at, self.value * np.repeat(by_row, np.diff(self.ends)), self.width)

    def gram(self, by_row: np.ndarray) -> np.ndarray:
        """Column products weighted by row: width x width."""
        out = np.zeros((self.width, self.width))
        for lo in range(0, self.rows, self.BLOCK):
            hi = min(lo + self.BLOCK, self.rows)
            cut = slice(self.ends[lo], self.ends[hi])
            block = np.zeros((hi - lo, self.width))
            block[np.repeat(np.arange(hi - lo), np.diff(self.ends[lo : hi + 1])), self.at[cut]] = self.value[cut]
            out += block.T @ (block * by_row[lo:hi, None])
        return out


@dataclass
class LabelModel:
    """Class-conditional firing rates of voters, and weights that discount correlated ones, where they fire and where they do not."""

    prior: float
    fire_toxic: np.ndarray
    fire_clean: np.ndarray
    share: np.ndarray
    share_off: np.ndarray

    def odds(self, votes: Sparse) -> np.ndarray:
        on = np.log(self.fire_toxic / self.fire_clean) * self.share
        off = np.log((1 - self.fire_toxic) / (1 - self.fire_clean)) * self.share_off
        return np.clip(np.log(self.prior / (1 - self.prior)) + off.sum() + votes.times(on - off), -30, 30)


def fit_label_model(votes: Sparse, labels: np.ndarray, rounds: int = 15) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over the votes; the annotation is one more voter.

    votes: rows x voters of 0/1; labels: 1, 0, or -1 where there is none.  Rows
    without an annotation get their posterior from the voters alone; they count from
    the second round on, when the voters' rates are known from the others.  The
    annotation's accuracies are estimated like those of the other voters, but kept
    above three quarters, which ties the two classes to their meaning.  The
    correlation of two voters is that of their residuals within the classes; a voter
    whose residuals go with those of others shares its evidence with them: by the
    variance they have in common where it fires, and by the whole correlation where
    it does not, since many silent voters of one subject say little more than one.
    Returns the model of the voters and the posterior of every row.
    """
    rows, m = votes.rows, votes.width
    given = labels >= 0
    p = np.where(given, np.where(labels == 1, 0.95, 0.05), 0.1)
    share, share_off, model, post = np.ones(m), np.ones(m), None, p
    for step in range(rounds):
        counts = given.astype(float) if step == 0 and given.any() else np.ones(rows)
        toxic, clean = post * counts, (1 - post) * counts
        w, v = toxic.sum() + 1e-9, clean.sum() + 1e-9
        prior = float(np.clip((toxic.sum() + 1) / (counts.sum() + 10), 1e-4, 0.9))
        in_toxic, in_clean = votes.summed(toxic), votes.summed(clean)
        hit, miss = np.clip((in_toxic + SMOOTH) / (w + 2 * SMOOTH), 1e-6, 1 - 1e-6), np.clip((in_clean + SMOOTH) / (v + 2 * SMOOTH), 1e-6, 1 - 1e-6)
        if step in (1, rounds // 2):  # correlations, from the residuals votes - post x hit - (1 - post) x miss, expanded
            mean = np.outer(in_toxic, hit) + np.outer(in_clean, miss)
            both = (post * (1 - post)).sum() * np.outer(hit, miss)
            fitted = (post * post).sum() * np.outer(hit, hit) + ((1 - post) ** 2).sum() * np.outer(miss, miss) + both + both.T
            cross = (votes.gram(np.ones(rows)) - mean - mean.T + fitted) / rows
            sd = np.sqrt(np.maximum(np.diag(cross), 0)) + 1e-9
            corr = cross / np.outer(sd, sd)
            together = np.where(corr > 0.2, corr, 0)
            share, share_off = 1 / np.maximum(1, (together**2).sum(1)), 1 / np.maximum(1, together.sum(1))
        model = LabelModel(prior, hit, miss, share, share_off)
        sens = np.clip((post * (labels == 1)).sum() / max((post * given).sum(), 1e-9), 0.75, 0.995)
        spec = np.clip(((1 - post) * (labels == 0)).sum() / max(((1 - post) * given).sum(), 1e-9), 0.75, 0.995)
        says = np.where(labels == 1, np.log(sens / (1 - spec)), np.where(labels == 0, np.log((1 - sens) / spec), 0.0))
        post = 1 / (1 + np.exp(-np.clip(model.odds(votes) + says, -30, 30)))
    return model, post


def fit_classifier(x: Sparse, target: np.ndarray, ridge: float = 0.2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps that never raise the penalised loss.

    Separable data would send plain Newton steps to infinity; each step is halved
    until the loss falls.  The bias is hardly penalised.
    """
    m = x.width
    w = np.zeros(m + 1)
    share = np.clip(target.mean(), 1e-3, 0.999)
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(m + 1, ridge)
    penalty[-1] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x.times(v[:-1]) + v[-1]
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -30, 30)))
        bend = p * (1 - p)
        grad = np.r_[x.summed(p - target), (p - target).sum()] + penalty * w
        curve = np.diag(penalty)
        curve[:-1, :-1] += x.gram(bend)
        curve[-1, :-1] = curve[:-1, -1] = x.summed(bend)
        curve[-1, -1] += bend.sum()
        step = np.linalg.solve(curve, grad)
        size = 1.0
        while (then := loss(w - size * step)) > now - 1e-4 * size * (grad @ step) and size > 1e-6:
            size /= 2
        if size <= 1e-6 or now - then < 1e-9 * (1 + now):
            break
        w, now = w - size * step, then
    return w[:-1], float(w[-1])


# Spark jobs


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fitting_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int, max_unlabelled: int) -> DataFrame:
    """(doc_id, toxic, text) of at most about ``max_labelled`` annotated rows and ``max_unlabelled`` without an annotation (toxic null).

    Both are chosen by a hash of the id and none is held out.  An id with several
    labels counts as toxic if one of them says so; of several texts of an id the one
    with the least hash counts.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1_000_000))
    usable = ~held_out("doc_id") & F.col("doc_id").isNotNull()
    use = labels.filter(usable & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n = use.count()
    cut = 1_000_000 if n <= max_labelled else int(1_000_000 * max_labelled / n)
    known = use.filter(place(F.col("doc_id")) < cut).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(col(id_col).alias("doc_id")).filter(usable)
    rest = max(docs.count() - n, 1)  # held-out rows among them: fewer are chosen, never more
    cut = 1_000_000 if rest <= max_unlabelled else int(1_000_000 * max_unlabelled / rest)
    near = lambda df: df.select("doc_id").filter(place(F.col("doc_id")) < cut).distinct()
    blank = near(ids).join(near(use), "doc_id", "left_anti").select("doc_id", F.lit(None).cast(use.schema["toxic"].dataType).alias("toxic"))
    texts = docs.select(col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    found = texts.join(F.broadcast(known.unionAll(blank)), "doc_id")  # the two bounds bound it
    return found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def candidate_voters(sample: DataFrame, max_voters: int) -> list[str]:
    """The words and stems that tell toxic rows best, by the G statistic, over those that occur more in toxic rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                (toxic if label.as_py() == 1 else clean).update({s for w in words_of(text.as_py()) for s in stems(w)})
        # what no toxic row of any task holds cannot become a voter; the others need their clean count
        names = list(toxic.keys() | clean.keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([toxic[s] for s in part], pa.int64()), pa.array([clean[s] for s in part], pa.int64())], names=["stem", "a", "b"]
            )

    sample = sample.filter(F.col("toxic").isNotNull())
    rows = sample.select("text", "toxic").mapInArrow(count, "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = sample.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = float(totals["p"] or 0), float(totals["n"])
    if not 0 < p < n:
        return []
    k, share = F.col("a") + F.col("b"), p / n

    def term(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    g = 2 * (term(F.col("a"), k * share) + term(F.col("b"), k * (1 - share)) + term(p - F.col("a"), p - k * share) + term(n - p - F.col("b"), (n - p) - k * (1 - share)))
    best = rows.filter((F.col("a") >= 3) & (F.col("a") > k * share * 1.5) & (k < n)).select("stem", g.alias("g")).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "stem").limit(max_voters)
    return [r["stem"] for r in best.collect()]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = MAX_LABELLED, max_voters: int = MAX_VOTERS, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Voters from the lexicon and the annotated rows, label model over rows with and without annotation, classifier on its posteriors.

    Only a sample of at most about ``max_labelled`` and ``max_unlabelled`` rows is read here;
    of it the driver gets the votes (``max_voters`` a row at most), never the texts.
    Without labels of both classes the hand-written voters decide by themselves.
    """
    sample = fitting_sample(docs, labels, id_col, text_col, max_labelled, max_unlabelled).persist()
    try:
        found = candidate_voters(sample, max_voters)
        voters = list(dict.fromkeys([*found, *[f"={w}" for w in LEXICON]]))
        if not found:
            n = len(voters)
            return Model(voters, np.r_[np.full(n, 3.0), np.full(n, 0.5), np.zeros(len(PATTERNS))], -2.0)
        lookup = {v: i for i, v in enumerate(voters)}

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, tuple[int, ...]] = {}
            for batch in batches:
                rows = [strengths(t.as_py(), lookup, known) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float32()))],
                    names=["toxic", "at", "value"],
                )

        kind = sample.schema["toxic"].dataType.simpleString()
        got = sample.select("text", "toxic").mapInArrow(vote, f"toxic {kind}, at array<int>, value array<float>").toArrow()
    finally:
        sample.unpersist()
    n, at = len(voters), got.column("at").combine_chunks()
    x = Sparse(at.offsets.to_numpy().astype(np.int64), at.values.to_numpy(), got.column("value").combine_chunks().values.to_numpy().astype(np.float64), 2 * n + len(PATTERNS))
    annotation = got.column("toxic").to_pandas()
    labels_ = np.where(annotation.isna(), -1, annotation == 1).astype(np.int64)
    _, target = fit_label_model(x.part(np.r_[:n, 2 * n : x.width]), labels_)
    sure = (labels_ >= 0) | (target < DOUBT) | (target > 1 - DOUBT)
    weights, bias = fit_classifier(x.only(sure), target[sure])
    return Model(voters, weights, bias)


_KNOWN: dict[int, dict[str, tuple[int, ...]]] = {}


def _known(lookup: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """The words this worker process has seen under the model at hand."""
    key = hash(tuple(lookup))
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = {}
    return _KNOWN[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """doc_id and score of every whole text; with ``keep`` all columns of ``docs`` and the score under that name.

    A null or empty text gets the score of a text without votes.
    """
    lookup, weights, bias = model.lookup(), model.weights, model.bias

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        known = _known(lookup)
        out = []
        for t in texts:
            got = strengths(t.as_py(), lookup, known)
            out.append(1 / (1 + np.exp(-np.clip(bias + sum(weights[i] * v for i, v in got.items()), -30, 30))))
        return pa.array(out, pa.float64())

    made = rate(whole(text_col))
    return docs.select("*", made.alias(keep)) if keep else docs.select(col(id_col).alias("doc_id"), made.alias("score"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: null and empty texts are scored like texts without votes; repeated rows
    are scored alike; labels of unknown ids, null labels and null ids are not used;
    without usable labels the hand-written voters decide; no rows give no rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rated = score(docs, model)
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
