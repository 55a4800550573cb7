"""Ranking and classification metrics as aggregations.

A *scored* frame has a boolean or 0/1 label, a numeric score and optional group
columns.  Rows are first reduced to one cell per (group, score); all curves and
areas follow from ordered totals over those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortspark.operators.ranks import ordered_totals, ranged


def positive(label: str | Column, pos_label: int = 1) -> Column:
    """Label as boolean; ``pos_label=0`` swaps the classes."""
    c = F.col(label) if isinstance(label, str) else label
    c = c.cast("boolean")
    return c if pos_label else ~c


def score_cells(scored: DataFrame, group: Sequence[str], label: str, score: str, pos_label: int = 1) -> DataFrame:
    """Counts of positives and negatives per (group, score); unknown scores or labels drop out.

    ``score`` must already be the score of the chosen positive class.
    """
    pos = positive(label, pos_label)
    known = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*group, F.col(score).alias("score")).agg(
        F.count(F.when(pos, 1)).alias("p"), F.count(F.when(~pos, 1)).alias("n")
    )


def score_table(scored, group, label, score, pos_label: int = 1) -> DataFrame:
    """Cells with ``tp``/``fp`` counted at ``score >= threshold`` and class totals."""
    t = ordered_totals(score_cells(scored, group, label, score, pos_label), group, "score", ["p", "n"])
    return t.withColumns({"tp": F.col("p_total") - F.col("p_before"), "fp": F.col("n_total") - F.col("n_before")})


def auc(scored: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with ties counted half; null when one class is missing.

    The wins of a range partition against itself, and of its positives against all
    negatives before it, add up; so no row needs its offset, only parts do.
    """
    return auc_of_cells(score_cells(scored, group, label, score), group)


def auc_of_cells(cells: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """E03 from one row (group..., score, p, n) per group and score."""
    cut = ranged(cells, group, ["score"])
    inside = W.partitionBy("__part", "__k").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    wins = F.col("p").cast("double") * (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2)
    per_part = cut.withColumn("__w", wins).groupBy("__part", "__k").agg(F.sum("__w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    earlier = W.partitionBy("__k").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    placed = per_part.withColumn("below", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    positives, negatives = F.sum("p"), F.sum("n")
    pairs = positives.cast("double") * negatives
    total = F.sum(F.col("w") + F.col("p").cast("double") * F.col("below"))
    counts = [F.when(pairs > 0, total / pairs).alias("auc"), positives.alias("positives"), negatives.alias("negatives")]
    return placed.groupBy("__k").agg(*counts).select(*[F.col(f"__k.`{g}`").alias(g) for g in group], "auc", "positives", "negatives") if group else placed.agg(*counts)


def pr_area(scored: DataFrame, label: str, score: str, group: Sequence[str] = (), pos_label: int = 1) -> DataFrame:
    """Trapezoid area under precision against recall, starting at (0, 1)."""
    t = score_table(scored, group, label, score, pos_label)
    above_tp, above_n = F.col("tp") - F.col("p"), F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    previous = F.when(above_n > 0, above_tp / F.when(above_n > 0, above_n)).otherwise(F.lit(1.0))
    step = F.when(F.col("p_total") > 0, F.col("p") / F.when(F.col("p_total") > 0, F.col("p_total")))
    return t.groupBy(*group).agg(F.sum(step * (precision + previous) / 2).alias("aupr"))


def roc_points(scored: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score plus the origin (null threshold)."""
    t = score_table(scored, group, label, score)
    rate = lambda a, total: F.when(F.col(total) > 0, F.col(a) / F.when(F.col(total) > 0, F.col(total)))
    points = t.select(*group, F.col("score").alias("threshold"), rate("fp", "n_total").alias("fpr"), rate("tp", "p_total").alias("tpr"))
    if group:
        groups = points.select(*group).distinct()
    else:
        groups = points.agg(F.count(F.lit(1)).alias("__k")).filter("__k > 0").select()
    origin = groups.select(
        *group, F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def population_curve(scored: DataFrame, label: str, score: str, group: Sequence[str] = (), pos_label: int = 1) -> DataFrame:
    """Precision and recall against the fraction of rows at or above each threshold.

    Thresholds below the one that first reaches full recall are left out.
    """
    t = score_table(scored, group, label, score, pos_label).filter(F.col("tp") - F.col("p") < F.col("p_total"))
    above = F.col("tp") + F.col("fp")
    return t.select(
        *group,
        F.col("score").alias("threshold"),
        (above / (F.col("p_total") + F.col("n_total"))).alias("fraction"),
        (F.col("tp") / above).alias("precision"),
        (F.col("tp") / F.col("p_total")).alias("recall"),
    )


def precision_top_k(
    scored: DataFrame,
    k: float,
    label: str,
    score: str,
    tie: str,
    group: Sequence[str] = (),
    pos_label: int = 1,
) -> DataFrame:
    """Share of positives among the ``int(k*n)`` highest scores.

    Equal scores are taken in ascending order of the numeric ``tie`` column; of
    rows that are equal in both, positives come first.
    Whole score levels above the cut are summed from cells; only the level the
    cut falls into is looked at row by row, again through ordered totals, so
    there is no global sort and no limit over the rows.
    """
    t = score_table(scored, group, label, score, pos_label)
    size = F.col("p_total") + F.col("n_total")
    cut = F.floor(F.lit(float(k)) * size)
    through = F.col("tp") + F.col("fp")
    levels = t.select(
        *group, "score", "p", cut.alias("r"), (through - F.col("p") - F.col("n")).alias("above"), through.alias("through")
    )
    full = levels.groupBy(*group).agg(
        F.max("r").alias("r"), F.sum(F.when(F.col("through") <= F.col("r"), F.col("p")).otherwise(0)).alias("hits_full")
    )
    edge = levels.filter((F.col("above") < F.col("r")) & (F.col("through") > F.col("r"))).select(
        *group, F.col("score").alias("__edge"), (F.col("r") - F.col("above")).alias("__take")
    )
    known = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    on = known[score] == edge["__edge"]
    for g in group:
        on = on & known[g].eqNullSafe(edge[g])
    in_level = known.join(edge, on).select(
        *[known[g] for g in group], known[tie].alias("__tie"), positive(known[label], pos_label).cast("int").alias("__hit"), "__take"
    )
    by_tie = in_level.groupBy(*group, "__tie").agg(
        F.sum("__hit").alias("__h"), F.count(F.lit(1)).alias("__c"), F.max("__take").alias("__take")
    )
    placed = ordered_totals(by_tie, group, "__tie", ["__c"])
    # of rows equal in score and tie, positives come first
    room = F.col("__take") - F.col("__c_before")
    partial = placed.filter(room > 0).groupBy(*group).agg(F.sum(F.least("__h", room)).alias("hits_edge"))
    if group:
        renamed = partial.select(*[F.col(g).alias(f"__r_{g}") for g in group], "hits_edge")
        cond = F.lit(True)
        for g in group:
            cond = cond & full[g].eqNullSafe(renamed[f"__r_{g}"])
        both = full.join(renamed, cond, "left")
        hits = F.col("hits_full") + F.coalesce(F.col("hits_edge"), F.lit(0))
    else:
        both = full
        hits = F.col("hits_full") + F.coalesce(partial.scalar(), F.lit(0))
    return both.select(
        *group,
        F.col("r").cast("bigint").alias("r"),
        F.when(F.col("r") > 0, hits / F.when(F.col("r") > 0, F.col("r"))).otherwise(F.lit(0.0)).alias("precision"),
    )


def ranking_summary(scored: DataFrame, label: str, score: str, ks: Sequence[float], pos_label: int = 1) -> DataFrame:
    """AUC, precision-recall area and top-k hits of one frame from one pass over its cells.

    Per ``k`` the row holds ``r`` (rows wanted), ``hits`` (positives on score
    levels wholly inside), and, when the cut falls inside a level, that level's
    score ``edge`` and the number of rows to ``take`` from it.
    """
    t = score_table(scored, (), label, score, pos_label)
    size, through = F.col("p_total") + F.col("n_total"), F.col("tp") + F.col("fp")
    above = through - F.col("p") - F.col("n")
    wins = F.sum(F.col("p").cast("double") * (F.col("n_before") + F.col("n") / 2))
    pairs = F.max("p_total").cast("double") * F.max("n_total")
    previous = F.when(above > 0, (F.col("tp") - F.col("p")) / F.when(above > 0, above)).otherwise(F.lit(1.0))
    step = F.when(F.col("p_total") > 0, F.col("p") / F.when(F.col("p_total") > 0, F.col("p_total")))
    aggs = [
        F.when(pairs > 0, wins / pairs).alias("auc"),
        F.sum(step * (F.col("tp") / through + previous) / 2).alias("aupr"),
    ]
    for i, k in enumerate(ks):
        r = F.floor(F.lit(float(k)) * size)
        cut = (above < r) & (through > r)
        aggs += [
            F.max(r).alias(f"r{i}"),
            F.sum(F.when(through <= r, F.col("p")).otherwise(0)).alias(f"hits{i}"),
            F.max(F.when(cut, F.col("score"))).alias(f"edge{i}"),
            F.max(F.when(cut, r - above)).alias(f"take{i}"),
        ]
    return t.agg(*aggs)


def edge_hits(scored: DataFrame, label: str, score: str, tie: str, edge: float, take: int, pos_label: int = 1) -> DataFrame:
    """Positives among the first ``take`` rows, by ``tie``, of one score level."""
    level = scored.filter((F.col(score) == F.lit(edge)) & F.col(label).isNotNull())
    by_tie = level.groupBy(F.col(tie).alias("__tie")).agg(
        F.sum(positive(label, pos_label).cast("int")).alias("__h"), F.count(F.lit(1)).alias("__c")
    )
    placed = ordered_totals(by_tie, (), "__tie", ["__c"])
    room = F.lit(take) - F.col("__c_before")
    return placed.agg(F.sum(F.when(room > 0, F.least("__h", room))).alias("hits"))


def confusion(scored: DataFrame, label: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """Counts by true and predicted class, at most four rows per group."""
    return scored.groupBy(*group, positive(label).cast("int").alias("label"), positive(predicted).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, and their support-weighted average."""
    y, z = positive(label).cast("int"), positive(predicted).cast("int")
    cells = scored.agg(
        *[F.count(F.when((y == a) & (z == b), 1)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    safe = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    c = lambda a, b: F.col(f"c{a}{b}")
    rows = []
    for k in (0, 1):
        precision = safe(c(k, k), c(0, k) + c(1, k))
        recall = safe(c(k, k), c(k, 0) + c(k, 1))
        rows.append(
            F.struct(
                F.lit(str(k)).alias("class"),
                precision.alias("precision"),
                recall.alias("recall"),
                safe(2 * precision * recall, precision + recall).alias("f1"),
                (c(k, 0) + c(k, 1)).alias("support"),
            )
        )
    per_class = cells.select(F.array(*rows).alias("r"))
    total = F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x["support"])
    weighted = lambda name: safe(
        F.aggregate("r", F.lit(0.0), lambda a, x: a + x[name] * x["support"]), total
    ).alias(name)
    average = F.struct(F.lit("avg / total").alias("class"), weighted("precision"), weighted("recall"), weighted("f1"), total.alias("support"))
    return per_class.select(F.explode(F.concat(F.col("r"), F.array(average))).alias("x")).select("x.*")


def mean_and_error(values: DataFrame, column: str) -> DataFrame:
    """Mean and standard error (population deviation) over folds."""
    n = F.count(column)
    return values.agg(
        F.avg(column).alias("mean"), (F.stddev_pop(column) / F.sqrt(n)).alias("sem"), n.alias("folds")
    )
