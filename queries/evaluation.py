"""Postprocessing, metrics, resampling, models and exploration queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortspark.operators import experiment as XP
from cohortspark.operators import explore as V
from cohortspark.operators import metrics as E
from cohortspark.operators import post as P
from cohortspark.operators import refit
from cohortspark.operators.features import windowed_aggregates
from cohortspark.operators.labels import LabelSpec, spine_by_window, transitions
from cohortspark.operators.models import ModelSpec, fit, nearest, neighbour_votes
from cohortspark.operators.resample import bootstrap_auc, bootstrap_mean, k_folds
from cohortspark.session import stored
from queries.base import POISSON_SQL, SPLIT, TRAIN_START, check_sql, oracle, query, raw, survived_sql, view, weight_sql
from queries.matrices import WINDOWS

# --- postprocessing ---------------------------------------------------------------

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    oracle(
        "person",
        "SELECT studentid, "
        + ", ".join(f"CAST(coalesce(e = '{v}', FALSE) AS INT) AS \"e_{v}\"" for v in _SEGMENTS if v != "FURNITURE")
        + " FROM (SELECT studentid, nullif(ethnicity, 'FURNITURE') AS e FROM person)",
    ),
)
def one_hot(spark, sf):
    """One column per category, null gives zeros."""
    p = view(spark, sf, "person").select("studentid", F.nullif("ethnicity", F.lit("FURNITURE")).alias("e"))
    return P.one_hot(p, "e")


@query(
    "null_dummy",
    oracle(
        "enrolment",
        "SELECT enrollid, coalesce(collegeid, 0) AS collegeid, CAST(collegeid IS NULL AS INT) AS collegeid_isnull, studentid FROM enrolment",
    ),
)
def null_dummy(spark, sf):
    """Indicator only for columns with nulls, then zero fill."""
    e = view(spark, sf, "enrolment").select("enrollid", "collegeid", "studentid")
    return P.fill_zero(P.null_dummy(P.null_dummy(e, "collegeid"), "studentid"), ["studentid"])


@query(
    "fill_median",
    oracle("provider", "SELECT collegeid, coalesce(price, (SELECT median(price) FROM provider)) AS price FROM provider"),
)
def fill_median(spark, sf):
    """Fill with the exact median."""
    return P.fill_median(view(spark, sf, "provider").select("collegeid", "price"), ["price"])


# --- metrics ------------------------------------------------------------------------

@query(
    "confusion",
    oracle("scored", "SELECT quality AS label, CAST(score > 40 AS INT) AS predicted, count(*) AS n FROM scored GROUP BY ALL"),
)
def confusion(spark, sf):
    """E01."""
    s = view(spark, sf, "scored").withColumn("hit", F.col("score") > 40)
    return E.confusion(s, "quality", "hit")


@query(
    "class_report",
    oracle(
        "scored",
        """WITH c AS (SELECT count(*) FILTER (quality = 0 AND score <= 40) AS tn, count(*) FILTER (quality = 0 AND score > 40) AS fp,
  count(*) FILTER (quality = 1 AND score <= 40) AS fn, count(*) FILTER (quality = 1 AND score > 40) AS tp FROM scored),
r AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM c
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM r)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM f
UNION ALL SELECT 'avg / total', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f""",
    ),
)
def class_report(spark, sf):
    """Precision, recall, F1, support per class and weighted."""
    s = view(spark, sf, "scored").withColumn("hit", F.col("score") > 40)
    out = E.class_report(s, "quality", "hit")
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def _auc_sql(source: str, group: str, label: str, score: str) -> str:
    """Mann-Whitney by average ranks: independent of the cell formula."""
    g, over = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    part = f"PARTITION BY {group}, s" if group else "PARTITION BY s"
    by = f"GROUP BY {group}" if group else ""
    return f"""r0 AS (SELECT {g}CAST({label} AS INT) AS y, {score} AS s FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL),
r1 AS (SELECT *, rank() OVER ({over} ORDER BY s) + (count(*) OVER ({part}) - 1) / 2 AS rk FROM r0),
aucs AS (SELECT {g}sum(y) AS np, count(*) - sum(y) AS nn,
  CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS a FROM r1 {by})"""


@query(
    "auc_exact",
    oracle(
        "scored",
        f"WITH {_auc_sql('scored', '', 'quality', 'score')} SELECT round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM aucs",
    ),
)
def auc_exact(spark, sf):
    """Exact AUC with ties."""
    return E.auc(view(spark, sf, "scored"), "quality", "score").withColumn("auc", F.round("auc", 9))


@query(
    "auc_grouped",
    oracle(
        "scored",
        f"WITH {_auc_sql('scored', 'lang', 'quality', 'size')} SELECT lang, round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM aucs",
    ),
)
def auc_grouped(spark, sf):
    """E03 per group."""
    return E.auc(view(spark, sf, "scored"), "quality", "size", ["lang"]).withColumn("auc", F.round("auc", 9))


@query(
    "auc_large",
    """WITH li AS (SELECT l_returnflag = 'A' AS y, l_extendedprice AS s FROM lineitem),
"""
    + _auc_sql("li", "", "y", "s")
    + " SELECT round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM aucs",
)
def auc_large(spark, sf):
    """E03 on near-unique scores over the largest table."""
    li = raw(spark, sf, "lineitem").select((F.col("l_returnflag") == "A").alias("y"), F.col("l_extendedprice").alias("s"))
    return E.auc(li, "y", "s").withColumn("auc", F.round("auc", 9))


_CURVE = """cells AS (SELECT score AS s, count(*) FILTER (quality = {pos}) AS p, count(*) AS c FROM scored GROUP BY 1),
cum AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS above, sum(p) OVER () AS np, sum(c) OVER () AS n FROM cells)"""


@query(
    "pr_area",
    oracle(
        "scored",
        "WITH "
        + _CURVE.format(pos=0)
        + """, pts AS (SELECT s, tp / above AS pr, tp / np AS re, coalesce(lag(tp / above) OVER (ORDER BY s DESC), 1.0) AS pr0, coalesce(lag(tp / np) OVER (ORDER BY s DESC), 0.0) AS re0 FROM cum)
SELECT round(sum((re - re0) * (pr + pr0) / 2), 9) AS aupr FROM pts""",
    ),
)
def pr_area(spark, sf):
    """Trapezoid area under precision-recall for class 0."""
    return E.pr_area(view(spark, sf, "scored"), "quality", "score", pos_label=0).withColumn("aupr", F.round("aupr", 9))


@query(
    "roc_points",
    oracle(
        "scored",
        "WITH "
        + _CURVE.format(pos=1)
        + " SELECT s AS threshold, round((above - tp) / (n - np), 9) AS fpr, round(tp / np, 9) AS tpr FROM cum UNION ALL SELECT NULL, 0.0, 0.0",
    ),
)
def roc_points(spark, sf):
    """ROC points with the origin."""
    out = E.roc_points(view(spark, sf, "scored"), "quality", "score")
    return out.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    "pr_population",
    oracle(
        "scored",
        "WITH "
        + _CURVE.format(pos=1)
        + """, kept AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY s DESC) AS tp0 FROM cum)
SELECT s AS threshold, round(above / n, 9) AS fraction, round(tp / above, 9) AS precision, round(tp / np, 9) AS recall FROM kept WHERE tp0 < np""",
    ),
)
def pr_population(spark, sf):
    """Precision and recall against the population share above each threshold."""
    out = E.population_curve(view(spark, sf, "scored"), "quality", "score")
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("fraction", "precision", "recall")])


def _top_sql(group: str) -> str:
    g, by, over = (f"{group}, ", f"GROUP BY {group}", f"PARTITION BY {group}") if group else ("", "", "")
    return f"""SELECT {g}CAST(r AS BIGINT) AS r, round(CASE WHEN r = 0 THEN 0.0 ELSE hits / r END, 9) AS precision FROM (
SELECT {g}max(floor(0.1 * n)) AS r, count(*) FILTER (quality = 0 AND rn <= floor(0.1 * n)) AS hits FROM (
  SELECT *, row_number() OVER ({over} ORDER BY score DESC, doc_id) AS rn, count(*) OVER ({over}) AS n FROM scored) {by})"""


@query("precision_top_k", oracle("scored", _top_sql("")))
def precision_top_k(spark, sf):
    """Precision among the highest tenth for class 0, ties by id."""
    out = E.precision_top_k(view(spark, sf, "scored"), 0.1, "quality", "score", "doc_id", pos_label=0)
    return out.withColumn("precision", F.round("precision", 9))


@query("precision_top_k_grouped", oracle("scored", _top_sql("lang")))
def precision_top_k_grouped(spark, sf):
    """E05 per group."""
    out = E.precision_top_k(view(spark, sf, "scored"), 0.1, "quality", "score", "doc_id", ["lang"], pos_label=0)
    return out.withColumn("precision", F.round("precision", 9))


# --- windows and transitions ------------------------------------------------------------

_WIN_VALUES = ", ".join(f"({w.window_id}, DATE '{w.start}', DATE '{w.split}')" for w in WINDOWS)


@query(
    "windowed_features",
    f"""WITH win(window_id, lo, split) AS (VALUES {_WIN_VALUES})
SELECT o.o_custkey AS studentid, w.window_id, count(*) FILTER (o.o_orderdate < w.split) AS n_orders,
  nullif(count(*) FILTER (o.o_orderdate < w.split AND o.o_orderstatus = 'F'), 0) AS n_done,
  max(CASE WHEN o.o_orderdate < w.split THEN o.o_totalprice END) AS best FROM orders o CROSS JOIN win w GROUP BY 1, 2
HAVING count(*) FILTER (o.o_orderdate < w.split) > 0""",
)
def windowed_features(spark, sf):
    """Point-in-time counts for every window from one scan and one shuffle."""
    o = raw(spark, sf, "orders").select(F.col("o_custkey").alias("studentid"), F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus", "o_totalprice")
    done = F.col("o_orderstatus") == "F"
    n = lambda p: F.count(F.when(p, 1))
    return windowed_aggregates(
        o, "studentid", "d", WINDOWS,
        {
            "n_orders": n,
            "n_done": lambda p: F.nullif(n(p & done), F.lit(0)),
            "best": lambda p: F.max(F.when(p, F.col("o_totalprice"))),
        },
    )


def _windowed_matrix(spark, sf):
    spine = spine_by_window(view(spark, sf, "enrolment"), LabelSpec(3), WINDOWS)
    o = raw(spark, sf, "orders").select(F.col("o_custkey").alias("studentid"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    measures = {
        "n_orders": lambda p: F.count(F.when(p, 1)),
        "spend": lambda p: F.max(F.when(p, F.col("o_totalprice"))),
    }
    feats = windowed_aggregates(o, "studentid", "d", WINDOWS, measures)
    price = view(spark, sf, "provider").select("collegeid", "price")
    return spine.join(feats, ["studentid", "window_id"], "left").join(price, "collegeid", "left")


_WMATRIX = f"""win(window_id, lo, split) AS (VALUES {_WIN_VALUES}),
sh AS (SELECT window_id, split, {check_sql('lo', -3)} AS a, {check_sql('split', -3)} AS b FROM win),
sp AS (SELECT s.window_id, s.split, e.enrollid, e.studentid, e.collegeid, {survived_sql(3, 'e.')} AS y FROM enrolment e JOIN sh s ON e.start_date >= s.a AND e.start_date < s.b),
ft AS (SELECT w.window_id, o.o_custkey AS studentid, count(*) FILTER (o.o_orderdate < w.split) AS n_orders, max(CASE WHEN o.o_orderdate < w.split THEN o.o_totalprice END) AS spend FROM orders o CROSS JOIN win w GROUP BY 1, 2),
wm AS (SELECT sp.*, ft.n_orders, ft.spend, p.price FROM sp LEFT JOIN ft USING (window_id, studentid) LEFT JOIN provider p USING (collegeid) WHERE y IS NOT NULL),
long AS (SELECT window_id, y, 'n_orders' AS feature, CAST(n_orders AS DOUBLE) AS value FROM wm UNION ALL SELECT window_id, y, 'spend', spend FROM wm UNION ALL SELECT window_id, y, 'price', price FROM wm)"""


@query(
    "auc_by_window",
    oracle(
        "enrolment provider",
        f"WITH {_WMATRIX}, {_auc_sql('long', 'window_id, feature', 'y', 'value')} SELECT window_id, feature, round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM aucs",
    ),
)
def auc_by_window(spark, sf):
    """Each feature as a score, per rolling window, in one job."""
    m = _windowed_matrix(spark, sf)
    return V.auc_by_feature(m, "persist_3_halfyear", "window_id", ["n_orders", "spend", "price"]).withColumn("auc", F.round("auc", 9))


@query(
    "window_counts",
    oracle("enrolment provider", f"WITH {_WMATRIX} SELECT window_id, y AS persist_3_halfyear, count(*) AS n FROM wm GROUP BY ALL"),
)
def window_counts(spark, sf):
    """Outcomes per window."""
    return V.window_counts(_windowed_matrix(spark, sf), "persist_3_halfyear", "window_id")


@query(
    "auc_by_transition",
    oracle(
        "enrolment",
        "WITH steps AS ("
        + " UNION ALL ".join(
            f"SELECT '{n - 1}->{n}' AS transition, {survived_sql(n)} AS y, CAST(collegeid AS DOUBLE) AS v, CAST(month(start_date) AS DOUBLE) AS m FROM enrolment"
            f" WHERE start_date >= {check_sql(f'''DATE '{TRAIN_START}' ''', -n)} AND start_date < {check_sql(f'''DATE '{SPLIT}' ''', -n)}"
            + (f" AND ({survived_sql(n - 1)})" if n > 1 else "")
            for n in range(1, 9)
        )
        + f"""), long AS (SELECT transition, y, 'collegeid' AS feature, v AS value FROM steps UNION ALL SELECT transition, y, 'month', m FROM steps),
{_auc_sql('long', 'transition, feature', 'y', 'value')} SELECT transition, feature, round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM aucs""",
    ),
)
def auc_by_transition(spark, sf):
    """Each feature as a score, per transition."""
    t = transitions(view(spark, sf, "enrolment"), TRAIN_START, SPLIT).withColumn("month", F.month("start_date"))
    return V.auc_by_feature(t, "persist", "transition", ["collegeid", "month"]).withColumn("auc", F.round("auc", 9))


# --- resampling -----------------------------------------------------------------------------

def _interval_sql(table: str, group: str, value: str) -> str:
    """lower, upper and replicates: the order statistics int(q * m) of the known values."""
    at = lambda q: f"list_sort(list({value}))[1 + CAST(floor({q} * count(*)) AS BIGINT)]"
    return f"SELECT {group}, {at(0.025)} AS lower, {at(0.975)} AS upper, CAST(count(*) AS INT) AS replicates FROM {table} WHERE {value} IS NOT NULL GROUP BY ALL"


def _bootstrap_auc_sql(src: str, group: str, label: str, score: str, text: str) -> str:
    """CTEs ending in bi: group..., lower, upper, replicates of the AUC over weighted cells."""
    return f"""bc AS (SELECT {group}, {score} AS score, count(*) FILTER (CAST({label} AS INT) = 1) AS p, count(*) FILTER (CAST({label} AS INT) = 0) AS n
  FROM {src} WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY ALL),
{POISSON_SQL}, {weight_sql('bw', 'bc', text, {'wp': ('p', 0), 'wn': ('n', 2)}, 1500)},
br AS (SELECT *, sum(wn) OVER (PARTITION BY {group}, rep ORDER BY score) - wn AS below FROM bw),
ba AS (SELECT {group}, rep, CASE WHEN sum(wp) > 0 AND sum(wn) > 0 THEN sum(wp * (below + wn / 2)) / (sum(wp) * sum(wn)) END AS a FROM br GROUP BY ALL),
bi AS ({_interval_sql('ba', group, 'a')})"""


@query(
    "bootstrap_auc_ci",
    oracle(
        "scored",
        f"""WITH {_auc_sql('scored', 'lang', 'quality', 'score')},
{_bootstrap_auc_sql('scored', 'lang', 'quality', 'score', "'0|' || lang || '|' || CAST(score AS VARCHAR)")}
SELECT lang, round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives, round(lower, 9) AS lower, round(upper, 9) AS upper, replicates
FROM aucs LEFT JOIN bi USING (lang)""",
    ),
)
def bootstrap_auc_ci(spark, sf):
    """AUC with a bootstrap interval of 1,500 replicates, per language."""
    s = view(spark, sf, "scored")
    both = E.auc(s, "quality", "score", ["lang"]).join(bootstrap_auc(s, "quality", "score", ["lang"], n_boot=1500), "lang", "left")
    return both.withColumns({c: F.round(c, 9) for c in ("auc", "lower", "upper")})


@query(
    "auc_by_window_ci",
    oracle(
        "enrolment provider",
        f"""WITH {_WMATRIX}, lv AS (SELECT * FROM long WHERE feature <> 'spend'), {_auc_sql('lv', 'window_id, feature', 'y', 'value')},
{_bootstrap_auc_sql('lv', 'window_id, feature', 'y', 'value', "'0|' || window_id || '|' || feature || '|' || CAST(score AS VARCHAR)")}
SELECT window_id, feature, round(a, 9) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives, round(lower, 9) AS lower, round(upper, 9) AS upper, replicates
FROM aucs LEFT JOIN bi USING (window_id, feature)""",
    ),
)
def auc_by_window_ci(spark, sf):
    """Each feature as a score, per rolling window, with a bootstrap interval of 1,500 replicates."""
    out = V.auc_by_feature_ci(_windowed_matrix(spark, sf), "persist_3_halfyear", "window_id", ["n_orders", "price"])
    return out.withColumns({c: F.round(c, 9) for c in ("auc", "lower", "upper")})


@query(
    "bootstrap_mean_ci",
    oracle(
        "enrolment provider",
        f"""WITH {_WMATRIX}, mc AS (SELECT window_id, y, feature, value AS v, count(*) AS c FROM long WHERE feature <> 'spend' AND value IS NOT NULL GROUP BY ALL),
{POISSON_SQL}, {weight_sql('mw', 'mc', "'0|' || window_id || '|' || y || '|' || feature || '|' || CAST(v AS VARCHAR)", {'w': ('c', 0)}, 1500)},
mr AS (SELECT window_id, y, feature, rep, sum(w * v) / nullif(sum(w), 0) AS m FROM mw GROUP BY ALL),
mi AS ({_interval_sql('mr', 'window_id, y, feature', 'm')}),
mp AS (SELECT window_id, y, feature, sum(v * c) / sum(c) AS mean, CAST(sum(c) AS BIGINT) AS rows FROM mc GROUP BY ALL)
SELECT window_id, y AS persist_3_halfyear, feature, round(mean, 6) AS mean, rows, round(lower, 6) AS lower, round(upper, 6) AS upper, replicates
FROM mp LEFT JOIN mi USING (window_id, y, feature)""",
    ),
)
def bootstrap_mean_ci(spark, sf):
    """Feature means per outcome and window with a bootstrap interval of 1,500 replicates."""
    out = V.window_means(_windowed_matrix(spark, sf), "persist_3_halfyear", "window_id", ["n_orders", "price"], n_boot=1500)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "lower", "upper")})


@query(
    "k_fold_sizes",
    oracle(
        "scored",
        """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM scored),
b AS (SELECT i, floor(i * n / 10) AS lo, floor((i + 1) * n / 10) AS hi FROM (SELECT unnest(range(10)) AS i) CROSS JOIN (SELECT max(n) AS n FROM p))
SELECT doc_id, CAST(i AS INT) AS fold FROM p JOIN b ON pos >= lo AND pos < hi""",
    ),
)
def k_fold_sizes(spark, sf):
    """Shuffled k folds with exact boundaries."""
    return k_folds(view(spark, sf, "scored").select("doc_id"), "doc_id", 10, seed=7).select("doc_id", "fold")


def _doc_features(spark, sf):
    d = raw(spark, sf, "documents").select(
        "doc_id",
        F.log1p("n_chars").alias("chars"),
        F.log1p(F.size(F.split("text", r"\s+"))).alias("words"),
        (F.length(F.regexp_replace("text", r"[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("letters"),
        F.log1p(F.size(F.split("text", r"[.!?]"))).alias("sentences"),
        (F.col("lang") == "en").cast("double").alias("english"),
    )
    y = raw(spark, sf, "labels").select("doc_id", "quality")
    # text measures are used by many fits: write them once
    return stored(d.join(y, "doc_id"), "doc-features")


_DOC = ["chars", "words", "letters", "sentences", "english"]


@query("kfold_auc")
def kfold_auc(spark, sf):
    """Mean and standard error of the AUC over folds."""
    scores = XP.k_fold_scores(_doc_features(spark, sf), "doc_id", _DOC, "quality", ModelSpec("LogisticRegression", {"max_iter": 20}), k=10)
    return XP.k_fold_auc(scores, "quality")


#: Rows a task reads at least, where there are as many.
_TASK_ROWS = 16_384
#: Learners that draw rows or split candidates partition by partition: these read the folds as they lie.
_DRAWING = {"RandomForest", "GBC", "DTC", "AdaBoost"}


@query("model_grid")
def model_grid(spark, sf):
    """One experiment row per model and parameter set."""
    folded = k_folds(_doc_features(spark, sf), "doc_id", 2).withColumnRenamed("doc_id", XP.ROW_KEY).persist()
    # the folds lie in many small partitions, and there are hundreds of passes: a task reads several of them
    few = folded.coalesce(max(1, math.ceil(folded.count() / _TASK_ROWS)))
    train, test = few.filter("fold = 0").drop("fold"), few.filter("fold = 1").drop("fold")
    as_laid = folded.filter("fold = 0").drop("fold")
    grids = {
        "LogisticRegression": {"C": [0.1, 1.0], "penalty": "l2", "max_iter": 20},
        "SVM": {"C": 1.0, "max_iter": 10},
        "RandomForest": {"n_estimators": 10, "max_depth": 5},
        "GBC": {"n_estimators": 5},
        "DTC": {"max_depth": 4},
        "GNB": {},
        "SGD": {"loss": "log", "max_iter": 20},
        "AdaBoost": {"n_estimators": 3},
    }
    rows = []
    for name, grid in grids.items():
        for params in XP.parameter_grid(grid):
            seen = as_laid if name in _DRAWING else None
            rows.append(XP.run_experiment(train, test, _DOC, "quality", ModelSpec(name, params), "lax", seen))
    folded.unpersist()
    return XP.results_frame(spark, rows).drop("seconds")


@query("auc_by_feature_group")
def auc_by_feature_group(spark, sf):
    """AUC per feature group with an interval from 1,500 refits; see ``refit_bootstrap_shares`` for the hard check."""
    folded = k_folds(_doc_features(spark, sf), "doc_id", 2)
    groups = {"length": ["chars", "words", "sentences"], "content": ["letters", "english"]}
    return refit.auc_by_feature_group(folded.filter("fold = 0"), folded.filter("fold = 1"), groups, "quality", "doc_id")


_LABELLED = """d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x1, CAST(lang = 'en' AS DOUBLE) AS x2, CAST(n_chars > 1500 AS DOUBLE) AS x3,
  quality AS y FROM documents JOIN labels USING (doc_id))"""


def _labelled(spark, sf):
    return raw(spark, sf, "documents").join(raw(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("x1"), (F.col("lang") == "en").cast("double").alias("x2"),
        (F.col("n_chars") > 1500).cast("double").alias("x3"), F.col("quality").alias("y"),
    )


_FOLDS = """fo AS (SELECT *, CAST(floor(((row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id)) * {k} - 1) / count(*) OVER ()) AS INT) AS fold FROM d)"""


@query(
    "refit_bootstrap_shares",
    f"""WITH {_LABELLED}, {_FOLDS.format(k=2)}, {POISSON_SQL},
tr AS (SELECT * FROM fo WHERE fold = 0), {weight_sql('rw', 'tr', "'0|' || doc_id", {'w': ('1', 0)}, 1500)},
al AS (SELECT doc_id, rep + 1 AS rep, w, x2, x3, y FROM rw UNION ALL SELECT doc_id, 0, 1, x2, x3, y FROM tr),
lo AS (SELECT rep, w, y, 'english' AS g, x2 AS x FROM al UNION ALL SELECT rep, w, y, 'long', x3 FROM al),
sh AS (SELECT g, rep, sum(w * y * x) / nullif(sum(w * x), 0) AS s1, sum(w * y * (1 - x)) / nullif(sum(w * (1 - x)), 0) AS s0 FROM lo GROUP BY ALL),
te AS (SELECT 'english' AS g, x2 AS x, y FROM fo WHERE fold = 1 UNION ALL SELECT 'long', x3, y FROM fo WHERE fold = 1),
tc AS (SELECT g, sum(y * x) AS p1, sum(y * (1 - x)) AS p0, sum((1 - y) * x) AS n1, sum((1 - y) * (1 - x)) AS n0 FROM te GROUP BY g),
au AS (SELECT g, rep, CASE WHEN s1 > s0 THEN (p1 * n0 + (p1 * n1 + p0 * n0) / 2) / ((p1 + p0) * (n1 + n0)) WHEN s1 < s0 THEN (p0 * n1 + (p1 * n1 + p0 * n0) / 2) / ((p1 + p0) * (n1 + n0)) ELSE 0.5 END AS a FROM sh JOIN tc USING (g)),
it AS ({_interval_sql('(SELECT * FROM au WHERE rep > 0)', 'g', 'a')})
SELECT g AS feature_group, round(lower, 9) AS lower, round(a, 9) AS auc, round(upper, 9) AS upper, replicates FROM it JOIN (SELECT * FROM au WHERE rep = 0) USING (g)""",
)
def refit_bootstrap_shares(spark, sf):
    """1,500 refits on one binary feature without penalty order the test rows by weighted class shares."""
    folded = k_folds(_labelled(spark, sf), "doc_id", 2)
    out = refit.auc_by_feature_group(folded.filter("fold = 0"), folded.filter("fold = 1"), {"english": ["x2"], "long": ["x3"]}, "y", "doc_id", C=1e15)
    return out.withColumns({c: F.round(c, 9) for c in ("lower", "auc", "upper")})


@query(
    "gnb_scores",
    f"""WITH {_LABELLED}, e AS (SELECT 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS eps, count(*) AS n FROM d),
c AS (SELECT y, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM d GROUP BY y),
l AS (SELECT doc_id, c.y, ln(c.n / e.n) - (ln(2 * pi() * (v1 + eps)) + (x1 - m1) ** 2 / (v1 + eps) + ln(2 * pi() * (v2 + eps)) + (x2 - m2) ** 2 / (v2 + eps)) / 2 AS ll
  FROM d, c, e),
s AS (SELECT doc_id, 1 / (1 + exp(sum(CASE WHEN y = 0 THEN ll ELSE -ll END))) AS score FROM l GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, CAST(score > 0.5 AS INT) AS predicted FROM s""",
)
def gnb_scores(spark, sf):
    """Class means and variances in closed form."""
    d = _labelled(spark, sf)
    return fit(ModelSpec("GNB"), d, ["x1", "x2"], "y").score(d).select("doc_id", F.round("score", 6).alias("score"), "predicted")


@query(
    "logit_scores",
    f"WITH {_LABELLED} SELECT x2, count(*) AS n, round(avg(y), 3) AS score FROM d GROUP BY 1",
)
def logit_scores(spark, sf):
    """With one binary feature and hardly any penalty the scores are the class shares."""
    d = _labelled(spark, sf)
    scored = fit(ModelSpec("LogisticRegression", {"C": 1e9, "max_iter": 200}), d, ["x2"], "y").score(d)
    return scored.groupBy("x2").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("score"))


_CELLS = "k AS (SELECT x2, x3, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM d GROUP BY 1, 2)"


def _newton_sql(penalty: float, steps: int = 25) -> str:
    """CTEs that end in ``nw``: b0, b1, b2 of a penalised logistic regression on two binary features, by Newton steps over their four cells."""
    cells = [(i, j) for i in (0, 1) for j in (0, 1)]
    pick = lambda c, i, j: f"max(CASE WHEN x2 = {i} AND x3 = {j} THEN {c} ELSE 0 END) AS {c}{i}{j}"
    prob = ", ".join(f"1 / (1 + exp(-(b0 + {i} * b1 + {j} * b2))) AS q{i}{j}" for i, j in cells)
    total = lambda w, keep=lambda i, j: True: " + ".join(w.format(i=i, j=j) for i, j in cells if keep(i, j)) or "0"
    err, bend = "(n{i}{j} * q{i}{j} - p{i}{j})", "n{i}{j} * q{i}{j} * (1 - q{i}{j})"
    sums = {
        "g0": total(err), "g1": f"{total(err, lambda i, j: i)} + {penalty} * b1", "g2": f"{total(err, lambda i, j: j)} + {penalty} * b2",
        "h00": total(bend), "h01": total(bend, lambda i, j: i), "h02": total(bend, lambda i, j: j),
        "h11": f"{total(bend, lambda i, j: i)} + {penalty}", "h12": total(bend, lambda i, j: i and j), "h22": f"{total(bend, lambda i, j: j)} + {penalty}",
    }
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    s0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
    s1 = "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
    s2 = "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
    return f"""{_CELLS}, kw AS (SELECT {', '.join(pick(c, i, j) for c in 'np' for i, j in cells)} FROM k),
nr AS (SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, * FROM kw UNION ALL
  SELECT step + 1, b0 - {s0} / {det}, b1 - {s1} / {det}, b2 - {s2} / {det}, * EXCLUDE (step, b0, b1, b2, {', '.join([*sums, *[f'q{i}{j}' for i, j in cells]])})
  FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in sums.items())} FROM (SELECT *, {prob} FROM nr WHERE step < {steps}))),
nw AS (SELECT b0, b1, b2 FROM nr WHERE step = {steps})"""


@query(
    "logit_penalised",
    f"""WITH RECURSIVE {_LABELLED}, {_newton_sql(20.0)} SELECT doc_id, round(1 / (1 + exp(-(b0 + b1 * x2 + b2 * x3))), 3) AS score FROM d, nw""",
)
def logit_penalised(spark, sf):
    """Two features under a real penalty, row by row against Newton steps."""
    d = _labelled(spark, sf)
    scored = fit(ModelSpec("LogisticRegression", {"C": 0.05, "max_iter": 500}), d, ["x2", "x3"], "y").score(d)
    return scored.select("doc_id", F.round("score", 3).alias("score"))


@query("sgd_scores", f"WITH {_LABELLED}, s AS (SELECT x3, avg(y) AS score FROM d GROUP BY 1) SELECT doc_id, round(score, 3) AS score FROM d JOIN s USING (x3)")
def sgd_scores(spark, sf):
    """Logistic loss without a penalty to speak of on one binary feature gives the class shares."""
    d = _labelled(spark, sf)
    scored = fit(ModelSpec("SGD", {"loss": "log", "alpha": 1e-12, "max_iter": 500}), d, ["x3"], "y").score(d)
    return scored.select("doc_id", F.round("score", 3).alias("score"))


@query("forest_scores", f"WITH {_LABELLED}, {_CELLS} SELECT doc_id, round(p / n, 6) AS score, CAST(p / n > 0.5 AS INT) AS predicted FROM d JOIN k USING (x2, x3)")
def forest_scores(spark, sf):
    """Every tree of a forest without resampling holds the class shares of the feature cells."""
    d = _labelled(spark, sf)
    spec = ModelSpec("RandomForest", {"n_estimators": 100, "max_depth": 5, "max_features": None, "bootstrap": False})
    return fit(spec, d, ["x2", "x3"], "y").score(d).select("doc_id", F.round("score", 6).alias("score"), "predicted")


@query(
    "gbc_scores",
    f"""WITH RECURSIVE {_LABELLED}, {_CELLS},
g AS (SELECT x2, x3, p / n AS s, 2 * p / n - 1 AS f, 1 AS trees FROM k UNION ALL
  SELECT x2, x3, s, f + 0.1 * (4 * s / (1 + exp(2 * f)) - 4 * (1 - s) / (1 + exp(-2 * f))), trees + 1 FROM g WHERE trees < 100)
SELECT doc_id, round(1 / (1 + exp(-2 * f)), 6) AS score, CAST(f > 0 AS INT) AS predicted FROM d JOIN g USING (x2, x3) WHERE trees = 100""",
)
def gbc_scores(spark, sf):
    """100 rounds of gradient boosting; trees of depth 3 over two binary features make each of their cells a recursion of its own."""
    d = _labelled(spark, sf)
    spec = ModelSpec("GBC", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3})
    return fit(spec, d, ["x2", "x3"], "y").score(d).select("doc_id", F.round("score", 6).alias("score"), "predicted")


def _stumps_sql(rounds: int) -> str:
    """CTEs that end in ``ab``: after the last round, per pair of feature values the weighted votes v and their total.

    State: the weight of each (x2, x3, y) cell.  A round takes the feature with the
    larger Gini gain; leaves of one class, or an error of a half, end it.
    """
    cells = [(i, j, y) for i in (0, 1) for j in (0, 1) for y in (0, 1)]
    w = lambda keep: " + ".join(f"w{i}{j}{y}" for i, j, y in cells if keep(i, j, y))
    first = ", ".join(f"max(CASE WHEN x2 = {i} AND x3 = {j} THEN {'p' if y else 'n - p'} ELSE 0 END) AS w{i}{j}{y}" for i, j, y in cells)
    side = lambda f, v: (lambda i, j, y: (i, j)[f] == v)
    impurity = lambda one, all_: f"(2 * ({one}) * (({all_}) - ({one})) / nullif({all_}, 0))"  # times the weight
    sums = {f"a{f}{v}": w(side(f, v)) for f in (0, 1) for v in (0, 1)}
    sums |= {f"o{f}{v}": w(lambda i, j, y, f=f, v=v: (i, j)[f] == v and y) for f in (0, 1) for v in (0, 1)}
    sums["tot"] = w(lambda *_: True)
    left = lambda f: " + ".join(f"coalesce({impurity(f'o{f}{v}', f'a{f}{v}')}, 0)" for v in (0, 1))
    pickf = f"CASE WHEN {left(1)} < {left(0)} THEN 1 ELSE 0 END"
    leaf = lambda v: f"CASE f WHEN 0 THEN CAST(o0{v} > a0{v} - o0{v} AS INT) ELSE CAST(o1{v} > a1{v} - o1{v} AS INT) END"
    vote = lambda i, j: f"CASE CASE f WHEN 0 THEN {i} ELSE {j} END WHEN 0 THEN c0 ELSE c1 END"
    miss = lambda i, j, y: f"CAST({vote(i, j)} <> {y} AS INT)"
    bad = " + ".join(f"w{i}{j}{y} * {miss(i, j, y)}" for i, j, y in cells)
    pairs = [(i, j) for i in (0, 1) for j in (0, 1)]
    go = "c0 <> c1 AND err < 0.5"
    return f"""{_CELLS}, ad AS (SELECT 0 AS step, FALSE AS done, 0.0::DOUBLE AS total, {', '.join(f'0.0::DOUBLE AS v{i}{j}' for i, j in pairs)}, {first} FROM k UNION ALL
  SELECT step + 1, NOT ({go}) OR err = 0, total + CASE WHEN {go} THEN alpha ELSE 0 END,
    {', '.join(f"v{i}{j} + CASE WHEN {go} THEN alpha * {vote(i, j)} ELSE 0 END" for i, j in pairs)},
    {', '.join(f"CASE WHEN {go} THEN w{i}{j}{y} * exp(alpha * {miss(i, j, y)}) / tot ELSE w{i}{j}{y} END" for i, j, y in cells)}
  FROM (SELECT *, CASE WHEN err > 0 AND err < 1 THEN ln((1 - err) / err) ELSE ln(1e10) END AS alpha FROM (SELECT *, ({bad}) / tot AS err FROM (SELECT *, {leaf(0)} AS c0, {leaf(1)} AS c1 FROM
    (SELECT *, {pickf} AS f FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in sums.items())} FROM ad WHERE step < {rounds} AND NOT done)))))),
ab AS (SELECT * FROM ad ORDER BY step DESC LIMIT 1)"""


@query(
    "adaboost_scores",
    f"""WITH RECURSIVE {_LABELLED.replace('quality AS y', 'CAST(n_chars % 10 < 2 + 3 * CAST(lang = ' + chr(39) + 'en' + chr(39) + ' AS INT) + 3 * CAST(n_chars > 1500 AS INT) AS INT) AS y')}, {_stumps_sql(50)}, r AS (SELECT doc_id, CASE WHEN x2 = 0 THEN CASE WHEN x3 = 0 THEN v00 ELSE v01 END ELSE CASE WHEN x3 = 0 THEN v10 ELSE v11 END END / CASE WHEN total = 0 THEN 1 ELSE total END AS v FROM d, ab)
SELECT doc_id, round(v, 6) AS score, CAST(v > 0.5 AS INT) AS predicted FROM r""",
)
def adaboost_scores(spark, sf):
    """50 rounds of boosted stumps on two binary features, against a recursion over the weights of their cells.

    The label leans on both features, so that leaves have different classes for several rounds.
    """
    d = _labelled(spark, sf).withColumn("y", (F.col("x1") % 10 < 2 + 3 * F.col("x2") + 3 * F.col("x3")).cast("int"))
    out = fit(ModelSpec("AdaBoost", {"n_estimators": 50}), d, ["x2", "x3"], "y").score(d)
    return out.select("doc_id", F.round("score", 6).alias("score"), "predicted")


@query(
    "tree_scores",
    f"""WITH {_LABELLED}, f AS (SELECT doc_id, 'x2' AS f, x2 AS x, y FROM d UNION ALL SELECT doc_id, 'x3', x3, y FROM d),
leaf AS (SELECT f, x, count(*) AS n, avg(y) AS p FROM f GROUP BY 1, 2),
best AS (SELECT f FROM leaf GROUP BY f ORDER BY sum(n * p * (1 - p)), f LIMIT 1)
SELECT doc_id, round(p, 9) AS score, CAST(p > 0.5 AS INT) AS predicted FROM f JOIN best USING (f) JOIN leaf USING (f, x)""",
)
def tree_scores(spark, sf):
    """A tree of depth one, against a search of all splits."""
    d = _labelled(spark, sf)
    return fit(ModelSpec("DTC", {"max_depth": 1}), d, ["x2", "x3"], "y").score(d).select("doc_id", F.round("score", 9).alias("score"), "predicted")


@query(
    "knn_scores",
    """WITH e AS (SELECT vec_id, embedding[1:4] AS v, CAST(label >= 5 AS INT) AS y FROM embeddings),
pairs AS (SELECT a.vec_id AS q, b.y, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2)) AS d2, b.vec_id AS p
  FROM e a JOIN e b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
nn AS (SELECT *, sqrt(d2) AS d FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) <= 5),
s AS (SELECT q AS vec_id, avg(y) AS u,
  CASE WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0) END AS w FROM nn GROUP BY 1)
SELECT vec_id, round(u, 6) AS uniform, round(w, 6) AS weighted FROM s""",
)
def knn_scores(spark, sf):
    """The neighbour scorer with both weightings, train and test apart."""
    e = raw(spark, sf, "embeddings")
    names = [f"v{i}" for i in range(4)]
    e = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)], (F.col("label") >= 5).cast("int").alias("y"))
    train, test = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", XP.ROW_KEY)
    scores = [fit(ModelSpec("KNN", {"n_neighbors": 5, "weights": w}), train, names, "y").score(test) for w in ("uniform", "distance")]
    a, b = (s.select(F.col(XP.ROW_KEY).alias("vec_id"), F.round("score", 6).alias(n)) for s, n in zip(scores, ("uniform", "weighted")))
    return a.join(b, "vec_id")


_KNN = """pairs AS (SELECT a.vec_id AS q, b.vec_id AS p, b.label AS label,
  round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 9) AS d2
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nn AS (SELECT q, p, label, d2 FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) <= 5)"""


@query("knn_neighbours", f"WITH {_KNN} SELECT q AS vec_id, p AS neighbour, label, round(sqrt(d2), 6) AS distance FROM nn")
def knn_neighbours(spark, sf):
    """Five nearest other vectors of every vector, exact."""
    e = raw(spark, sf, "embeddings")
    out = nearest(e, e, 5, "vec_id", "vec_id", "embedding", "label", exclude_self=True)
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "knn_vote",
    f"""WITH {_KNN}, v AS (SELECT q, label, count(*) AS c FROM nn GROUP BY 1, 2)
SELECT q AS vec_id, label AS predicted, c / 5 AS share FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, label) = 1""",
)
def knn_vote(spark, sf):
    """Majority vote of the five nearest neighbours."""
    e = raw(spark, sf, "embeddings")
    out = nearest(e, e, 5, "vec_id", "vec_id", "embedding", "label", exclude_self=True)
    return neighbour_votes(out, "vec_id", "label")


# --- exploration ------------------------------------------------------------------------------

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "corr_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _NUM for b in _NUM),
)
def corr_matrix(spark, sf):
    """Correlation of every column pair in one pass."""
    return V.correlation_matrix(raw(spark, sf, "lineitem"), _NUM).withColumn("corr", F.round("corr", 6))


@query(
    "pairwise_fit",
    " UNION ALL ".join(
        f"SELECT year(l_shipdate) AS year, l_returnflag, '{x}' AS x, '{y}' AS y, round(corr({y}, {x}), 6) AS corr, round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 6) AS intercept FROM lineitem GROUP BY ALL"
        for x, y in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))
    ),
)
def pairwise_fit(spark, sf):
    """Correlation and regression line of feature pairs per window and outcome."""
    li = raw(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate").cast("bigint"))
    out = V.pairwise_fit(li, ["l_quantity", "l_discount", "l_tax"], ["year", "l_returnflag"])
    return out.select("year", "l_returnflag", "x", "y", *[F.round(c, 6).alias(c) for c in ("corr", "slope", "intercept")])


def _jacobi_sql(names, sweeps: int = 7) -> str:
    """CTEs that end in ``jz``: eigenvalues d0.. and axes v{row}{axis} of the columns' correlation matrix, by cyclic Jacobi rotations.

    Every rotation is a one-row table; independent of the Spark side, which sums
    products once and leaves the axes to a library.
    """
    n = len(names)
    up = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    first = ", ".join("1.0::DOUBLE AS a%d%d" % (i, j) if i == j else f"corr({names[i]}, {names[j]}) AS a{i}{j}" for i, j in cells)
    unit = ", ".join(f"{float(i == j)}::DOUBLE AS v{i}{j}" for i in range(n) for j in range(n))
    ctes, last = [f"j0 AS MATERIALIZED (SELECT {first}, {unit} FROM lineitem)"], "j0"
    for k, (p, q) in enumerate([(p, q) for _ in range(sweeps) for p in range(n) for q in range(p + 1, n)], 1):
        half = f"({up(q, q)} - {up(p, p)}) / (2 * {up(p, q)})"
        turn = f"CASE WHEN abs({up(p, q)}) < 1e-18 THEN 0 ELSE CASE WHEN {half} < 0 THEN -1 ELSE 1 END / (abs({half}) + sqrt({half} * {half} + 1)) END"
        ctes.append(f"t{k} AS MATERIALIZED (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (SELECT *, {turn} AS t FROM {last}))")
        out = []
        for i, j in cells:
            if (i, j) == (p, q):
                e = "0::DOUBLE"
            elif (i, j) == (p, p):
                e = f"{up(p, p)} - t * {up(p, q)}"
            elif (i, j) == (q, q):
                e = f"{up(q, q)} + t * {up(p, q)}"
            elif p in (i, j):
                o = j if i == p else i
                e = f"c * {up(o, p)} - s * {up(o, q)}"
            elif q in (i, j):
                o = j if i == q else i
                e = f"s * {up(o, p)} + c * {up(o, q)}"
            else:
                e = up(i, j)
            out.append(f"{e} AS a{i}{j}")
        for i in range(n):
            for j in range(n):
                out.append((f"c * v{i}{p} - s * v{i}{q}" if j == p else f"s * v{i}{p} + c * v{i}{q}" if j == q else f"v{i}{j}") + f" AS v{i}{j}")
        ctes.append(f"j{k} AS MATERIALIZED (SELECT {', '.join(out)} FROM t{k})")
        last = f"j{k}"
    return ",\n".join([*ctes, f"jz AS MATERIALIZED (SELECT {', '.join(f'a{i}{i} AS d{i}' for i in range(n))}, * FROM {last})"])


_DIAGONAL = "[" + ", ".join(f"d{i}" for i in range(len(_NUM))) + "]"
_TOP = lambda i: "CASE list_max(" + _DIAGONAL + ") " + " ".join(f"WHEN d{k} THEN v{i}{k}" for k in range(len(_NUM))) + " END"
_Z = [f"(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem))" for c in _NUM]


@query(
    "pca_variance",
    f"""WITH {_jacobi_sql(_NUM)}, e AS (SELECT unnest(list_reverse_sort({_DIAGONAL})) AS v, generate_subscripts({_DIAGONAL}, 1) AS i FROM jz)
SELECT CAST(i - 1 AS INT) AS component, round(v / {len(_NUM)}, 9) AS variance, round(sum(v / {len(_NUM)}) OVER (ORDER BY i), 9) AS cumulative FROM e""",
)
def pca_variance(spark, sf):
    """Explained variance of the standardised columns."""
    out = V.pca_variance(raw(spark, sf, "lineitem"), _NUM)
    return out.withColumns({c: F.round(c, 9) for c in ("variance", "cumulative")})


@query(
    "pca_project",
    f"""WITH {_jacobi_sql(_NUM)}, w AS (SELECT {', '.join(f'{_TOP(i)} AS w{i}' for i in range(len(_NUM)))} FROM jz),
u AS (SELECT *, CASE greatest({', '.join(f'abs(w{i})' for i in range(len(_NUM)))}) {' '.join(f'WHEN abs(w{i}) THEN sign(w{i})' for i in range(len(_NUM)))} END AS side FROM w)
SELECT l_orderkey, l_linenumber, round(side * ({' + '.join(f'{z} * w{i}' for i, z in enumerate(_Z))}), 6) AS pc0 FROM lineitem, u""",
)
def pca_project(spark, sf):
    """Projection on the first component."""
    return V.pca_project(raw(spark, sf, "lineitem"), _NUM, ["l_orderkey", "l_linenumber"]).withColumn("pc0", F.round("pc0", 6))
