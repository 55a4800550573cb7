"""Experiment loops: grids, feature lists, one experiment, k-fold, group comparison."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Lock, get_ident

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortspark.operators import metrics as E
from cohortspark.operators import refit
from cohortspark.operators.matrix import MatrixSpec, feature_columns, postprocess, subset
from cohortspark.operators.models import ModelSpec, fit
from cohortspark.operators.post import PostPlan
from cohortspark.operators.resample import k_folds
from cohortspark.operators.rows import any_null, apply_null_policy, common_columns, null_counts
from cohortspark.operators.windowed import assemble_windows, part_of, window_of
from cohortspark.session import stored
from cohortspark.sources.writers import RESULT_SCHEMA, append_results, finished_runs

ROW_KEY = "row_key"


def parameter_grid(params: Mapping) -> list[dict]:
    """Every combination; a scalar counts as a list of one."""
    names = list(params)
    lists = [v if isinstance(v, list) else [v] for v in params.values()]
    return [dict(zip(names, combo)) for combo in itertools.product(*lists)]


def feature_lists(features: Sequence[str], products: int | None = None) -> Iterator[tuple[str, ...]]:
    """The whole list, or all combinations up to length ``products``."""
    if products == 0:
        raise ValueError("feature lists of length 0 make no sense; use None to switch products off")
    sizes = [len(features)] if products is None else range(1, products + 1)
    for size in sizes:
        yield from itertools.combinations(features, size)




@dataclass(frozen=True)
class Evaluation:
    """Metrics of one scored frame."""

    rows: int
    auc: float | None
    precision0_top10: float | None
    precision0_top25: float | None
    aupr0: float | None
    confusion: Mapping[str, int]
    report: Sequence[Mapping] = ()


def evaluate(scored: DataFrame, label: str) -> Evaluation:
    """The metrics of one experiment.

    Class 0 is ranked by the reversed score; the AUC is the same for either
    class.  The scored frame is persisted for a few jobs that each return one
    small row; they are ranked over range partitions, whatever their size.
    """
    base = scored.select(ROW_KEY, F.col(label).cast("int").alias("y"), (-F.col("score")).alias("score0"), "predicted")
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells = {f"{r['label']}->{r['predicted']}": r["n"] for r in E.confusion(base, "y", "predicted").collect()}
        rows = sum(cells.values())
        if not rows:
            return Evaluation(0, None, None, None, None, cells)
        found = E.ranking_summary(base, "y", "score0", (0.1, 0.25), 0).first()
        precision = []
        for i in range(2):
            r, hits = found[f"r{i}"], found[f"hits{i}"]
            if found[f"take{i}"]:
                more = E.edge_hits(base, "y", "score0", ROW_KEY, found[f"edge{i}"], found[f"take{i}"], 0).first()
                hits += more["hits"] or 0
            precision.append(hits / r if r else 0.0)
        report = [r.asDict() for r in E.class_report(base, "y", "predicted").collect()]
        return Evaluation(rows, found["auc"], precision[0], precision[1], found["aupr"], cells, report)
    finally:
        base.unpersist()


def with_row_key(df: DataFrame) -> DataFrame:
    """A numeric key per row from its content, for deterministic tie-breaks."""
    if ROW_KEY in df.columns:
        return df
    return df.withColumn(ROW_KEY, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def run_experiment(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    model: ModelSpec,
    null_policy: str = "strict",
    fit_rows: DataFrame | None = None,
) -> dict:
    """Common columns -> null policy -> fit -> score -> metrics on train and test.

    ``features`` are the postprocessed predictor columns.  ``fit_rows`` are the rows of
    ``train`` in the partitions the learner is to read, where these matter to it.
    Returns one result row.
    """
    start = time.time()
    columns = [c for c in common_columns(train, test) if c in features or c == target]
    predictors = [c for c in columns if c != target]
    keys = [c for c in (ROW_KEY,) if c in train.columns and c in test.columns]
    cleaned = lambda df: with_row_key(apply_null_policy(df.select(*[f"`{c}`" for c in columns], *keys), null_policy, columns))
    nulls = {}
    parts = {}
    for name, df in (("train", train), ("test", test)):
        counted = null_counts(df, columns).first().asDict()
        rows = counted.pop("__rows")
        nulls[name] = counted
        parts[name] = (rows, cleaned(df))
    scorer = fit(model, parts["train"][1] if fit_rows is None else cleaned(fit_rows), predictors, target)
    seen = evaluate(scorer.score(parts["train"][1]), target)
    held = evaluate(scorer.score(parts["test"][1]), target)
    return {
        "seconds": time.time() - start,
        "target": target,
        "classifier": model.name,
        "parameters": {k: str(v) for k, v in model.params.items()},
        "features": list(predictors),
        "train_rows": seen.rows,
        "test_rows": held.rows,
        "train_rows_dropped": parts["train"][0] - seen.rows,
        "test_rows_dropped": parts["test"][0] - held.rows,
        "train_max_nulls": max(nulls["train"].values(), default=0),
        "test_max_nulls": max(nulls["test"].values(), default=0),
        "train_nulls": nulls["train"],
        "test_nulls": nulls["test"],
        "auc": held.auc,
        "auc_train": seen.auc,
        "precision0_top10": held.precision0_top10,
        "precision0_top25": held.precision0_top25,
        "aupr0_test": held.aupr0,
        "aupr0_train": seen.aupr0,
        "confusion": dict(held.confusion),
        "confusion_train": dict(seen.confusion),
        "class_report": list(held.report),
        "coefficients": dict(scorer.coefficients()) if hasattr(scorer, "coefficients") else {},
    }


def experiment_id(spec: MatrixSpec, features: Sequence[str], model: ModelSpec, null_policy: str) -> str:
    """A name of the experiment by its content: dates, target, restrictions, options, features, model and policy."""
    parts = [spec.target.column, spec.train_start, spec.split, spec.test_end, [[r.feature, r.text, str(r.predicate)] for r in spec.restrictions], spec.options]
    parts += [list(features), model.name, sorted((k, str(v)) for k, v in model.params.items()), null_policy]
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()


def encoded_windows(tables, specs: Sequence[MatrixSpec], features: Sequence[str]) -> list[tuple[DataFrame, DataFrame, PostPlan]]:
    """Per spec the encoded train and test matrix and what the training rows taught.

    Specs that differ in their dates only are windows of one job; each encoded part
    is a table of the shared folder that all experiments of its window select from.
    """
    same: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        same.setdefault((s.target, tuple((r.feature, r.text, str(r.predicate)) for r in s.restrictions), str(s.options)), []).append(i)
    out: list = [None] * len(specs)
    for members in same.values():
        spec = replace(specs[members[0]], features=list(features))
        matrix = stored(assemble_windows(tables, spec, [window_of(specs[i], i) for i in members]), "windows")
        for i in members:
            parts = [subset(part_of(matrix, i, p), spec, features, ROW_KEY) for p in ("train", "test")]
            train, test, plan = postprocess(*parts, features)
            out[i] = stored(train, "train"), stored(test, "test"), plan
    return out


def run_grid(
    tables,
    specs: Sequence[MatrixSpec],
    models: Mapping[str, Mapping],
    feature_groups: Sequence[Sequence[str]],
    products: int | None = None,
    null_policy: str = "strict",
    results: str | None = None,
    workers: int = 4,
) -> list[dict]:
    """Windows x models x parameters x feature lists.

    All windows are assembled in one job and encoded once; every experiment is a
    selection of columns.  Experiments run ``workers`` at a time, each in a fair
    pool of its own.  With ``results``, a path, finished experiments are appended
    there as they end, and those the table already holds are not run again: a grid
    that stopped goes on where it was.  An experiment that fails does not stop the
    others; its error is raised when they are done.
    """
    spark = next(iter(tables.values())).sparkSession
    features = list(dict.fromkeys(f for g in feature_groups for f in g))
    done = finished_runs(spark, results) if results else set()
    wanted = []
    for i, spec in enumerate(specs):
        for chosen in dict.fromkeys(c for g in feature_groups for c in feature_lists(g, products)):
            for name, grid in models.items():
                for params in parameter_grid(grid):
                    model = ModelSpec(name, params)
                    run = experiment_id(spec, chosen, model, null_policy)
                    if run not in done:
                        wanted.append((run, i, chosen, model))
    if not wanted:
        return []
    matrices = encoded_windows(tables, specs, features)
    lock, rows = Lock(), []

    def one(job) -> None:
        run, i, chosen, model = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{get_ident()}")
        spec, (train, test, plan) = specs[i], matrices[i]
        predictors = [o for c in feature_columns(chosen) for o in plan.outputs(c)]
        row = run_experiment(train, test, predictors, spec.target.column, model, null_policy)
        row |= {
            "run_id": run, "train_start": spec.train_start, "split_date": spec.split, "test_end": spec.test_end,
            "restrictions": [f"{r.feature} {r.text}" for r in spec.restrictions],
        }
        with lock:
            rows.append(row)
            if results:
                append_results(spark, [row], results)

    with ThreadPoolExecutor(workers) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(one), job) for job in wanted]
    order = {job[0]: k for k, job in enumerate(wanted)}
    for f in futures:
        f.result()
    return sorted(rows, key=lambda r: order[r["run_id"]])


def results_frame(spark, rows: Sequence[Mapping]) -> DataFrame:
    """Experiment rows as a frame (one row per experiment)."""
    return spark.createDataFrame([Row(**{f.name: r.get(f.name) for f in RESULT_SCHEMA.fields}) for r in rows], RESULT_SCHEMA)


def k_fold_scores(df: DataFrame, key: str, features: Sequence[str], target: str, model: ModelSpec, k: int = 10, seed: int = 0) -> DataFrame:
    """Out-of-fold scores of all rows without nulls, with their fold.

    A logistic regression with an l2 penalty is fitted for all folds at once (see
    ``refit``); other models are fitted one after the other on the written folds.
    """
    # the folds are cut over all rows, then rows with nulls go from every part
    folded = stored(k_folds(df, key, k, seed).filter(~any_null([*features, target])), "folds")
    if model.name == "LogisticRegression" and model.params.get("penalty", "l2") == "l2" and not model.params.get("class_weight"):
        scored = refit.k_fold_scores(folded, "fold", k, features, target, float(model.params.get("C", 1.0)))
        return scored.select(key, "fold", target, "score", (F.col("score") > 0.5).cast("int").alias("predicted"))
    out = None
    for i in range(k):
        scorer = fit(model, folded.filter(F.col("fold") != i), features, target)
        part = scorer.score(folded.filter(F.col("fold") == i)).select(key, "fold", target, "score", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def k_fold_auc(scores: DataFrame, target: str) -> DataFrame:
    """AUC per fold reduced to mean and standard error."""
    per_fold = E.auc(scores, target, "score", ["fold"])
    return E.mean_and_error(per_fold, "auc")
