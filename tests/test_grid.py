"""The experiment grid: one matrix job for its windows, resumable results, full report rows."""

from dataclasses import replace
from datetime import date

import pytest

from cohortspark.operators import experiment as XP
from cohortspark.operators.matrix import assemble, postprocess, subset
from cohortspark.operators.models import ModelSpec
from cohortspark.sources.writers import RESULT_SCHEMA, finished_runs
from queries.base import SPLIT, tables
from queries.matrices import flagship_spec

SF = "/root/testdata/sf0.001"
FEATURES = ("totalNumberofContacts", "SpringEnrollment", "avgNetPrice", "Major")


@pytest.fixture(scope="module")
def setup(spark):
    first = flagship_spec(FEATURES, )
    first = replace(first, restrictions=first.restrictions[1:])
    return tables(spark, SF), [first, replace(first, split=date(1999, 9, 1), test_end=SPLIT)], {"GNB": {}, "LogisticRegression": {"C": [0.1, 1.0]}}


def test_grid_stops_and_goes_on(spark, setup, tmp_path, monkeypatch):
    t, specs, models = setup
    path, calls, real = str(tmp_path / "results"), [], XP.run_experiment

    def flaky(*args, **kw):
        calls.append(args[4])
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args, **kw)

    monkeypatch.setattr(XP, "run_experiment", flaky)
    with pytest.raises(RuntimeError):
        XP.run_grid(t, specs, models, [FEATURES], null_policy="lax", results=path, workers=2)
    assert len(calls) == 6 and len(finished_runs(spark, path)) == 5
    rest = XP.run_grid(t, specs, models, [FEATURES], null_policy="lax", results=path)
    assert len(rest) == 1 and len(calls) == 7
    assert XP.run_grid(t, specs, models, [FEATURES], null_policy="lax", results=path) == [] and len(calls) == 7
    table = spark.read.schema(RESULT_SCHEMA).parquet(path).collect()
    assert len({r.run_id for r in table}) == 6 == len(table)
    assert {(r.split_date, r.classifier, r.parameters.get("C")) for r in table} == {
        (s.split, m, c) for s in specs for m, c in (("GNB", None), ("LogisticRegression", "0.1"), ("LogisticRegression", "1.0"))
    }
    logit = next(r for r in table if r.classifier == "LogisticRegression")
    assert set(logit.coefficients) == set(logit.features) and sum(logit.confusion_train.values()) == logit.train_rows
    assert [r["class"] for r in logit.class_report] == ["0", "1", "avg / total"] and logit.class_report[2].support == logit.test_rows
    assert set(logit.train_nulls) >= set(logit.features) and logit.train_max_nulls == max(logit.train_nulls.values())


def test_grid_rows_equal_single_experiments(spark, setup):
    t, specs, _ = setup
    rows = XP.run_grid(t, specs, {"GNB": {}}, [FEATURES], null_policy="lax")
    for spec, row in zip(specs, rows):
        parts = [subset(assemble(t, spec, p), spec, FEATURES, XP.ROW_KEY) for p in ("train", "test")]
        train, test, plan = postprocess(*parts, FEATURES)
        alone = XP.run_experiment(train, test, [o for c in XP.feature_columns(FEATURES) for o in plan.outputs(c)], spec.target.column, ModelSpec("GNB", {}), "lax")
        for name in ("train_rows", "test_rows", "confusion", "features", "train_nulls"):
            assert row[name] == alone[name]
        assert row["auc"] == pytest.approx(alone["auc"], abs=1e-9)


def test_ids_follow_content(setup):
    _, specs, _ = setup
    ids = {
        XP.experiment_id(s, f, ModelSpec("LogisticRegression", {"C": c}), p)
        for s in (*specs, replace(specs[0], restrictions=())) for f in (FEATURES, FEATURES[:2]) for c in (0.1, 1) for p in ("lax", "strict")
    }
    assert len(ids) == 24 and XP.experiment_id(specs[0], list(FEATURES), ModelSpec("GNB", {}), "lax") == XP.experiment_id(specs[0], FEATURES, ModelSpec("GNB", {}), "lax")


def test_model_grid_reads_small_folds_in_few_tasks(spark, tmp_path, monkeypatch):
    """The many partitions of the folds are read as they lie only where a learner draws by partition."""
    from queries import evaluation

    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('a word. ', CAST(1 + id % 9 AS INT)) AS text", "'en' AS lang", "10 + id % 9 AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []

    def look(train, test, features, target, model, policy, fit_rows=None):
        seen.append((model.name, train.rdd.getNumPartitions(), test.rdd.getNumPartitions(), train.count() + test.count()))
        assert fit_rows is None or sorted(fit_rows.collect()) == sorted(train.collect())
        return {"classifier": model.name}

    monkeypatch.setattr(evaluation.XP, "run_experiment", look)
    evaluation.model_grid(spark, str(tmp_path))
    assert len(seen) == 9 and {s[1:] for s in seen} == {(1, 1, 60)}
