import dataclasses

import pytest

from logloom.operators import evaluate
from logloom.operators.match import Config
from logloom.sources.lines import dataset_path


def test_dataset_path(spark, tmp_path):
    (tmp_path / "sets" / "harbour").mkdir(parents=True)
    base = str(tmp_path / "sets")
    assert dataset_path(spark, f"{base}/harbour", base) == f"{base}/harbour"
    assert dataset_path(spark, "harbour", base) == f"{base}/harbour"
    with pytest.raises(FileNotFoundError):
        dataset_path(spark, "quay", base)
    with pytest.raises(ValueError):
        dataset_path(spark, " ", base)


def test_weights_as_text():
    told = dataclasses.replace(Config(), regex_full=0.41, min_score=0.3)
    text = evaluate.config_text(told, "tuned on harbour\nby hand")
    assert text.startswith("# tuned on harbour\n# by hand\n")
    assert evaluate.config_of(text) == told
    assert evaluate.config_of("min_score: 0.3\n") == dataclasses.replace(Config(), min_score=0.3)
    with pytest.raises(ValueError):
        evaluate.config_of("mass: 1")


def test_trials_as_a_report(spark, tmp_path):
    tried = [(Config(), {"at1": 3, "high": 2, "high_correct": 2}), (dataclasses.replace(Config(), min_score=0.55), {"at1": 4, "high": 2, "high_correct": 1})]
    rows = evaluate.trial_rows(spark, tried)
    assert [(r.trial, r.n_at1, r.n_high_correct, r.distance > 0) for r in rows.orderBy("trial").collect()] == [(0, 3, 2, False), (1, 4, 1, True)]
    evaluate.write_report(rows.coalesce(1), str(tmp_path / "trials"))
    assert spark.read.csv(str(tmp_path / "trials"), header=True).count() == 2
