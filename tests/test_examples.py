"""The example jobs run end to end."""

from __future__ import annotations

import importlib.util

from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F

from rolloom.plans import derived


def example(name):
    spec = importlib.util.spec_from_file_location(name, ROOT / "examples" / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.main


def test_examples(spark, tmp_path, capsys):
    landing, dataset, rollouts, scores, result = (
        str(tmp_path / x) for x in ("landing", "dataset", "rollouts", "scores", "result")
    )
    derived.responses(spark, SF_SMALL).write.json(landing)
    example("build_dataset")(landing, dataset, 5)
    assert spark.read.json(f"{dataset}/all").count() > 5
    picked = spark.read.option("multiLine", True).json(f"{dataset}/dataset")
    assert picked.columns == ["answer", "prompt"] and 5 <= picked.count() <= 6

    rows = derived.rollouts(spark, SF_SMALL).withColumns(
        {"task": F.lit("one"), "sample_id": F.concat_ws("-", "prompt_id", "gen_idx")}
    )
    rows.write.parquet(rollouts)
    example("score_rollouts")(rollouts, scores, "c")
    scored = spark.read.parquet(scores)
    assert scored.count() == spark.read.parquet(rollouts).count()
    assert "advantage" in scored.columns

    example("eval_report")(rollouts, result, 10)
    assert "± " in capsys.readouterr().out
    assert spark.read.json(result).first()["results"]["n"] == 10
