"""models for a running stream, by versions in a shared folder.

``folder/version=N`` holds what the model's ``save`` wrote. A micro-batch
scores with the largest complete version there is when it starts, so a new model takes
effect with the next batch and the query is not restarted. A version counts once
its marker ``folder/ready/N`` is there, which ``publish`` writes last. Without any
version every row takes the rules with FALLBACK_MODE (E9), as in the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Thresholds
from ..operators.rules import Rule
from ..operators.scoring import hybrid_score
from ..operators.training import BoostedModel
from ..session import list_path


def publish(spark: SparkSession, model, folder: str, version: int) -> None:
    """Save a model as a version of the folder; versions are never rewritten."""
    if version in versions(spark, folder):
        raise ValueError(f"version {version} of {folder} is published already")
    model.save(f"{folder}/version={version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(f"{folder}/ready/{version}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, ascending."""
    return sorted(int(n) for n in list_path(spark, f"{folder}/ready")
                  if n.isdigit() and "_SUCCESS" in list_path(spark, f"{folder}/ready/{n}"))


def folder_scorer(folder: str, load: Callable[[str], object] = BoostedModel.load, t: Thresholds = DEFAULT,
                  rules: Sequence[Rule] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Scorer of a micro-batch's feature rows: the newest model, else rules.
    A version is loaded once. ``load`` raises where a published version can't
    be read: the batch fails and is run again, it is not scored by other means."""
    loaded: dict[int, object] = {}

    def score(features: DataFrame) -> DataFrame:
        have = versions(features.sparkSession, folder)
        if not have:
            return hybrid_score(features, t=t, rules=rules)
        if have[-1] not in loaded:
            loaded.clear()
            loaded[have[-1]] = load(f"{folder}/version={have[-1]}")
        m = loaded[have[-1]]
        return hybrid_score(m.predict_proba(features, "model_probability"), model_version=m.version, t=t, rules=rules)
    return score
