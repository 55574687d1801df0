"""A forecaster as one unit on disk, the shared model and those of segments together, and the full report of a training run."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scoring
from .baselines import BASELINES, FOLDS
from .boosting import Boosted
from .models import DemandModel

SHARED = "shared"


def _write_text(spark: SparkSession, value: str, path: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_forecaster(model: DemandModel, metadata: dict, path: str) -> None:
    """All parts go to a folder of their own, the metadata that names it last: a save that breaks off leaves the forecaster saved before."""
    if model.shared is None:
        raise ValueError("the model is not fitted")
    spark = SparkSession.getActiveSession()
    version, parts = f"v-{uuid.uuid4().hex}", []
    for i, (name, part) in enumerate([(SHARED, model.shared), *sorted(model.own.items())]):
        at = f"{path}/{version}/{i}"
        if isinstance(part, Boosted):
            _write_text(spark, part.to_json(), at)
        else:
            part.write().overwrite().save(at)
        parts.append({"segment": None if i == 0 else name, "kind": "boosted" if isinstance(part, Boosted) else "pipeline"})
    record = {"version": version, "parts": parts, "numeric": list(model.numeric), "categorical": list(model.categorical), "levels": model.levels, "metadata": metadata}
    _write_text(spark, json.dumps(record), f"{path}/forecaster")


def load_forecaster(spark: SparkSession, path: str, numeric, categorical, levels: dict[str, list[str]] | None = None) -> tuple[DemandModel, dict]:
    """The forecaster and its metadata; refused if it was trained on other features, another order of them, or other levels."""
    record = json.loads(spark.read.text(f"{path}/forecaster").first()[0])
    had, asked = [*record["numeric"], *record["categorical"]], [*numeric, *categorical]
    if had != asked:
        gone, new = sorted(set(had) - set(asked)), sorted(set(asked) - set(had))
        raise ValueError(f"forecaster of other features: removed {gone}, added {new}" + ("" if gone or new else ", order differs"))
    if levels is not None and record["levels"] is not None and levels != record["levels"]:
        other = sorted(c for c in levels.keys() | record["levels"].keys() if levels.get(c) != record["levels"].get(c))
        raise ValueError(f"forecaster of other levels: {other}")
    model = DemandModel(None, (), record["levels"], tuple(numeric), tuple(categorical))
    for i, part in enumerate(record["parts"]):
        at = f"{path}/{record['version']}/{i}"
        got = Boosted.from_json(spark.read.text(at).first()[0]) if part["kind"] == "boosted" else PipelineModel.load(at)
        if part["segment"] is None:
            model.shared = got
        else:
            model.own[part["segment"]] = got
    return model, record["metadata"]


def full_report(on_folds: DataFrame, held: DataFrame, model: str, params: dict[str, str], start, folds=FOLDS, baselines=BASELINES) -> DataFrame:
    """One row for the run log: parameters, MAPE of each fold and their mean, MAE, MAPE and WAPE on the holdout, the baselines' MAPE on the same days,
    and the business figures of the model and of the first baseline. on_folds has the model's predictions, held also the baselines'."""
    names = [f[0] for f in folds]
    scores = scoring.fold_scores(on_folds.filter(F.col("model") == model)).groupBy().pivot("fold", [*names, "mean"]).agg(F.first("mape"))
    parts = [scores.select(*[F.col(n).alias(f"fold_{n}_mape") for n in names], F.col("mean").alias("folds_mape"))]
    own = held.filter(F.col("model") == model)
    parts.append(scoring.metrics(own).select(*[F.col(m).alias(f"holdout_{m}") for m in ("mae", "mape", "wape")]))
    base = scoring.metrics(held, "model").groupBy().pivot("model", list(baselines)).agg(F.first("mape"))
    parts.append(base.select(*[F.col(b).alias(f"holdout_mape_{b}") for b in baselines]))
    for prefix, rows in (("", own), (f"{baselines[0]}_", held.filter(F.col("model") == baselines[0]))):
        figures = scoring.business_summary(rows, start)
        parts.append(figures.select(*[F.col(c).alias(f"{prefix}{c}") for c in figures.columns]))
    row = reduce(DataFrame.crossJoin, parts)  # single rows
    return row.select(*[F.lit(v).alias(k) for k, v in params.items()], F.lit(model).alias("model"), "*")
