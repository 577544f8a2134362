"""Saved models in one directory: MLlib model, fitted preparation, feature names, threshold, rate maps and encoders."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import FittedPreparation
from .tables import path_exists

REQUIRED = ["model", "settings"]


@dataclass
class Bundle:
    model: PipelineModel
    feature_names: list[str]
    options: dict = field(default_factory=dict)
    threshold: float = 0.5
    rate_maps: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    rate_fallback: float = 0.5
    encoders: dict[str, DataFrame] = field(default_factory=dict)
    preparation: FittedPreparation | None = None


def save_bundle(spark: SparkSession, bundle: Bundle, root: str, name: str) -> str:
    """Write every part under ``root/name``; lookups are parquet, settings one JSON line."""
    base = f"{root}/{name}"
    bundle.model.write().overwrite().save(f"{base}/model")
    for feature, (_, table) in bundle.rate_maps.items():
        table.write.mode("overwrite").parquet(f"{base}/rates/{feature}")
    for col, table in bundle.encoders.items():
        table.write.mode("overwrite").parquet(f"{base}/encoders/{col}")
    if bundle.preparation is not None:
        bundle.preparation.save(f"{base}/preparation")
    settings = {
        "feature_names": bundle.feature_names,
        "prepared": sorted(bundle.preparation.tables) if bundle.preparation is not None else None,
        "options": bundle.options,
        "threshold": bundle.threshold,
        "rates": {f: source for f, (source, _) in bundle.rate_maps.items()},
        "rate_fallback": bundle.rate_fallback,
        "encoders": list(bundle.encoders),
    }
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/settings")
    return base


def load_bundle(spark: SparkSession, root: str, name: str) -> Bundle:
    """Read a bundle back; every missing part is named in the error."""
    base = f"{root}/{name}"
    missing = [p for p in REQUIRED if not path_exists(spark, f"{base}/{p}")]
    settings = {}
    if "settings" not in missing:
        settings = json.loads(spark.read.text(f"{base}/settings").first()[0])
        parts = [f"rates/{f}" for f in settings["rates"]] + [f"encoders/{c}" for c in settings["encoders"]]
        prepared = settings.get("prepared")
        parts += ["preparation/options", *[f"preparation/tables/{t}" for t in prepared]] if prepared is not None else []
        missing += [p for p in parts if not path_exists(spark, f"{base}/{p}")]
    if missing:
        raise FileNotFoundError(f"bundle '{name}' lacks: " + ", ".join(f"{base}/{p}" for p in missing))
    return Bundle(
        model=PipelineModel.load(f"{base}/model"),
        feature_names=settings["feature_names"],
        options=settings["options"],
        threshold=settings["threshold"],
        rate_maps={f: (source, spark.read.parquet(f"{base}/rates/{f}")) for f, source in settings["rates"].items()},
        rate_fallback=settings["rate_fallback"],
        encoders={c: spark.read.parquet(f"{base}/encoders/{c}") for c in settings["encoders"]},
        preparation=FittedPreparation.load(spark, f"{base}/preparation") if settings.get("prepared") is not None else None,
    )


def list_bundles(spark: SparkSession, root: str) -> DataFrame:
    """``(name, path)`` of every bundle under ``root``."""
    pattern = f"{root}/*/settings"
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], "name string, path string")
    path = F.regexp_replace(F.input_file_name(), "/settings/[^/]*$", "")
    return spark.read.text(pattern).select(F.element_at(F.split(path, "/"), -1).alias("name"), path.alias("path")).distinct()
