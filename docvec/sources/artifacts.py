"""Fitted state and results as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from docvec.session import path_exists

META = "fitted_values"


def _at(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def save_artifact(spark: SparkSession, path: str, params: dict, tables: dict[str, DataFrame] | None = None,
                  models: dict | None = None) -> None:
    """Tables as parquet, Spark ML models by their own writer, parameters as
    one JSON line, written last.  All by Spark, so any file system serves."""
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").parquet(_at(path, name))
    for name, m in (models or {}).items():
        m.write().overwrite().save(_at(path, name))
    meta = json.dumps({"params": params, "tables": sorted(tables or {}), "models": sorted(models or {})})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(_at(path, META))


def can_load(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, _at(path, f"{META}/_SUCCESS"))


def load_artifact(spark: SparkSession, path: str, model_loaders: dict | None = None):
    meta = json.loads(spark.read.text(_at(path, META)).first()[0])
    tables = {n: spark.read.parquet(_at(path, n)) for n in meta["tables"]}
    models = {n: model_loaders[n].load(_at(path, n)) for n in meta["models"] if model_loaders}
    return meta["params"], tables, models


def save_word_stats(df: DataFrame, path: str) -> None:
    """Word -> cluster / coefficients table."""
    df.write.mode("overwrite").parquet(path)


def load_word_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(runs: DataFrame, report: DataFrame | None, path: str) -> None:
    """runs(method, run, accuracy, train_seconds) and the class report."""
    runs.write.mode("append").parquet(_at(path, "runs"))
    if report is not None:
        report.write.mode("append").parquet(_at(path, "class_report"))
