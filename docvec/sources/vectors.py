"""Word-vector sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvec.session import path_exists


def read_word_vectors(spark: SparkSession, path: str, dim: int, report: dict | None = None) -> DataFrame:
    """Text file ``word v1 ... vd``.  Rows of the wrong width are skipped
    and counted (``report['rejected']``); a word listed twice keeps its last
    line (file, then byte offset of the split, then line in the split)."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_o"),
        F.split(F.trim("value"), " +").alias("p"))
    ok = F.size("p") == dim + 1
    if report is not None:
        report["rejected"] = raw.filter(~ok).count()
    rows = raw.filter(ok).select(
        "_f", "_b", "_o", F.element_at("p", 1).alias("word"),
        F.transform(F.slice("p", 2, dim), lambda x: x.cast("float").cast("double")).alias("vec"))
    # one window per word: bounded by the number of duplicate lines of a word
    w = Window.partitionBy("word").orderBy(F.desc("_f"), F.desc("_b"), F.desc("_o"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("word", "vec")


def cached_word_vectors(spark: SparkSession, path: str, dim: int, cache_path: str | None = None) -> DataFrame:
    """Parse once, keep a parquet copy beside the input, reuse it."""
    cache_path = cache_path or f"{path}.parquet"
    if not path_exists(spark, f"{cache_path.rstrip('/')}/_SUCCESS"):
        read_word_vectors(spark, path, dim).write.mode("overwrite").parquet(cache_path)
    return spark.read.parquet(cache_path)
