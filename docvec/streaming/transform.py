"""Fitted transforms on streams.

Every per-document transform with a fitted model (text rules, vocabulary
look-ups, SIF / P-SIF / attention document vectors) is stateless per
document, so the same DataFrame code runs on a streaming DataFrame.  This
module wires a parquet folder stream through a fitted embedder into a sink;
``foreachBatch`` lets embedders whose transform uses grouped pandas steps
run per micro-batch.  A batch owns one folder of the output and overwrites
it, so a batch that is run again after a failure leaves its rows once
(checkpoint location in the shared checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.session import ensure_checkpoint_dir


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string",
                     max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def embed_stream(stream: DataFrame, model, out_path: str, name: str = "docvec_stream"):
    """Write (doc_id, vec) of every micro-batch to parquet; returns the query."""
    from pyspark.ml.functions import vector_to_array

    ckpt = f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name}"

    def batch(df: DataFrame, epoch: int) -> None:
        out = model.transform(df).select("doc_id", vector_to_array("features").alias("vec"))
        out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).queryName(name).start()
