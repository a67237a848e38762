"""Incremental ingest (an extension): new documents of a folder are embedded
and encoded as they arrive. Stateless, so no watermark is needed; a batch that
is repeated after a failure overwrites its own folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vesperine.api import Embedder, embedded
from vesperine.operators.quantize import Codebook, encode
from vesperine.sources.shipping import ship


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, embedder: Embedder, book: Codebook) -> StreamingQuery:
    """Encode documents (``doc_id, text``) of Parquet files under ``source``
    into ``target/batch=N`` until stopped; ends when all present are done."""

    ship(spark)

    def one(batch: DataFrame, number: int) -> None:
        vectors = embedded(batch.filter(F.col("text").isNotNull()), embedder)
        encode(vectors, book).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
