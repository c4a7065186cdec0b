"""Tokens as a stream of files: each holds whole documents, so a micro-batch is parsed like a table.

Nothing is kept between batches, and a batch that is run again overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docustrata import api
from docustrata.sources.tokens import enriched


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, document_type: str = "auto", once: bool = True) -> StreamingQuery:
    tokens = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        got = api.extract(enriched(batch), document_type)
        got["fields"].write.mode("overwrite").parquet(f"{sink}/fields/batch={number}")
        got["review"].write.mode("overwrite").parquet(f"{sink}/review/batch={number}")
        batch.unpersist()

    writer = tokens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
