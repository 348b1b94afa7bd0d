"""Deliveries that arrive file by file: each micro-batch is parsed and judged by the expressions of the batch loader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from zonalis.operators.rejects import DENUE_RULES, Rule, load_denue, rejected


def load_stream(raw: DataFrame, good_path: str, bad_path: str, checkpoint: str, rules: tuple[Rule, ...] = DENUE_RULES) -> StreamingQuery:
    """Writes the good rows and the rejects of a stream of raw records to two folders, a sub-folder per micro-batch, so
    that a batch that is repeated after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        bad = rejected(batch, rules).persist()
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        load_denue(batch, bad).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.unpersist()
        batch.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
