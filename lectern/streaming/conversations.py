"""Turn inserts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lectern.operators.conversations import accept_turns, seed_titles, touch


def append_turns(inserts: DataFrame, path: str) -> DataStreamWriter:
    """Append accepted turns below ``path``, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so no turn is stored
    twice. Rejected rows go to ``rejected`` the same way. Parent rows are not rewritten:
    ``current_conversations`` derives titles and times from the stored turns.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = accept_turns(batch)
        accepted.write.mode("overwrite").parquet(f"{path}/turns/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")

    return inserts.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")


def stored_turns(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/turns").drop("batch")


def current_conversations(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations with seeded titles and ``updated_at`` moved by the stored turns."""
    return touch(seed_titles(conversations, turns), turns).select(
        *[F.col(c) for c in conversations.columns]
    )
