"""Warm start on a stream: new vectors go to the heads of existing clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators import blocks
from topicloom.operators import clusters as C
from topicloom.staging import stage, stage_scope


def assign_stream(
    arrivals: DataFrame, heads: DataFrame, threshold: float, path: str, checkpoint: str,
    id_col: str = "id", vec_col: str = "vec", limit: int = blocks.BROADCAST_BYTES, left: str | None = None,
) -> StreamingQuery:
    """Append a cluster table row for every arriving vector that reaches a head.

    Each arriving row is looked at on its own, so there is no state and no late
    data; ``heads`` is a written table that does not change while the query
    runs.  Every micro-batch goes through the batch operator, so the head table
    may have any size.  A batch owns one folder ``batch=<number>`` and writes it
    anew when it is repeated after a failure, so no row is doubled.
    Rows that reach no head go to the folder ``left``, if one is named, which
    ``page_stream`` can read as its arrivals; else they are left for the next
    batch run of the clustering plan.
    """

    def take_in(rows: DataFrame, number: int) -> None:
        with stage_scope():
            rows = rows if left is None else stage(rows.select(id_col, vec_col), "arrived")
            found = C.assign_nearest(rows, heads, threshold, id_col, vec_col, limit)
            if left is not None:
                found = stage(found, "found")
                rest = C.unclustered(rows, found.select("head_id", "member_id"), id_col)
                rest.write.mode("overwrite").parquet(f"{left.rstrip('/')}/batch={number}")
            found.withColumn("assigned_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
