"""Clusters on a stream: rows that no head takes wait in keyed state until they fill a page, which is clustered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from topicloom.functions import kernels as K
from topicloom.functions.vectors import ROUND
from topicloom.plans.clustering import Settings

#: Where the state of lanes is kept; the stateful operator needs this provider.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "id long, vec array<float>"
FOUND = "lane int, page long, head_id long, member_id long, score double"


def lane_of(id_col: str, lanes: int) -> Column:
    """The lane of a row, by the hash of its id."""
    return F.pmod(F.xxhash64(F.lit("lane"), F.col(id_col).cast("long")), F.lit(lanes)).cast("int")


class _Lane(StatefulProcessor):
    """One lane: the rows that wait for a page, the heads that earlier pages gave, and the number of the page."""

    def __init__(self, threshold: float, min_size: int, page_size: int):
        self.threshold, self.min_size, self.page_size = threshold, min_size, page_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", ROWS)
        self.heads = handle.getListState("heads", ROWS)
        self.page = handle.getValueState("page", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["place", "id"], kind="stable")
        ids, values = batch["id"].to_numpy(np.int64), _matrix(batch["vec"])
        units = K.unit_rows(values)
        page = self.page.get()[0] if self.page.exists() else 0
        waiting, waiting_values = _loaded(self.kept, values.shape[1])
        best_head, best = np.full(len(ids), -1), np.full(len(ids), -2.0)
        self._closer(units, best_head, best, *_loaded(self.heads, values.shape[1]))
        at, fresh = 0, []
        while True:
            near = best[at:] >= self.threshold
            open_rows = np.flatnonzero(~near) + at
            room = self.page_size - len(waiting) - len(fresh)
            stop = open_rows[room - 1] + 1 if len(open_rows) >= room else len(ids)
            gone = np.flatnonzero(near[: stop - at]) + at
            if len(gone):
                yield _found(key[0], page, best_head[gone], ids[gone], best[gone])
            fresh += open_rows[open_rows < stop].tolist()
            at = stop
            if len(waiting) + len(fresh) < self.page_size:
                break
            page_ids, page_values = np.concatenate([waiting, ids[fresh]]), np.concatenate([waiting_values, values[fresh]])
            heads, members, scores = K.greedy_page(page_ids, K.unit_rows(page_values), self.threshold, self.min_size, strict=True)
            left = np.setdiff1d(page_ids, members)
            yield _found(key[0], page, np.concatenate([heads, np.full(len(left), -1)]), np.concatenate([members, left]), np.concatenate([scores, np.full(len(left), np.nan)]))
            lead = np.isin(page_ids, heads)
            if lead.any():
                self.heads.appendList(_rows(page_ids[lead], page_values[lead]))
                self._closer(units[at:], best_head[at:], best[at:], page_ids[lead], page_values[lead])
            waiting, waiting_values, fresh = waiting[:0], waiting_values[:0], []
            self.kept.clear()
            page += 1
        if fresh:
            self.kept.appendList(_rows(ids[fresh], values[fresh]))
        self.page.update((page,))

    @staticmethod
    def _closer(units: np.ndarray, best_head: np.ndarray, best: np.ndarray, head_ids: np.ndarray, head_values: np.ndarray) -> None:
        """Nearer heads take over in place."""
        if not len(units) or not len(head_ids):
            return
        order = np.argsort(head_ids, kind="stable")
        head, score = K.nearest_rows(units, head_ids[order], K.unit_rows(head_values[order]))
        over = (score > best) | ((score == best) & (head < best_head))
        best_head[over], best[over] = head[over], score[over]

    def close(self) -> None:
        pass


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _loaded(state, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows = list(state.get()) if state.exists() else []
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)


def _rows(ids: np.ndarray, values: np.ndarray) -> list[tuple]:
    return list(zip(ids.tolist(), values.tolist()))


def _found(lane, page, heads, members, scores) -> pd.DataFrame:
    head = pd.array(heads.astype("int64"), dtype="Int64")
    head[np.isnan(scores)] = pd.NA
    score = pd.array(np.round(np.nan_to_num(scores), ROUND), dtype="Float64")
    score[np.isnan(scores)] = pd.NA
    return pd.DataFrame({"lane": np.int32(lane), "page": np.int64(page), "head_id": head, "member_id": members.astype("int64"), "score": score})


def page_stream(
    arrivals: DataFrame, settings: Settings, path: str, checkpoint: str, lanes: int = 16,
    id_col: str = "id", vec_col: str = "vec", order_col: str | None = None, lane: Column | None = None,
) -> StreamingQuery:
    """Cluster a stream: appends ``(lane, page, head_id, member_id, score)`` to ``path``.

    A row belongs to the lane of its id, or to ``lane``, an expression for a number
    from 0 to ``lanes - 1``.  It goes to the nearest head that
    earlier pages of its lane gave, if one reaches the threshold; else it waits
    in the lane's state.  When ``settings.page_size`` rows wait they are
    clustered like a page of the batch plan, the clusters are appended, and
    their heads take later arrivals.  Rows of the page that no cluster takes are
    appended with a null ``head_id``; rows of a page that is not full yet stay
    in the state, also when the query ends and goes on later from its
    checkpoint.  In a micro-batch rows count as arriving in the order of
    ``order_col`` (their id by default).

    State and work of a lane are bounded by a page and the heads of the lane; a
    lane's share of a micro-batch is held in its task, which the source's limits
    on files or bytes per trigger bound.  Rows with a null id or vector are left out.
    The head table of ``heads_so_far`` belongs into ``assign_stream`` before this
    one, with which both streams together follow the warm start of the batch plan.
    """
    spark = arrivals.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    rows = arrivals.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        (lane_of(id_col, lanes) if lane is None else lane.cast("int")).alias("lane"), F.col(order_col or id_col).cast("long").alias("place"),
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"),
    )
    state = _Lane(settings.threshold, settings.min_size, settings.page_size)
    found = rows.groupBy("lane").transformWithStateInPandas(state, FOUND, "append", "none")
    return (
        found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def clusters_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The cluster table that a page stream has written."""
    return spark.read.schema(FOUND).parquet(path).where(F.col("head_id").isNotNull()).select("head_id", "member_id", "score")


def heads_so_far(spark: SparkSession, path: str, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``vectors`` that lead a cluster of a page stream."""
    heads = clusters_so_far(spark, path).where("head_id = member_id").select(F.col("head_id").alias(id_col))
    return vectors.join(heads, id_col, "left_semi")
