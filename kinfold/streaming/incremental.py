"""Incremental adds as a stream: each micro-batch of image rows goes through ``add`` against the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import SpeciesConfig
from ..operators.tables import numbered
from ..plans import identify
from ..sources import state as S


def step(folder: str, cfg: SpeciesConfig, face_dim: int, body_dim: int):
    """A function for ``foreachBatch``. A batch that comes again adds nothing, as its paths are stored by then.

    Only a folder that is not there is a new state; one without a whole version is an error. A
    first batch without faces clusters bodies alone.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        if not S.exists(spark, folder):
            ranked = numbered(batch.dropDuplicates(["path"]).drop("idx"), ["path"], "idx")
            S.save(S.State(identify.batch(ranked, cfg, guarded=False).rows, face_dim, body_dim, cfg), folder)
            return
        stored = S.load(spark, folder)
        result = identify.add(stored.rows, batch, stored.config)
        if result.rows is not stored.rows:
            S.save(S.State(result.rows, stored.face_dim, stored.body_dim, stored.config), folder)

    return run


def start(rows: DataFrame, folder: str, cfg: SpeciesConfig, face_dim: int, body_dim: int, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream of rows (path, face, body, has_face, has_body) into the state at ``folder``."""
    w = rows.writeStream.foreachBatch(step(folder, cfg, face_dim, body_dim)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
