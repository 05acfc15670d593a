"""Vault loads from streams: every micro-batch is one load batch (an addition of this library)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keelvault.plans.spec import VaultSpec, load_vault


def stream_vault(stream: DataFrame, stages: Callable[[DataFrame], dict[str, DataFrame]], spec: VaultSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Load a vault from a stream. ``stages`` makes the stages of a micro-batch.

    A micro-batch that is run again after a failure adds nothing, since all loads are idempotent.
    With available input done the query ends; start it again to go on."""

    def one(batch: DataFrame, _: int) -> None:
        load_vault(batch.sparkSession, spec, stages(batch), path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
