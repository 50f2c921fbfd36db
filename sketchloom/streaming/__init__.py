"""Structured Streaming: stateful de-duplication filters, and sketches over event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..hashing import key_of
from ..operators import cms, hll
from ..operators.ordered import SHARDS, StreamFilter, shard_of
from ..shipping import ship


def deduplicate_stream(stream: DataFrame, key: str, order: str, bits_each: int, fpp: float, rule: str = "bs", shards: int = SHARDS, seed: str = "") -> DataFrame:
    """``order``, item, shard, is_distinct, with each shard's filter as state.

    A micro-batch's rows are taken in the order of ``order``; batches follow one another.  A shard's part of a micro-batch is sorted in
    memory, so the source's rate limit and ``shards`` together bound what a task holds.
    """
    if order in ("item", "shard", "is_distinct"):
        raise ValueError(f"the order column may not be called {order}")
    text = f"{order} {dict(stream.dtypes)[order]}, item string, shard int, is_distinct boolean"

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = StreamFilter(bits_each, fpp, rule, seed, group[0])
        if state.exists:
            held.load(state.get[0])
        rows = pd.concat(list(frames)).sort_values([order, "item"], kind="stable")
        rows["is_distinct"] = [held.insert(k) for k in rows["item"]]
        state.update((held.dump(),))
        yield rows[[order, "item", "shard", "is_distinct"]]

    ship(stream.sparkSession)
    item = key_of(key)
    keyed = stream.where(item.isNotNull()).select(order, item.alias("item"), shard_of(item, shards).alias("shard"))
    return keyed.groupBy("shard").applyInPandasWithState(update, text, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_registers(events: DataFrame, time: str, key: Column, p: int, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Registers by event-time window, for batches and streams: window_start, register, rho."""
    if late:
        events = events.withWatermark(time, late)
    register, rho = hll.register_columns(key, p)
    rows = events.where(key.isNotNull()).select(F.window(time, width, slide).alias("w"), register.alias("register"), rho.alias("rho"))
    return rows.groupBy("w", "register").agg(F.max("rho").alias("rho")).select(F.col("w.start").alias("window_start"), "register", "rho")


def windowed_cells(events: DataFrame, time: str, key: Column, spec: cms.CmsSpec, width: str, late: str | None = None) -> DataFrame:
    """Count-min cells by tumbling window: window_start, row, col, cnt."""
    if late:
        events = events.withWatermark(time, late)
    rows = events.where(key.isNotNull()).select(F.window(time, width).alias("w"), F.explode(cms.cells(key, spec)).alias("c"))
    return rows.groupBy("w", "c.row", "c.col").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), "row", "col", "cnt")
