"""Streams of tile requests: generations of a viewer's camera, and debounced saves, as stateful operators. Each has a batch twin in operators.pyramid."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "viewer long, event_id long, generation long"
STATE = "generation long, cam_x double, cam_y double, zoom int"


def _follow(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    generation, *last = state.get if state.exists else (0, None, None, None)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    now = rows[["cam_x", "cam_y", "zoom"]]
    before = now.shift()
    before.iloc[0] = last
    counts = generation + (now != before).any(axis=1).cumsum()
    state.update((int(counts.iloc[-1]), float(now["cam_x"].iloc[-1]), float(now["cam_y"].iloc[-1]), int(now["zoom"].iloc[-1])))
    yield pd.DataFrame({"viewer": key[0], "event_id": rows["event_id"].to_numpy(), "generation": counts.to_numpy()})


def generations(requests: DataFrame) -> DataFrame:
    """A stream of requests (viewer, ts, event_id, cam_x, cam_y, zoom) with the viewer's generation, which goes up with every change of state.

    Rows of one viewer in a batch are put in order; a later batch goes on from the state that the earlier ones left. The state of a viewer is one small row.
    """
    return requests.groupBy("viewer").applyInPandasWithState(_follow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def distinct_requests(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests without those that repeat a key in flight; keys are forgotten after the delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["viewer", "zoom", "tile_x", "tile_y"])


def saves(changes: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """viewer, first_ts, last_ts, n of each run of changes with no pause of the gap or more: the times at which a debounced save happens."""
    grouped = changes.withWatermark("ts", delay).groupBy("viewer", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).select("viewer", "first_ts", "last_ts", "n")
