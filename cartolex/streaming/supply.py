"""Tile supply as a stateful stream: delays leave no trace, terminal answers are remembered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("ok", "empty", "failed")
OUTPUT = "tile long, status string, req_id long"
STATE = "status string, req_id long"


def next_state(state: tuple[str, int] | None, events: list[tuple[int, str]]) -> tuple[tuple[str, int] | None, list[tuple[str, int]]]:
    """(state, answers): each terminal event of a later request than the remembered one is an answer; anything else is ignored."""
    out = []
    for req, status in sorted(events):
        if status not in TERMINAL or state is not None and req <= state[1]:
            continue
        state = (status, req)
        out.append(state)
    return state, out


def supply(events: DataFrame) -> DataFrame:
    """Answers of a stream of (tile, req_id, status). ``not_ready`` is never state, so the tile is asked for again."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else None
        rows = [(int(r), s) for b in batches for r, s in zip(b.req_id, b.status, strict=True)]
        new, out = next_state(old, rows)
        if new is not None and new != old:
            state.update(new)
        yield pd.DataFrame({"tile": [key[0]] * len(out), "status": [s for s, _ in out], "req_id": [r for _, r in out]})

    return events.groupBy("tile").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def supply_batch(events: DataFrame) -> DataFrame:
    """What the stream remembers in the end: each tile's latest terminal answer."""
    done = events.where(F.col("status").isin(*TERMINAL))
    return done.groupBy("tile").agg(F.max("req_id").alias("req_id"), F.max_by("status", "req_id").alias("status"))
