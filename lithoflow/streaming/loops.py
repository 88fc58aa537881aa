"""Streams: loop detection over growing texts, and documents as they arrive.

``watch_loops`` keeps the tail of each generated text and reports the first time it runs in circles.
``each_batch`` hands new rows to a batch function; a row with a key seen before is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lithoflow import policy as P


def loop_reason(text: str) -> str | None:
    """As functions.text.loop_reason, for a tail held in memory."""
    tail = text[-P.LOOP_TAIL :]
    if len(tail) >= P.LOOP_BLANK and not tail[-P.LOOP_BLANK :].strip():
        return "endless whitespace"
    for period in range(P.LOOP_PERIODS[0], P.LOOP_PERIODS[1] + 1):
        times = max(4, -(-P.LOOP_CHARS // period))
        if len(tail) >= period * times and tail.endswith(tail[-period:] * times):
            return "repeats: " + tail[-period:][: P.LOOP_SHOWN]
    return None


def watch_loops(chunks: DataFrame) -> DataFrame:
    """(text_id, n_chars, reason) once per text that loops. chunks: a stream (text_id, seq, chunk)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen, done = state.get if state.exists else ("", 0, False)
        parts = pd.concat(list(batches)).sort_values("seq")
        for chunk in parts["chunk"].fillna(""):
            if done:
                break
            seen += len(chunk)
            tail = (tail + chunk)[-P.LOOP_TAIL :]
            if reason := loop_reason(tail):
                done = True
                yield pd.DataFrame({"text_id": [key[0]], "n_chars": [seen], "reason": [reason]})
        state.update((tail, seen, done))

    return chunks.groupBy("text_id").applyInPandasWithState(step, "text_id bigint, n_chars bigint, reason string", "tail string, seen bigint, done boolean", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, key: str, arrived: str, delay: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts handling new documents in batches; repeats within ``delay`` of event time are dropped."""
    fresh = stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, arrived: str = "received_at", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Documents per window of event time and source, with late data up to ``delay``."""
    return stream.withWatermark(arrived, delay).groupBy(F.window(arrived, window), "source").agg(F.count("*").alias("n"))
