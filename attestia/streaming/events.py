"""Event-driven parts as Structured Streaming: alarms once in twelve hours, queues of turns, arrivals of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds in which an alarm is not raised again, from its first one on.
QUIET = 12 * 3600


def alarm_key(file: Column, quote: Column) -> Column:
    return F.md5(F.concat(file, F.lit("\x00"), quote))


def raised(seconds: list[float], last: float | None, quiet: float = QUIET) -> tuple[list[bool], float | None]:
    """(which of the sorted times raise an alarm, the time of the last alarm): the first, and each that is quiet seconds or
    more after the last alarm; what is suppressed does not renew the quiet."""
    out = []
    for t in seconds:
        fresh = last is None or t - last >= quiet
        out.append(fresh)
        last = t if fresh else last
    return out, last


def _with_seconds(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 1e6)


def suppress(events: DataFrame, keys: list[str], ts: str, tie: str, quiet: float = QUIET) -> DataFrame:
    """The events of a batch that raise an alarm; all columns. Each key's times are folded in order, as one alarm decides
    the next; events without a time raise none. A key's events are of one group, so a key is a (file, quotation)."""
    schema = events.schema

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__s", tie], kind="stable")
        return frame[raised(frame["__s"].tolist(), None, quiet)[0]].drop(columns="__s")

    return _with_seconds(events.where(F.col(ts).isNotNull()), ts).groupBy(*keys).applyInPandas(fold, schema)


def suppress_stream(events: DataFrame, keys: list[str], ts: str, quiet: float = QUIET) -> DataFrame:
    """``suppress`` of a stream, (keys, ts, raised): the state of a key is the time of its last alarm and ends, in
    processing time, quiet seconds after it was last seen."""
    named = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values("__s", kind="stable")
        hit, last = raised(frame["__s"].tolist(), state.get[0] if state.exists else None, quiet)
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(int(quiet * 1000))
        yield pd.DataFrame({**{k: [v] * sum(hit) for k, v in zip(keys, key)}, ts: frame[ts][hit].tolist()})

    rows = _with_seconds(events.where(F.col(ts).isNotNull()), ts)
    kind = events.schema[ts].dataType.simpleString()
    return rows.groupBy(*keys).applyInPandasWithState(run, f"{named}, {ts} {kind}", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def queue_turns(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a stream of turns: each batch is judged (candidates, bank, verdicts, cap) and appended to the queue's table."""
    return stream.writeStream.foreachBatch(lambda batch, number: judge(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).start()


def arrivals(stream: DataFrame, take: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a stream of landed files: each batch goes through an intake against the register, whose editions are appended.

    A batch that is run again after a failure overwrites its own rows, as each has a folder by its number.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: take(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")).option("checkpointLocation", checkpoint).start()
