"""Stateless judging, tumbling and counted windows, and enforcement of controls on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.controls import RowCheck


def violated(controls: Sequence[RowCheck]):
    """Array of the names of the controls that a message violates: one projection for the whole suite."""
    return F.array_compact(F.array(*[F.when(c.scope() & c.violating(), F.lit(c.name)) for c in controls]))


def tag(stream: DataFrame, controls: Sequence[RowCheck], column: str = "violations") -> DataFrame:
    """Every message, with what it violates."""
    return stream.withColumn(column, violated(controls))


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Event times as instants, with a watermark on streams."""
    out = stream.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if out.isStreaming else out


def window_verdicts(stream: DataFrame, controls: Sequence[RowCheck], time: str, width: str, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """(start, control, scanned_rows, violating_rows, verdict) of windows aligned to the epoch.

    All controls share one streaming aggregation; messages later than ``late``
    are left out.
    """
    source = _timed(stream, time, late)
    parts = []
    for i, c in enumerate(controls):
        s = c.scope()
        parts += [F.count_if(s).alias(f"s{i}"), F.count_if(s & c.violating()).alias(f"v{i}")]
    wide = source.groupBy(F.window(time, width, slide or width).alias("w")).agg(*parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("control"), F.col(f"s{i}").alias("scanned_rows"), F.col(f"v{i}").alias("violating_rows"),
                c.verdict(lambda m, i=i: F.col(f"{m[0]}{i}")).alias("verdict"),
            )
            for i, c in enumerate(controls)
        ]
    )
    return wide.select(F.col("w.start").alias("start"), F.inline(rows))


def session_verdicts(stream: DataFrame, control: RowCheck, key: str, time: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Counts per key and session, sessions ending after ``gap`` without a message."""
    source = _timed(stream, time, late)
    s = control.scope()
    out = source.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count_if(s).alias("scanned_rows"), F.count_if(s & control.violating()).alias("violating_rows"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "scanned_rows", "violating_rows").withColumn("verdict", control.verdict(F.col))


def count_windows(stream: DataFrame, control: RowCheck, key: str, size: int) -> DataFrame:
    """(key, number, scanned_rows, violating_rows) after every ``size`` messages of a key.

    The state is one pair of counters and a number for each key.
    """
    judged = stream.where(control.scope()).select(F.col(key).cast("string").alias("key"), control.violating().cast("int").alias("bad"))

    def update(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, seen, bad = state.get if state.exists else (0, 0, 0)
        for frame in frames:
            # Violations up to every message, those of the open window first.
            upto = np.concatenate(([0], np.cumsum(frame["bad"].to_numpy(np.int64))))
            ends = np.arange(size - seen, len(upto), size)
            if len(ends):
                each = np.diff(upto[ends], prepend=-bad)
                yield pd.DataFrame({"key": group[0], "number": np.arange(number, number + len(ends)), "scanned_rows": size, "violating_rows": each})
                number, seen, bad = number + len(ends), len(upto) - 1 - int(ends[-1]), int(upto[-1] - upto[ends[-1]])
            else:
                seen, bad = seen + len(upto) - 1, bad + int(upto[-1])
        state.update((number, seen, bad))

    return judged.groupBy("key").applyInPandasWithState(
        update,
        "key string, number long, scanned_rows long, violating_rows long",
        "number long, seen long, bad long",
        "append",
        "NoTimeout",
    )


class _Opened(StatefulProcessor):
    """The open window of a key: when it began, its messages and violations; a timer closes it when no message does."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, scanned long, bad long")

    def _rows(self, key, closed: list[tuple[int, int, int]]) -> pd.DataFrame:
        start, scanned, bad = zip(*closed, strict=True)
        return pd.DataFrame({"key": key[0], "start": start, "scanned_rows": scanned, "violating_rows": bad})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f[["at", "bad"]] for f in rows]
        at = np.concatenate([f["at"].to_numpy(np.int64) for f in frames])
        order = np.argsort(at, kind="stable")
        at, bad = at[order], np.concatenate([f["bad"].to_numpy(np.int64) for f in frames])[order]
        upto = np.concatenate(([0], np.cumsum(bad)))
        state = self.window.get() if self.window.exists() else None
        start, scanned, gone = state if state is not None else (int(at[0]), 0, 0)
        if state is not None:
            # Only a key with an open window has a timer.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        i, closed = 0, []
        while True:
            end = int(np.searchsorted(at, start + self.width, side="left"))
            end = max(end, i)
            scanned, gone = scanned + end - i, gone + int(upto[end] - upto[i])
            if end == len(at):
                break
            closed.append((start, scanned, gone))
            start, scanned, gone, i = int(at[end]), 0, 0, end
        self.window.update((start, scanned, gone))
        # Timers count milliseconds; the window must be over when this one fires.
        self.handle.registerTimer(-(-(start + self.width) // 1000))
        if closed:
            yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists():
            yield self._rows(key, [self.window.get()])
            self.window.clear()

    def close(self) -> None:
        pass


def opened_windows(stream: DataFrame, control: RowCheck, key: str, time: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, start, scanned_rows, violating_rows, verdict) of windows that a key's first message opens.

    A window holds what comes less than ``seconds`` after that message; the first
    message beyond closes it and opens the next.  Where none comes, a timer gives
    the window out, and forgets it, once the watermark has passed its end.  Within
    a batch a key's messages are taken in order of time; one from before the open
    window counts in it, as it can't open one any more.  A batch holds a key's
    messages of one trigger (16 bytes each): bound them by the source's options.
    The state store must be RocksDB's.
    """
    source = _timed(stream, time, late)
    judged = source.where(control.scope() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_micros(time).alias("at"), control.violating().cast("int").alias("bad"), F.col(time).alias("moment"))
    out = judged.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Opened(round(seconds * 1_000_000)), outputStructType="key string, start long, scanned_rows long, violating_rows long", outputMode="append", timeMode="EventTime"
    )
    return out.select("key", F.timestamp_micros("start").alias("start"), "scanned_rows", "violating_rows").withColumn("verdict", control.verdict(F.col))


def reconciled(left: DataFrame, right: DataFrame, key: str, amount: str, time: str, within: str, late: str = "0 seconds", tolerance: float = 0.0) -> DataFrame:
    """(key, left_at, right_at, left_amount, right_amount, kind) of messages of two streams that should tell the same.

    Messages of one key at most ``within`` of each other are a pair: matched, or
    off where amounts differ by more than ``tolerance``.  A message without a
    partner is given out once the watermark of both streams says that none can
    come any more, and then leaves the state: missing if the left one is alone,
    extra if the right one is; so the state holds ``late`` plus twice ``within``
    of both streams.  Messages without a key or time are left out.  Each of
    several partners makes a pair.
    """
    def side(stream: DataFrame, name: str) -> DataFrame:
        known = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias(f"{name}_key"), F.col(time).cast("timestamp").alias(f"{name}_at"), F.col(amount).alias(f"{name}_amount"))
        return known.withWatermark(f"{name}_at", late) if known.isStreaming else known

    near = F.expr(f"left_key = right_key AND right_at >= left_at - INTERVAL {within} AND right_at <= left_at + INTERVAL {within}")
    both = side(left, "left").join(side(right, "right"), near, "full")
    off = ~F.coalesce(F.abs(F.col("left_amount") - F.col("right_amount")) <= tolerance, F.col("left_amount").isNull() & F.col("right_amount").isNull())
    kind = F.when(F.col("right_key").isNull(), "missing").when(F.col("left_key").isNull(), "extra").when(off, "off").otherwise("matched")
    return both.select(F.coalesce("left_key", "right_key").alias("key"), "left_at", "right_at", "left_amount", "right_amount", kind.alias("kind"))


def enforce(stream: DataFrame, controls: Sequence[RowCheck], action: str, good: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], checkpoint: str, most_dead: int | None = None, **trigger) -> StreamingQuery:
    """Write messages after judging: alert and tag pass all on, quarantine and block set violating ones aside first.

    A batch is written at least once, dead letters before good rows; more than
    ``most_dead`` dead letters in a batch stop the query instead of dropping any.
    """
    if action not in ("alert", "tag", "quarantine", "block"):
        raise ValueError(f"no action {action!r}")

    def write(batch: DataFrame, number: int) -> None:
        marked = tag(batch, controls).persist()
        try:
            bad = marked.where(F.size("violations") > 0)
            if action in ("quarantine", "block"):
                if most_dead is not None and (n := bad.count()) > most_dead:
                    raise RuntimeError(f"{n} dead letters in batch {number}, more than {most_dead}")
                dead(bad, number)
                good(marked.where(F.size("violations") == 0).drop("violations"), number)
            elif action == "tag":
                good(marked, number)
            else:
                dead(bad, number)
                good(marked.drop("violations"), number)
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_kafka(spark, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """Messages of a topic with their envelope and the JSON value parsed; unreadable values have a null payload."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), "timestamp", F.from_json(F.col("value").cast("string"), schema).alias("payload"))


def lag(query: StreamingQuery, most: int = 10_000) -> tuple[int, bool]:
    """(messages produced but not yet read, whether that is too many) from a query's last progress."""
    progress = query.lastProgress
    total = sum(int((s.get("metrics") or {}).get("maxOffsetsBehindLatest", 0)) for s in (progress or {}).get("sources", []))
    return total, total > most
