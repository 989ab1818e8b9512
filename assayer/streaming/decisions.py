"""Streams of decisions and labels: windows over late data, and learners kept as state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.learners import Drift


def windowed(events: DataFrame, kind: str, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), size: str = "1 hour", slide: str = "30 minutes", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Counts and mean values by ``tumbling``, ``sliding`` or ``session`` window; with ``late``, a watermark bounds what a stream keeps."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    window: Column = {"tumbling": lambda: F.window(ts, size), "sliding": lambda: F.window(ts, size, slide), "session": lambda: F.session_window(ts, gap)}[kind]()
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")


def drift_stream(decisions: DataFrame, key: str = "question") -> DataFrame:
    """``key, seq, status`` for a stream of ``key, seq, ok``: the drift detector's state is kept for each key.

    Rows of a batch are stepped in order of ``seq``; rows at or before the last one stepped are late and left out.
    """
    kind = dict(decisions.dtypes)[key]

    def run(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, errors, low, p, s, last = state.get if state.exists else (0, 0, float("inf"), 0.0, 0.0, -1)
        detector = Drift(n, errors, low, p, s)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        rows = rows[rows["seq"] > last].drop_duplicates("seq")
        status = [detector.step(ok == 0) for ok in rows["ok"]]
        last = int(rows["seq"].iloc[-1]) if len(rows) else last
        state.update((detector.n, detector.errors, detector.low, detector.low_p, detector.low_s, last))
        yield pd.DataFrame({key: names[0], "seq": rows["seq"].to_numpy(), "status": status})

    state = "n long, errors long, low double, p double, s double, last long"
    return decisions.select(key, "seq", "ok").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, status string", state, "append", GroupStateTimeout.NoTimeout)


def into_log(stream: DataFrame, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Append a stream of decisions or labels to a Parquet log, once each: batches are written under their number."""

    def save(df: DataFrame, batch: int) -> None:
        enrich(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
