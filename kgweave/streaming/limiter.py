"""Sliding-window rate limiter per key, as a batch window and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S, MOST = 60, 20


def limit_batch(hits: DataFrame, key: str, ts: str, seconds: int = WINDOW_S, most: int = MOST, order: str | None = None) -> DataFrame:
    """hits with n_window (hits of the key in the last ``seconds``, this one and rejected ones included) and rejected.

    Hits of one key and instant count one after another, by ``order`` (without it, in any order). A hit without a time is
    in no window (n_window null) and not rejected.

    Time is divided into spans of ``seconds``, and each span of a key is read with a copy of the times of the one before,
    which is all that its windows reach back to: a client with very many hits is in as many tasks as it has spans.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    row = F.struct(*[F.col(f"`{c}`") for c in hits.columns])
    held = hits.select(row.alias("_row"), F.col(key).alias("_key"), micros.alias("_us"), (F.col(order) if order else F.lit(0)).alias("_order"))
    at = F.floor(F.col("_us") / span)
    spread = held.where("_us IS NOT NULL").select("_row", "_key", "_us", "_order", F.posexplode(F.array(at, at + 1)).alias("_copy", "_span"))
    spread = spread.withColumn("_row", F.when(F.col("_copy") == 0, F.col("_row")))
    spans = Window.partitionBy("_key", "_span")
    before = F.count("*").over(spans.orderBy("_us").rangeBetween(Window.unboundedPreceding, -span))
    counted = spread.withColumn("n_window", F.row_number().over(spans.orderBy("_us", "_order")) - before).where(F.col("_copy") == 0)
    timeless = held.where("_us IS NULL").select("_row", F.lit(None).cast("long").alias("n_window"))
    out = counted.select("_row", F.col("n_window").cast("long").alias("n_window")).union(timeless)
    return out.select("_row.*", "n_window", F.coalesce(F.col("n_window") > most, F.lit(False)).alias("rejected"))


def limit_stream(hits: DataFrame, key: str, ts: str, seconds: int = WINDOW_S, most: int = MOST, late: str = "10 minutes") -> DataFrame:
    """The same over a stream (key, ts): state is a key's hit times of the last window, dropped when the watermark has
    passed it. Hits later than ``late`` are dropped; hits of one key count in order of time within a micro-batch. Of hits
    at the same instant, each counts those before it only."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("_us")
        out = []
        for t, now in zip(rows[ts], rows["_us"].tolist(), strict=True):
            times = [x for x in times if now - x < seconds * 1_000_000] + [now]
            out.append((k[0], t, len(times), len(times) > most))
        state.update((times,))
        state.setTimeoutTimestamp(max(max(times) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, "n_window", "rejected"])

    kind, when = hits.schema[key].dataType.simpleString(), hits.schema[ts].dataType.simpleString()
    timed = hits.withWatermark(ts, late).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} {when}, n_window long, rejected boolean", "times array<long>", "append", "EventTimeTimeout")
