"""Streams of network events: lifecycle by request, as-of matches, duplicates, changed bodies, frame counts, windows.

State is keyed and expires by watermark or timer, so it is bounded by what is open and not by what was seen; rates are
limited at the source and nothing is dropped for being too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, req_id string, ev string, url string, method string, status int, mime string, bytes long"
LIFECYCLE = "req_id string, url string, method string, status int, mime string, redirects array<string>, state string, started timestamp, ended timestamp, bytes long"
_STATE = "url string, method string, status int, mime string, redirects array<string>, started timestamp, ended timestamp, bytes long"


def read_events(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 16, form: str = "parquet") -> DataFrame:
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def lifecycle(events: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """One row for each finished, failed or expired request from its req, redirect, res and fail events, in any order within a batch.

    The last URL is kept and earlier ones are its redirects. A request without an end is given out as ``expired`` when
    the watermark has passed its last event by ``idle``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in LIFECYCLE.split(", ")]

        def row(kind: str, s: tuple) -> pd.DataFrame:
            url, method, status, mime, redirects, started, ended, size = s
            return pd.DataFrame([[key[0], url, method, status, mime, list(redirects or []), kind, started, ended, size]], columns=names)

        if state.hasTimedOut:
            out = row("expired", state.get)
            state.remove()
            yield out
            return
        url, method, status, mime, redirects, started, ended, size = state.get if state.exists else (None, None, None, None, [], None, None, 0)
        redirects, done = list(redirects or []), ""
        for part in parts:
            for e in part.sort_values(["ts", "event_id"]).itertuples(index=False):
                started = e.ts if started is None else min(started, e.ts)
                ended = e.ts if ended is None else max(ended, e.ts)
                if e.ev == "redirect" and url and url != e.url:
                    redirects.append(url)
                if e.ev in ("req", "redirect") and e.url:
                    url = e.url
                url, method = url or e.url, method or e.method
                status = int(e.status) if pd.notna(e.status) else status
                mime = e.mime or mime
                size += int(e.bytes) if pd.notna(e.bytes) else 0
                done = {"res": "finished", "fail": "failed"}.get(e.ev, done)
        values = (url, method, status, mime, redirects, started, ended, size)
        if done:
            if state.exists:
                state.remove()
            yield row(done, values)
        else:
            state.update(values)
            state.setTimeoutTimestamp(max(int(ended.timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", idle).groupBy("req_id")
    return keyed.applyInPandasWithState(step, LIFECYCLE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def as_of_stream(events: DataFrame, entries: DataFrame, keys: list[str], within: str = "30 seconds") -> DataFrame:
    """Inner join of two streams on keys, the entry at most ``within`` before the event; both sides' state ends by watermark."""
    e = events.withWatermark("ts", within).alias("e")
    n = entries.withWatermark("ts", within).alias("n")
    near = F.expr(f"e.ts >= n.ts AND e.ts <= n.ts + INTERVAL {within}")
    for k in keys:
        near = near & (F.col(f"e.{k}") == F.col(f"n.{k}"))
    return e.join(n, near).select(*[F.col(f"e.{k}").alias(k) for k in keys], "e.event_id", "n.entry_id", F.col("e.ts").alias("ts"), F.col("n.ts").alias("entry_ts"))


def without_repeats(events: DataFrame, keys: list[str], within: str = "2 seconds") -> DataFrame:
    """The first of rows with equal keys that come within the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def changed_bodies(bodies: DataFrame) -> DataFrame:
    """Rows (url, ts, body) whose body differs from the one before it of its URL; state is a hash for each URL."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import xxhash

        last = state.get[0] if state.exists else None
        rows = []
        for part in parts:
            for r in part.sort_values("ts").itertuples(index=False):
                now = xxhash.xxh64_hexdigest((r.body or "").encode("utf-8", "surrogatepass"))
                if now != last:
                    rows.append((key[0], r.ts, r.body))
                    last = now
        state.update((last,))
        yield pd.DataFrame(rows, columns=["url", "ts", "body"])

    return bodies.groupBy("url").applyInPandasWithState(step, "url string, ts timestamp, body string", "hash string", "append", GroupStateTimeout.NoTimeout)


def frame_counts(frames: DataFrame, delay: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """Frames and bytes by URL and window."""
    w = frames.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "url")
    return w.agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes")).select("url", F.col("w.start").alias("start"), "frames", "bytes")


def window_counts(events: DataFrame, key: str, value: str, delay: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), key)
    return out.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key)
    return out.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def current_generation(events: DataFrame, generation: int) -> DataFrame:
    """Rows of the current session only: results of an earlier one are late."""
    return events.where(F.col("gen") == generation)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that the source has now, into a table in memory; for tests and small replays."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
