"""Structured Streaming forms: keyed state, sketches and rate limits over an append-only log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators import cms as K


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """The log as a stream of its Parquet files; a trigger takes at most files_per_trigger of them.

    The engine takes a plain path for a folder, so the path is given as a pattern, which may be a file too.
    """
    path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def lww_state(stream: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Newest row of each key as a streaming aggregation, for update or complete mode. Late rows lose by their ts."""
    rest = [c for c in stream.columns if c not in by and c not in order]
    keyed = stream.where(F.col(by[-1]).isNotNull())
    return keyed.groupBy(*by).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*by, "r.*")


def cms_cells(stream: DataFrame, key: str, rows: int, cols: int, seed: int = 1) -> DataFrame:
    """Cells of a Count-Min sketch that grows with the stream: state of rows * cols counters."""
    items = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"))
    return K._cells(items, rows, cols, seed).groupBy("row", "col").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Events of each key in tumbling windows; rows later than the watermark are dropped, none if late is None."""
    return (stream if late is None else stream.withWatermark(time, late)).groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of each limiter and second, counted within a task."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["limiter", "ts"]).aggregate([("ts", "count")])
            yield from t.select(["limiter", "ts", "ts_count"]).rename_columns(["limiter", "ts", "n"]).to_batches()


def token_bucket(stream: DataFrame, key: str, ts: str, most: int = 1024, interval: int = 60) -> DataFrame:
    """(limiter, ts, n, window_start, allowed) per limiter and second of each batch, with the bucket as state.

    Within a batch a limiter's events are taken in the order of ts; an event older than the state's window counts in it.
    Events are counted by second before they are shuffled, so of a hot limiter its seconds move and not its events.
    """
    seconds = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("limiter"), F.col(ts).cast("bigint").alias("ts"))

    def go(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for p in parts:
            for t, n in p.groupby("ts")["n"].sum().items():
                counts[int(t)] = counts.get(int(t), 0) + int(n)
        begin, left = state.get if state.exists else (None, 0)
        out = []
        for t in sorted(counts):
            if begin is None or begin + interval <= t:
                begin, left = t, most
            ok = min(left, counts[t])
            left -= ok
            out.append((k[0], t, counts[t], begin, ok))
        state.update((begin, left))
        yield pd.DataFrame(out, columns=["limiter", "ts", "n", "window_start", "allowed"])

    return seconds.mapInArrow(_counted, "limiter string, ts bigint, n bigint").groupBy("limiter").applyInPandasWithState(go, "limiter string, ts bigint, n bigint, window_start bigint, allowed bigint", "begin bigint, tokens bigint", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(root: str):
    """A foreachBatch function that keeps an equality-delete table under root; a repeated batch replaces itself."""
    from tidelog.operators.changefeed import EqualityDeleteTable

    def write(batch: DataFrame, number: int) -> None:
        EqualityDeleteTable(batch.sparkSession, root).append(batch, number)

    return write


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there and end; a second call goes on from the checkpoint.

    Each batch is a folder of its own, so a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_once(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Run a stream of changes into the equality-delete table under root."""
    stream.writeStream.foreachBatch(upsert_sink(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
