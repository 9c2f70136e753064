"""Structured Streaming jobs: import, counters, windows, stateful loops, upserts and sync."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..context import shared_dir


def landed(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over landed Parquet files of one table."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def landed_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Rotated transcript files as they arrive: file_path, value. A path is read once."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(folder)
    return stream.select(F.col("_metadata.file_path").alias("file_path"), "value")


def fold(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None, every: str | None = None) -> None:
    """Run ``write`` per micro-batch: until the input is drained, or forever with a trigger interval."""
    spark = stream.sparkSession
    place = checkpoint or f"{shared_dir(spark)}/sessionloom/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    if not every:
        query.awaitTermination()


def to_table(stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain the stream into a table in the shared folder and read it back.

    A second call with the path of an earlier one adds only what has arrived since; the checkpoint lies in the path,
    where readers don't see it, unless another place is named.
    """
    spark = stream.sparkSession
    if path and mode == "append":
        checkpoint = checkpoint or f"{path}/_checkpoint"
    path = path or f"{shared_dir(spark)}/sessionloom/out-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    fold(stream, write, mode, checkpoint)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


# --- windows -----------------------------------------------------------------------


def tumbling(events: DataFrame, width: str = "1 day", *keys: str) -> DataFrame:
    """Events and tokens per window; events later than two days behind go to a side batch (``late_rows``)."""
    return events.withWatermark("ts", f"{K.MTIME_SLACK_DAYS} days").groupBy(F.window("ts", width), *keys).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens")
    )


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day", *keys: str) -> DataFrame:
    return events.withWatermark("ts", f"{K.MTIME_SLACK_DAYS} days").groupBy(F.window("ts", width, step), *keys).agg(F.sum("tokens").alias("tokens"))


def session_windows(events: DataFrame, *keys: str) -> DataFrame:
    """Sittings as session windows: half an hour of silence closes one."""
    return events.withWatermark("ts", f"{K.MTIME_SLACK_DAYS} days").groupBy(F.session_window("ts", "30 minutes"), *keys).agg(F.count(F.lit(1)).alias("replies"))


def late_rows(batch: DataFrame, newest: str, slack_days: int = K.MTIME_SLACK_DAYS) -> DataFrame:
    """Rows of a batch that the watermark leaves out, for a repair job."""
    return batch.where(F.col("ts") < F.lit(newest).cast("timestamp") - F.expr(f"interval {slack_days} days"))


# --- state -----------------------------------------------------------------------------


#: Groups of keys that share one state. It is part of a checkpoint: a stream keeps the number it began with.
BUCKETS = 4096


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def _held(state: GroupState, columns: list[str]) -> pd.DataFrame:
    """The rows that the state of a bucket holds, one for each key."""
    if not state.exists:
        return pd.DataFrame(columns=columns)
    return pa.ipc.open_stream(state.get[0]).read_pandas()


def _hold(state: GroupState, rows: pd.DataFrame) -> None:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _codes(held: pd.Series, seen: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the keys in the state and in the batch, and the keys by number."""
    codes, names = pd.factorize(np.concatenate([held.to_numpy(object), seen.to_numpy(object)]), use_na_sentinel=False)
    return codes[: len(held)], codes[len(held) :], names


def stateful_counters(counts: DataFrame, key: str = "file_path") -> DataFrame:
    """Cumulative totals to deltas per key, across batches: key, line_no, delta. A smaller total is a reset.

    Rows without a total tell nothing and drop out. The state is the last total of each key, held by bucket.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, held = pd.concat(list(batches)), _held(state, ["key", "total"])
        old, new, names = _codes(held["key"], rows[key])
        order = np.lexsort((rows["line_no"].to_numpy(), new))
        code, line, total = new[order], rows["line_no"].to_numpy()[order], rows["total"].to_numpy(np.int64)[order]
        known, last = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        known[old], last[old] = True, held["total"].to_numpy(np.int64)
        first = np.append(True, code[1:] != code[:-1])
        seen = np.where(first, known[code], True)
        previous = np.where(first, last[code], np.append(0, total[:-1]))
        delta = total - np.where(seen & (total >= previous), previous, 0)
        fresh = ~seen | (total != previous)
        ends = np.append(first[1:], True)
        last[code[ends]] = total[ends]
        _hold(state, pd.DataFrame({"key": names, "total": last}))
        yield pd.DataFrame({key: names[code[fresh]], "line_no": line[fresh], "delta": delta[fresh]})

    rows = counts.where("total is not null").select(_bucket(key), key, "line_no", "total")
    return rows.groupBy("bucket").applyInPandasWithState(
        step, f"{key} string, line_no long, delta long", "held binary", "append", GroupStateTimeout.NoTimeout
    )


_OPEN = ["session_id", "start", "end", "steps", "spoken", "due"]


def stateful_loops(points: DataFrame, gap_ms: int = K.SITTING_GAP_MS) -> DataFrame:
    """Runs of work between human turns as they close: session_id, start_ms, end_ms, steps.

    ``points``: session_id, ts (watermarked), at_ms, turn (1 for a human turn). State is one open run per
    session, held by bucket; an event-time timer closes it after the pause. When a source has ended, one more row (of any
    session, a turn, later than all others by the watermark's delay and the pause) closes the runs that are still open.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, passed = _held(state, _OPEN), int(state.getCurrentWatermarkMs())
        rows = None if state.hasTimedOut else pd.concat(list(batches))
        out, kept = _loops(held, rows, gap_ms, passed)
        if len(kept):
            _hold(state, kept)
            state.setTimeoutTimestamp(max(int(kept["due"].min()), passed + 1))
        else:
            state.remove()
        yield out

    rows = points.select(_bucket("session_id"), "session_id", "ts", "at_ms", "turn")
    return rows.groupBy("bucket").applyInPandasWithState(
        step, "session_id string, start_ms long, end_ms long, steps long", "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def _loops(held: pd.DataFrame, rows: pd.DataFrame | None, gap_ms: int, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Closed runs, and the open ones afterwards, of the sessions of a bucket.

    A session of the batch goes on from its open run; any other one closes when the watermark has passed its ``due``.
    """
    seen = rows["session_id"] if rows is not None else pd.Series([], dtype=object)
    old, new, names = _codes(held["session_id"], seen)
    number = {c: held[c].to_numpy(np.int64) for c in _OPEN[1:]}
    moved = np.zeros(len(names), bool)
    moved[new] = True
    due = ~moved[old] & (number["due"] < passed)
    closed = [(old[due & (number["steps"] > 0)], *[number[c][due & (number["steps"] > 0)] for c in ("start", "end", "steps")])]
    stay = ~moved[old] & ~due
    kept = [(old[stay], *[number[c][stay] for c in _OPEN[1:]])]
    if len(new):
        # The open run of a session stands before its rows: a step that ended at ``end``, and what was spoken.
        on = moved[old]
        at = np.concatenate([number["end"][on], rows["at_ms"].to_numpy(np.int64)])
        turn = np.concatenate([np.zeros(on.sum(), bool), rows["turn"].to_numpy() != 0])
        code = np.concatenate([old[on], new])
        carried = np.concatenate([np.ones(on.sum(), bool), np.zeros(len(new), bool)])
        start = np.concatenate([number["start"][on], at[on.sum() :]])
        steps = np.concatenate([number["steps"][on], (~turn[on.sum() :]).astype(np.int64)])
        spoken = np.concatenate([number["spoken"][on], np.where(turn[on.sum() :], at[on.sum() :], -1)])
        order = np.lexsort((~turn, at, ~carried, code))
        code, at, start, steps, spoken = (x[order] for x in (code, at, start, steps, spoken))
        spoken = pd.Series(spoken).groupby(code).cummax().to_numpy()
        ends = np.append(code[1:] != code[:-1], True)
        last_spoken = np.full(len(names), -1, np.int64)
        last_spoken[code[ends]] = spoken[ends]
        w = steps > 0
        code, at, start, steps, spoken = (x[w] for x in (code, at, start, steps, spoken))
        starts = np.ones(len(code), bool)
        if len(code):
            starts[1:] = (code[1:] != code[:-1]) | (at[1:] - at[:-1] > gap_ms) | (spoken[1:] > at[:-1])
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(code))[: len(first)] - 1
        run = (code[first], start[first], at[last], np.add.reduceat(steps, first) if len(first) else steps[:0])
        open_ = np.append(run[0][1:] != run[0][:-1], True)[: len(first)]
        closed.append(tuple(x[~open_] for x in run))
        every = np.flatnonzero(moved)
        state = {c: np.full(len(names), v, np.int64) for c, v in (("start", -1), ("end", -1), ("steps", 0))}
        for c, x in zip(state, run[1:], strict=True):
            state[c][run[0][open_]] = x[open_]
        begun = {c: x[every] for c, x in state.items()}
        wait = np.maximum(np.maximum(begun["end"], last_spoken[every]) + gap_ms + 1, passed + 1)
        kept.append((every, *begun.values(), last_spoken[every], wait))
    done, rest = ([np.concatenate(x) for x in zip(*parts, strict=True)] for parts in (closed, kept))
    return (
        pd.DataFrame({"session_id": names[done[0]], "start_ms": done[1], "end_ms": done[2], "steps": done[3]}),
        pd.DataFrame(dict(zip(_OPEN, (names[rest[0]], *rest[1:]), strict=True))),
    )


# --- upserts ------------------------------------------------------------------------------


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder for each micro-batch; a repeated batch replaces its own folder and no other."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches; ``start_table`` must have made the table."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(path)


def _there(read: Callable[[], DataFrame]) -> bool:
    try:
        read()
    except AnalysisException:  # the path doesn't exist
        return False
    return True


def start_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table, batch -1 without rows, where there is none yet; a table that is there stays as it is."""
    if not _there(lambda: batches(spark, path, schema)):
        append_batch(spark.createDataFrame([], schema), path, -1)


def append_stream(stream: DataFrame, path: str, schema: str, checkpoint: str | None, write: Callable[[DataFrame, int], None]) -> None:
    """Fold a stream into the batches of a table.

    Numbers of batches come from the checkpoint. It lies in the table's folder unless another place is named, so that a
    second call and a restart go on counting. A new checkpoint would begin at 0 again and replace what is there, so on a
    table with batches it is refused.
    """
    spark = stream.sparkSession
    start_table(spark, path, schema)
    place = checkpoint or f"{path}/_checkpoint"
    if not _there(lambda: spark.read.text(f"{place}/metadata")) and not batches(spark, path, schema).where("batch_id >= 0").isEmpty():
        raise ValueError(f"{path} has batches of another checkpoint; name that one, or compact the table to a new path")
    fold(stream, write, checkpoint=place)


def compact(current: DataFrame, path: str) -> None:
    """Write what a table holds as the only batch of a new one; readers move to it when it is complete."""
    append_batch(current, path, -1)


STORED_SCHEMA = (
    "id string, first_seq long, seq long, project_seq long, tool string, session_id string, project string, model string, ts timestamp, "
    "input long, output long, cache_read long, cache_write long"
)
_IDENTITY, _COUNTERS = ("tool", "session_id", "model", "ts"), ("input", "output", "cache_read", "cache_write")


def combined_usage(rows: DataFrame) -> DataFrame:
    """One row per id: what the first record names, the last counters, the last project that isn't empty.

    The order is that of ``seq``, so neither the order of batches nor a repeated one changes the result.
    """
    return rows.groupBy("id").agg(
        F.min("first_seq").alias("first_seq"), F.max("seq").alias("seq"),
        F.max(F.when(F.col("project") != "", F.col("project_seq"))).alias("project_seq"),
        F.min_by(F.struct(*_IDENTITY), "first_seq").alias("named"), F.max_by(F.struct(*_COUNTERS), "seq").alias("counted"),
        F.coalesce(F.max_by("project", F.when(F.col("project") != "", F.col("project_seq"))), F.lit("")).alias("project"),
    ).select("id", "first_seq", "seq", "project_seq", "named.*", "counted.*", "project").select(*[c.split()[0] for c in STORED_SCHEMA.split(", ")])


def stream_usage_upsert(events: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Later counters of a response replace earlier ones. ``events`` carries id, seq and the stored columns.

    Each batch is combined and appended; ``combined_usage(batches(…))`` is the table. See ``append_stream``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = batch.withColumn("project", F.coalesce("project", F.lit(""))).withColumn("first_seq", F.col("seq")).withColumn("project_seq", F.col("seq"))
        append_batch(combined_usage(whole), path, batch_id)

    append_stream(events, path, STORED_SCHEMA, checkpoint, write)


SNAPSHOT_SCHEMA = "key string, hash string, seq long"


def latest_hashes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq"))


def changed_keys(snapshots: DataFrame) -> DataFrame:
    """``key, hash, seq`` of each key whose newest hash in a batch isn't the one known before; of older rows nothing comes.

    The state of a key is its newest hash and position, so no batch reads what earlier ones have sent.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, best = state.get if state.exists else (None, None), None
        for part in parts:
            seqs = part["seq"].to_numpy()
            if len(seqs) and (best is None or seqs.max() > best[1]):
                best = (part["hash"].iloc[int(seqs.argmax())], int(seqs.max()))
        fresh = best is not None and (known[1] is None or best[1] > known[1])
        if fresh:
            state.update(best)
        yield pd.DataFrame([(k[0], *best)] if fresh and best[0] != known[0] else [], columns=["key", "hash", "seq"])

    rows = snapshots.select(F.col("key").cast("string"), "hash", F.col("seq").cast("long"))
    return rows.groupBy("key").applyInPandasWithState(step, SNAPSHOT_SCHEMA, "hash string, seq long", "append", GroupStateTimeout.NoTimeout)


def stream_sync(snapshots: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Checkpointed delta upload: only keys whose hash the remote does not have are appended."""
    append_stream(changed_keys(snapshots), path, SNAPSHOT_SCHEMA, checkpoint, lambda batch, batch_id: append_batch(batch, path, batch_id))


def stream_import(lines: DataFrame, index: Callable[[DataFrame, int], None], every: str | None = None) -> None:
    """Import landed transcripts batch by batch; ``index`` writes the sessions of one batch (see archive.replace_rows).

    With ``every`` the job polls forever; a slow pass delays the next one, it does not pile up.
    """
    fold(lines, index, every=every)
