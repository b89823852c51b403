"""Incremental evaluation: only new frames are scored, and totals follow."""

from __future__ import annotations

import json
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from glintframe.operators.suppression import transition_matrix


def _guard(spark: SparkSession, path: str, parameters: dict) -> None:
    """Parameters of a run are stored once and must not change afterwards."""
    text = json.dumps(parameters, sort_keys=True)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_parameters")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        stored = spark.read.text(f"{path}/_parameters").first()[0]
        if stored != text:
            raise ValueError(f"{path} was written with other parameters: {stored}")
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/_parameters")


def _folders(spark: SparkSession, output: str, name: str) -> list[tuple[int, str]]:
    """Batch number and path of the folders ``name=number`` under ``output``, in order."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{output}/{name}=*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.globStatus(pattern) or []]
    return sorted((int(p.rsplit("=", 1)[1]), p) for p in found)


def _last(spark: SparkSession, output: str, name: str, before: int) -> DataFrame | None:
    """The newest written state of an earlier batch."""
    older = [p for i, p in _folders(spark, output, name) if i < before]
    return spark.read.parquet(older[-1]) if older else None


@contextmanager
def _keyed_state(spark: SparkSession, empty_batches: bool = True):
    """Queries started inside keep their state in RocksDB, on local disk with snapshots beside the checkpoint; settings are put back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _run(rows: DataFrame, step, output: str) -> None:
    (rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{output}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def _once(rows: pd.DataFrame, pixel: list[str]) -> pd.DataFrame:
    """The first row of each pixel."""
    again = (rows[pixel[0]] if len(pixel) == 1 else rows).duplicated(**({} if len(pixel) == 1 else {"subset": pixel})).to_numpy()
    return rows[~again] if again.any() else rows


class _Assembly(StatefulProcessor):
    """State of one frame: a list of the pieces that came, and a mark, once it was whole the mark alone.

    Each look at state is a call to the engine, so the mark tells whether there is a list to look at.
    """

    def __init__(self, pixel: list[str], expected: str | None, patience: int | None, columns: list[str]):
        self.pixel, self.expected, self.patience, self.columns = pixel, expected, patience, columns

    def init(self, handle):
        self.handle = handle
        self.mark = handle.getValueState("mark", "whole boolean")
        self.pieces = handle.getListState("pieces", "rows binary")

    def _held(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(x[0]).read_pandas() for x in self.pieces.get()] if self.pieces.exists() else []

    def _timer(self, at: int | None):
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        mark = self.mark.get()
        if mark is not None and mark[0]:
            return
        new = list(rows)
        held = self._held() if mark is not None else []
        frame = _once(pd.concat([*held, *new]) if held or len(new) > 1 else new[0], self.pixel)
        if self.expected is None or len(frame) >= frame[self.expected].max():
            self.mark.update((True,))
            if mark is not None:
                self.pieces.clear()
                if self.patience is not None:
                    self._timer(None)
            yield frame.assign(status=None, held=None)[self.columns]
            return
        if mark is None:
            self.mark.update((False,))
        batch = pa.RecordBatch.from_pandas(frame.iloc[sum(map(len, held)):], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        self.pieces.appendValue((sink.getvalue().to_pybytes(),))
        if self.patience is not None:
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        if held:
            frame = pd.concat(held)
            self.pieces.clear()
            self.mark.clear()
            yield frame.iloc[:1].assign(status="incomplete", held=len(frame))[self.columns]

    def close(self):
        pass


def evaluate_new_frames(stream: DataFrame, evaluate, output: str, parameters: dict, keys=("scene", "frame"), pixel=("y", "x"), expected: str | None = None,
                        patience_ms: int | None = None) -> None:
    """Run ``evaluate`` on frames without output and append their rows.

    ``stream`` holds pixel rows. A pixel that comes twice, in one micro-batch or in several, counts once; frames that
    were evaluated are dropped, by a mark in their state and without a look at earlier output. With ``expected``, a
    column that tells the pixels of the frame, a frame in several pieces waits in its state until it is whole; without
    it a frame is whole in the batch that brings it. A frame that gets no piece for ``patience_ms`` is given up: its
    pieces go and ``given_up`` has a row for it; pieces that come later begin it anew. Timers fire with a batch that brings rows.

    A frame is assembled in one task, the unit that is bounded by its sensor. Each micro-batch overwrites its own
    folders, so a batch that is run again after a failure leaves no duplicates.
    """
    spark, keys = stream.sparkSession, list(keys)
    _guard(spark, output, parameters)
    schema = StructType([*stream.schema, StructField("status", StringType()), StructField("held", LongType())])
    processor = _Assembly(list(pixel), expected, patience_ms, schema.names)
    frames = stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "none" if patience_ms is None else "processingTime")

    def step(batch: DataFrame, batch_id: int) -> None:
        # state may be read once: everything else starts from the written rows
        batch.write.mode("overwrite").parquet(f"{output}/_assembled={batch_id}")
        rows = spark.read.schema(schema).parquet(f"{output}/_assembled={batch_id}")
        rows.where("status is not null").select(*keys, "status", "held", *([expected] if expected else [])).write.mode("overwrite").parquet(f"{output}/_given_up={batch_id}")
        evaluate(rows.where("status is null").drop("status", "held")).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    with _keyed_state(spark, empty_batches=patience_ms is None):  # a clock would call for empty batches without end
        _run(frames, step, output)


def given_up(spark: SparkSession, output: str) -> DataFrame | None:
    """A row for each frame that was given up: its keys, ``status``, the pixels ``held`` and those expected."""
    found = [p for _, p in _folders(spark, output, "_given_up")]
    return spark.read.parquet(*found) if found else None


def results(spark: SparkSession, output: str, before: int | None = None) -> DataFrame | None:
    found = [p for i, p in _folders(spark, output, "batch") if before is None or i < before]
    return spark.read.option("basePath", output).parquet(*found) if found else None


def frame_transitions(pixels: DataFrame) -> DataFrame:
    """Transition counts per frame: what a running total adds up."""
    return transition_matrix(pixels, ("scene", "frame"))


class _Deliveries(StatefulProcessor):
    """State of one frame: the version that counts and its cells, which go when the frame is closed."""

    def __init__(self, keys: list[str], version: str, horizon: int | None):
        self.keys, self.version, self.horizon = keys, version, horizon

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "version long, cells string")

    def handleInputRows(self, key, rows, timerValues):
        new = [row for part in rows for row in zip(*(part[c].tolist() for c in (self.version, "before", "after", "pixels")))]
        top, cells = int(max(row[0] for row in new)), {}
        for version, b, a, n in new:
            if version == top:
                cells.setdefault((int(b), int(a)), int(n))
        known, old = self.state.get() or (None, "[]")
        if known is not None and (top < known or top == known and old is None):
            return
        closed = old is None
        before = {} if closed else {(b, a): n for b, a, n in json.loads(old)}
        if top == known:  # more of the same delivery
            cells = {**cells, **before}
        change = {c: cells.get(c, 0) - before.get(c, 0) for c in {**before, **cells}}
        self.state.update((top, None if closed else json.dumps([[b, a, n] for (b, a), n in cells.items()])))
        if self.horizon is not None and not closed and top != known:
            if known is not None:  # an open frame has the one timer of its version
                self.handle.deleteTimer(known * 1000 + 1)
            self.handle.registerTimer(top * 1000 + 1)
        out = pd.DataFrame([[*key, b, a, n, closed] for (b, a), n in change.items() if n or closed], columns=[*self.keys, "before", "after", "pixels", "reopened"])
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self.state.update((self.state.get()[0], None))
        return iter(())

    def close(self):
        pass


def running_totals(stream: DataFrame, output: str, keys=("scene",), version: str = "version", horizon: int | None = None) -> None:
    """Totals of per-frame transition rows, where a frame delivered again replaces what it brought before.

    Of several deliveries of a frame that with the highest ``version`` counts, whenever and in whatever order they
    come: repeats and older ones change nothing. Each frame keeps its version and cells in its state and sends on what
    a delivery changes, so a batch costs what it brings. With ``horizon``, a frame whose version is that far behind the
    newest is closed and keeps its version alone; a correction of a closed frame takes back what the written changes of
    that frame add up to, so totals stay exact. A repeat of the version of a closed frame is taken for a copy.

    Versions are whole numbers that fit a time in seconds. Each batch overwrites its own folders; ``totals`` reads the newest.
    """
    spark, frame = stream.sparkSession, [*keys, "frame"]
    cell = [*keys, "before", "after"]
    rows = stream.select(*frame, "before", "after", "pixels", version)
    if horizon is not None:
        # the watermark is the newest version less the horizon; its column goes, so late deliveries are not dropped
        rows = rows.withColumn("_at", F.timestamp_seconds(version)).withWatermark("_at", f"{horizon} seconds").drop("_at")
    kept = [f for f in rows.schema if f.name in frame + ["before", "after"]]
    schema = StructType([*sorted(kept, key=lambda f: [*frame, "before", "after"].index(f.name)), StructField("pixels", LongType()), StructField("reopened", BooleanType())])
    changes = rows.groupBy(*frame).transformWithStateInPandas(_Deliveries(frame, version, horizon), schema, "append", "none" if horizon is None else "eventTime")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/_brought={batch_id}")
        brought = spark.read.schema(schema).parquet(f"{output}/_brought={batch_id}")
        change = brought.drop("reopened")
        earlier = [p for i, p in _folders(spark, output, "_changes") if i < batch_id]
        if earlier and brought.where("reopened").take(1):
            again = brought.where("reopened").select(*frame).distinct()
            before = spark.read.parquet(*earlier).join(again, frame, "left_semi")
            change = change.unionByName(before.withColumn("pixels", -F.col("pixels")))
        change.groupBy(*frame, "before", "after").agg(F.sum("pixels").alias("pixels")).write.mode("overwrite").parquet(f"{output}/_changes={batch_id}")
        now = spark.read.parquet(f"{output}/_changes={batch_id}").select(*cell, "pixels")
        total = _last(spark, output, "_totals", batch_id)
        now = now if total is None else now.unionByName(total)
        now.groupBy(*cell).agg(F.sum("pixels").alias("pixels")).write.mode("overwrite").parquet(f"{output}/_totals={batch_id}")

    with _keyed_state(spark):
        _run(changes, step, output)


def totals(spark: SparkSession, output: str, keys=("scene",)) -> DataFrame | None:
    """The newest totals of ``running_totals``, or None before the first batch."""
    found = _last(spark, output, "_totals", 1 << 62)
    return None if found is None else found.where("pixels <> 0").select(*keys, "before", "after", "pixels")
