"""Keyed state of streams: seen rows, lifecycle decisions and poll cadence, a key at a time.

Each processor keeps its state in the RocksDB store of the stream's checkpoint: a batch reads and writes the keys that it
brings, and a restart goes on from the checkpoint. Changed keys are the stream's output (update mode); the whole state is
read with state_of(). The three jobs equal the batch steps of operators.state over the same landings.

Cases: null times count as never, a null key is a key of its own, a batch without rows changes nothing; rows of one key in
one batch are taken in the order of `ordinal`, or of time and text, so that a batch that is run again gives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyrook.session import work_folder

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_HOUR = 3_600_000_000


def _fields(text: str) -> T.StructType:
    """A schema of strings and of times, in microseconds, as a worker has no session that would parse types or know a zone."""
    kinds = {"string": T.StringType(), "long": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _names(text: str) -> list[str]:
    return [x.split()[0] for x in text.split(", ")]


SEEN = "company string, title string, url string, first_seen_at long, last_seen_at long"
_SEEN_ROW = Row("profile", "key", *_names(SEEN))


class Seen(StatefulProcessor):
    """Key (profile, key): the first and the last sight, and the names of the last one. Rows: profile, key, company, title, url, at."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _fields(SEEN))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, names = None, None, (None, None, None)
        if self.entry.exists():
            *names, first, last = self.entry.get()
        for r in rows:
            new = (r.company, r.title, r.url)
            if last is None or (r.at is not None and (r.at, *(x or "" for x in new)) >= (last, *(x or "" for x in names))):
                last, names = r.at, new
            first = r.at if first is None or (r.at is not None and r.at < first) else first
        entry = (*names, first, last)
        self.entry.update(entry)
        yield _SEEN_ROW(*key, *entry)

    def close(self) -> None:
        pass


DECISION = "key string, company string, title string, url string, at long, source_report string"
_DECISION_ROW = Row("entity", "disposition", *_names(DECISION))


class Lifecycle(StatefulProcessor):
    """Key (entity): a map from disposition to its decision, of which the last one alone stays.

    Rows: entity (what all names of a listing share), disposition, key, company, title, url, at, source_report, ordinal. A
    decision repeated keeps its first time and key; another one takes its place, and starts anew when it comes back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decisions = handle.getMapState("decisions", _fields("disposition string"), _fields(DECISION))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = {d[0]: tuple(e) for d, e in self.decisions.iterator()}
        now = dict(before)
        for r in sorted(rows, key=lambda r: (r.ordinal, r.disposition, r.key)):
            known = now.get(r.disposition)
            now = {r.disposition: (known[0] if known else r.key, r.company, r.title, r.url, known[4] if known else r.at, r.source_report)}
        for d in before.keys() - now.keys():
            self.decisions.removeKey((d,))
        for d, e in now.items():
            if before.get(d) != e:
                self.decisions.updateValue((d,), e)
                yield _DECISION_ROW(*key, d, *e)

    def close(self) -> None:
        pass


POLL = "last_attempt_at long, last_success_at long, last_failure_at long, last_error string, held_until long"
_POLL_ROW = Row("profile", "source_id", "kind", *_names(POLL))


class Polls(StatefulProcessor):
    """Key (profile, source_id): the last attempt, success and failure, and until when the source is held.

    Rows: profile, source_id, ordinal, attempted_at, at (of completion), ok, error, min_hours, watermarked by at. A timer
    releases a source when its cadence ends: the output has a row `held` for each change and a row `released` for each
    timer that the watermark passes; a new attempt puts its timer in the place of the old one. A source with min_hours of
    0 or less is never held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _fields(POLL))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempt = success = failure = error = None
        hours = 0
        if self.entry.exists():
            attempt, success, failure, error, _ = self.entry.get()
        for r in sorted(rows, key=lambda r: r.ordinal):
            attempt, hours = r.attempted_at, r.min_hours
            if r.ok:
                success, error = r.at, None
            else:
                failure, error = r.at, r.error
        times = [x for x in (attempt, success, failure) if x is not None]
        until = max(times) + int(hours * _HOUR) if times and hours > 0 else None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))
        entry = (attempt, success, failure, error, until)
        self.entry.update(entry)
        yield _POLL_ROW(*key, "held" if until is not None else "free", *entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = (*tuple(self.entry.get())[:4], None)
        self.entry.update(entry)
        yield _POLL_ROW(*key, "released", *entry)

    def close(self) -> None:
        pass


def _numbered(rows: DataFrame, *times: str) -> DataFrame:
    return rows.withColumns({x: F.unix_micros(F.col(x).cast("timestamp")) for x in times})


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({x: F.timestamp_micros(x) for x in rows.columns if x == "at" or x.endswith("_at") or x == "held_until"})


def seen(rows: DataFrame) -> DataFrame:
    return _timed(_numbered(rows, "at").groupBy("profile", "key").transformWithState(Seen(), f"profile string, key string, {SEEN}", "Update", "None"))


def lifecycle(rows: DataFrame) -> DataFrame:
    return _timed(_numbered(rows, "at").groupBy("entity").transformWithState(Lifecycle(), f"entity string, disposition string, {DECISION}", "Update", "None"))


def polls(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Attempts older than the watermark when they land (by more than `late`) are dropped: they no longer hold a source."""
    keyed = _numbered(rows.withColumn("completed", F.col("at").cast("timestamp")).withWatermark("completed", late), "attempted_at", "at").groupBy("profile", "source_id")
    return _timed(keyed.transformWithState(Polls(), f"profile string, source_id string, kind string, {POLL}", "Update", "EventTime"))


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> list[dict]:
    """Runs a keyed stream over what has landed since the checkpoint and stops; gives Spark's progress of each batch."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS_DB)
    try:
        query = stream.writeStream.foreachBatch(sink or (lambda batch, _: batch.write.format("noop").mode("overwrite").save()))
        query = query.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return list(query.recentProgress)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def state_of(spark: SparkSession, checkpoint: str, variable: str = "entry") -> DataFrame:
    """The keyed state that a checkpoint holds: the key's columns, then the value's; of a map (`decisions`), its keys and values."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return _timed(rows.select("key.*", *[f"{x}.*" for x in ("user_map_key", "user_map_value", "value") if x in rows.columns]))


def over_landings(landings: list[DataFrame], keyed: Callable[[DataFrame], DataFrame], name: str, sink: Callable[[DataFrame, int], None] | None = None) -> str:
    """Lands tables one after the other and runs a keyed stream after each, started anew every time; gives the checkpoint."""
    spark = landings[0].sparkSession
    root = f"{work_folder(spark)}/keyed-{name}-{uuid.uuid4().hex}"
    for rows in landings:
        rows.write.mode("append").parquet(f"{root}/landed")
        run(keyed(spark.readStream.schema(landings[0].schema).parquet(f"{root}/landed")), f"{root}/checkpoint", sink)
    return f"{root}/checkpoint"
