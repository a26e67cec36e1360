"""Runs and their result sets: staged, published by one rename, then state advanced, a pointer last.

    root/staging/<run>    rows (by part), their shape, attempts, summary of a run that isn't whole yet
    root/runs/<run>       the same of a published run
    root/pointers/<run>   one row: the run's state has been advanced too

A run's rows are written once, partitioned by what became of them (PARTS), and the funnel's numbers are observed by that
write. The four result sets are parts of it: `ranked` is new and seen together, in the order of tier_rank.

Steps: stage, rename, advance the seen and poll states, point. A run that died is undone (staged only) or finished (from
its own published rows) by recover(), which every publish() begins with; the states' upserts give the same when they are
made again, so every step may be repeated, and a run id that is published already is left alone. Where no source
succeeded the seen state stays as it is; the poll state keeps the failures. One writer at a time.

Cases: a run without rows has empty sets; null columns of rows are kept; a part that isn't one of PARTS is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators import state as S
from tallyrook.operators.state_table import StateTable, all_names
from tallyrook.session import discard

PARTS = ("new", "seen", "suppressed", "excluded")
SETS = {"ranked": ("new", "seen"), "new": ("new",), "seen": ("seen",), "excluded": ("excluded",)}
#: What the seen state needs of a row.
ENTRY = ("posting_id", "dedupe_key", "legacy_key", "aliases", "company", "title", "url")


def part_of() -> F.col:
    """The part of a judged row with reason, disposition and status."""
    return F.when(F.col("reason").isNotNull(), "excluded").when(F.col("disposition").isNotNull(), "suppressed").otherwise(F.col("status"))


def _counts(reasons: tuple[str, ...]) -> dict[str, str]:
    """The funnel's numbers as conditions on a row; reasons of exclusion are named, as a write can't observe groups."""
    live, quoted = "part in ('new', 'seen')", ["'" + r.replace("'", "''") + "'" for r in reasons]
    return {
        "policy_matched": "part <> 'excluded'", "excluded": "part = 'excluded'", "active": live, "suppressed": "part = 'suppressed'", "new": "part = 'new'", "seen": "part = 'seen'",
        "eligible": live + " and geo = 'eligible'", "verify": live + " and geo = 'verify'", "likely_expired": live + " and likely_expired",
        **{d: f"part = 'suppressed' and disposition = '{d}'" for d in S.DISPOSITIONS},
        **{f"excluded: {r}": f"part = 'excluded' and reason = {q}" for r, q in zip(reasons, quoted, strict=True)},
        "excluded for another reason": "part = 'excluded'" + (f" and reason not in ({', '.join(quoted)})" if reasons else ""),
    }


@dataclass
class RunStore:
    spark: SparkSession
    root: str
    seen: StateTable
    polls: StateTable
    profile: str
    reasons: tuple[str, ...] = ()

    def _fs(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _move(self, run_id: str, source: str, target: str) -> None:
        (a, fs), (b, _) = self._fs(source, run_id), self._fs(target, run_id)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise RuntimeError(f"can't publish {run_id}: {b} is there already, or {a} isn't")

    def stage(self, run_id: str, at: str, rows: DataFrame, attempts: DataFrame) -> None:
        """rows: ENTRY, part and whatever a reader needs; attempts: source_id, ordinal, at, ok, error. One pass over rows."""
        path = f"{self.root}/staging/{run_id}"
        discard(self.spark, path)
        kinds = {k: F.count_if(F.expr(e)) for k, e in _counts(self.reasons).items()}
        odd = F.count_if(F.coalesce(~F.col("part").isin(*PARTS), F.lit(True)))
        told = Observation()
        observed = rows.observe(told, F.count(F.lit(1)).alias("rows"), odd.alias("odd"), *[v.alias(f"n{k}") for k, v in enumerate(kinds.values())])
        observed.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/rows")
        numbers = told.get
        if numbers["odd"]:
            raise ValueError(f"{numbers['odd']} rows have no part of {PARTS}")
        self.spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/shape")  # of rows, should there be none
        attempts.write.parquet(f"{path}/attempts")
        summary = [("rows", numbers["rows"]), *[(k, numbers[f"n{i}"]) for i, k in enumerate(kinds)]]
        self.spark.createDataFrame([(run_id, at, *x) for x in summary], "run_id string, at string, metric string, n long").coalesce(1).write.parquet(f"{path}/summary")

    def commit(self, run_id: str) -> None:
        """Published from here on: one rename."""
        self._move(run_id, "staging", "runs")

    def _read(self, run_id: str, what: str) -> DataFrame:
        path = f"{self.root}/runs/{run_id}"
        reader = self.spark.read.schema(self.spark.read.parquet(f"{path}/shape").schema) if what == "rows" else self.spark.read
        return reader.parquet(f"{path}/{what}")

    def advance(self, run_id: str) -> None:
        """The states after a published run; again, they stay as they are."""
        at = F.lit(self._read(run_id, "summary").first()["at"]).cast("timestamp_ntz")
        attempts = self._read(run_id, "attempts")
        updates = attempts.withColumn("profile", F.lit(self.profile))
        self.polls.upsert(attempts.select("source_id").distinct(), lambda old: S.upsert_poll(old, updates))
        if attempts.where("ok").isEmpty():
            return
        entries = self._rows(run_id, ("new", "seen", "suppressed")).select(*ENTRY)
        self.seen.upsert(all_names(entries, "dedupe_key", "legacy_key", lists=("aliases",)), lambda old: S.upsert_seen(old, entries, self.profile, at))

    def point(self, run_id: str) -> None:
        """The run is the latest one, and done."""
        discard(self.spark, f"{self.root}/staging/pointer")
        row = self._read(run_id, "summary").select("run_id", "at").limit(1)
        row.coalesce(1).write.parquet(f"{self.root}/staging/pointer/{run_id}")
        self._move(run_id, "staging/pointer", "pointers")
        discard(self.spark, f"{self.root}/staging/pointer")

    def recover(self) -> None:
        """Undoes runs that are staged only, and finishes published ones that have no pointer."""
        discard(self.spark, f"{self.root}/staging")
        done = set(self._names("pointers"))
        for run_id in self._names("runs"):
            if run_id not in done:
                self.advance(run_id)
                self.point(run_id)

    def publish(self, run_id: str, at: str, rows: DataFrame, attempts: DataFrame) -> None:
        self.recover()
        if run_id not in self._names("runs"):
            self.stage(run_id, at, rows, attempts)
            self.commit(run_id)
            self.advance(run_id)
            self.point(run_id)

    def latest(self) -> str | None:
        """The run whose pointer is the latest, by time and name."""
        if not self._names("pointers"):
            return None
        return self.spark.read.parquet(f"{self.root}/pointers/*").agg(F.max(F.struct("at", "run_id"))).first()[0]["run_id"]

    def _rows(self, run_id: str, parts: tuple[str, ...]) -> DataFrame:
        return self._read(run_id, "rows").where(F.col("part").isin(*parts))

    def result(self, name: str, run_id: str | None = None) -> DataFrame:
        """One of SETS of a run, of the latest one by default."""
        return self._rows(run_id or self.latest(), SETS[name])

    def summary(self, run_id: str | None = None) -> DataFrame:
        return self._read(run_id or self.latest(), "summary")
