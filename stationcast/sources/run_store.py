"""Runs that appear whole or not at all.

An attempt writes every table into folders of its own, ``<table>/attempt=<id>/...``, and is
published by one small file, its manifest, written last.  Readers take the folders that
manifests name and list no others, so what a killed or still running attempt wrote is never
seen, and the run before stays readable all the time.

A manifest names entries, each a table with the model and horizon its folder holds (either
may be missing).  The current entry of a table, model and horizon is that of the last
published attempt with one; entries that a later attempt did not write stay as they are.
Folders of replaced and of failed attempts are left in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "seq bigint, entries array<struct<name: string, model: string, horizon_label: string>>, attempt string"
Entry = tuple[str, str | None, str | None]
#: Tables that are stored as text; all others are parquet.
FORMATS = {"split_metadata": "json", "metrics/json": "json", "metrics/csv": "csv"}


class RunConflict(RuntimeError):
    """Another run was published into the folder while this one was under way."""


@dataclass
class RunAttempt:
    """Folders and entries of one run that is not published yet."""

    spark: SparkSession
    path: str
    attempt: str
    before: frozenset[str]
    entries: set[Entry] = field(default_factory=set)

    def folder(self, name: str, model: str | None = None, horizon_label: str | None = None) -> str:
        """Where this attempt keeps ``name``; the parts that sinks add themselves may be left out."""
        return _folder(self.path, (name, model, horizon_label), self.attempt)

    def add(self, name: str, model: str | None = None, horizon_label: str | None = None) -> None:
        """Note a folder as written.  A folder without rows may be noted if its file has a schema."""
        self.entries.add((name, model, horizon_label))

    def add_written(self, name: str, rows: DataFrame) -> None:
        """Note the models and horizons that ``rows``, read back from the attempt, are stored by."""
        parts = [c for c in ("model", "horizon_label") if c in rows.columns]
        for row in rows.select(*parts).distinct().collect():  # one per model and horizon
            self.add(name, **{c: str(row[c]) for c in parts})

    def publish(self) -> None:
        """Make all entries current at once.

        Raises ``RunConflict`` if another run was published since this one began, as its
        figures were made without the other's.  Two runs that publish within the same
        moment may both succeed; the order of their names then decides.
        """
        log = _manifests(self.spark, self.path)
        if frozenset(r["attempt"] for r in log.select("attempt").collect()) != self.before:
            raise RunConflict(f"another run was published into {self.path}")
        last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        row = [(last + 1, sorted(self.entries, key=str))]
        one = self.spark.createDataFrame(row, _MANIFEST.rsplit(",", 1)[0]).coalesce(1)
        # a single file, which the commit of the write moves into place in one step
        one.write.mode("errorifexists").json(f"{self.path}/manifests/attempt={self.attempt}")


def _folder(path: str, entry: Entry, attempt: str) -> str:
    name, model, horizon_label = entry
    folder = f"{path}/{name}/attempt={attempt}"
    if model is not None:
        folder += f"/model={model}"
    return folder if horizon_label is None else f"{folder}/horizon_label={horizon_label}"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per published run; as many as runs wrote into the folder."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def begin_run(spark: SparkSession, path: str) -> RunAttempt:
    before = frozenset(r["attempt"] for r in _manifests(spark, path).select("attempt").collect())
    return RunAttempt(spark, path, f"a{uuid.uuid4().hex}", before)


def current_entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, model, horizon_label, attempt, seq): what readers of the folder see."""
    each = _manifests(spark, path).select("seq", "attempt", F.explode("entries").alias("_e")).select("seq", "attempt", "_e.*")
    last = F.max(F.struct("seq", "attempt"))
    return each.groupBy("name", "model", "horizon_label").agg(last.alias("_l")).select(
        "name", "model", "horizon_label", "_l.attempt", "_l.seq"
    )


def current_folders(
    spark: SparkSession, path: str, name: str, model: str | None = None, horizon_label: str | None = None,
    attempt: RunAttempt | None = None,
) -> list[str]:
    """Folders of table ``name``, one per model and horizon; ``attempt`` sees its own entries first."""
    rows = current_entries(spark, path).where(F.col("name") == F.lit(name)).collect()
    found: dict[Entry, str] = {(r["name"], r["model"], r["horizon_label"]): r["attempt"] for r in rows}
    if attempt is not None:
        found |= {e: attempt.attempt for e in attempt.entries if e[0] == name}
    return sorted(
        _folder(path, e, a) for e, a in found.items()
        if model in (None, e[1]) and horizon_label in (None, e[2])
    )


def read_run(
    spark: SparkSession,
    path: str,
    name: str,
    model: str | None = None,
    horizon_label: str | None = None,
    schema: StructType | str | None = None,
    attempt: RunAttempt | None = None,
) -> DataFrame:
    """Rows of table ``name`` as last published, with the ``attempt`` each comes from.

    Raises ``LookupError`` where no published run holds the table, model and horizon.
    """
    folders = current_folders(spark, path, name, model, horizon_label, attempt)
    if not folders:
        raise LookupError(f"no published run in {path} has {name} {model or ''} {horizon_label or ''}".rstrip())
    kind = FORMATS.get(name, "parquet")
    reader = spark.read.option("basePath", f"{path}/{name}")
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    reader = reader.schema(schema) if schema is not None else reader
    rows = reader.format(kind).load(folders)
    # names that look like numbers are names all the same
    named = {c: F.col(c).cast("string") for c in ("model", "horizon_label", "attempt") if c in rows.columns}
    return rows.withColumns(named)


def publish_table(
    spark: SparkSession, path: str, name: str, rows: DataFrame, partition_by: Sequence[str] = ("model", "horizon_label")
) -> str:
    """Write and publish ``rows`` as a run of one table; returns the name of the attempt."""
    attempt = begin_run(spark, path)
    parts = [c for c in partition_by if c in rows.columns]
    rows.write.partitionBy(*parts).format(FORMATS.get(name, "parquet")).save(attempt.folder(name))
    if parts:
        attempt.add_written(name, rows.sparkSession.read.format(FORMATS.get(name, "parquet")).load(attempt.folder(name)))
    else:
        attempt.add(name)
    attempt.publish()
    return attempt.attempt
