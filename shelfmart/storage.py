"""Stored tables: Parquet folders, never changed once written, and a log of which folders are current.

A change writes new folders beside the old ones and then names them in the `_current` log, so a job that dies half
way leaves the table as it was. Partitioned tables are replaced partition by partition: a merge reads and rewrites
only the partitions its batch touches.
"""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from shelfmart.operators.merge import CHANGE, INSERTED, UPDATED, batch_changes, full_changes
from shelfmart.session import shared_dir

# `whole` rows start a table anew; partitions named before them no longer count.
CURRENT = "name string, part string, version long, path string, whole boolean"


# Batches of more rows than a broadcast would hold take one full outer join with the partitions they touch.
BULK_ROWS = 50_000

# A merge goes through its partitions in waves of about so many stored bytes, so that what it shuffles at a time does not
# grow with the table. A single partition is not split.
WAVE_BYTES = 1 << 30


def _version(path: str) -> int:
    return int(re.search(r"/v=(\d+)", path)[1])


def together(*works: Callable[[], object]) -> list:
    """Results of steps that do not need each other, run at the same time, so that small jobs share the cluster."""
    with ThreadPoolExecutor(len(works)) as pool:
        return [done.result() for done in [pool.submit(work) for work in works]]


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder, for plans outside a store that read them several times."""
    path = f"{shared_dir(df.sparkSession)}/kept/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Merged:
    """A table after a merge, the partitions that were rewritten (None: all), and inserted and updated rows by group."""

    table: DataFrame
    parts: list | None
    counts: dict[str, tuple[int, int]]


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._current: dict[str, dict[str, str]] | None = None
        self._schemas: dict[str, StructType] = {}
        self._frames: dict[str, tuple[list[str], DataFrame]] = {}
        self._lock, self._appending = threading.Lock(), threading.Lock()

    # Snapshots

    def write(
        self,
        name: str,
        df: DataFrame,
        partition_by: str | None = None,
        sort_by: str | None = None,
        last: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> DataFrame:
        """Replace a table and return it as stored. `last` is applied to the rows right before they are written: what is
        observed there is counted by the tasks that write, and by a plan whose input turns out to be empty as well."""
        version = time.time_ns()
        path = f"{self.root}/{name}/v={version}"
        self._schemas.pop(name, None)
        if partition_by is None:
            last(df).write.parquet(path)
            self._publish(name, version, {"": path}, whole=True)
        else:
            self._write_partitions(path, df, partition_by, sort_by, last)
            written = self.spark.read.schema(df.schema).parquet(path)
            found = written.select(F.col(partition_by).cast("string").alias("part")).distinct()
            parts = [row["part"] for row in found.toLocalIterator()]
            if not parts:
                return self.write(name, df.limit(0))
            self._publish(name, version, {p: f"{path}/{partition_by}={p}" for p in parts}, whole=True)
        return self.read(name)

    def spool(self, name: str, rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows stored once, for several steps that read them, and their number, counted while they are written."""
        path = f"{self.root}/_spool/{name}/v={time.time_ns()}"
        seen = Observation()
        rows.observe(seen, F.count("*").alias("rows")).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), seen.get["rows"]

    def share(self, other: TableStore, names: Iterable[str]) -> None:
        """Name the current folders of another store's tables as current here as well. Folders never change once
        written, so that nothing is copied; a later change here writes to this store."""
        for name in names:
            other._paths(name)
            paths = other._current[name]
            self._schemas.pop(name, None)
            self._publish(name, time.time_ns(), paths, whole=True)

    def drop_spooled(self, *spooled: DataFrame) -> None:
        """Delete rows stored by `spool`, once no step reads them any more."""
        for rows in spooled:
            for path in {file.rsplit("/", 1)[0] for file in rows.inputFiles() if "/_spool/" in file}:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def merge(
        self,
        name: str,
        batch: DataFrame,
        keys: Sequence[str],
        updated: Sequence[str],
        partition_by: str | None = None,
        sort_by: str | None = None,
        fixed_by_key: bool = False,
        bulk: bool | None = None,
        version_by: Sequence[str] = (),
        groups: Mapping[str, Column] | None = None,
    ) -> Merged:
        """Merge a batch (one row per key) into a table; the result tells what was done, counted while writing.

        The batch is stored once. Only touched partitions are read and rewritten. Where the partition follows from the
        key (`fixed_by_key`) the batch alone tells which those are; otherwise the keys of the table are looked up as well.
        `bulk` is for a batch about as large as what it touches; left out, the number of its rows decides. With
        `version_by`, a row older than the stored one changes nothing. `groups` are the rows to be counted apart.
        """
        groups = groups or {"all": F.lit(True)}
        table = self.read(name)
        whole = partition_by is None or self._whole_path(name) is not None
        if table is None or (whole and partition_by is not None and table.isEmpty()):
            seen = Observation()
            count = lambda rows: rows.observe(seen, *[F.count_if(which).alias(g) for g, which in groups.items()])
            table = self.write(name, batch, partition_by, sort_by, count)
            return Merged(table, None, {g: (seen.get[g], 0) for g in groups})
        batch, rows = self.spool(name, batch)
        if not rows:
            self.drop_spooled(batch)
            return Merged(table, [], {g: (0, 0) for g in groups})
        change = full_changes if (rows > BULK_ROWS if bulk is None else bulk) else batch_changes
        parts = None
        if not whole:
            touched = batch.select(partition_by)
            if not fixed_by_key:
                known = table.select(*keys, partition_by).join(batch.select(*keys), list(keys), "left_semi")
                touched = touched.unionByName(known.select(partition_by))
            parts = [row[0] for row in touched.distinct().toLocalIterator()]
            table = table.where(F.col(partition_by).isin(parts))
        counts = [
            F.count_if(which & (F.col(CHANGE) == what)).alias(f"{g} {what}")
            for g, which in groups.items()
            for what in (INSERTED, UPDATED)
        ]
        done: Counter[str] = Counter()

        def merge_into(write: Callable, mine: Column | None = None) -> None:
            old, new = (table, batch) if mine is None else (table.where(mine), batch.where(mine))
            seen = Observation()
            write(change(old, new, keys, updated, version_by), lambda rows: rows.observe(seen, *counts).drop(CHANGE))
            done.update(seen.get)

        if parts is None:
            merge_into(lambda rows, count: self.write(name, rows, partition_by, sort_by, count))
        else:
            version = time.time_ns()
            path = f"{self.root}/{name}/v={version}"
            for wave in self._waves(table.unionByName(batch.select(*table.columns)), partition_by, parts if fixed_by_key else []):
                merge_into(lambda rows, count: self._write_partitions(path, rows, partition_by, sort_by, count), wave)
            self._publish(name, version, {str(p): f"{path}/{partition_by}={p}" for p in parts}, whole=False)
        self.drop_spooled(batch)
        return Merged(self.read(name), parts, {g: tuple(done[f"{g} {what}"] for what in (INSERTED, UPDATED)) for g in groups})

    def _waves(self, rows: DataFrame, partition_by: str, parts: list) -> list[Column | None]:
        """Which partitions to merge at a time, neighbours together; None is all at once."""
        factor = float(self.spark.conf.get("spark.sql.sources.fileCompressionFactor"))
        stored = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() / factor
        waves = min(len(parts), math.ceil(stored / WAVE_BYTES))
        if waves < 2:
            return [None]
        parts = sorted(parts, key=lambda p: (p is not None, p))
        cuts = [len(parts) * k // waves for k in range(waves + 1)]
        column = F.col(partition_by)
        found = [column.isin(parts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return [found[0] | column.isNull(), *found[1:]]

    def read(self, name: str) -> DataFrame | None:
        """A table as it is now; until it changes, its folders are listed once."""
        paths = self._paths(name)
        if not paths:
            return None
        known = self._frames.get(name)
        if known is None or known[0] != paths:
            self._frames[name] = known = (paths, self._at(name, paths))
        return known[1]

    def read_since(self, name: str, version: int) -> DataFrame | None:
        """The folders of a table that were written after `version`; None if there is no table."""
        paths = self._paths(name)
        newer = [path for path in paths if _version(path) > version]
        if not paths:
            return None
        return self._at(name, newer) if newer else self._at(name, paths).limit(0)

    def _at(self, name: str, paths: list[str]) -> DataFrame:
        """Folders of a table, some of which may be shared with another store. Its columns are read from files once and
        remembered; a table that gets others is written anew as a whole."""
        rows = None
        for base in sorted({path.rsplit("/v=", 1)[0] for path in paths}):
            reader = self.spark.read.option("basePath", base)
            if name in self._schemas:
                reader = reader.schema(self._schemas[name])
            found = reader.parquet(*[path for path in paths if path.startswith(f"{base}/v=")]).drop("v")
            self._schemas[name] = found.schema
            rows = found if rows is None else rows.unionByName(found)
        return rows

    def newest(self, names: Iterable[str]) -> int:
        """The newest version of any of the tables, 0 if there is none."""
        return max((_version(path) for name in names for path in self._paths(name)), default=0)

    def _write_partitions(
        self,
        path: str,
        df: DataFrame,
        partition_by: str,
        sort_by: str | None,
        last: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> None:
        """Rebalanced by partition, so that adaptive execution cuts one that holds much of the data into several
        tasks and packs small ones together."""
        order = [partition_by, *([sort_by] if sort_by else [])]
        rows = df.hint("rebalance", partition_by).sortWithinPartitions(*order)
        last(rows).write.mode("append").partitionBy(partition_by).parquet(path)

    def _publish(self, name: str, version: int, paths: dict[str, str], whole: bool) -> None:
        entries = json.dumps([{"part": part, "path": path} for part, path in sorted(paths.items())])
        rows = self.spark.range(1).select(
            F.lit(name).alias("name"),
            F.inline(F.from_json(F.lit(entries), "array<struct<part: string, path: string>>")),
            F.lit(version).alias("version"),
            F.lit(whole).alias("whole"),
        )
        # a folder of its own, since writers of one folder disturb each other
        rows.coalesce(1).write.parquet(f"{self.root}/_current/{name}-{version}")
        with self._lock:
            if self._current is not None:
                before = {} if whole else self._current.get(name, {})
                self._current[name] = {**before, **paths}

    def _paths(self, name: str) -> list[str]:
        """Current folders of a table: one, or one per partition. The log is read once; this store adds to its copy
        what it publishes itself, and `reload` picks up the changes of others."""
        with self._lock:
            if self._current is None:
                self._current = self._load()
        return sorted(self._current.get(name, {}).values())

    def _whole_path(self, name: str) -> str | None:
        """Folder of a table stored in one piece, which a partitioned one is while it is empty, or as it was shared."""
        self._paths(name)
        return self._current.get(name, {}).get("")

    def reload(self) -> None:
        self._current = None
        self._schemas = {}
        self._frames = {}

    def _load(self) -> dict[str, dict[str, str]]:
        try:
            log = self.spark.read.schema(CURRENT).option("recursiveFileLookup", True)
            entries = log.parquet(f"{self.root}/_current")
        except AnalysisException:
            return {}
        newest = entries.groupBy("name", "part").agg(
            F.max_by("path", "version").alias("path"),
            F.max("version").alias("version"),
            F.max(F.when(F.col("whole"), F.col("version"))).alias("started"),
        )
        found = list(newest.toLocalIterator())
        starts: dict[str, int] = {}
        for row in found:
            starts[row["name"]] = max(starts.get(row["name"], 0), row["started"] or 0)
        current: dict[str, dict[str, str]] = {}
        for row in found:
            if row["version"] >= starts[row["name"]]:
                current.setdefault(row["name"], {})[row["part"]] = row["path"]
        return current

    # Logs

    def append(self, name: str, rows: DataFrame) -> None:
        with self._appending:
            rows.write.mode("append").parquet(f"{self.root}/{name}")

    def log(self, name: str, schema: str) -> DataFrame:
        """An append-only table; empty until its first append."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
