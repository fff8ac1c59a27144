"""Columns of stored tables and the day folders they first and last appear in, from file footers alone.

The merged schema of a range of day folders says what any of its files holds, and Spark merges footers in a job
that reads no rows. The folder a column first appears in is found by halving: a range that brings nothing new is not
looked into, so there are as many jobs as changes times the logarithm of the days. A range whose files
disagree about a type has no merged schema and is halved too, a single folder by its files.

Only names, types and days reach the driver. As the engine merges them, decimals of one scale count as one type. A table
without day folders counts as one folder without a day; a missing or empty one has no columns.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

DRIFT = "msg_type string, column string, status string, stored_type string, first_day string, last_day string"


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    """Paths of the files under ``paths``; contents are not read, since no column of them is."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return listing.select("path")


def day_folders(spark: SparkSession, path: str, batches: DataFrame | None = None) -> list[tuple[str | None, list[str]]]:
    """(day, folders) of a table in order of the days; with ``batches`` only the folders of those batches."""
    day = F.regexp_extract("path", r"/dt=([^/]*)/", 1)
    if batches is None:
        own = F.when(day == "", F.lit(path)).otherwise(F.regexp_extract("path", r"^(.*/dt=[^/]*)/", 1))
    else:
        own = F.regexp_extract("path", r"^(.*/batch=[^/]*)/", 1)
    try:
        folders = _files(spark, path).select(day.alias("day"), own.alias("folder"), F.regexp_extract("path", r"/batch=([^/]*)/", 1).alias("batch"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    if batches is not None:
        folders = folders.join(batches.select("batch"), "batch", "left_semi")
    found: dict[str, list[str]] = {}
    for row in folders.select("day", "folder").distinct().collect():
        found.setdefault(row.day, []).append(row.folder)
    return [(d or None, sorted(found[d])) for d in sorted(found)]


class Footers:
    """Merged schemas of ranges of day folders, each read once."""

    def __init__(self, spark: SparkSession, folders: list[tuple[str | None, list[str]]]):
        self.spark, self.folders = spark, folders
        self._known: dict[tuple[int, int], frozenset[tuple[str, str]] | None] = {}

    def _merged(self, paths: list[str]) -> frozenset[tuple[str, str]] | None:
        reader = self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
        try:
            return frozenset((f.name, f.dataType.simpleString()) for f in reader.parquet(*paths).schema.fields)
        except (PySparkException, Py4JJavaError) as e:  # a failed merge comes unconverted from the engine
            if "[UNABLE_TO_INFER_SCHEMA]" in str(e):
                return frozenset()
            if "[CANNOT_MERGE_SCHEMAS]" in str(e):
                return None
            raise

    def merged(self, lo: int, hi: int) -> frozenset[tuple[str, str]] | None:
        """(name, type) pairs in the folders ``lo`` to ``hi``, None where their files disagree about a type."""
        if (lo, hi) not in self._known:
            self._known[lo, hi] = self._merged([p for _, paths in self.folders[lo : hi + 1] for p in paths])
        return self._known[lo, hi]

    def within(self, k: int) -> frozenset[tuple[str, str]]:
        """(name, type) pairs of one folder, whether or not its files agree."""
        if self.merged(k, k) is None:
            found: set[tuple[str, str]] = set()
            todo = [[r.path for r in _files(self.spark, *self.folders[k][1]).collect()]]
            while todo:
                part = todo.pop()
                columns = self._merged(part)
                if columns is None:
                    todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                else:
                    found |= columns
            self._known[k, k] = frozenset(found)
        return self._known[k, k]

    def appearances(self, last: bool = False) -> dict[tuple[str, str], int]:
        """Place of the first folder that holds a (name, type) pair, or of the last one."""
        found: dict[tuple[str, str], int] = {}
        # a range with the columns of the range it is half of: once they are all found, the other half needs no reading
        todo = [(0, len(self.folders) - 1, None)] if self.folders else []
        while todo:
            lo, hi, of = todo.pop()
            if of is not None and of <= found.keys():
                continue
            columns = self.within(lo) if lo == hi else self.merged(lo, hi)
            if lo == hi:
                found |= {c: lo for c in columns if c not in found}
            elif columns is None or not columns <= found.keys():
                mid = (lo + hi) // 2
                halves = [(mid + 1, hi, columns), (lo, mid, columns)]
                todo += halves[::-1] if last else halves
        return found


def stored_columns(spark: SparkSession, path: str, batches: DataFrame | None = None) -> dict[tuple[str, str], tuple[str | None, str | None]]:
    """(name, type) → first and last day whose folder holds it, for the columns in the files of a table."""
    footers = Footers(spark, day_folders(spark, path, batches))
    first, last = footers.appearances(), footers.appearances(last=True)
    return {c: (footers.folders[first[c]][0], footers.folders[last[c]][0]) for c in first}


def stored_drift(spark: SparkSession, tables: dict[str, str], batches: DataFrame | None = None,
                 allow: tuple[str, ...] = ("athlete_id", "extra")) -> DataFrame:
    """How stored tables (type → path) depart from the declared schemas: a column is ``undeclared``, of another ``type``, or declared
    and ``missing`` from every file. Tables that hold no file are left out."""
    rows = []
    for msg_type, path in sorted(tables.items()):
        declared = {f.name: f.dataType.simpleString() for f in S.ingest_schema(msg_type).fields}
        stored = stored_columns(spark, path, batches)
        for (name, kind), (first, last) in sorted(stored.items()):
            if name not in allow and declared.get(name) != kind:
                rows.append((msg_type, name, "type" if name in declared else "undeclared", kind, first, last))
        absent = sorted(declared.keys() - {name for name, _ in stored}) if stored else []
        rows += [(msg_type, name, "missing", None, None, None) for name in absent]
    return spark.createDataFrame(rows, DRIFT)
