"""Lineage cutting and Parquet tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; on a local master that names none (tests), set one of our own."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))


def shared_dir(spark: SparkSession) -> str:
    """The session's folder for what one job leaves for a later one."""
    ready(spark)
    return (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


_left: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a written table, which stays until the end of the driver's Python.

    A checkpoint would run the plan twice, once to count and once to save; files also tell the planner their true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _cleared() -> None:
    while _left:
        path, spark = _left.popitem()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():  # at exit the session may be gone
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


atexit.register(_cleared)


_VERSIONS = "version long, tables map<string, array<string>>"


class Tables:
    """Tables in a folder that are loaded again and again; one writer at a time, any readers.

    Parts of tables are written beside each other and never change. Which parts each table has is one row appended to the folder's
    manifest, the last act of a load: one that fails leaves what was there, and readers see a load whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _now(self) -> tuple[int, dict[str, list[str]]]:
        try:
            row = self.spark.read.schema(_VERSIONS).parquet(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            row = None
        return (row["version"], dict(row["tables"])) if row else (0, {})

    def _commit(self, version: int, parts: dict[str, list[str]]) -> None:
        self.spark.createDataFrame([(version, parts)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/parts/{path}")
        return path

    def names(self) -> list[str]:
        return sorted(self._now()[1])

    def read(self, name: str) -> DataFrame:
        """A table as the newest load left it; ``KeyError`` for one that was never loaded."""
        parts = self._now()[1][name]
        return self.spark.read.parquet(*[f"{self.folder}/parts/{p}" for p in parts])

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Load these tables anew, all at once; others stay as they are."""
        version, parts = self._now()
        made = {name: [self._write(rows, name)] for name, rows in tables.items()}
        self._commit(version + 1, {**parts, **made})

    def insert(self, tables: dict[str, DataFrame], keys: dict[str, list[list[str]]]) -> dict[str, int]:
        """Add the rows whose keys are new, and say how many of each table; what is stored stays as it is.

        A table may have several ``keys``, lists of columns; a row that agrees in any of them with a stored one is left out. Of new rows that agree the
        least counts, by the columns in order, so a load gives the same rows however it is partitioned, and twice the same as once.
        """
        version, parts = self._now()
        made, counts = dict(parts), {}
        for name, rows in tables.items():
            columns = rows.columns
            for by in keys[name]:
                rest = [c for c in columns if c not in by]
                once = rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("x")).select(*by, "x.*") if rest else rows.distinct()
                rows = once.select(*columns)
            if name in parts:
                stored = self.read(name)
                for by in keys[name]:
                    same = [rows[c].eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(by)]
                    rows = rows.join(stored.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]), reduce(lambda a, b: a & b, same), "left_anti")
            path = self._write(rows, name)
            counts[name] = self.spark.read.parquet(f"{self.folder}/parts/{path}").count()
            if counts[name] or name not in parts:
                made[name] = [*parts.get(name, []), path]
        self._commit(version + 1, made)
        return counts

    def clear(self, *names: str) -> None:
        """Leave these tables (all, if none is named) without rows."""
        version, parts = self._now()
        empty = {name: [self._write(self.read(name).limit(0), name)] for name in names or parts}
        self._commit(version + 1, {**parts, **empty})


def save(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Write a model's tables under a folder; ``mode="ignore"`` keeps those that exist."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
