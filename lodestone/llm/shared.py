"""Shared storage, lineage cutting and connected components.

Everything that one job leaves for a later job goes to the folder in ``spark.checkpoint.dir``, which
every executor can reach, so that a lost executor costs recomputation and never data.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master that names none (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows written as Parquet to the shared folder and read again (column pruning stays possible).

    The files stay, as the result is read lazily, until ``dropped``, ``cleared`` or the end of the driver's Python.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _left[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks write by themselves; they stay until ``cleared`` or the end of the driver's Python."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, shares: int = 2000) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row a key and in ``weight`` at least the number of ``rows`` of that key.

    Keys with more than one in ``shares`` of ``total``, the sum of all weights, are fewer than ``shares`` and are broadcast; the rows of the
    others are shuffled, where no key is heavy any more.
    """
    crowded = F.broadcast(table.where(F.col(weight) > total / shares).drop(weight))
    rest = rows.join(crowded.select(*on), on, "left_anti").join(table.drop(weight), on, "left")
    return rows.join(crowded, on).unionByName(rest)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a written table.

    A checkpoint would keep the planner's estimate of its size, which multiplies with each join of each round; files have true sizes.
    """
    return written(df, "cut")


def _delete(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that came from ``written`` or ``cut`` and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written", None)
        if path in _left:
            _delete(path, _left.pop(path))


def cleared() -> None:
    """Delete all that ``written`` and ``cut`` have left; results that read it can no longer be read."""
    while _left:
        path, spark = _left.popitem()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():  # at exit the session may be gone
            _delete(path, spark)


atexit.register(cleared)


def _smaller(a: str, b: str, turn: int) -> F.Column:
    """Of two node columns, the one that comes first in this round's random order."""
    ha, hb = F.xxhash64(F.lit(turn), a), F.xxhash64(F.lit(turn), b)
    return F.when((ha < hb) | ((ha == hb) & (F.col(a) < F.col(b))), F.col(a)).otherwise(F.col(b))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; equal roots mean one component.

    Rounds of contraction: each node hooks onto the first of itself and its neighbours in a random order
    that changes every round, then onto what that one hooked onto, and the edges move to the nodes hooked onto. Chains shrink by a constant
    fraction however they are numbered. Hub nodes are met by partial minima and by joins whose right side
    has one row a key, so no hub is gathered in one task. Nulls and self links are ignored.
    """
    both = edges.select("a", "b").where("a <> b")
    left = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    turn = 0
    while not left.isEmpty():
        turn += 1
        ways = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("b"))
        near = ways.groupBy("a").agg(F.min(order)["b"].alias("b"))
        hook = near.select(F.col("a").alias("node"), _smaller("a", "b", turn).alias("up"))
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = cut(hook.join(above, "up").select("node", F.col("top").alias("up")))
        levels.append(hook)
        moved = (
            left.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct()
        )
        done, left = left, cut(moved)
        dropped(done)
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    dropped(left)
    out = levels[-1].withColumnRenamed("up", "root")
    for hook in reversed(levels[:-1]):
        deeper = out.select(F.col("node").alias("up"), F.col("root").alias("deep"))
        out = hook.join(deeper, "up", "left").select("node", F.coalesce("deep", "up").alias("root"))
    out = cut(out)
    dropped(*levels)
    return out
