"""A text index that is kept up to date: segments that never change, each with the texts it adds and those it takes away.

A batch of changes becomes one segment: postings of its texts, and ``docs``, a row for each text that it adds, replaces or deletes. A text counts as the
newest segment that names it says; older postings of it are left out by an anti join when they are read. What a segment adds to
the number of texts and tokens is known when it is written, so these add up without reading any. Which segments there are is one
row appended to the index's manifest, its last act: a batch that fails on the way leaves the index as it was. Segments of like size
are merged, so that a text is written again once for each tier of sizes only.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textindex
from .textindex import TextIndex

#: Neighbouring segments of one tier that are merged, and how many times larger a tier's segments are than those of the tier before.
FANOUT = 4
_MANIFEST = "version long, batch long, n long, total long, segments array<struct<name: string, rows: long>>"


@dataclass(frozen=True)
class SegmentedIndex:
    """The index of a kind in a folder of the shared store; one writer at a time, any readers."""

    spark: SparkSession
    folder: str
    kind: str = "unicode"

    def manifest(self) -> dict:
        """The newest row of the manifest; an empty index if there is none."""
        try:
            row = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            row = None
        if row is None:
            return {"version": 0, "batch": -1, "n": 0, "total": 0, "segments": []}
        return {**row.asDict(), "segments": [(s["name"], s["rows"]) for s in row["segments"]]}

    def _commit(self, made: dict) -> None:
        row = (made["version"], made["batch"], made["n"], made["total"], made["segments"])
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _docs(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{name}/docs")

    def docs(self, segments: list[tuple[str, int]] | None = None) -> DataFrame:
        """``doc_id, version, deleted, size`` of every text ever named (of these segments), as the newest that names it says."""
        names = self.manifest()["segments"] if segments is None else segments
        each = [self._docs(name).withColumn("age", F.lit(len(names) - i)) for i, (name, _) in enumerate(names)]
        rows = reduce(DataFrame.unionByName, each)
        newest = rows.groupBy("doc_id").agg(F.min_by(F.struct("version", "deleted", "size"), "age").alias("x"))
        return newest.select("doc_id", "x.*")

    def _postings(self, segments: list[tuple[str, int]]) -> DataFrame:
        """Postings of these segments that no later one of them replaces."""
        out = None
        for i, (name, _) in enumerate(segments):
            rows = self.spark.read.parquet(f"{self.folder}/segments/{name}/postings")
            later = [self._docs(other).select("doc_id") for other, _ in segments[i + 1 :]]
            if later:
                rows = rows.join(reduce(DataFrame.unionByName, later), "doc_id", "left_anti").select("term", "doc_id", "size", "n", "places")
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self) -> TextIndex:
        """The index as it stands, for ``bm25``, searches and queries like any other."""
        held = self.manifest()
        if not held["segments"]:
            return TextIndex(self.kind, self.spark.createDataFrame([], textindex.POSTINGS), None, None, (0, 0))
        return TextIndex(self.kind, self._postings(held["segments"]), None, None, (held["n"], held["total"]))

    def apply(self, changes: DataFrame, batch: int | None = None) -> None:
        """Add ``changes(doc_id, body, version)``: a null body deletes; of a text's changes the highest version counts, and none that is not above the one known.

        A batch whose number is not above the last one changes nothing, so a stream may run a batch again.
        """
        held = self.manifest()
        if batch is not None and batch <= held["batch"]:
            return
        at = f"{self.folder}/segments/{(name := uuid.uuid4().hex)}"
        latest = changes.groupBy("doc_id").agg(F.max(F.struct("version", F.col("body").isNull().alias("deleted"), "body")).alias("x")).select("doc_id", "x.*")
        size = F.when(F.col("deleted"), F.lit(0)).otherwise(textindex._size(self.kind, F.col("body"))).cast("int")
        known = self.docs(held["segments"]) if held["segments"] else self.spark.createDataFrame([], "doc_id long, version long, deleted boolean, size int")
        before = known.select("doc_id", F.col("version").alias("old"), F.col("deleted").alias("was_deleted"), F.col("size").alias("old_size"))
        fresh = latest.join(before, "doc_id", "left").where("old IS NULL OR version > old")
        fresh.select("doc_id", "version", "deleted", size.alias("size"), "body", "was_deleted", "old_size").write.parquet(f"{at}/changes")
        rows = self.spark.read.parquet(f"{at}/changes")
        textindex.write_sorted(textindex.postings(rows.where("NOT deleted").select("doc_id", "body"), self.kind), f"{at}/postings")
        rows.select("doc_id", "version", "deleted", "size").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/docs")
        live = F.coalesce(~F.col("was_deleted"), F.lit(False))
        one = lambda c: c.cast("long")
        sums = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.sum(one(~F.col("deleted")) - one(live)).alias("n"), F.sum(F.col("size") - F.when(live, F.col("old_size")).otherwise(0)).alias("total")
        ).first()
        segments = [*held["segments"], (name, sums["rows"])] if sums["rows"] else held["segments"]
        batch = held["batch"] if batch is None else batch
        self._commit({"version": held["version"] + 1, "batch": batch, "n": held["n"] + (sums["n"] or 0), "total": held["total"] + (sums["total"] or 0), "segments": segments})

    def compact(self, fanout: int = FANOUT) -> int:
        """Merge neighbouring segments, of which ``fanout`` are of one tier and none of a higher, again until there are none such; how many merges it took.

        The merged segment stands where its parts stood. Deleted texts keep their row in ``docs``, so an older version that comes late stays out.
        """
        merges = 0
        while True:
            held = self.manifest()
            run = _run([rows for _, rows in held["segments"]], fanout)
            if run is None:
                return merges
            a, b = run
            part = held["segments"][a:b]
            at = f"{self.folder}/segments/{(name := uuid.uuid4().hex)}"
            textindex.write_sorted(self._postings(part), f"{at}/postings")
            docs = self.docs(part)
            docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/docs")
            rows = self._docs(name).count()
            self._commit({**held, "version": held["version"] + 1, "segments": [*held["segments"][:a], (name, rows), *held["segments"][b:]]})
            merges += 1

    def history(self) -> DataFrame:
        """``version, batch, n, total, segments`` of every manifest so far, and how many texts each changed."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        return rows.withColumn("added", F.col("n") - F.coalesce(F.lag("n").over(Window.orderBy("version")), F.lit(0)))


def _tier(rows: int, fanout: int) -> int:
    return int(math.log(max(1, rows), fanout) + 1e-9)


def _run(sizes: list[int], fanout: int) -> tuple[int, int] | None:
    """Of the lowest tier that has ``fanout`` segments among neighbours no larger than itself, the newest such neighbours."""
    tiers = [_tier(n, fanout) for n in sizes]
    for tier in sorted(set(tiers)):
        end = len(tiers)
        while end > 0:
            start = end
            while start > 0 and tiers[start - 1] <= tier:
                start -= 1
            if tiers[start:end].count(tier) >= fanout:
                return start, end
            end = min(start, end - 1)
    return None
