"""Token counts kept up to date by deltas: signed batches add up to totals by source, language and tokenizer version."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
BATCH = re.compile(r"[A-Za-z0-9_-]+")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add documents. ``counted``: source, lang, tokenizer, tokens."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take documents away again, with the counts they were added with."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(counted: DataFrame, old: str, new: str) -> DataFrame:
    """Changes of counts: ``counted`` has the old and the new count of each document, whose number stays."""
    return counted.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


class Rollup:
    """Additive totals in a shared folder: one folder per committed batch.

    A batch is written under its own name, and its name is in the folder's path, so a batch that is committed again
    (a retried job, a replayed stream) replaces itself or is skipped, and never counts twice. A batch without its
    success mark is unfinished and does not count. ``compact`` folds finished batches into one table and keeps their names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, batch: str) -> bool:
        return self._finished(f"batch={batch}") or batch in self._folded()[1]

    def _finished(self, folder: str) -> bool:
        path, files = self._path(f"{folder}/_SUCCESS")
        return files.exists(path)

    def _listed(self, kind: str) -> list[str]:
        """Names of the finished folders of a kind."""
        path, files = self._path("")
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
        return [n.removeprefix(kind) for n in names if n.startswith(kind) and self._finished(n)]

    def _folded(self) -> tuple[int, set[str]]:
        """Number of the latest finished fold (0: none), and the batches that it covers."""
        last = max(map(int, self._listed("fold=")), default=0)
        return last, {r.value for r in self.spark.read.text(f"{self.folder}/fold={last}/names").collect()} if last else set()

    def compact(self) -> bool:
        """Fold all committed batches, and the fold before, into one table; False if there is nothing new to fold.

        The fold counts from its success mark on, which is written last; batches that it covers do not count beside it,
        so a fold that was broken off changes no total. Covered folders are deleted afterwards: frames of ``totals``
        that were made before must have been read. One writer at a time.
        """
        last, covered = self._folded()
        new = set(self._listed("batch=")) - covered
        if new:
            target = f"fold={last + 1}"
            self.totals().write.mode("overwrite").parquet(f"{self.folder}/{target}/totals")
            names = self.spark.createDataFrame([(n,) for n in sorted(covered | new)], "value string")
            names.coalesce(1).write.mode("overwrite").text(f"{self.folder}/{target}/names")
            path, files = self._path(f"{target}/_SUCCESS")
            files.createNewFile(path)
            last, covered = last + 1, covered | new
        old = [f"batch={b}" for b in self._listed("batch=") if b in covered] + [f"fold={n}" for n in self._listed("fold=") if int(n) < last]
        for folder in old:
            path, files = self._path(folder)
            files.delete(path, True)
        return bool(new)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed ``changes`` (source, lang, tokenizer, docs, tokens); False if the batch is there already.

        Changes are summed before they are shuffled, so a hot source is one row per task. Null keys are values of their
        own; null counts add nothing.
        """
        if not BATCH.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.has(batch):
            return False
        totals = changes.groupBy(*KEYS).agg(
            F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
        )
        totals.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        return sorted({*self._listed("batch="), *self._folded()[1]})

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups that hold nothing are left out."""
        last, covered = self._folded()
        done = [f"{self.folder}/batch={b}" for b in sorted(self._listed("batch=")) if b not in covered]
        done += [f"{self.folder}/fold={last}/totals"] if last else []
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*done)
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 or tokens <> 0")


def words(text: Column) -> Column:
    """Tokens of the plain tokenizer: runs without ASCII white space. Null has none."""
    solid = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(solid == "", F.lit(0)).otherwise(F.length(solid) - F.length(F.replace(solid, F.lit(" "))) + 1).cast("long")


def pieces(text: Column) -> Column:
    """Tokens of the second tokenizer version: runs of ASCII letters, of digits, and every other visible character."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[A-Za-z]+|[0-9]+", ".")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")


def pieces_by_digit(text: Column) -> Column:
    """The same with every digit a token of its own."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[A-Za-z]+", ".")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")
