"""Views that are kept up to date by batches: each batch leaves partial aggregates, which are merged on reading.

A batch has a folder of its own, which it overwrites when it runs again, so that late and repeated batches count once. Counts, sums, extremes and sketches of distinct
values merge; a reader's work grows with keys and batches, not with rows, and fold() puts batches together that will not change any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.views import children
from millrace.shared import new_folder

#: Bits of a sketch's index: its estimates have a standard error of about 0.81 percent.
SKETCH_BITS = 14

# The partial aggregate of a measure, how partials merge, and what the merged one says.
PARTIAL = {
    "count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c), "distinct": lambda c: F.hll_sketch_agg(c, F.lit(SKETCH_BITS)),
}
MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.hll_union_agg}


@dataclass(frozen=True)
class Rollup:
    """keys: column names. measures: name to (count, sum, min, max or distinct; the column's name or expression)."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    measures: dict[str, tuple[str, str]]

    @classmethod
    def create(cls, spark: SparkSession, keys: tuple[str, ...], measures: dict[str, tuple[str, str]]) -> Rollup:
        return cls(spark, new_folder(spark, "rollup"), keys, measures)

    def add(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch; those that the batch had before no longer count."""
        aggregates = [PARTIAL[kind](F.expr(column)).alias(name) for name, (kind, column) in self.measures.items()]
        rows.groupBy(*self.keys).agg(*aggregates).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def sink(self):
        """For foreachBatch."""
        return lambda rows, batch: self.add(rows, batch)

    def _merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[MERGED[kind](name).alias(name) for name, (kind, _) in self.measures.items()])

    def read(self) -> DataFrame:
        """The view over all batches: keys and measures."""
        if not children(self.spark, self.folder):
            raise ValueError("no batch has been added")
        merged = self._merge(self.spark.read.parquet(self.folder))
        said = lambda name, kind: F.hll_sketch_estimate(name) if kind == "distinct" else F.col(name)
        return merged.select(*self.keys, *[said(name, kind).alias(name) for name, (kind, _) in self.measures.items()])

    def fold(self, upto: int) -> None:
        """Batches up to this number become one, under its number. None of them may run again after that."""
        numbers = sorted(int(p.rsplit("=", 1)[1]) for p in children(self.spark, self.folder))
        old = [n for n in numbers if n <= upto]
        if len(old) < 2:
            return
        where = f"{new_folder(self.spark, 'rollup-folded')}"
        self._merge(self.spark.read.parquet(*[f"{self.folder}/batch={n}" for n in old])).write.parquet(where)
        jvm = self.spark.sparkContext._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for n in old:
            fs.delete(path(f"{self.folder}/batch={n}"), True)
        fs.rename(path(where), path(f"{self.folder}/batch={old[-1]}"))
