"""What the training-data operators share: tables in the shared folder, and batches of texts."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import shared_dir

#: Texts that a Python worker holds as strings at once.
SLICE_ROWS = 256


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has gone, and with it the right to clean up
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by the key into as many buckets as a shuffle has partitions; rows stay in the tasks that wrote them until it is read.

    What is then grouped by the key meets the other side without moving.
    """
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").bucketBy(n, key).option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id"):
    """True for the fifth of the ids that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sampled(text: Column, most: int, parts: int = 8) -> Column:
    """The text, or of a longer one `parts` pieces that lie evenly over the whole of it, `most` characters together."""
    size = most // parts
    gap = (F.length(text) - size) / F.lit(parts - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substring(text, F.floor(k * gap).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > most, F.array_join(pieces, " ")).otherwise(text)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Places that each_place() makes of one row at a time.
PLACES = 10_000


def each_place(df: DataFrame, many: str, place: str, most: int = PLACES) -> DataFrame:
    """df with a row for each place from 1 to the column many, which may be any long. Rows of many places are dealt out by pieces of `most`, so that no array or task has them all."""
    n, upto = F.col(many), lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    pieces = F.floor((n - 1) / F.lit(most)).cast("long")  # the last piece of each row
    few = df.where(n <= most).withColumn(place, upto(n - 1))
    tops = df.where(n > most).withColumn("_top", upto(F.floor(pieces / F.lit(most)).cast("long"))).withColumn("_in", upto(F.least(F.lit(most - 1).cast("long"), pieces - F.col("_top") * most)))
    dealt = tops.withColumn("_piece", F.col("_top") * most + F.col("_in")).drop("_top", "_in").repartition(*[c for c, kind in df.dtypes if not kind.startswith("map<")], "_piece")
    each = dealt.withColumn(place, upto(F.least(F.lit(most).cast("long"), n - F.col("_piece") * most) - 1)).withColumn(place, F.col(place) + F.col("_piece") * most)
    return few.unionByName(each.drop("_piece")).withColumn(place, F.col(place) + 1)


def named(c: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def positional(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ..., so that no name of its own, dotted or met before, can clash with an operator's."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def map_texts(df: DataFrame, text: str, schema: str, compute: Callable[[list], dict[str, pa.Array | list]], keep: list[str]) -> DataFrame:
    """df's columns in keep, and those that compute() makes of a list of whole texts (None where null).

    schema: of the new columns only, as DDL.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    made = StructType.fromDDL(schema)
    chosen = positional(df.select(*map(named, keep), named(text)))
    old = [StructField(f"c{k}", f.dataType) for k, f in enumerate(chosen.schema.fields[:-1])]
    full = StructType(old + [StructField(f"m{k}", f.dataType) for k, f in enumerate(made)])
    arrow = to_arrow_schema(full, prefers_large_types=False)
    names = [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            new = compute(part.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                + [x if isinstance(x := new[n], pa.Array) else pa.array(x, arrow.field(len(keep) + k).type) for k, n in enumerate(names)],
                schema=arrow,
            )

    return chosen.mapInArrow(run, full).toDF(*keep, *names)
