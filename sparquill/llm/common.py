"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Byte table: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Byte table: A-Z to a-z, bytes outside `[0-9A-Za-z\x80-\xFF]` to a space. UTF-8 keeps ASCII apart,
#: so after it ``bytes.split`` yields the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and in whatever lambdas ``use`` has it.

    A column of an inner select does not do for that: the optimizer may move its expression into a lambda, where it is
    computed for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, ``spark.checkpoint.dir``. Where none is set a session on one machine, as in tests, takes a temporary one; on a cluster that is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` does not have."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, as two columns. Unlike a row's place they are the same each time that a table is read."""
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)) for k in (1, 2)]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: a later loss of an executor then re-reads a file
    instead of repeating the work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_rows(batches: Iterator[pa.RecordBatch], text: int = -1, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of at most ``rows`` rows, each with its binary text column as a list of bytes or None."""
    for part in slices(batches, rows):
        yield part, part.column(part.num_columns - 1 if text < 0 else text).to_pylist()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a folder, and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_order(df: DataFrame, group: str, order: list[str], path: str) -> DataFrame:
    """``df`` with pos, each row's place (from 0) in its group by ``order`` (nulls first), and size, the group's rows; kept in the folder ``path``.

    Rows are dealt by ranges of group and order and sorted in their runs, so a group of any size is spread over many tasks; what is summed over the runs
    has one row a run and group. Rows equal in all keys take any of their places.
    """
    (salt,) = fresh(df, "salt")
    given = stored(df.withColumn(salt, F.monotonically_increasing_id()), f"{path}/given")
    keys = [group, *order, salt]
    runs = stored(given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt).withColumn("__mid", F.monotonically_increasing_id()), f"{path}/runs")
    run = F.shiftright("__mid", 33).alias("__run")
    counts = runs.groupBy(group, run).agg(F.count("*").alias("n"), F.min("__mid").alias("first"))
    w = Window.partitionBy(group)
    before = F.sum("n").over(w.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("of"), F.col("__run").alias("of_run"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(w).alias("size"))
    placed = runs.withColumn("__run", run).join(stored(offsets, f"{path}/offsets"), F.col(group).eqNullSafe(F.col("of")) & (F.col("__run") == F.col("of_run")))
    return placed.select(*(c for c in runs.columns if c != "__mid"), (F.col("__mid") + F.col("shift")).alias("pos"), "size")
