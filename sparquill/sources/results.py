"""Readers and writers of truth, submissions, cached stages and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import format_cell, parse_cell


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(scene, query, x, y, member, constellation) of a wide CSV: a row for each of a scene's first n_patches cells; absent ones
    have null places. Fails at a malformed cell or a repeated Id."""
    return truth_cells(spark.read.csv(path, header=True))


def truth_cells(wide: DataFrame) -> DataFrame:
    """As ``read_truth``, of a wide table."""
    cells = [c for c in wide.columns if c.startswith("patch_")]
    n = F.count("*").over(Window.partitionBy("Id"))
    once = wide.withColumn("n", n).where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated Id: "), F.col("Id").cast("string"))).cast("boolean")))
    long = once.unpivot(["Id", "n_patches", "constellation"], cells, "patch", "cell")
    long = long.withColumns({"query": F.regexp_extract("patch", r"(\d+)$", 1).cast("int"), "p": parse_cell(F.col("cell"))}).where(F.col("query") <= F.col("n_patches").cast("int"))
    return long.select(F.col("Id").alias("scene"), "query", "p.x", "p.y", "p.member", "constellation")


#: Rules of a submission, in the order of their report.
RULES = ("header", "missing scene", "unknown scene", "repeated scene", "other n_patches", "unknown class", "malformed cell", "place outside", "cell beyond n_patches")


def violations(own: DataFrame, sample: DataFrame, classes: DataFrame, size: int = 3000) -> DataFrame:
    """(rule, n): how often a submission breaks each rule. ``sample`` gives columns, scenes and n_patches, ``classes`` (name) the classes."""
    cells = [c for c in own.columns if c.startswith("patch_")]
    rows = own.groupBy("Id").agg(F.count("*").alias("n"), F.max("n_patches").alias("np"), F.max("constellation").alias("class"))
    known = classes.select(F.col("name").alias("class"), F.lit(True).alias("known")).distinct()
    both = sample.select("Id", F.col("n_patches").alias("want"), F.lit(True).alias("sampled")).join(rows, "Id", "full").join(known, "class", "left")
    here, there = F.col("n").isNotNull(), F.col("sampled").isNotNull()
    scenes = both.agg(
        F.count_if(there & ~here), F.count_if(here & ~there), F.count_if(F.coalesce(F.col("n"), F.lit(0)) > 1), F.count_if(here & there & (F.col("np") != F.col("want"))), F.count_if(here & F.col("known").isNull()),
    ).toDF(*RULES[1:6])
    form = r"^\s*\(\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s*,\s*([01])\s*\)\s*$"
    long = own.unpivot(["Id", "n_patches"], cells, "patch", "cell").where(F.trim("cell") != "-1")
    at = lambda i: F.regexp_extract("cell", form, i).try_cast("double")
    fine = F.col("cell").rlike(form) & at(1).isNotNull() & at(2).isNotNull()
    outside = fine & ~(at(1).between(0, size - 1) & at(2).between(0, size - 1))
    beyond = F.regexp_extract("patch", r"(\d+)$", 1).cast("int") > F.col("n_patches").cast("int")
    places = long.agg(F.count_if(~fine), F.count_if(outside), F.count_if(beyond)).toDF(*RULES[6:])
    head = F.lit(int(own.columns != sample.columns)).cast("long").alias("header")
    wide = scenes.crossJoin(places).select(head, *(F.col(f"`{r}`") for r in RULES[1:]))  # two single rows
    return wide.unpivot([], [F.col(f"`{r}`") for r in RULES], "rule", "n")


def submission(predictions: DataFrame, sample: DataFrame) -> DataFrame:
    """The wide table of a sample's columns, in its order: cells with three decimals, -1 for what is absent or beyond n_patches.

    ``predictions``: (scene, query, x, y, member, name). Fails if the scenes differ from the sample's.
    """
    cells = [c for c in sample.columns if c.startswith("patch_")]
    key = F.concat(F.lit("patch_"), F.lpad(F.col("query").cast("string"), 2, "0"))
    rows = predictions.select("scene", "name", key.alias("patch"), format_cell(F.col("x"), F.col("y"), F.col("member")).alias("cell"))
    wide = rows.groupBy("scene").pivot("patch", sorted(cells)).agg(F.first("cell"))
    names = rows.groupBy("scene").agg(F.first("name", ignorenulls=True).alias("constellation"))
    own = wide.join(names, "scene").withColumnRenamed("scene", "Id")
    both = sample.select("Id", "n_patches", F.lit(True).alias("in_sample")).join(own.withColumn("in_rows", F.lit(True)), "Id", "full")
    same = F.col("in_sample").isNotNull() & F.col("in_rows").isNotNull()
    both = both.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("scene in one table only: "), "Id")).cast("boolean")))
    number = lambda c: int(c.rpartition("_")[2])
    shown = {c: F.when(F.lit(number(c)) <= F.col("n_patches").cast("int"), F.coalesce(c, F.lit("-1"))).otherwise("-1").alias(c) for c in cells}
    return both.select(*(shown.get(c, F.col(c)) for c in sample.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_scene_json(df: DataFrame, path: str) -> None:
    """JSON lines, a folder a scene."""
    df.write.mode("overwrite").partitionBy("scene").json(path)


def read_scene_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def digest(spec: dict) -> str:
    """sha256 of a spec's canonical JSON."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, spec: dict, make) -> DataFrame:
    """The table that ``make`` gives for a spec, written once under the spec's digest and read after that."""
    path = f"{folder}/{digest(spec)[:16]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json_atomic(path: str, value: dict) -> None:
    """JSON by way of a temporary file; NaN is refused."""
    text = json.dumps(value, indent=1, sort_keys=True, allow_nan=False)
    part = Path(f"{path}.part")
    part.write_text(text)
    os.replace(part, path)


class Manifest:
    """A run's record: its spec while running, and its metrics when complete."""

    def __init__(self, path: str, spec: dict) -> None:
        self.path, self.spec = path, spec
        write_json_atomic(path, {"spec": spec, "digest": digest(spec), "status": "running"})

    def complete(self, metrics: dict) -> None:
        write_json_atomic(self.path, {"spec": self.spec, "digest": digest(self.spec), "status": "complete", "metrics": metrics})


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return todo.join(done.select(*keys), keys, "left_anti")


def guarded(manifest: DataFrame, split: str, allow_confirmation: bool = False, log: str | None = None) -> DataFrame:
    """A manifest's rows of a split; the confirmation split only on request, of which each is a line of the file ``log``."""
    if split == "confirmation" and not allow_confirmation:
        raise PermissionError("the confirmation split has to be asked for")
    if log and split == "confirmation":
        with open(log, "a") as f:
            f.write(json.dumps({"split": split, "at": time.time()}) + "\n")
    return manifest.where(F.col("split") == split)
