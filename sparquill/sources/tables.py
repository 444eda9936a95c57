"""Views of the driver's tables as scenes, queries, candidates, points, truth and predictions, and the same in SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, for several uses: written to the cluster's shared checkpoint folder and read from there. Where none is set a session on one machine, as in tests, takes
    a temporary one; on a cluster that is refused."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, query, id, pos, score, x, y): the events of a user and type, in order, as scored candidates."""
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.select(
        F.col("user_id").alias("scene"), F.col("event_type").alias("query"), F.col("event_id").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("value").alias("score"),
        (F.col("event_id") * 37 % 3000).cast("double").alias("x"), (F.col("event_id") * 91 % 3000).cast("double").alias("y"),
    )


CAND = """cand AS (SELECT user_id AS scene, event_type AS query, event_id AS id,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, value AS score,
 CAST(event_id * 37 % 3000 AS DOUBLE) AS x, CAST(event_id * 91 % 3000 AS DOUBLE) AS y FROM events)"""


def points(spark: SparkSession, sf_dir: str, scored: bool = False) -> DataFrame:
    """(scene, id, x, y): a vector's first two components as a place in its label's scene; ``scored``, the third as its score."""
    e = load(spark, sf_dir, "embeddings")
    at = lambda i: (F.get("embedding", F.lit(i)).cast("double") + 0.5) * 3000.0
    return e.select(F.col("label").alias("scene"), F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), *([F.get("embedding", F.lit(2)).cast("double").alias("score")] if scored else []))


PTS = """pts AS (SELECT label AS scene, vec_id AS id, (CAST(embedding[1] AS DOUBLE) + 0.5) * 3000.0 AS x,
 (CAST(embedding[2] AS DOUBLE) + 0.5) * 3000.0 AS y, CAST(embedding[3] AS DOUBLE) AS score FROM embeddings)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, query, present, predicted, truth_class, class, tx, ty, x, y): labels as truth, lengths as predictions."""
    d, t = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    place = lambda a, b: (F.col("doc_id") * a % 3000 + b).cast("double")
    return t.join(d, "doc_id").select(
        F.col("source").alias("scene"), F.col("doc_id").alias("query"), (F.col("quality") == 1).alias("present"), (F.col("n_chars") >= 500).alias("predicted"),
        F.col("toxic").alias("truth_class"), (F.col("n_chars") % 5 == 0).cast("int").alias("class"),
        place(17, 0).alias("tx"), place(29, 0).alias("ty"), (F.col("doc_id") * 17 % 3000 + F.col("n_chars") % 40).cast("double").alias("x"), place(29, 0).alias("y"),
    )


DEC = """dec AS (SELECT source AS scene, l.doc_id AS query, quality = 1 AS present, n_chars >= 500 AS predicted, toxic AS truth_class,
 CAST(n_chars % 5 = 0 AS INT) AS class, CAST(l.doc_id * 17 % 3000 AS DOUBLE) AS tx, CAST(l.doc_id * 29 % 3000 AS DOUBLE) AS ty,
 CAST(l.doc_id * 17 % 3000 + n_chars % 40 AS DOUBLE) AS x, CAST(l.doc_id * 29 % 3000 AS DOUBLE) AS y
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
