"""Iteration over DataFrames that survives lost executors: results of a round are written to the folder that all
executors share (``spark.checkpoint.dir``) and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder.  Only a local session may leave the setting out; it gets a temporary folder."""
    uri = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if uri:
        return uri.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="palisade-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def written(df: DataFrame, label: str = "round") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/palisade/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`written` wrote for ``df``, once nothing will read it again."""
    path, spark = getattr(df, "_written_to", None), df.sparkSession
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Numbers 1, 2, ... over all rows in order without bringing them together: sorted ranges are counted, and the small
    table of range sizes gives each its first number."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = written(placed.withColumn("within", F.row_number().over(W.partitionBy("part").orderBy(*order))), "ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.orderBy("part")) - F.col("size")).select("part", "before")
    return placed.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("within")).drop("part", "within", "before")


def components(edges: DataFrame, key: str = "gid", max_rounds: int = 60) -> DataFrame:
    """``(key, node, root)``: the smallest node reachable, within ``key``, from each node of undirected
    ``edges(key, a, b)``.  Labels spread over edges and jump to their label's label; a round is written out, and only a
    count of changes reaches the driver."""
    both = edges.select(key, "a", "b").unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    label = written(both.groupBy(key, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    previous = label
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("node", "b"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = label.join(near, [key, "node"]).select(key, "node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        jump = label.select(key, F.col("node").alias("next"), F.col("root").alias("further"))
        moved = lower.join(jump, [key, "next"], "left").select(key, "node", F.least("next", F.coalesce("further", "next")).alias("root"), "was")
        moved = written(moved, "labels")
        discard(previous)
        previous, label = moved, moved.drop("was")
        if not moved.where("root <> was").limit(1).count():
            discard(both)
            return label
    raise RuntimeError("components did not settle")
