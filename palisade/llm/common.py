"""Helpers shared by the corpus operators: table access, durable materialisation, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: maximal runs without ASCII white space.  ``bytes.split()`` cuts at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


#: Rows of an Arrow batch: texts are long, and both sides of a Python worker hold a batch whole.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus.  Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list:
    """All columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for tables whose column names may hold dots: inside, columns go by position."""
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns(df))]).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, where everything runs on one machine, may leave the setting out; it then gets a
    temporary folder of its own, removed at exit.
    """
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


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palisade/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor
    costs only the tasks it was running."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``, once nothing will read it again."""
    remove(df.sparkSession, getattr(df, "_written_to", None))


def remove(spark: SparkSession, path: str | None) -> None:
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread_key(col):
    """An injective function of a long join key.  A side that is already partitioned by the key is then exchanged
    again for the join, so that adaptive execution can split the partition of a hot key."""
    return F.expr(f"`{col}` ^ 1") if isinstance(col, str) else col.bitwiseXOR(F.lit(1))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``: a row ``(node, root)`` for every node of an edge,
    ``root`` being the smallest node of its component.

    Alternates the large-star and small-star steps, which keep connectivity and bring every component to a star in
    O(log^2) rounds.  Each round is materialised; nothing but a count and a checksum reaches the driver.  Self loops,
    repeated and reversed edges are harmless; an empty input gives an empty result.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept = materialise(kept, "edges")
    seen = _checksum(kept)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(spread_key("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").select(spread_key("u").alias("k"), "v").join(low, "k").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.select(spread_key("u").alias("k"), "v").join(low.select(spread_key("u").alias("k"), "m"), "k").where("v <> m")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        former, kept = kept, materialise(small.distinct(), "edges")
        discard(former)
        now = _checksum(kept)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
