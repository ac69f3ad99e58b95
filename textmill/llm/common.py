"""Plumbing of the training-data operators: shared-folder tables and a let-binding for array lambdas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import table

__all__ = ["components", "drop", "hot_keys", "let", "materialise", "renew", "shared_dir", "spread_join", "table"]

#: Rows of a key that one task takes in any case, and keys that are split at most, whatever the input.
BLOCK_ROWS, HOT_KEYS = 256, 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where the setting is absent a temporary folder is chosen once per session in local mode; on a cluster, whose
    executors would each write to a disk of their own, the call fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, which cuts its lineage.

    Unlike a local checkpoint the files survive lost executors; unlike a cached table they cost no executor memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textmill/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def renew(old: DataFrame | None, df: DataFrame) -> DataFrame:
    """df materialised; the table `old` that it replaces, which nothing may read any more, is deleted."""
    out = materialise(df)
    if old is not None:
        drop(old)
    return out


def drop(written: DataFrame) -> None:
    """Delete the files of a materialised table."""
    jvm = written.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(written.written_to)
    path.getFileSystem(written.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where the optimiser would inline it into a lambda."""
    return F.transform(F.array(value), body)[0]


def hot_keys(counted: DataFrame, key: str) -> DataFrame | None:
    """(key, _parts) of the keys of so many rows that they are split, for spread_join; None where there is none.

    The HOT_KEYS most frequent keys of more than BLOCK_ROWS rows are looked at, and a part holds at least a HOT_KEYS-th
    of their rows; whatever key is not among them has no more rows than such a part.
    """
    counts = counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > BLOCK_ROWS)
    found = counts.orderBy(F.desc("_rows"), key).limit(HOT_KEYS).collect()
    block = max(BLOCK_ROWS, sum(r["_rows"] for r in found) // HOT_KEYS)
    split = [(r[key], -(-r["_rows"] // block)) for r in found if r["_rows"] > block]
    return counted.sparkSession.createDataFrame(split, f"{key} {counts.schema[key].dataType.simpleString()}, _parts int") if split else None


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined on key to side, which has one row a key at most; the keys of hot are dealt to several tasks.

    The rows of such a key are dealt by the hash of their column `by`, and its row of side is repeated for each part.
    Null keys match nothing; how is inner or left. Which keys are hot changes the plan, never the rows.
    """
    if hot is None:
        return rows.join(side, key, how)
    parts = F.broadcast(hot)  # HOT_KEYS rows at most
    dealt = rows.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")
    repeated = side.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (src, dst): rows (node, component), component = smallest node reached.

    Alternates large-star and small-star steps, which keep the number of edges bounded by the input and
    converge in a logarithmic number of rounds. A node's whole neighbourhood is only ever aggregated (min),
    never collected, so a hub node costs one partial aggregate per task. Nodes without edges do not appear.
    """
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    current = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(rounds):
        # large star: each node's larger neighbours point to the smallest of the node and its neighbours
        pairs = both(current)
        low = pairs.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = pairs.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        # small star: each node and its smaller neighbours point to the smallest of them
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low2 = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(low2, "src").select(F.col("dst").alias("a"), "low").where("a <> low").select(F.col("a").alias("src"), F.col("low").alias("dst")).union(low2.select("src", F.col("low").alias("dst"))).distinct()
        after = materialise(small)
        # stable when every node points straight at a root: no destination is itself a source
        moving = after.join(after.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").limit(1).count()
        doubled = after.groupBy("src").count().where("count > 1").limit(1).count()
        drop(current)
        current = after
        if not moving and not doubled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
