"""Readers and writers of training-data files.

All but the pinned reader go through Spark's readers and writers, so a path may be in any store that Spark reads.
Nothing that exists is overwritten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_first(spark: SparkSession, path: str, key: str, rows: int | None = None) -> DataFrame:
    """A table, or its first rows in the order of its key (an ordered limit: each task keeps that many)."""
    df = spark.read.parquet(path)
    return df if rows is None else df.orderBy(key).limit(rows)


def read_prefix(df: DataFrame, key: str, text_col: str, budget: int, block: int = 4096) -> DataFrame:
    """Whole rows in the order of a whole-number key until their texts reach a budget of characters; the row that crosses stays.

    Sums of blocks of keys come first, so that only rows of the blocks before the budget are ordered, block by block.
    Null texts count as empty.
    """
    sized = df.withColumn("_n", F.coalesce(F.length(text_col), F.lit(0))).withColumn("_block", F.expr(f"{key} div {block}"))
    from pyspark.sql import Window

    blocks = sized.groupBy("_block").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).where(F.col("_before") < budget).drop("_sum")
    placed = sized.join(blocks, "_block").withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_block").orderBy(key)))
    return placed.where(F.col("_upto") - F.col("_n") < budget).drop("_n", "_block", "_before", "_upto")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, broken ones become null rows."""
    return spark.read.schema(schema).json(path)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested JSON document (over several lines) as one row; maps are exploded with explode_map."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def explode_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row for each entry of a map column."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(key, value))


def read_records(spark: SparkSession, pattern: str, schema: str, order: tuple[str, ...]) -> DataFrame:
    """All record files that match a pattern, tagged with their file, in total order."""
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.orderBy(*order)


def read_pinned(spark: SparkSession, path: str, sha256_prefix: str) -> str:
    """The text of a small held-out file; fails where its digest does not start as pinned."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    found = hashlib.sha256(rows[0]["content"]).hexdigest()
    if not found.startswith(sha256_prefix):
        raise ValueError(f"{path} has digest {found[:16]}, not {sha256_prefix}")
    return bytes(rows[0]["content"]).decode("utf-8")


def json_parsed(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, with `parsed`; one row with the number of rows and of failures). Null text is a failure."""
    tried = df.withColumn("parsed", F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    good = F.col("parsed").isNotNull() & F.col("parsed._broken").isNull()
    return tried.where(good), tried.agg(F.count("*").alias("rows"), F.sum((~F.coalesce(good, F.lit(False))).cast("int")).alias("failed"))


def write_shards(df: DataFrame, path: str, by: tuple[str, ...] = ("lane", "split")) -> None:
    """Immutable Parquet shards: refuses a path that exists."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def pack_tokens(df: DataFrame, ids_col: str, bytes_col: str = "tokens") -> DataFrame:
    """df with an array of ids as little-endian unsigned 32-bit integers in a binary column."""
    return _converted(df, ids_col, bytes_col, "binary", lambda x: None if x is None else _u32(x))


def unpack_tokens(df: DataFrame, bytes_col: str = "tokens", ids_col: str = "ids") -> DataFrame:
    """df with the ids of a binary column of little-endian unsigned 32-bit integers."""
    return _converted(df, bytes_col, ids_col, "array<bigint>", lambda x: None if x is None else _from_u32(x))


def _u32(ids) -> bytes:
    import numpy as np

    return np.asarray(ids, "<u4").tobytes()


def _from_u32(data) -> list[int]:
    import numpy as np

    return np.frombuffer(data, "<u4").tolist()


def _converted(df: DataFrame, source: str, target: str, kind: str, one) -> DataFrame:
    names = [c for c in df.columns if c not in (source, target)]
    arrow = pa.binary() if kind == "binary" else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([one(x) for x in batch.column(source).to_pylist()], arrow)], names=[*names, target])

    fields = ", ".join([*[f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names], f"`{target}` {kind}"])
    return df.select(*names, source).mapInArrow(run, fields)


def write_vocab(df: DataFrame, path: str) -> None:
    """id<TAB>token lines ordered by id."""
    df.select("id", "token").orderBy("id").write.mode("errorifexists").option("sep", "\t").csv(path)


def write_jsonl(df: DataFrame, path: str, order: str, sample: int = 12) -> None:
    """All rows as JSON lines, and the first ones in order as a sample beside them (<path>_sample)."""
    df.write.mode("errorifexists").json(path)
    df.orderBy(order).limit(sample).coalesce(1).write.mode("errorifexists").json(f"{path}_sample")


def canonical_json(value) -> str:
    """JSON with sorted keys, without blanks, in UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_json(spark: SparkSession, value, path: str) -> str:
    """A small report as readable JSON; returns the digest of its canonical form, which formatting does not change."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def report(stages: DataFrame, title: str) -> str:
    """Stage statistics (a bounded table) as a Markdown table."""
    rows = stages.collect()
    names = stages.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows)]) + "\n"


class RunLog:
    """Checks of a run: (key, passed, detail) rows; the exit status tells whether all passed."""

    def __init__(self):
        self.rows: list[tuple[str, bool, str]] = []

    def check(self, key: str, passed: bool, detail: str = "") -> bool:
        self.rows.append((key, bool(passed), detail))
        return bool(passed)

    def checks(self, df: DataFrame) -> None:
        """Take over a bounded table with key and passed."""
        for r in df.select("key", "passed").collect():
            self.check(r["key"], r["passed"])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "key string, passed boolean, detail string")

    @property
    def exit_status(self) -> int:
        return int(not all(passed for _, passed, _ in self.rows))


def in_sync(generated: DataFrame, committed: DataFrame) -> bool:
    """Whether a regenerated table has exactly the committed rows."""
    names = committed.columns
    return sorted(names) == sorted(generated.columns) and generated.select(*names).exceptAll(committed).isEmpty() and committed.exceptAll(generated.select(*names)).isEmpty()
