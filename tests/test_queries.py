"""Every query with an oracle gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from textmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_matches_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    want_rows = sorted(map(repr, duck.sql(f"select {quoted} from ({registry.ORACLES[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(names).collect()) == want_rows


def test_entry_imports():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_streaming_counts_equal_batch(spark, tmp_path):
    from textmill.streaming import windowed_counts

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    flat = lambda df: sorted((str(r["window"]), r["event_type"], r["n"]) for r in df.collect())
    assert flat(spark.table("counted")) == flat(windowed_counts(events))


def test_windows_cover_every_word_of_long_texts(spark, tmp_path):
    lengths = [0, 1, 255, 256, 257, 510, 511, 19_913, 65_281, 70_000]
    spark.createDataFrame([(k, "w " * n) for k, n in enumerate(lengths)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["consecutive_windows"](spark, str(tmp_path)).collect()
    for k, n in enumerate(lengths):
        want, start = [], 0
        while start < n:
            want.append(start)
            start += 255
        starts = sorted(r["start"] for r in rows if r["doc_id"] == k)
        assert starts == want and {i for s in starts for i in range(s, min(s + 256, n))} == set(range(n))
