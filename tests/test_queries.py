"""Every registered query of the rest over the smallest tables, against its SQL where there is any."""

import os

import duckdb
import pytest

from quillstone.plans import REGISTRY

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_names():
    assert set(REGISTRY.ORACLE_SQL) <= set(REGISTRY.QUERIES)
    with pytest.raises(ValueError):
        REGISTRY.query("count")(None)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    got = REGISTRY.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*cols).collect()), key=str)
    if name in REGISTRY.ORACLE_SQL:
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({REGISTRY.ORACLE_SQL[name]})").fetchall()
        assert rows == sorted((tuple(r) for r in want), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_streams_with_a_watermark(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillstone.streaming import limits

    src = spark.read.parquet(f"{DATA}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = limits.run_counts(stream, "user_id", str(tmp_path / "closed"), str(tmp_path / "at"), 5, 86_400, mode="append", watermark="1 hour")
    q.awaitTermination()
    batch = limits.window_counts(src, "user_id", seconds=86_400)
    closed = limits.read_counts(spark, str(tmp_path / "closed"), "user_id")
    assert closed.count() > 0 and closed.select("user_id", "window_start", "requests").exceptAll(batch).count() == 0
    assert limits.read_counts(spark, str(tmp_path / "nothing"), "user_id").count() == 0
    assert limits.limited(src, "user_id", limit=1, seconds=86_400).where(F.col("rejected") & (F.col("retry_after") <= 0)).count() == 0
