"""Incremental pulls from, and writing once to, a database in a file."""

import json
import sqlite3

import pytest
from pyspark.sql.types import Row, StructType

from tallyhawk.sources import database
from tallyhawk.streaming import stateful

SHAPE = "id long, who string, size double"


@pytest.fixture
def base(spark, tmp_path):
    database.register(spark)
    path = str(tmp_path / "events.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE events (id INTEGER, who TEXT, size REAL)")
        con.execute("CREATE TABLE alerts (id INTEGER, who TEXT, size REAL)")
    return path


def put(path, ids):
    with sqlite3.connect(path) as con:
        con.executemany("INSERT INTO events VALUES (?, ?, ?)", [(i, f"w{i}", i / 2) for i in ids])


def options(path, **more):
    return {"driver": "sqlite3", "database": path, "table": "events", "cursor": "id", **more}


def held(path, table="alerts"):
    with sqlite3.connect(path) as con:
        return sorted(con.execute(f"SELECT id, who, size FROM {table}").fetchall())


def test_partitions_at_quantiles(spark, base):
    put(base, [*range(300), *range(1_000_000, 1_000_100)])
    df = spark.read.format("tally_pull").schema(SHAPE).options(**options(base, partitions="4")).load()
    parts = df.rdd.glom().map(len).collect()
    assert len(parts) == 4 and max(parts) <= 102 and sum(parts) == 400
    assert sorted(map(tuple, df.collect())) == held(base, "events")
    later = spark.read.format("tally_pull").schema("who string").options(**options(base, after=json.dumps(299))).load()
    assert later.count() == 100


def test_one_value_and_no_rows(spark, base):
    read = lambda **o: spark.read.format("tally_pull").schema(SHAPE).options(**options(base, partitions="3", **o)).load().count()
    assert read() == 0
    put(base, [7] * 50)
    assert read() == 50 and read(after="7") == 0
    with pytest.raises(ValueError):
        database.Pull(options(base, cursor="id; DROP TABLE events")).reader(StructType.fromDDL(SHAPE))


def test_stream_resumes_from_its_mark(spark, base, tmp_path):
    got = []

    def run():
        stream = spark.readStream.format("tally_pull").schema(SHAPE).options(**options(base, partitions="2")).load()
        stateful.drain(stream, str(tmp_path / "cp"), lambda batch, _: got.append(sorted(r.id for r in batch.collect())))

    put(base, range(10))
    run()
    put(base, range(10, 25))
    run()
    run()
    assert [x for x in got if x] == [list(range(10)), list(range(10, 25))]


def push(df, path, batch):
    df.write.format("tally_push").mode("append").options(driver="sqlite3", database=path, table="alerts", query="q", batch=str(batch)).save()


def test_a_repeated_batch_is_written_once(spark, base):
    df = spark.range(0, 2500, 1, 3).selectExpr("id", "concat('w', id) AS who", "id / 2 AS size")
    push(df, base, 0)
    push(df, base, 0)
    assert held(base) == [(i, f"w{i}", i / 2) for i in range(2500)]
    push(df.where("id < 5"), base, 1)
    assert len(held(base)) == 2505
    with sqlite3.connect(base) as con:
        assert con.execute("SELECT count(*) FROM alerts_staged").fetchone() == (0,)


def test_a_failed_task_leaves_nothing(spark, base):
    df = spark.range(0, 100, 1, 4).selectExpr("id", "'a' AS who", "CASE WHEN id = 77 THEN raise_error('lost') ELSE 1D END AS size")
    with pytest.raises(Exception, match="lost"):
        push(df, base, 0)
    assert held(base) == []
    push(spark.range(3).selectExpr("id", "'a' AS who", "1D AS size"), base, 0)
    assert [r[0] for r in held(base)] == [0, 1, 2]


def test_only_the_attempt_that_counts_is_moved(base):
    writer = database.PushWriter(StructType.fromDDL(SHAPE), {"driver": "sqlite3", "database": base, "table": "alerts", "query": "q", "batch": "4"})
    writer.write(iter([Row(1, "lost", 0.0)]))  # an executor goes away after staging
    told = writer.write(iter([Row(1, "kept", 0.0)]))
    writer.commit([told, None])
    assert held(base) == [(1, "kept", 0.0)]


def test_stream_writes_each_batch_once(spark, base, tmp_path):
    put(base, range(40))
    stream = spark.readStream.format("tally_pull").schema(SHAPE).options(**options(base, partitions="2")).load()
    for _ in range(2):
        query = (
            stream.writeStream.format("tally_push").options(driver="sqlite3", database=base, table="alerts", query="s").option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        put(base, range(40, 50))
    assert [r[0] for r in held(base)] == list(range(50))
