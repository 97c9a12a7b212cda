"""Every query with SQL against DuckDB, and the pieces that SQL cannot express."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trailmill.functions import text
from trailmill.operators import late
from trailmill.plans.registry import ORACLE_SQL, QUERIES
from trailmill.streaming.cells import accepted_once, cell_states

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def in_order(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    at = [[x[0] for x in found.description].index(n) for n in names]
    expected = in_order(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert in_order(tuple(plain(r[n]) for n in names) for r in df.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_words(spark):
    given = {0: "zero", 21: "twenty-one", 100: "one hundred", 105: "one hundred and five", 1001: "one thousand and one", -3: "minus three"}
    df = spark.createDataFrame([(k,) for k in given], "n long")
    assert {r["n"]: r["w"] for r in df.select("n", text.number_words(F.col("n")).alias("w")).collect()} == given
    ordinals = df.filter("n > 0").select("n", text.ordinal_words(F.col("n")).alias("w")).collect()
    assert {r["n"]: r["w"] for r in ordinals} == {21: "twenty-first", 100: "one hundredth", 105: "one hundred and fifth", 1001: "one thousand and first"}


def test_render(spark):
    df = spark.createDataFrame([(3, None)], "a long, b long")
    shown = lambda t: df.select(text.render(F.lit(t), {"a": F.col("a"), "b": F.col("b")}).alias("x")).first()["x"]
    assert shown("{a} and {a:Words}, the {a:ordinal}") == "3 and Three, the third"
    assert shown("{b} is missing") is None and shown("none") == "none"


VISITS = [(1, 10, "2020-01-01 00:00:00", 5), (1, 11, "2020-09-01 00:00:00", 5), (1, 12, "2020-03-01 00:00:00", 5), (2, 13, "2020-01-01 00:00:00", 5), (1, 14, "2020-09-02 00:00:00", 5)]


def finished(query):
    query.processAllAvailable()
    query.stop()


def delivered(spark, path, rows, schema):
    """Each row a file of its own, in order."""
    for k, row in enumerate(rows):
        df = spark.createDataFrame([row], schema).coalesce(1)
        df.write.mode("append").json(path)
        for name in os.listdir(path):
            if name.startswith("part-") and not name.startswith("part-k"):
                os.rename(f"{path}/{name}", f"{path}/part-k{k}.json")
                os.utime(f"{path}/part-k{k}.json", (time.time() - 1000 + k,) * 2)


def test_stream_of_visits_equals_the_batch_of_arrivals(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "user_id long, activity_id long, started_at timestamp, cell long"
    os.makedirs(path)
    typed = "user_id long, activity_id long, started_at string, cell long"
    delivered(spark, path, VISITS, typed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    finished(cell_states(stream).writeStream.outputMode("update").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).start())
    last = spark.table("cells").groupBy("user_id", "cell").agg(F.max_by(F.struct("credits", "deferred", "visits"), "visits").alias("s")).select("user_id", "s.*")
    arrived = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(VISITS) for x in (v[1], k)]), F.col("activity_id").cast("int"))
    batch = late.arrived_state(late.arrivals(spark.createDataFrame(VISITS, typed).withColumn("started_at", F.col("started_at").cast("timestamp")), arrived))
    assert in_order(map(tuple, last.collect())) == in_order(map(tuple, batch.select("user_id", "credits", "deferred", "visits").collect()))


def test_events_are_accepted_once(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("a", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "key string, at string").write.json(path)
    stream = accepted_once(spark.readStream.schema("key string, at timestamp").json(path), "key", "at")
    finished(stream.writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "c")).start())
    assert {r["key"] for r in spark.table("accepted").collect()} == {"a", "b"} and spark.table("accepted").count() == 2


def test_speed_gate_holds_no_walk_in_memory(spark):
    from trailmill.operators.trace import gate_speed

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = [(u, k, k * 1000, 0.0, 1.0 if k % 4 == 2 else k * 1e-6) for u in range(5) for k in range(10 + u)] + [(None, 1, 0, None, 0.0), (9, 1, 0, 0.0, 0.0)]
        out = gate_speed(spark.createDataFrame(rows, "user_id long, seq int, t_ms long, lat double, lng double").repartition(4), 5.0)
        found = {r["user_id"]: (r["kept"], r["rejected"]) for r in out.collect()}
    finally:
        spark.conf.set(key, before)
    bad = {u: sum(k % 4 == 2 for k in range(10 + u)) for u in range(5)}
    assert found == {u: (10 + u - bad[u], bad[u]) for u in range(5)} | {None: (1, 0), 9: (1, 0)}
    assert "collect_list" not in out._jdf.queryExecution().toString()
