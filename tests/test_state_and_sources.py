"""Streams with state against their batch form over restarts; a data source that takes filters; what Spark keeps of them."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lattiq.operators import signals
from lattiq.sources import database
from lattiq.streaming.crossings import crossings

START = datetime.datetime(2024, 1, 1)


def bar_rows(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for c in ("a", "b", "c"):
        x = 50.0
        for k in range(n):
            x += rng.gauss(0, 1)
            rows.append((c, START + datetime.timedelta(minutes=k), round(x, 3)))
    return rows


@pytest.mark.parametrize("long_only", [True, False])
def test_crossings_of_a_stream_equal_batch_after_a_restart(spark, tmp_path, long_only):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = bar_rows()
    flush = [(c, START + datetime.timedelta(days=9), 1.0) for c in ("a", "b", "c")]
    folder, out = tmp_path / "in", tmp_path / "out"
    minute = lambda r: int((r[1] - START).total_seconds() // 60)
    rng = random.Random(2)
    late = [r for r in rows if 40 <= minute(r) < 60 and rng.random() < 0.3]  # come a batch later, within what the watermark bears
    parts = [[r for r in rows if minute(r) < 60 and r not in late], late + [r for r in rows if 60 <= minute(r) < 110], [r for r in rows if minute(r) >= 110], flush]
    schema = "code string, ts timestamp, close double"

    def run():
        stream = crossings(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), 5, 12, long_only, "30 minutes")
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        if k in (1, 3):  # stops here and starts again from its checkpoint
            run()
    key = lambda r: (r.code, r.ts)
    got = sorted(spark.read.parquet(str(out)).collect(), key=key)
    want = sorted(signals.ma_cross(spark.createDataFrame(rows, schema), 5, 12, long_only).collect(), key=key)
    assert [(r.code, r.ts, r.close, r.action, r.position) for r in got] == [(r.code, r.ts, r.close, r.action, r.position) for r in want] and len(want) > 20
    assert all(abs(g.fast - w.fast) < 1e-9 and abs(g.slow - w.slow) < 1e-9 for g, w in zip(got, want, strict=True))


def test_crossings_equal_a_loop(spark):
    rows = bar_rows(3)
    got = {(r.code, r.ts): r.position for r in signals.ma_cross(spark.createDataFrame(rows, "code string, ts timestamp, close double"), 4, 9, False).collect()}
    want = {}
    for c in ("a", "b", "c"):
        x, t, pos = [r[2] for r in rows if r[0] == c], [r[1] for r in rows if r[0] == c], 0
        m = lambda k, n: sum(x[k - n + 1 : k + 1]) / n  # noqa: B023, E731
        for k in range(9, len(x)):
            up, down = m(k, 4) > m(k, 9) and m(k - 1, 4) <= m(k - 1, 9), m(k, 4) < m(k, 9) and m(k - 1, 4) >= m(k - 1, 9)
            new = 1 if up else -1 if down else pos
            if new != pos:
                want[c, t[k]] = pos = new
    assert got == want


def test_filters_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "bars.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE bars AS SELECT 'c' || (i % 7) AS code, DATE '2024-01-01' + CAST(i // 7 AS INT) AS date, CAST(i AS DOUBLE) AS close, CASE WHEN i % 11 = 0 THEN NULL ELSE i END AS volume FROM range(7000) t(i)")
        con.execute("CREATE TABLE none AS SELECT * FROM bars LIMIT 0")
    database.register(spark)
    df = spark.read.format("duckdb_table").option("path", path).option("table", "bars").option("partitions", "5").load()
    assert df.rdd.getNumPartitions() == 5 and df.count() == 7000 and dict(df.dtypes) == {"code": "string", "date": "date", "close": "double", "volume": "bigint"}
    some = df.where("code = 'c3' AND date >= DATE '2025-01-01' AND volume IS NOT NULL AND close < 6000").select("code", "close")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # the reader takes them all
    want = [float(i) for i in range(7000) if i % 7 == 3 and i // 7 >= 366 and i % 11 and i < 6000]
    assert sorted(r.close for r in some.collect()) == want
    assert df.where("code IN ('c1', 'c2') AND code LIKE 'c%' AND length(code) = 2").count() == 2000
    assert spark.read.format("duckdb_table").option("path", path).option("table", "none").load().count() == 0


def test_the_reader_sees_only_what_the_filters_leave():
    from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

    reader = database.TableReader("x", "t", ["a"], 2)
    rest = list(reader.pushFilters([EqualTo(("a",), 1), In(("b",), (1, 2)), StringStartsWith(("c",), "q"), Not(EqualTo(("a",), 3))]))
    assert [type(f) for f in rest] == [Not] and reader.where == ['"a" = ?', '"b" IN (?, ?)', 'starts_with("c", ?)'] and reader.values == [1, 1, 2, "q"]
