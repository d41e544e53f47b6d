"""The web connector on saved pages, the table function, and streams of hypotheses and orders."""

from __future__ import annotations

import json

import pytest

from tests.test_points import frame, series
from tidemark.functions import table
from tidemark.operators import lattice
from tidemark.plans import registry
from tidemark.sources import bars, catalog, rest
from tidemark.streaming import points


def test_klines_from_saved_pages(spark, tmp_path):
    step = 3_600
    span = rest.PAGE * step * 10
    for symbol in ("AAA", "BBB"):
        for start, n in ((0, rest.PAGE), (rest.PAGE * step, 3), (span, 5)):
            rows = [[(start + i * step) * 1000, "1.0", "2.0", "0.5", "1.5", "10", 0] for i in range(n)]
            (tmp_path / f"{symbol}-{start * 1000}.json").write_text(json.dumps(rows))
    rest.register(spark)
    reader = spark.read.format("rest_bars").options(source="web", url=f"file://{tmp_path}/{{symbol}}-{{start_ms}}.json", symbols="AAA, BBB", timeframe="1h", start=0, end=span + 5 * step - 1, wait=0)
    got = reader.load().groupBy("symbol").count().collect()
    # the last bar isn't over at `end`
    assert {r["symbol"]: r["count"] for r in got} == {"AAA": rest.PAGE + 3 + 4, "BBB": rest.PAGE + 3 + 4}


def test_chart_documents_and_patience(spark, tmp_path, monkeypatch):
    quotes = {"open": [1.0, None], "high": [2.0, 2.0], "low": [0.5, 0.5], "close": [1.5, 1.5], "volume": [None, 1]}
    (tmp_path / "X.json").write_text(json.dumps({"timestamp": [0, 86_400], "indicators": {"quote": [quotes]}}))
    rest.register(spark)
    (row,) = spark.read.format("rest_bars").options(source="web", kind="chart", url=f"file://{tmp_path}/{{symbol}}.json", symbols="X", timeframe="1d", start=0, end=10**6).load().collect()
    assert (row.ts_sec, row.close, row.volume) == (0, 1.5, 0.0)
    (tmp_path / "X-1wk-max.json").write_text(json.dumps({"timestamp": [0, 604_800], "indicators": {"quote": [{k: [1.0, 1.0] for k in quotes}]}}))
    weekly = spark.read.format("rest_bars").options(source="web", kind="chart", url=f"file://{tmp_path}/{{symbol}}-{{interval}}-{{period}}.json", symbols="X", timeframe="1w", start=0, end=10**6).load()
    assert [r.ts_sec for r in weekly.collect()] == [0]
    waits = []
    monkeypatch.setattr(rest.time, "sleep", waits.append)
    with pytest.raises(rest.urllib.error.URLError):
        rest.fetch("file:///does/not/exist", tries=3)
    assert waits == [1.0, 2.0]


def test_table_function(spark):
    bars = frame(spark, series(300, 4))
    bars.createOrReplaceTempView("some_bars")
    table.register(spark)
    got = spark.sql("SELECT * FROM turning_points(TABLE(SELECT symbol, bar_idx, high, low, close FROM some_bars) PARTITION BY symbol ORDER BY bar_idx)")
    key = ["scale", "seq", "idx", "price", "kind", "confirmed_idx", "is_anchor"]
    assert {tuple(r) for r in got.select(*key).collect()} == {tuple(r) for r in lattice.build(bars).select(*key).collect()}


def test_closed_bars(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("t", "S", t(1), 1, 10.0, 1.0), ("t", "S", t(14), 2, 12.0, 1.0), ("t", "S", t(16), 3, 9.0, 1.0), ("t", "S", t(59), 4, 8.0, 1.0)]
    schema = "source string, symbol string, ts timestamp, ingest_seq int, price double, volume double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = points.closed_bars(stream, "15m", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts_sec").collect()
    # the last bar is still open
    assert [(r.open, r.high, r.low, r.close) for r in got] == [(10.0, 12.0, 10.0, 12.0), (9.0, 9.0, 9.0, 9.0)]


def test_two_writers_lose_no_entry_of_the_manifest(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "bars")
    entry = lambda symbols, at: spark.createDataFrame([("s", x, "1d", at) for x in symbols], "source string, symbol string, timeframe string, fetched_at int")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: catalog.record(entry([f"S{k}", "both"], k), root), range(4)))
    found = catalog.recorded(spark, root)
    assert {(r.symbol, r.fetched_at) for r in found.collect()} == {("S0", 0), ("S1", 1), ("S2", 2), ("S3", 3), ("both", 3)}
    # a later column joins; earlier entries lack it
    catalog.record(entry(["S1"], 9).selectExpr("*", "'x' AS cluster"), root)
    assert {(r.symbol, r.cluster) for r in catalog.recorded(spark, root).collect()} >= {("S1", "x"), ("S0", None)}
    assert catalog.as_json(found.filter("symbol = 'both'")).first().manifest == '{"s/both/1d":{"source":"s","symbol":"both","timeframe":"1d","fetched_at":3}}'


def test_digest_of_very_large_numbers(spark):
    rows = [("t", s, "1d", i, i, x, x, x, x, v) for s, x, v in (("a", 1e30, 1e300), ("b", 1.5e30, 1e300), ("c", 1e30, None)) for i in range(2)]
    bars = spark.createDataFrame(rows, "source string, symbol string, timeframe string, bar_idx int, ts_sec bigint, open double, high double, low double, close double, volume double")
    assert len({r.hash for r in catalog.content_hash(bars).collect()}) == 3


def _stages(spark):
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [stages.apply(i) for i in range(stages.size())]


def _exchanged(spark, since=-1):
    """The last stage and the bytes that stages after `since` have written for others."""
    found = [(s.stageId(), s.shuffleWriteBytes()) for s in _stages(spark)]
    return max((i for i, _ in found), default=-1), sum(n for i, n in found if i > since)


def _items(path, n, orders):
    """lineitem of n rows in random order, a hundred bars; the fewer orders the more rows tie up to their line number."""
    import duckdb

    path.mkdir()
    h = lambda k, mod: f"(hash(i * 31 + {k}) % {mod})::BIGINT"
    duckdb.execute(
        f"""COPY (SELECT {h(1, orders)} AS l_orderkey, {h(2, 20_000)} AS l_partkey, {h(3, 1_000)} AS l_suppkey, ({h(4, 7)} + 1)::INTEGER AS l_linenumber, ({h(5, 50)} + 1)::DOUBLE AS l_quantity,
        {h(6, 10_000_000)} / 100e0 AS l_extendedprice, CASE {h(7, 2)} WHEN 0 THEN 'A' ELSE 'R' END AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1995-01-01' + to_days({h(8, 50)}::INTEGER) AS l_shipdate
        FROM range({n}) r(i)) TO '{path}/lineitem.parquet' (FORMAT parquet)"""
    )
    return str(path)


def test_bars_of_rows_that_tie(spark, tmp_path):
    import duckdb

    for n, orders in ((20_000, 10**9), (20_000, 300), (20_000, 2)):
        at = _items(tmp_path / str(orders), n, orders)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
        walk = bars.walk_d(spark, at)
        got = sorted(map(tuple, walk.collect()))
        assert len(got) == 100 and got == sorted(con.execute(f"WITH {bars.WALK_D_SQL} SELECT {', '.join(walk.columns)} FROM walk_d").fetchall())


@pytest.mark.parametrize("name", ["bars_walk_d", "correlation_clusters", "correlation_pairs_by_time"])
def test_bars_move_no_more_than_their_order_needs(spark, tmp_path, name):
    n = 300_000
    at = _items(tmp_path / "items", n, 10**7)
    since = _exchanged(spark)[0]
    assert registry.queries()[name](spark, at).collect()
    assert 5 * n < _exchanged(spark, since)[1] < 25 * n


@pytest.mark.parametrize("name", ["bars_walk_d", "correlation_clusters", "correlation_pairs_by_time"])
def test_a_task_orders_a_bounded_number_of_rows(spark, tmp_path, monkeypatch, name):
    import duckdb

    monkeypatch.setattr(bars, "TASK_ROWS", 5_000)
    n, since = 100_000, _exchanged(spark)[0]
    at = _items(tmp_path / "items", n, 10**7)
    got = registry.queries()[name](spark, at)
    rows = sorted(map(tuple, got.collect()))
    tasks = [s.numTasks() for s in _stages(spark) if s.stageId() > since and s.shuffleReadRecords() >= n]
    assert tasks and min(tasks) >= n // 5_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]}) q").fetchall())


@pytest.mark.parametrize("name", ["bars_walk_d", "correlation_clusters", "correlation_pairs_by_time"])
def test_a_few_tied_places_exchange_no_rows(spark, tmp_path, name):
    import duckdb

    n = 300_000
    at = _items(tmp_path / "items", n, 10**7)
    tied = f"SELECT 1 FROM '{at}/lineitem.parquet' GROUP BY l_returnflag, l_shipdate, l_orderkey, l_linenumber HAVING min(l_quantity) < max(l_quantity)"
    assert duckdb.execute(f"SELECT count(*) FROM ({tied})").fetchone()[0] > 0
    most, since = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _exchanged(spark)[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        assert registry.queries()[name](spark, at).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert 5 * n < _exchanged(spark, since)[1] < 25 * n


def test_many_tied_places_are_shuffled(spark, tmp_path, monkeypatch):
    import duckdb

    monkeypatch.setattr(bars, "SENT_PLACES", 10)
    at = _items(tmp_path / "items", 20_000, 300)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        walk = bars.walk_d(spark, at)
        got = sorted(map(tuple, walk.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(got) == 100 and got == sorted(con.execute(f"WITH {bars.WALK_D_SQL} SELECT {', '.join(walk.columns)} FROM walk_d").fetchall())
