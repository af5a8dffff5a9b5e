import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.sources import paged, tables
from marlstone.streaming.upserts import KeyedTable, stream_upsert

D = dt.date


def rows_of(start, end, page, size):
    """A service with three rows a day."""
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    rows = [{"day": d.isoformat(), "k": k} for d in days for k in range(3)]
    return rows[(page - 1) * size : page * size]


def test_ranges():
    assert paged.month_ranges(D(2023, 11, 15), D(2024, 1, 5)) == [(D(2023, 11, 15), D(2023, 11, 30)), (D(2023, 12, 1), D(2023, 12, 31)), (D(2024, 1, 1), D(2024, 1, 5))]
    assert paged.quarter_ends(D(2023, 6, 30), D(2024, 1, 1)) == [D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 31)]


def test_pages_and_halving():
    bucket = paged.TokenBucket(1e9)
    got = list(paged.read_range(rows_of, D(2024, 1, 1), D(2024, 1, 31), bucket, page_rows=10, range_rows=40))
    assert sorted((r["day"], r["k"]) for r in got) == sorted((r["day"], r["k"]) for r in rows_of(D(2024, 1, 1), D(2024, 1, 31), 1, 1000))


def test_retries_and_rate():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) == 1:
            raise paged.TooMany
        if len(calls) == 2:
            raise OSError
        return [{}]

    assert paged.with_retries(call, sleep=waits.append) == [{}] and waits == [15, 2]
    with pytest.raises(OSError):
        paged.with_retries(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)
    now, slept = [0.0], []
    bucket = paged.TokenBucket(60, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        bucket.take()
    assert slept == [1.0, 2.0]


def test_data_source(spark, tmp_path, monkeypatch):
    module = tmp_path / "fetch_stub.py"
    module.write_text("import datetime as dt\ndef fetch(a, b, page, size):\n    n = (b - a).days + 1\n    rows = [{'day': (a + dt.timedelta(days=i)).isoformat(), 'n': i} for i in range(n)]\n    return rows[(page - 1) * size:page * size]\n")
    spark.sparkContext.addPyFile(str(module))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(fetch="fetch_stub:fetch", start="2024-01-10", end="2024-03-05", page_rows="7", per_minute="1000000").schema("day string, n int").load()
    assert df.count() == 56 and df.rdd.getNumPartitions() == 3


def test_tables_from_files(spark, tmp_path):
    rows = [("2024-01-02", "1.SZ", 1.0, False), ("2024-01-09", "600000.SH", 2.0, True), ("2024-01-05", "bad", 3.0, None)]
    df = spark.createDataFrame(rows, "trade_date string, stock_code string, x double, is_backfill boolean")
    df.write.parquet(str(tmp_path / "margin_detail.parquet"))
    (tmp_path / "pool.txt").write_text("1\n\n 600000.SH \n")
    pool = tables.load_pool(spark, str(tmp_path / "pool.txt"))
    got = tables.load_panel(spark, str(tmp_path), "margin_detail", pool=pool)
    assert sorted(r.code for r in got.collect()) == ["000001", "600000"]
    late = tables.load_panel(spark, str(tmp_path), "margin_detail", start=D(2024, 1, 7), lookback_days=2)
    assert sorted(r.date.day for r in late.collect()) == [5, 9]
    assert "GreaterThanOrEqual(trade_date,2024-01-05)" in late._jdf.queryExecution().executedPlan().toString()
    both = spark.createDataFrame([("20240104",), ("20240105",), ("2024-01-04",), ("2024-01-05",), ("20240110",), ("2024-01-11",)], "trade_date string")
    kept = {r[0] for r in tables.stored_between(both, D(2024, 1, 5), D(2024, 1, 10)).collect()}
    assert {"20240105", "2024-01-05", "20240110"} <= kept  # wide enough for both forms
    assert tables.max_date(df, "trade_date").first()[0] == "2024-01-05"
    assert tables.clean_codes(df.withColumn("stock_code", F.lit("600000.SH"))).count() == 3
    assert tables.clean_codes(df).count() == 1


def test_bars_take_their_code_from_the_file(spark, tmp_path):
    for code in ("000001.SZ", "600000.SH"):
        spark.createDataFrame([("2024-01-02 09:45:00", 1.0)], "trade_time string, close double").toPandas().to_parquet(tmp_path / f"{code}.parquet")
    assert sorted(r.code for r in tables.load_bars(spark, str(tmp_path / "*.parquet")).collect()) == ["000001", "600000"]


def test_stream_upsert_is_by_key_and_repeatable(spark, tmp_path):
    src = tmp_path / "in"
    for i, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)])):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.parquet(str(src / f"p{i}"))
    out = stream_upsert(spark, str(src / "*"), ["k"], lambda df: df.groupBy("k").max("v").withColumnRenamed("max(v)", "v"))
    assert sorted(map(tuple, out.collect())) == [("a", 2), ("b", 1)]
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    with pytest.raises(ValueError):
        table.read()
    batch = spark.createDataFrame([("a", 5)], "k string, v int")
    table.merge(batch, 0)
    table.merge(batch, 0)
    table.merge(spark.createDataFrame([("a", 6), ("c", 1)], "k string, v int"), 1)
    assert sorted(map(tuple, table.read().collect())) == [("a", 6), ("c", 1)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two batches of one key, the second by a new table and a new stream, as after a failure: nothing is lost or counted twice."""

    src, count = tmp_path / "in", lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    add = lambda a, b: a.unionByName(b).groupBy("k").agg(F.sum("n").alias("n"))
    for i, rows in enumerate(([("a",), ("b",)], [("a",), ("c",)])):
        spark.createDataFrame(rows, "k string").coalesce(1).write.mode("append").parquet(str(src))
        out = stream_upsert(spark, str(src), ["k"], count, add, folder=str(tmp_path / "t"))
        assert len(KeyedTable(spark, str(tmp_path / "t" / "table"), ["k"]).versions.numbers()) == i + 1
    assert sorted(map(tuple, out.collect())) == [("a", 2), ("b", 1), ("c", 1)]
    again = KeyedTable(spark, str(tmp_path / "t" / "table"), ["k"], add)
    again.merge(count(spark.createDataFrame([("a",), ("c",)], "k string")), 1)  # a batch that is run again
    assert sorted(map(tuple, again.read().collect())) == [("a", 2), ("b", 1), ("c", 1)]


def test_versions_are_whole_or_not_there(spark, tmp_path):
    from marlstone.sources.files import Folder, Versions

    folder = Folder(spark, str(tmp_path / "f"))
    versions = Versions(folder)
    assert versions.current() is None
    for n in (1, 2, 3):
        spark.range(n).write.parquet(versions.place(n))
        versions.name(n, {"n": n})
    spark.range(9).write.parquet(versions.place(4))  # a run that failed before it named its version
    assert versions.current() == {"n": 3} and spark.read.parquet(versions.place(3)).count() == 3
    assert versions.numbers() == [2, 3] and not folder.exists("v1")


def test_requests_of_all_partitions_share_one_limit():
    from pyspark.sql.types import StructType

    of = lambda **o: paged.PagedReader(StructType(), {"fetch": "x:y", **o}).partitions()
    for o in ({"start": "2024-01-01", "end": "2024-06-30"}, {"by": "codes", "codes": "a, b,c", "start": "2024-01-01", "end": "2024-01-02"}, {"by": "quarters", "start": "2023-01-01", "end": "2023-12-31"}):
        parts = of(**o)
        assert abs(sum(p.per_minute for p in parts) - paged.PER_MINUTE) < 1e-9
    assert [p.per_minute for p in of(by="codes", codes="a,b,c,d", concurrency="2")] == [140] * 4
    assert [(p.start, p.end) for p in of(by="days", dates="2024-01-02,2024-01-04", start="2024-01-03")] == [(D(2024, 1, 4), D(2024, 1, 4))]
    assert [(p.start, p.code) for p in of(by="once")] == [(None, None)]
    with pytest.raises(ValueError):
        of(by="weeks")


def test_feather_files_base_and_increment(spark, tmp_path):
    import pandas as pd

    from marlstone.sources.feather import read_factors

    pd.DataFrame({"Date": ["20240102", "20240103"], "000001": [1.0, 2.0], "000002": [None, 4.0]}).to_feather(tmp_path / "mom_5.fea")
    pd.DataFrame({"Date": ["20240103", "20240104"], "000001": [9.0, 5.0]}).to_feather(tmp_path / "mom_5_incr.fea")
    got = {(r.factor, r.date, r.code): r.value for r in read_factors(spark, str(tmp_path / "*.fea")).collect()}
    assert got == {("mom_5", "20240102", "000001"): 1.0, ("mom_5", "20240103", "000001"): 9.0, ("mom_5", "20240103", "000002"): 4.0, ("mom_5", "20240104", "000001"): 5.0}
