import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from panelwright import cli, report, store
from panelwright.operators import fundamentals as fu
from panelwright.sources import connectors, html_tables, prices, reference, vendor_json
from panelwright.streaming.prices import ingest

OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN\nAAA,EQ,1,2,1,1.5,1.5,1,\"1,000\",1500,02-JAN-2020,3,X\nAAA,BE,1,2,1,9.5,1.5,1,10,15,02-JAN-2020,3,X\nBBB,BZ,1,2,1,1,1,1,1,1,02-JAN-2020,3,X\nHDFC,EQ,x,2,1,2.5,1,1,1,1,02-JAN-2020,3,X\n"
NEW = "TradDt,BizDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal\n2024-07-08,2024-07-08,CCC,EQ,1,2,1,3.5,1,1,10,35\n2024-07-08,2024-07-08,DDD,BZ,1,2,1,3.5,1,1,10,35\n"


def zipped(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("files")
    (tmp_path / "cm02JAN2020bhav.csv.zip").write_bytes(zipped("cm02JAN2020bhav.csv", OLD))
    (tmp_path / "cm03JAN2020bhav.csv").write_text(OLD)
    (tmp_path / "BhavCopy_NSE_CM_0_0_0_20240708_F_0000.csv.zip").write_bytes(zipped("x.csv", NEW))
    (tmp_path / "PR060120.zip").write_bytes(zipped("pd060120.csv", OLD))
    return tmp_path


def test_both_dialects_and_zips(spark, folder):
    out = {(r.trade_date, r.symbol): r for r in prices.read_price_files(spark, str(folder)).collect()}
    days = [dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2020, 1, 6)]
    assert set(out) == {(d, s) for d in days for s in ("AAA", "HDFCBANK")} | {(dt.date(2024, 7, 8), "CCC")}
    row = out[days[0], "AAA"]
    assert row.close == 1.5 and row.tottrdqty == 1000.0 and row.series == "EQ" and out[days[0], "HDFCBANK"].open is None


def test_plain_csv_reader_agrees(spark, folder):
    got = prices.read_price_csv(spark, str(folder / "cm03JAN2020bhav.csv")).orderBy("symbol").collect()
    assert [(r.symbol, r.trade_date, r.close) for r in got] == [("AAA", dt.date(2020, 1, 3), 1.5), ("HDFCBANK", dt.date(2020, 1, 3), 2.5)]
    assert prices.detect_dialect(["symbol", "CLOSE"]) == "old" and prices.detect_dialect(["x"]) == "auto"
    with pytest.raises(ValueError):
        prices.canonicalize(spark.createDataFrame([("A",)], "symbol string"))


def test_stream_ingest_is_idempotent(spark, folder, tmp_path):
    out, mark = str(tmp_path / "lake"), str(tmp_path / "mark")
    for _ in range(2):
        ingest(spark, str(folder), out, mark).awaitTermination(120)
    first = store.read_partitioned(spark, out).count()
    assert first == 7 and store.partitions(spark, out) == ["2020", "2024"]


def test_risk_free_file(spark, tmp_path):
    (tmp_path / "rf.csv").write_text("Auction_Date,YTM\n01-Jan-2020,5.1\n2020-01-08,-\n")
    out = {r.date.day: r for r in reference.read_risk_free(spark, str(tmp_path / "rf.csv")).collect()}
    assert out[1].daily_rf == pytest.approx(0.051 / 365) and out[8].annualized_yield is None
    (tmp_path / "t.csv").write_text(reference.rate_template())
    assert reference.read_risk_free(spark, str(tmp_path / "t.csv")).count() == 3


def test_fundamentals_file_lag_and_ratio(spark, tmp_path):
    (tmp_path / "f.csv").write_text("As_Of_Date,Symbol,market_cap,book_value\n2020-11-30,AAA.NS,100,50\n2020-01-31,AAA,,50\n")
    out = {r.as_of_date.month: r for r in reference.read_fundamentals(spark, str(tmp_path / "f.csv")).collect()}
    assert out[11].available_date == dt.date(2021, 2, 28) and out[1].available_date == dt.date(2020, 4, 30)
    assert out[11].book_to_market == 0.5 and out[1].book_to_market is None
    with pytest.raises(ValueError):
        fu.reporting_lag(spark.createDataFrame([(dt.date(2020, 1, 1),)], "as_of_date date"), -1)


def test_universe_snapshots(spark, tmp_path):
    (tmp_path / "u_2020-01-31.csv").write_text("Company Name,Industry,Symbol,ISIN Code\nA Ltd,X,AAA,I1\nA Ltd,X,AAA,I1\n")
    (tmp_path / "u_2020-06-30.csv").write_text("Company Name,Industry,Symbol,ISIN Code\nB Ltd,X,BBB,I2\n")
    uni = reference.read_universe(spark, str(tmp_path))
    assert uni.count() == 2 and [r.symbol for r in fu.members_on(uni, dt.date(2020, 5, 1)).collect()] == ["AAA"]
    days = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 7, 1),)], "trade_date date")
    assert [(r.trade_date.month, r.symbol) for r in fu.membership_on_dates(uni, days).collect()] == [(7, "BBB")]


def test_market_equity_weekend_and_missing_shares(spark):
    closes = spark.createDataFrame([(dt.date(2020, 1, 31), "A", 10.0), (dt.date(2020, 1, 31), "B", 5.0)], "trade_date date, symbol string, close double")
    shares = spark.createDataFrame([(dt.date(2019, 12, 31), "A", 7.0)], "as_of_date date, symbol string, shares double")
    ask = spark.createDataFrame([(dt.date(2020, 2, 2), "A"), (dt.date(2020, 2, 2), "B"), (dt.date(2019, 1, 1), "A")], "as_of_date date, symbol string")
    out = {(r.symbol, r.as_of_date.year): r for r in fu.market_equity_asof(ask, closes, shares).collect()}
    assert out["A", 2020].market_cap == 70.0 and out["A", 2020].price_date == dt.date(2020, 1, 31)
    assert out["B", 2020].market_cap is None and out["A", 2019].close is None


def test_balance_sheet_cells(spark):
    page = "<table class='data-table'><tr><td>no</td></tr></table><section id='balance-sheet'><div><table class='x data-table'><tr><th></th><th>Mar 2020</th><th>TTM</th></tr><tr><td>Equity Capital</td><td>6,339</td><td>1</td></tr><tr><td>Reserves +</td><td>442,827<br></td><td></td></tr><tr><td>ROE</td><td>12%</td><td>-</td></tr></table></div></section>"
    df = spark.createDataFrame([("R", page), ("N", None), ("E", "<p>")], "symbol string, html string")
    sheets = html_tables.balance_sheets(df)
    assert {(r.label, r.as_of_date, r.value_crore) for r in sheets.collect()} == {("Equity Capital", dt.date(2020, 3, 31), 6339.0), ("Reserves", dt.date(2020, 3, 31), 442827.0)}
    assert html_tables.book_equity(sheets).first().book_value == 449166e7


def test_statement_quarters(spark):
    body = '[{"date":"2020-03-31","fillingDate":"2020-05-01","totalStockholdersEquity":"10"},{"date":"2020-06-30","totalEquity":"20"}]'
    cap = spark.createDataFrame([("A", 40.0)], "symbol string, market_cap double")
    out = {r.as_of_date.month: r for r in vendor_json.statement_quarters(spark.createDataFrame([("A", body), ("B", "broken")], "symbol string, body string"), cap).collect()}
    assert out[3].available_date == dt.date(2020, 5, 1) and out[3].market_cap is None
    assert out[6].book_to_market == 0.5 and out[6].available_date == dt.date(2020, 9, 30)


def test_partition_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "trade_date date, symbol string, x double")
    store.write_partitioned(make([(dt.date(2020, 1, 1), "A", 1.0), (dt.date(2021, 1, 1), "A", 2.0)]), path)
    store.write_partitioned(make([(dt.date(2021, 1, 1), "A", 3.0)]), path)
    assert sorted(r.x for r in store.read_partitioned(spark, path).collect()) == [1.0, 3.0]
    assert store.read_partitioned(spark, path, years=[2020]).count() == 1 and store.read_partitioned(spark, str(tmp_path / "none")) is None
    same = store.read_partitioned(spark, path)
    store.write_partitioned(same, path)
    assert store.read_partitioned(spark, path).count() == 2
    keyed = str(tmp_path / "k")
    for x in (1.0, 2.0):
        store.upsert(make([(dt.date(2020, 1, 1), "A", x), (dt.date(2020, 1, 1), f"B{x}", x)]), keyed, ["trade_date", "symbol"])
    assert sorted((r.symbol, r.x) for r in spark.read.parquet(keyed).collect()) == [("A", 2.0), ("B1.0", 1.0), ("B2.0", 2.0)]
    store.write_partitioned(make([(dt.date(2020, 1, 1), "A", 1.0)]), str(tmp_path / "lake/returns"))
    assert store.register_standard_views(spark, str(tmp_path / "lake")) == ["returns"]
    assert store.sql(spark, "select year, count(*) n from returns group by year").first().year == 2020


def test_connectors(tmp_path):
    day = dt.date(2024, 7, 8)
    assert connectors.candidates(day)[0] == connectors.udiff_name(day) and connectors.legacy_name(dt.date(2020, 1, 2)) == "cm02JAN2020bhav.csv.zip"
    assert connectors.report_name(dt.date(2020, 1, 6)) == "PR060120.zip"
    fetched = connectors.fetch_day(day, lambda n, d: n, str(tmp_path), lambda url: b"PK.." if url.startswith("cm") else b"<html>")
    assert fetched.name.startswith("cm") and len(connectors.weekdays(dt.date(2020, 1, 3), dt.date(2020, 1, 7))) == 3


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1.23456), ("b", float("nan")), (None, None)], "k string, v double")
    assert report.markdown_table(df).splitlines()[2:] == ["| a | 1.2346 |", "| b |  |", "|  |  |"]
    assert report.markdown_table(df.where("k = 'z'")) == "_empty_"


def test_command_line_end_to_end(spark, tmp_path):
    import numpy as np

    rng, days = np.random.default_rng(5), [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(70)]
    rows = [(d, f"S{i:02d}", "EQ", float(c), float(c), float(c), float(c), 100.0, 1000.0 + i) for i in range(25) for d, c in zip(days, 100 * np.cumprod(1 + rng.normal(0, 0.01, 70)))]
    lake, reports = str(tmp_path / "lake"), str(tmp_path / "reports")
    df = spark.createDataFrame(rows, "trade_date date, symbol string, series string, open double, high double, low double, close double, tottrdqty double, tottrdval double")
    store.write_partitioned(df, str(tmp_path / "in"))
    (tmp_path / "rf.csv").write_text("date,yield\n2019-12-31,5.0\n")
    assert cli.main(["returns", "--prices", str(tmp_path / "in"), "--risk-free", str(tmp_path / "rf.csv"), "--lake", lake]) == 0
    assert cli.main(["factors", "--lake", lake, "--amihud-window", "5", "--lookback", "12", "--skip", "2"]) == 0
    assert cli.main(["evaluate", "--lake", lake, "--reports", reports, "--tc-bps", "5"]) == 0
    assert cli.main(["tearsheet", "--lake", lake, "--reports", reports, "--min-ts-obs", "30"]) == 0
    text = (tmp_path / "reports/tearsheet.md").read_text()
    assert "Two-pass premia" in text and "beta_MKT" in text
    assert spark.read.parquet(f"{lake}/returns").where(F.col("excess_ret").isNotNull()).count() == 25 * 69


def test_statement_lines(spark):
    from panelwright.operators.overview import to_numpy
    from panelwright.sources import statements

    day = dt.date(2020, 3, 31)
    lines = spark.createDataFrame([("A", day, "Total Equity Gross Minority Interest", 9.0), ("A", day, "Common Stock Equity", 8.0), ("B", day, "Shareholders equity, net", 7.0), ("B", day, "Cash", 1.0)], "symbol string, as_of_date date, label string, value double")
    closes = spark.createDataFrame([(dt.date(2020, 3, 27), "A", 2.0)], "trade_date date, symbol string, close double")
    shares = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 10.0)], "as_of_date date, symbol string, shares double")
    out = {r.symbol: r for r in statements.quarterly_fundamentals(lines, closes, shares).collect()}
    assert out["A"].book_value == 8.0 and out["A"].book_to_market == pytest.approx(0.4) and out["A"].available_date == dt.date(2020, 6, 30)
    assert out["B"].book_value == 7.0 and out["B"].market_cap is None
    row = spark.range(1).select(statements.resolved_shares(F.lit(None).cast("double"), F.lit(0.0), F.lit(None).cast("double"), F.lit(50.0), F.lit(5.0)).alias("x"))
    assert to_numpy(row, "x").tolist() == [10.0]


def test_discovery_order(spark, tmp_path):
    for name in ("b.parquet", "a.parquet", "z.csv", "y.CSV", "x.txt"):
        (tmp_path / name).write_text("")
    assert [p.rsplit("/", 1)[1] for p in store.discover(spark, str(tmp_path), str(tmp_path / "none"))] == ["y.CSV", "z.csv", "a.parquet", "b.parquet"]
    store.write_flat(spark.range(3), str(tmp_path / "t"))
    assert store.snappy_files(spark, str(tmp_path / "t"))


def test_unknown_headers_and_members(spark, tmp_path):
    import io
    import zipfile

    from panelwright.sources import prices

    with pytest.raises(ValueError, match="neither dialect"):
        prices.parse_text("A,B\n1,2\n")
    assert prices.parse_text("symbol,close,note\nX,1,n\n") == [{"symbol": "X", "close": "1"}]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        out.writestr("big.csv", "A,B\n" + "1,2\n" * 99)
        out.writestr("pd.txt", "SYMBOL,SERIES,CLOSE\nX,EQ,1.5\n")
    assert prices.parse_file("PR010120.zip", held.getvalue()) == [{"symbol": "X", "series": "EQ", "close": "1.5"}]
    (tmp_path / "PR010120.zip").write_bytes(b"PK\x05\x06" + bytes(18))
    with pytest.raises(Exception, match="no price table"):
        prices.read_price_files(spark, str(tmp_path)).collect()


def test_upsert_recovers_the_table_of_a_lost_driver(spark, tmp_path):
    from panelwright import store

    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    store.upsert(df, path, ["k"])
    (tmp_path / "t").rename(tmp_path / "t-before")  # lost between the two renames
    store.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert not (tmp_path / "t-before").exists()


def test_long_tables_say_that_they_are_cut(spark):
    from panelwright.report import markdown_table

    assert "first 3 rows" in markdown_table(spark.range(5).toDF("x"), most=3) and "first" not in markdown_table(spark.range(3).toDF("x"), most=3)


def test_price_files_are_parsed_some_rows_at_a_time(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    head = "symbol,series,close,tottrdqty,timestamp\n"
    body = "\ufeff" + head + "".join(f"S{i},EQ,{i + 1},1,\"a\n\n{i}\"\n" for i in range(2500)) + "LAST,BE,7"
    (tmp_path / "deep").mkdir()
    (tmp_path / "cm02JAN2020bhav.csv").write_bytes(body.replace("\n", "\r\n").encode())
    (tmp_path / "deep" / "cm02JAN2020bhav.CSV").write_bytes(b"ClsPric,SctySrs,TckrSymb\n5,EQ,CAF\xe9\n\n6,EQ,S1,more\n")
    (tmp_path / "cm03JAN2020bhav.csv.zip").write_bytes(zipped("x.csv", body))
    monkeypatch.setattr(prices, "BATCH", 1000)
    files = pa.record_batch({"path": ["cm02JAN2020bhav.csv"], "content": [body.encode()]})
    assert [b.num_rows for b in prices._parsed(iter([files]))] == [1000, 1000, 501]
    parts = [pa.record_batch({"path": ["a.csv"] * 2 + ["b.csv"], "line": [head[:-1], "A,EQ,\"1", "CLOSE,SYMBOL"]}), pa.record_batch({"path": ["b.csv"], "line": ["2,B"]})]
    assert [b.select(["symbol", "close"]).to_pylist() for b in prices._parsed_lines(iter(parts))] == [[{"symbol": "A", "close": "1"}], [{"symbol": "B", "close": "2"}]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # far smaller than a file
    try:
        out = {(r.trade_date.day, r.symbol): r for r in prices.read_price_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(out) == 2 * 2501 + 1 and out[2, "CAF\ufffd"].close == 5 and out[2, "S1"].close == 6 and out[2, "LAST"].series == out[3, "LAST"].series == "BE"
    assert all(out[d, f"S{i}"].close == i + 1 for d in (2, 3) for i in range(2, 2500)) and out[3, "S7"].timestamp == "a\n\n7"
