"""Ingest (E4, E5), keyed appends (K1-K4, K7) and landed payload parsing."""

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from helpers import series
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from navframe import schemas as S
from navframe.operators import delta as D
from navframe.operators import ingest as I
from navframe.operators import returns as R
from navframe.sinks import writers as W
from navframe.sources import json_docs as J


def _write_lines(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _doc(code, items, meta=True, data=True):
    d = {}
    if meta:
        d["meta"] = {"scheme_code": code, "fund_house": f"H{code}", "scheme_name": f"S{code}"}
    if data:
        d["data"] = [{"date": a, "nav": b} for a, b in items]
    return json.dumps(d)


def _read_docs(spark, path, **kw):
    return J.explode_nav_documents(J.read_nav_documents(spark, path), **kw)


def test_dup_in_payload_first_wins(spark, tmp_dir):
    _write_lines(tmp_dir, "a.json", [_doc(1, [("02-01-2024", "10.5"), ("02-01-2024", "99.0"), ("3-1-2024", "11")])])
    rows = _read_docs(spark, tmp_dir)
    empty = spark.createDataFrame([], "scheme_code bigint, nav_date date")
    out = {r["nav_date"]: r["nav"] for r in I.new_nav_rows(rows, empty).collect()}
    assert out == {dt.date(2024, 1, 2): Decimal("10.500000"), dt.date(2024, 1, 3): Decimal("11.000000")}


def test_no_meta_and_no_data(spark, tmp_dir):
    _write_lines(
        tmp_dir,
        "a.json",
        [_doc(1, [("01-01-2024", "1")], meta=False), _doc(2, [], data=False), _doc(3, [("01-01-2024", "2")])],
    )
    rows = _read_docs(spark, tmp_dir, strict=True).collect()
    # the document without data yields no row; without meta the names are NULL,
    # and the key too, as nothing says which scheme was requested
    assert len(rows) == 2
    nometa = [r for r in rows if r["scheme_code"] is None]
    assert len(nometa) == 1 and nometa[0]["fund_house"] is None and nometa[0]["scheme_name"] is None


def test_decimal_tie_rounds_half_up(spark, tmp_dir):
    _write_lines(tmp_dir, "a.json", [_doc(1, [("01-01-2024", "1.2345675")])])
    r = _read_docs(spark, tmp_dir).collect()[0]
    assert r["nav"] == Decimal("1.234568")


def test_bad_values_strict_raises_quarantine_separates(spark, tmp_dir):
    _write_lines(
        tmp_dir,
        "a.json",
        [_doc(1, [("01-01-2024", "N.A."), ("31-02-2024", "5"), ("02-01-2024", "7.25")]), "{not json"],
    )
    with pytest.raises(PySparkException):
        _read_docs(spark, tmp_dir, strict=True).collect()
    docs = J.read_nav_documents(spark, tmp_dir)
    valid, bad = J.split_quarantine(J.explode_nav_documents(docs, strict=False))
    assert [(r["nav_date"], r["nav"]) for r in valid.collect()] == [(dt.date(2024, 1, 2), Decimal("7.250000"))]
    assert sorted(r["_date_text"] for r in bad.collect()) == ["01-01-2024", "31-02-2024"]
    assert J.corrupt_documents(docs).count() == 1


def test_scheme_list_missing_keys_and_first_listing(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "page=1")
    p2 = os.path.join(tmp_dir, "page=2")
    _write_lines(p1, "x.json", [json.dumps([{"schemeCode": 5, "schemeName": "A", "isinGrowth": "G5"}, {"schemeCode": 6}])])
    _write_lines(p2, "x.json", [json.dumps([{"schemeCode": 5, "schemeName": "A-relisted"}, {"schemeCode": 7, "schemeName": "C"}])])
    parsed = J.parse_scheme_list(J.read_scheme_pages(spark, tmp_dir))
    assert parsed.count() == 4
    stored = spark.createDataFrame([(7,)], "scheme_code bigint")
    new = {r["scheme_code"]: r.asDict() for r in I.new_schemes(parsed, stored).collect()}
    assert set(new) == {5, 6}
    assert new[5]["scheme_name"] == "A" and new[5]["isin_growth"] == "G5"
    assert new[5]["isin_div_reinvestment"] is None
    assert new[6]["scheme_name"] is None


def test_null_keys_never_enter(spark):
    df = spark.createDataFrame([(None, dt.date(2024, 1, 1), 1.0), (1, None, 2.0), (1, dt.date(2024, 1, 1), 3.0)], S.RAW_NAV.fieldNames()[:2] + ["nav"])
    stored = spark.createDataFrame([], "scheme_code bigint, nav_date date")
    assert D.new_rows(df, stored, ["scheme_code", "nav_date"]).count() == 1


def test_rerun_appends_nothing_and_late_nav(spark, tmp_dir):
    keys = ["scheme_code", "nav_date"]
    d0 = dt.date(2024, 1, 1)
    dates = [d0 + dt.timedelta(days=i) for i in range(10) if i != 3]
    nav = series(spark, [float(10 + i) for i in range(9)], dates=dates)
    as_of = dt.date(2024, 2, 1)
    path = os.path.join(tmp_dir, "daily_returns")
    assert W.append_new(spark, R.return_features(nav, as_of), path, keys) == 9
    # rerun on the same input appends 0 rows
    assert W.append_new(spark, R.return_features(nav, as_of), path, keys) == 0
    assert spark.read.parquet(path).count() == 9
    before = {r["nav_date"]: r["prev_day_nav"] for r in spark.read.parquet(path).collect()}
    # a late NAV for the missing day: one row appended, later rows unchanged
    late = nav.unionByName(series(spark, [99.0], dates=[d0 + dt.timedelta(days=3)]))
    assert W.append_new(spark, R.return_features(late, as_of), path, keys) == 1
    after = {r["nav_date"]: r["prev_day_nav"] for r in spark.read.parquet(path).collect()}
    assert len(after) == 10
    assert after[d0 + dt.timedelta(days=4)] == before[d0 + dt.timedelta(days=4)] == 12.0


def test_empty_append_is_noop(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    W.append(series(spark, [1.0]), path)
    W.append(series(spark, [1.0]).filter(F.lit(False)), path)
    assert spark.read.parquet(path).count() == 1


def test_schema_conform_and_check(spark, tmp_dir):
    nav = series(spark, [1.0, 2.0]).withColumn("fund_house", F.lit("H")).withColumn("scheme_name", F.lit("S"))
    path = os.path.join(tmp_dir, "raw_nav")
    W.append(nav, path, schema=S.RAW_NAV)
    back = spark.read.parquet(path)
    assert [f.name for f in back.schema.fields] == S.RAW_NAV.fieldNames()
    assert back.schema["nav"].dataType.simpleString() == "decimal(18,6)"
    with pytest.raises(ValueError):
        S.conform(nav.drop("fund_house"), S.RAW_NAV)
    with pytest.raises(ValueError):
        S.check(nav, S.RAW_NAV)


def test_overwrite_replaces_column_set(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m")
    W.overwrite(spark.createDataFrame([(1, 2)], "a int, b int"), path)
    W.overwrite(spark.createDataFrame([(3,)], "c int"), path)
    back = spark.read.parquet(path)
    assert back.columns == ["c"] and back.count() == 1


def test_people_fallback(spark, tmp_dir):
    msgs = J.people_messages(J.read_people(spark, os.path.join(tmp_dir, "missing"))).collect()
    assert len(msgs) == 12
    assert msgs[0]["message"] == "Oleg Kononenko is currently in space flying on the ISS! Hello! :)"
    n = J.people_in_space(J.read_people(spark, None)).collect()[0]
    assert (n["number_of_people"], n["people_listed"]) == (12, 12)


def test_weather_flatten(spark, tmp_dir):
    _write_lines(
        tmp_dir,
        "w.json",
        [json.dumps({"current_weather": {"temperature": 11.5, "windspeed": 3.0, "winddirection": 270.0, "weathercode": 2}})],
    )
    r = J.flatten_weather(J.read_weather(spark, tmp_dir)).collect()[0]
    assert (r["latitude"], r["longitude"], r["temperature"], r["weathercode"]) == (51.5074, -0.1278, 11.5, 2)


def test_codes_as_numbers_or_strings(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "pages", "page=1")
    _write_lines(p1, "x.json", ['[{"schemeCode": 5, "schemeName": "A"}, {"schemeCode": "6", "schemeName": "B"}, {"schemeCode": "x"}]'])
    rows = J.parse_scheme_list(J.read_scheme_pages(spark, os.path.join(tmp_dir, "pages"))).collect()
    got = sorted(((r["scheme_code"], r["scheme_name"]) for r in rows), key=lambda t: (t[0] is not None, t[0] or 0))
    assert got == [(None, None), (5, "A"), (6, "B")]
    docs = os.path.join(tmp_dir, "docs")
    _write_lines(docs, "a.json", ['{"meta": {"scheme_code": "7"}, "data": [{"date": "01-01-2024", "nav": 1.5}]}'])
    r = _read_docs(spark, docs).collect()[0]
    assert r["scheme_code"] == 7 and str(r["nav"]) == "1.500000"


def test_code_of_the_request_before_meta(spark, tmp_dir):
    _write_lines(os.path.join(tmp_dir, "a"), "x.json", ['{"requested": 9, "data": [{"date": "01-01-2024", "nav": "1"}]}', '{"requested": 8, "meta": {"scheme_code": 7, "scheme_name": "S"}, "data": [{"date": "01-01-2024", "nav": "2"}]}'])
    _write_lines(os.path.join(tmp_dir, "b", "scheme_code=5"), "x.json", ['{"meta": {"scheme_code": 7}, "data": [{"date": "01-01-2024", "nav": "3"}]}'])
    a = _read_docs(spark, os.path.join(tmp_dir, "a")).collect()
    assert sorted((r["scheme_code"], r["scheme_name"]) for r in a) == [(8, "S"), (9, None)]
    assert [r["scheme_code"] for r in _read_docs(spark, os.path.join(tmp_dir, "b")).collect()] == [5]


def test_first_document_of_a_file_wins(spark, tmp_dir):
    # the second document has the same day at an earlier position
    _write_lines(tmp_dir, "a.json", [_doc(1, [("05-01-2024", "1"), ("02-01-2024", "10")]), _doc(1, [("02-01-2024", "99"), ("05-01-2024", "98")])])
    empty = spark.createDataFrame([], "scheme_code bigint, nav_date date")
    got = {r["nav_date"].day: int(r["nav"]) for r in I.new_nav_rows(_read_docs(spark, tmp_dir), empty).collect()}
    assert got == {2: 10, 5: 1}


def test_malformed_input_is_never_dropped_silently(spark, tmp_dir):
    from navframe.plans import jobs

    land = os.path.join(tmp_dir, "nav")
    _write_lines(land, "a.json", [_doc(1, [("01-01-2024", "1")]), '{"meta": {"scheme_code": 2}, "data": [{"date"'])
    with pytest.raises(PySparkException, match="malformed NAV document"):
        _read_docs(spark, land, strict=True).collect()
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    with pytest.raises(PySparkException):
        jobs.run_nav_ingest(spark, land, wh, strict=True)
    assert spark.read.parquet(wh.path("nav_documents_corrupt")).count() == 1
    assert jobs.run_nav_ingest(spark, land, wh) == 1
    assert jobs.run_nav_ingest(spark, land, wh) == 0
    assert spark.read.parquet(wh.path("nav_documents_corrupt")).count() == 1  # keyed by place
    pages = os.path.join(tmp_dir, "pages")
    _write_lines(os.path.join(pages, "listing=0", "page=0"), "x.json", ['[{"schemeCode": 1}, {"schemeCode": 2}]'])
    _write_lines(os.path.join(pages, "listing=0", "page=1"), "x.json", ['[{"schemeCode": 3}, {"schemeCode": 4'])
    assert jobs.run_scheme_ingest(spark, pages, wh) == 2
    bad = spark.read.parquet(wh.path("scheme_pages_corrupt")).collect()
    assert [(r["listing"], r["page"]) for r in bad] == [(0, 1)]


def test_people_other_errors_are_raised(spark, tmp_dir):
    with pytest.raises((PySparkException, Py4JJavaError)):
        J.read_people(spark, "nosuchscheme://x/y").collect()


def test_rejected_rows_are_kept_once_when_files_are_added(spark, tmp_dir):
    from navframe.plans import jobs

    land, wh = os.path.join(tmp_dir, "nav"), jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    broken = '{"meta": {"scheme_code": 2}, "data": [{"date"'
    _write_lines(land, "b.json", [_doc(1, [("01-01-2024", "N.A."), ("02-01-2024", "1")]), broken, broken])
    stored = {}
    for added in ("none", "a.json", "c.json", "none"):
        if added != "none":  # files before and after, of other sizes, move every line's number
            _write_lines(land, added, [_doc(i, [("01-01-2024", "1")]) for i in range(5, 300)])
        jobs.run_nav_ingest(spark, land, wh)
        rows = [sorted(map(str, spark.read.parquet(wh.path(t)).collect())) for t in ("raw_nav_quarantine", "nav_documents_corrupt")]
        assert stored.setdefault("first", rows) == rows
    assert [len(r) for r in stored["first"]] == [1, 1]  # the line stands there twice and is kept once


def test_scheme_items_without_a_code_are_kept(spark, tmp_dir):
    from navframe.plans import jobs

    pages, wh = os.path.join(tmp_dir, "pages"), jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    _write_lines(os.path.join(pages, "page=1"), "x.json", ['[{"schemeCode": 1}, {"schemeCode": "ABC", "schemeName": "n"}, {"schemeName": "m"}]'])
    assert jobs.run_scheme_ingest(spark, pages, wh) == 1
    assert jobs.run_scheme_ingest(spark, pages, wh) == 0
    bad = spark.read.parquet(wh.path("schemes_quarantine")).orderBy("pos").collect()
    assert [(r["pos"], r["code_text"], json.loads(r["item"])["schemeName"]) for r in bad] == [(1, "ABC", "n"), (2, None, "m")]


def test_malformed_weather_and_people_lines_make_no_rows(spark, tmp_dir):
    from navframe.plans import jobs

    good = json.dumps({"current_weather": {"temperature": 1.5}})
    land, wh = os.path.join(tmp_dir, "weather"), jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    _write_lines(land, "w.json", [good, "", '{"current_weather": {"temper', "[]", '{"other": 1}', "7"])
    jobs.run_weather_load(spark, land, wh)
    jobs.run_weather_load(spark, land, wh)
    assert [r["temperature"] for r in spark.read.parquet(wh.path("weather")).collect()] == [1.5, 1.5]
    bad = [r[J.CORRUPT] for r in spark.read.parquet(wh.path("weather_corrupt")).collect()]
    assert sorted(bad) == sorted(['{"current_weather": {"temper', "[]", '{"other": 1}', "7"])
    people = os.path.join(tmp_dir, "people")
    _write_lines(people, "p.json", ['{"number": 1, "people": [{"craft": "c", "name": "n"}]}', '{"number": 2, "peo'])
    docs = J.read_people(spark, people)
    assert [r["name"] for r in J.people_messages(docs).collect()] == ["n"]
    assert [r[J.CORRUPT] for r in J.corrupt_documents(docs).collect()] == ['{"number": 2, "peo']
    assert J.people_in_space(docs).collect()[0]["number_of_people"] == 1
    with pytest.raises(PySparkException, match="malformed people document"):
        jobs.run_people_report(spark, people).collect()


def test_one_large_array_is_read_in_splits(spark, tmp_dir, monkeypatch):
    items = [{"schemeCode": i, "schemeName": n, "isinGrowth": f"G{i}", "more": {"a": {"b": "}"}}} for i, n in enumerate(['a}b"{', "x\\", '"}],[{', "{{", "ü}", "plain"] * 300)]
    page = os.path.join(tmp_dir, "listing=0", "page=3")
    _write_lines(page, "x.json", [json.dumps(items, indent=1)])
    _write_lines(os.path.join(tmp_dir, "listing=1", "page=0"), "x.json", [json.dumps(items[:2])])
    rows = lambda: sorted(map(str, J.parse_scheme_list(J.read_scheme_pages(spark, tmp_dir)).collect()))
    whole = rows()
    assert len(whole) == len(items) + 2
    monkeypatch.setattr(J, "MAX_PAGE_BYTES", 10_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert J.read_scheme_pages(spark, tmp_dir).rdd.getNumPartitions() > 1 and rows() == whole
        assert J.corrupt_scheme_pages(J.read_scheme_pages(spark, tmp_dir)).count() == 0
        _write_lines(page, "x.json", [json.dumps(items)[:-30]])  # broke off in the last item
        assert len(rows()) == len(items) + 1
        assert J.corrupt_scheme_pages(J.read_scheme_pages(spark, tmp_dir)).count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_landed_documents_are_packed_and_bounded(spark, tmp_dir, monkeypatch):
    from navframe.plans import landing

    monkeypatch.setattr(landing, "DOCUMENTS_A_FILE", 2)
    rows = [(c, dt.date(2000 + y, m, 31), 10.0 * c + m) for c in range(3) for y in range(2) for m in (1, 12)]
    nav = spark.createDataFrame(rows, "scheme_code bigint, nav_date date, nav double")
    path = os.path.join(tmp_dir, "landed")
    landing.land_nav_documents(nav, path, year_end_unavailable=True)
    files = [f for f in os.listdir(path) if not f.startswith((".", "_"))]
    assert files and all(f.endswith(".gz") for f in files)
    lines = spark.read.text(path).groupBy(F.input_file_name().alias("f")).agg(F.count("value").alias("n"), F.collect_list("value").alias("v")).collect()
    assert sum(r.n for r in lines) == 6 and max(r.n for r in lines) <= 2
    one = next(v for r in lines for v in r.v if v.startswith('{"requested":1,') and "2001" in v)
    assert '"data":[{"date":"31-12-2001","nav":"N.A."},{"date":"31-01-2001","nav":"11.0"}]' in one
