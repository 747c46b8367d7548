"""The dated data source against a local server, its cache, and backfills that fail, stop and go on."""

import datetime
import json
import os
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from marlstone.functions.semantics import canonical_json, variant_field, variant_text
from marlstone.sources import dated, readers
from marlstone.sources.readers import DataError, SourceError
from marlstone.streaming import backfill
from marlstone.streaming.upsert import committed

KEY = "k-very-secret"


class Vendor(ThreadingHTTPServer):
    """Answers by date: rows in pages of two, or (status, body); counts requests."""

    def __init__(self):
        self.days, self.asked, self.keys = {}, [], set()
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_address[1]}/v2/rows"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        self.server.asked.append(q["date"])
        self.server.keys.add(self.headers.get("x-api-key"))
        got = self.server.days.get(q["date"], [])
        if isinstance(got, tuple):
            status, body = got
        else:
            at = int(q.get("pagination_key", 0))
            page = {"data": got[at : at + 2]} | ({"pagination_key": str(at + 2)} if at + 2 < len(got) else {})
            status, body = 200, json.dumps(page)
        if status == 0:  # the connection breaks off
            self.wfile.close()
            return
        data = body.encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def vendor(monkeypatch):
    monkeypatch.setenv("VENDOR_KEY", KEY)
    s = Vendor()
    yield s
    s.shutdown()
    s.server_close()


def load(spark, key_env=None, **options):
    dated.register(spark, key_env)
    return spark.read.format(dated.NAME).options(**{k: str(v) for k, v in options.items()}).load()


def rows(n, day):
    return [{"Code": f"{1000 + k}0", "Date": day, "C": str(k), "é": {"b": 1, "a": [None]}} for k in range(n)]


def test_pages_key_and_cache(spark, vendor, tmp_path):
    vendor.days = {"2024-05-01": rows(5, "2024-05-01"), "2024-05-02": [], "2024-05-03": rows(1, "2024-05-03")}
    options = {"url": vendor.url, "network": "true", "key_env": "VENDOR_KEY", "cache": tmp_path, "first": "2024-05-01", "last": "2024-05-03", "wait": 0}
    df = load(spark, **options)
    got = df.orderBy("date", "seq").collect()
    assert [(str(r["date"]), r["seq"]) for r in got] == [("2024-05-01", k) for k in range(5)] + [("2024-05-03", 0)]
    assert got[0]["row"] == '{"C":"0","Code":"10000","Date":"2024-05-01","é":{"a":[null],"b":1}}'
    assert vendor.keys == {KEY} and KEY not in df._jdf.queryExecution().toString()
    asked = len(vendor.asked)
    assert asked == 3 + 1 + 1
    # Now the cache answers, without network too; a date that has no rows is remembered as such.
    again = load(spark, **options | {"network": "false", "failures": "rows"}).orderBy("date", "seq").collect()
    assert [(r["row"], r["reason"]) for r in again] == [(r["row"], None) for r in got[:5]] + [(None, dated.EMPTY), (got[5]["row"], None)]
    assert len(vendor.asked) == asked and all(not f.startswith(".") for d in os.listdir(tmp_path) for f in os.listdir(tmp_path / d))
    bars = readers.vendor_bars(readers.vendor_rows(load(spark, **options), "row")).orderBy("date", "ticker").collect()
    assert [(r["ticker"], r["close"]) for r in bars][:2] == [("1000", 0.0), ("1001", 1.0)]


def test_date_bounds_choose_requests(spark, vendor):
    vendor.days = {f"2024-05-{d:02d}": rows(1, f"2024-05-{d:02d}") for d in range(1, 31)}
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, url=vendor.url, network="true", pushdown="true", first="2024-05-01", last="2024-05-30")
        day = lambda d: F.lit(datetime.date(2024, 5, d))
        for where, want in ((F.col("date") >= day(28), [28, 29, 30]), ((F.col("date") > day(3)) & (F.col("date") < day(6)), [4, 5]), (F.col("date").isin(datetime.date(2024, 5, 7), datetime.date(2024, 5, 9)), [7, 9]), (F.col("date") == day(2), [2]), (F.col("date") > day(30), [])):
            vendor.asked.clear()
            assert [r["date"].day for r in df.where(where).orderBy("date").collect()] == want
            assert {int(d[-2:]) for d in vendor.asked} == set(want)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_refusals_and_failures(spark, vendor, tmp_path, monkeypatch):
    one = {"dates": "2024-05-01", "url": vendor.url}
    with pytest.raises(Exception, match="the network wasn't asked for"):
        load(spark, **one).collect()
    with pytest.raises(SourceError, match="NO_SUCH_KEY isn't set"):
        load(spark, **one, network="true", key_env="NO_SUCH_KEY")
    with pytest.raises(DataError):
        dated.Settings.of({"api_key": KEY})
    vendor.days = {
        "2024-05-01": (400, f"Your subscription covers 2024-06-01 ~ 2024-12-31. {KEY}"),
        "2024-05-02": (403, "no"),
        "2024-05-03": (410, "V1 -> migration"),
        "2024-05-04": (404, "The endpoint does not exist"),
        "2024-05-05": (400, "check other plans"),
        "2024-05-06": (401, "Authorization header is malformed"),
        "2024-05-07": (500, "x" * 900),
        "2024-05-08": (0, ""),
        "2024-05-09": (200, "not json"),
    }
    r = {x["date"].day: x for x in load(spark, dates=",".join(vendor.days), url=vendor.url, network="true", key_env="VENDOR_KEY", failures="rows", attempts=2, wait=0, cache=tmp_path).collect()}
    assert [r[d]["reason"] for d in range(1, 10)] == [dated.OUTSIDE, dated.NO_PLAN, dated.HTTP, dated.HTTP, dated.HTTP, dated.HTTP, dated.HTTP, dated.NETWORK, dated.NETWORK]
    assert "2024-06-01 to 2024-12-31" in r[1]["detail"] and "has ended" in r[3]["detail"] and "no such endpoint" in r[4]["detail"] and "plan covers" in r[5]["detail"] and "own header" in r[6]["detail"] and len(r[7]["detail"]) < 400
    assert all(KEY not in x["detail"] for x in r.values()) and [r[d]["attempts"] for d in (1, 8)] == [1, 2]
    assert not any(os.scandir(tmp_path))
    with pytest.raises(Exception, match="2024-05-07: HTTP_ERROR"):
        load(spark, dates="2024-05-07", url=vendor.url, network="true").collect()
    os.makedirs(tmp_path / "date=2024-05-01")
    (tmp_path / "date=2024-05-01" / "a.json").write_text("{broken")
    with pytest.raises(Exception, match="is no JSON"):
        load(spark, **one, cache=tmp_path).collect()


def summaries(day, n, first=0):
    return [{"DiscNo": str(first + k), "Code": f"{1000 + k}0", "DiscDate": day, "DocType": "FY", "v": f"{day}/{k}"} for k in range(n)]


def test_runs_carry_failures_over_and_keep_a_log(spark, vendor, tmp_path):
    universe = spark.createDataFrame([(f"{1000 + k}",) for k in range(3)] + [("7777",)], "ticker string")
    days = [f"2024-05-{d:02d}" for d in range(1, 9)]
    vendor.days = {d: summaries(d, 4, 10 * k) for k, d in enumerate(days)} | {days[1]: (500, "down"), days[2]: [], days[5]: (403, "no")}
    vendor.days[days[3]] += summaries(days[3], 1, 30) + [{**summaries(days[0], 1, 0)[0], "v": "late"}]
    path = str(tmp_path / "store")
    options = dict(first=days[0], last=days[-1], cap=5, url=vendor.url, network="true", key_env="VENDOR_KEY", wait=0, attempts=1)
    backfill.run(spark, path, universe, **options)
    log = {str(r["date"]): r for r in backfill.read_state(spark, path).collect()}
    assert {d: r["outcome"] for d, r in log.items()} == {days[0]: "rows", days[1]: "failed", days[2]: "empty", days[3]: "rows", days[4]: "rows"}
    assert (log[days[3]]["n_rows"], log[days[3]]["added"]) == (6, 3) and str(log[days[3]]["latest"]) == days[3]
    one = backfill.summary(spark, path, universe).first()
    assert [str(d) for d in one["carried_over"]] == [days[1]] and one["rows_saved"] == 9 and (one["with_summary"], one["without_summary"]) == (3, 1)
    vendor.asked.clear()
    vendor.days[days[1]] = summaries(days[1], 4, 10)
    out = backfill.run(spark, path, universe, **options)
    # The failed date comes first; a plan that doesn't have a date is no reason to ask again.
    assert sorted(vendor.asked, key=days.index)[0] == days[1] and set(vendor.asked) == {days[1], *days[5:]}
    assert {variant: n for variant, n in out.groupBy("ticker").count().collect()} == {f"{1000 + k}": 6 for k in range(3)}
    assert "late" not in [r[0] for r in out.select(variant_text("fields", "v")).collect()]
    assert backfill.summary(spark, path, universe).first()["rows_added"] == 9
    vendor.asked.clear()
    backfill.run(spark, path, universe, **options)
    assert vendor.asked == [] and out.count() == backfill.read_rows(spark, path).count()
    assert backfill.coverage(out, universe).where("NOT has_summary").collect()[0]["ticker"] == "7777"


def test_dates_after_one_outside_the_subscription_wait(spark, vendor, tmp_path):
    universe = spark.createDataFrame([("1000",)], "ticker string")
    days = [f"2024-05-{d:02d}" for d in range(1, 5)]
    vendor.days = {d: summaries(d, 1, k) for k, d in enumerate(days)} | {days[1]: (400, "covers 2024-05-03 ~ 2024-06-01")}
    path, options = str(tmp_path / "store"), dict(first=days[0], last=days[-1], url=vendor.url, network="true", wait=0, attempts=1)
    backfill.run(spark, path, universe, **options)
    assert [(str(r["date"]), r["outcome"]) for r in backfill.read_state(spark, path).orderBy("nth").collect()] == [(days[0], "rows"), (days[1], "skipped")]
    vendor.days[days[1]] = summaries(days[1], 1, 1)
    assert backfill.run(spark, path, universe, **options).count() == 4


def test_a_killed_run_is_done_again(spark, vendor, tmp_path, monkeypatch):
    universe = spark.createDataFrame([("1000",), ("1001",)], "ticker string")
    days = [f"2024-05-{d:02d}" for d in range(1, 5)]
    vendor.days = {d: summaries(d, 2, 10 * k) for k, d in enumerate(days)}
    options = dict(first=days[0], last=days[-1], cap=2, url=vendor.url, network="true", wait=0, attempts=1)
    plain, path = str(tmp_path / "plain"), str(tmp_path / "store")
    for _ in range(2):
        backfill.run(spark, plain, universe, **options)
    backfill.run(spark, path, universe, **options)
    real = backfill._fs
    monkeypatch.setattr(backfill, "_fs", lambda *a: (_ for _ in ()).throw(SourceError("killed before the marker")))
    with pytest.raises(Exception):
        backfill.run(spark, path, universe, **options)
    monkeypatch.setattr(backfill, "_fs", real)
    assert committed(spark, path) == [0] and backfill.read_rows(spark, path).count() == 4
    vendor.days["2024-05-05"] = summaries("2024-05-05", 2, 90)
    backfill.run(spark, path, universe, **options)
    key = lambda p: sorted(backfill.read_rows(spark, p).select("ticker", F.col("disclosed").cast("string"), F.to_json("fields"), "batch").collect())
    assert key(path) == key(plain)


def test_variant_rows_and_indexes(spark):
    text = spark.createDataFrame([('[{"Code":"10000","Date":"2024-01-02","AdjC":null,"C":" ","Close":7,"my_token":"t","x":{"api":1}}]',), ('{"LocalCode":"10010","Date":"20240103","AdjC":"1,000.5"}',), (None,)], "value string")
    got = {r["ticker"]: r for r in readers.vendor_bars(readers.vendor_rows(text)).collect()}
    assert got["1000"]["close"] == 7.0 and got["1000"]["adj_close"] is None and got["1001"]["adj_close"] == 1000.5
    assert got["1000"]["source_fields_json"] == '{"C":" ","Close":7,"Code":"10000","Date":"2024-01-02","x":{"api":1}}'
    with pytest.raises(Exception, match="without date or code"):
        readers.vendor_bars(readers.vendor_rows(spark.createDataFrame([('{"Code":"1"}',)], "value string"))).collect()
    names = lambda t: sorted(r[0] for r in readers.index_names(spark.createDataFrame([(x,) for x in t], "value string")).collect())
    assert names(['["a.json", "documents/b.json", {"path": "x/c.json", "doc_id": "z"}, {"doc_id": "documents"}]']) == ["a", "b", "c", "documents"]
    assert names(['{"documents": ["a.json", {"doc_id": "d.1"}], "doc_id_list": "no"}']) == ["a", "d.1"]
    assert names(['{"doc_id": "a"}', '"b.json"', " "]) == ["a", "b"] and names(["[]"]) == []
    with pytest.raises(Exception, match="names no document"):
        names(['[{"title": "x"}]'])
    d = spark.createDataFrame([('{"b":1.50,"a":{"z":[1, {"q":2,"p":null}]},"c.d":"e"}',), ("no json",)], "t string")
    assert [r[0] for r in d.select(canonical_json("t")).collect()] == ['{"a":{"z":[1,{"p":null,"q":2}]},"b":1.5,"c.d":"e"}', None]
    one = d.where("t <> 'no json'").select(F.parse_json("t").alias("v"))
    assert one.select(variant_field("v", "a.z"), variant_field("v", "b", "double"), variant_text("v", "c.d"), variant_field("v", "b", "date")).first()[:] == ('[1,{"p":null,"q":2}]', 1.5, "e", None)
    assert "a: OBJECT<z: ARRAY<VARIANT>>" in one.select(F.schema_of_variant_agg("v")).first()[0]
