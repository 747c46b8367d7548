"""A dated source of JSON rows as a Spark data source, in batches and as a stream.

Each date is a request, answered in pages, or a folder of the cache. The cache
comes first, and the network only where it is asked for. Executors fetch; the
driver knows dates alone. As a stream the offsets are lists of dates, worked
out from a committed table of what became of earlier ones.
"""

from __future__ import annotations

import datetime
import json
import os
import posixpath
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .readers import DataError, SourceError

NAME = "dated_rest"
SCHEMA = "date date, nth int, seq int, row string, reason string, detail string, attempts int"
#: What may become of a date besides rows.
EMPTY, NOT_CACHED = "EMPTY", "NOT_CACHED"
OUTSIDE, NO_PLAN, HTTP, NETWORK = "OUT_OF_SUBSCRIPTION_DATE_RANGE", "PLAN_NOT_AVAILABLE", "HTTP_ERROR", "NETWORK_OR_DNS_RETRY_EXHAUSTED"
#: Failures that no later run mends.
FINAL = (OUTSIDE, NO_PLAN)
WINDOW = re.compile(r"(\d{4}-\d{2}-\d{2})\s*~\s*(\d{4}-\d{2}-\d{2})")


@dataclass
class Settings:
    """Options of the source, typed."""

    url: str = ""
    cache: str = ""
    closed: bool = False
    network: bool = False
    header: str = "x-api-key"
    rows_key: str = "data"
    page_key: str = "pagination_key"
    attempts: int = 3
    wait: float = 30.0
    timeout: float = 90.0
    failures: str = "raise"
    dates_per_task: int = 1
    pushdown: bool = False
    dates: str = ""
    first: str = ""
    last: str = ""
    state: str = ""
    cap: int = 20
    #: The secret itself: it is in no option, and so in no plan.
    key: str = field(default="", repr=False)

    @classmethod
    def of(cls, options: dict[str, str], key: str = "") -> Settings:
        known = {f.lower(): f for f in cls.__dataclass_fields__ if f != "key"}
        got = {}
        for k, v in options.items():
            name = known.get(k.lower())
            if name is None:
                raise DataError(f"{k} is no option of {NAME}" + ("; register the source with the key's environment variable" if "key" in k.lower() else ""))
            kind = cls.__dataclass_fields__[name].type
            got[name] = v.strip().lower() == "true" if kind == "bool" else {"int": int, "float": float}.get(kind, str)(v)
        s = cls(**got, key=key)
        if s.failures not in ("raise", "rows"):
            raise DataError("failures must be raise or rows")
        return s

    def days(self) -> list[datetime.date]:
        """The dates asked for: a list, in its order, or a range."""
        day = datetime.date.fromisoformat
        if self.dates:
            return list(dict.fromkeys(day(d.strip()) for d in self.dates.split(",")))
        if not self.first:
            raise DataError("dates, or first and last, must be given")
        first = day(self.first)
        last = day(self.last) if self.last else datetime.date.today()
        return [first + datetime.timedelta(days=k) for k in range((last - first).days + 1)]


@dataclass
class Answer:
    """Rows of a date, or why there are none."""

    rows: list[dict] | None
    reason: str | None = None
    detail: str | None = None
    attempts: int = 0


def told(code: int, body: str) -> tuple[str, str]:
    """Reason and explanation of an HTTP failure; nothing of the request is in it."""
    low = body.lower()
    window = WINDOW.search(body)
    if code == 400 and window:
        return OUTSIDE, f"the subscription covers {window[1]} to {window[2]}"
    reason = NO_PLAN if code == 403 else HTTP
    if code == 410 or "移行" in body or "migration" in low:
        why = "this version of the service has ended; use the current one's paths"
    elif "endpoint does not exist" in low:
        why = "no such endpoint: check version and path"
    elif "subscription covers" in low or "check other plans" in low:
        why = "the date is outside what the plan covers"
    elif "authorization" in low and ("malformed" in low or "bearer" in low):
        why = "the key belongs in its own header, not in Authorization"
    elif code in (401, 403):
        why = "the key is missing, wrong, or may not read this"
    else:
        why = "the request failed"
    return reason, f"HTTP {code}: {why}"


def fetched(s: Settings, date: datetime.date) -> Answer:
    """All pages of a date. An answer with an error counts as it is; where none comes, there are further attempts."""
    for attempt in range(1, s.attempts + 1):
        rows: list[dict] = []
        page: str | None = None
        try:
            while True:
                query = {"date": date.isoformat()} | ({s.page_key: page} if page else {})
                request = urllib.request.Request(f"{s.url}?{urllib.parse.urlencode(query)}", headers={s.header: s.key} if s.key else {})
                with urllib.request.urlopen(request, timeout=s.timeout) as answer:
                    got = json.load(answer)
                if not isinstance(got, dict):
                    return Answer(None, HTTP, "the answer is no object", attempt)
                rows += got[s.rows_key] if isinstance(got.get(s.rows_key), list) else next((v for v in got.values() if isinstance(v, list)), [])
                page = got.get(s.page_key)
                if not page:
                    return Answer(rows, None, None, attempt)
        except urllib.error.HTTPError as err:
            try:
                body = err.read().decode("utf-8", "replace")
            except OSError:
                body = ""
            reason, why = told(err.code, body)
            said = body[:300].replace(s.key, "[removed]") if s.key else body[:300]
            return Answer(None, reason, f"{why}. {said}".strip(), attempt)
        except (OSError, ValueError) as err:  # no connection, or one that broke off
            if attempt == s.attempts:
                return Answer(None, NETWORK, type(err).__name__, attempt)
            time.sleep(s.wait * attempt)
    raise AssertionError("unreachable")


def _fs(place: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else os.path.abspath(place))


def _files(place: str) -> list[tuple]:
    """(file system, path) of a folder's files, in order; none if there is no such folder."""
    from pyarrow import fs

    store, path = _fs(place)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [(store, f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))]


def _parsed(store, path: str) -> list[dict]:
    """Rows of a file: a list, or an object a line."""
    with store.open_input_stream(path) as f:
        text = f.read().decode("utf-8")
    try:
        rows = json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
    except ValueError:
        raise SourceError(f"the cache's file {posixpath.basename(path)} is no JSON") from None
    if not all(isinstance(r, dict) for r in rows):
        raise SourceError(f"the cache's file {posixpath.basename(path)} holds other things than rows")
    return rows


def _folder(s: Settings, date: datetime.date) -> str:
    return f"{s.cache.rstrip('/')}/date={date}"


def answered(s: Settings, date: datetime.date) -> Answer:
    """From the cache if the date is there, else, where that is allowed, from the network; what came goes to the cache."""
    files = _files(_folder(s, date)) if s.cache else []
    if files:
        return Answer([r for store, path in files for r in _parsed(store, path)])
    if s.cache and s.closed:
        return Answer([])
    if not s.network:
        return Answer(None, NOT_CACHED, "the date isn't cached, and the network wasn't asked for")
    got = fetched(s, date)
    if got.rows is not None and s.cache:
        store, path = _fs(_folder(s, date))
        store.create_dir(path, recursive=True)
        own = f"{path}/.{uuid.uuid4().hex}"  # readers see whole files alone
        with store.open_output_stream(own) as f:
            f.write(json.dumps(got.rows, ensure_ascii=False).encode())
        store.move(own, f"{path}/rows.json")
    return got


class Days(InputPartition):
    """Dates of a task, each with its place among all that were asked for."""

    def __init__(self, days: list[tuple[int, datetime.date]]):
        super().__init__(None)
        self.days = days


def tasks(days: list[datetime.date], size: int) -> list[Days]:
    numbered = list(enumerate(days))
    return [Days(numbered[k : k + size]) for k in range(0, len(numbered), max(1, size))]


def rows_of(s: Settings, part: Days) -> Iterator[tuple]:
    for nth, date in part.days:
        got = answered(s, date)
        if got.rows is None and s.failures == "raise":
            raise SourceError(f"{date}: {got.reason}: {got.detail}")
        for seq, row in enumerate(got.rows or ()):
            yield date, nth, seq, json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None, None, got.attempts
        if not got.rows and s.failures == "rows":
            yield date, nth, None, None, got.reason or EMPTY, got.detail, got.attempts


class DatedReader(DataSourceReader):
    def __init__(self, s: Settings):
        self.s = s
        self.days = s.days()

    def partitions(self) -> list[Days]:
        # A source must have a partition, even for no dates.
        return tasks(self.days, self.s.dates_per_task) or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple]:
        return rows_of(self.s, partition)


class PushedReader(DatedReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the date choose requests; what else is asked is left to Spark."""
        for f in filters:
            test = _TESTS.get(type(f)) if getattr(f, "attribute", None) == ("date",) else None
            if test is None:
                yield f
            else:
                self.days = [d for d in self.days if test(d, f.value)]


_TESTS = {
    EqualTo: lambda d, v: d == v,
    In: lambda d, v: d in v,
    GreaterThan: lambda d, v: d > v,
    GreaterThanOrEqual: lambda d, v: d >= v,
    LessThan: lambda d, v: d < v,
    LessThanOrEqual: lambda d, v: d <= v,
}


def outcomes(state: str) -> list[dict]:
    """Rows of the committed batches of a state table, in order: a date's outcome in each run; some dozen bytes a date."""
    marks = _files(f"{state.rstrip('/')}/committed")
    out = []
    for k in sorted(int(posixpath.basename(p)) for _, p in marks):
        out += [r | {"batch": k} for store, path in _files(f"{state.rstrip('/')}/state/batch={k}") for r in _parsed(store, path)]
    return out


def due(rows: list[dict], first: datetime.date, today: datetime.date, cap: int) -> list[datetime.date]:
    """Dates of the next run, ``cap`` at most: those that failed last time they were tried, unless for good, then the days after the last success."""
    from .ingest import carry_over

    day = datetime.date.fromisoformat
    latest: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["batch"], r["nth"])):
        latest[r["date"]] = r
    failed = [day(d) for d, r in latest.items() if r["outcome"] == "failed" and r["reason"] not in FINAL]
    good = [day(r["date"]) for r in rows if r["outcome"] in ("rows", "empty")]
    known = [day(r["latest"]) for r in rows if r.get("latest")]
    return carry_over(failed, max(good, default=None), max([*known, first - datetime.timedelta(days=1)]), today, cap)


class DatedStream(DataSourceStreamReader):
    """Offsets are {"dates": [..], "after": number of dates tried before}: a batch that runs again asks for the same dates."""

    def __init__(self, s: Settings):
        if not s.state or not s.first:
            raise DataError("a stream needs state and first")
        self.s = s

    def initialOffset(self) -> dict:
        return {"dates": [], "after": -1}

    def latestOffset(self) -> dict:
        done = outcomes(self.s.state)
        today = datetime.date.fromisoformat(self.s.last) if self.s.last else datetime.date.today()
        dates = due(done, datetime.date.fromisoformat(self.s.first), today, self.s.cap)
        return {"dates": [str(d) for d in dates], "after": len(done) if dates else -1}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        return tasks([datetime.date.fromisoformat(d) for d in end["dates"]], self.s.dates_per_task)

    def read(self, partition: Days) -> Iterator[tuple]:
        return rows_of(self.s, partition)

    def commit(self, end: dict) -> None:
        return None


class DatedSource(DataSource):
    """``spark.read.format("dated_rest")``, after ``register(spark)``.

    Options: dates (a list) or first and last; url, network (false), header
    (in which the key goes); cache (a folder
    with a folder ``date=..`` for each date, of files that are lists or have
    an object a line); closed (false), if the cache is all there is, so that
    dates that it lacks have no rows; attempts, wait, timeout; failures: ``raise``, or
    ``rows`` for a row with reason and detail for each date without rows; and
    dates_per_task; and pushdown, which lets conditions on the date choose
    requests, in sessions that have that switched on. For a stream also state (the store's folder) and cap.
    """

    key = ""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DatedReader:
        s = Settings.of(dict(self.options), self.key)
        return PushedReader(s) if s.pushdown else DatedReader(s)

    def streamReader(self, schema) -> DatedStream:
        return DatedStream(Settings.of(dict(self.options), self.key))


def register(spark: SparkSession, key_env: str | None = None) -> None:
    """Make the source known. ``key_env`` is the environment variable of this process that holds the key for the network."""
    source = DatedSource
    if key_env is not None:
        if not os.environ.get(key_env):
            raise SourceError(f"{key_env} isn't set")
        source = type("KeyedSource", (DatedSource,), {"key": os.environ[key_env]})
    spark.dataSource.register(source)
