"""Rows from web services and databases, through Spark's Python data source and JDBC."""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.shared import cut
from .files import ENVELOPES

TIMEOUT_S, MOST_BYTES = 30, 256 << 20
#: Answers after which a request is made again.
PASSING = (408, 425, 429, 500, 502, 503, 504)


@dataclass
class Request:
    """One request, or one for each of `pages`, values of the query parameter `page_param`; pages are read by tasks of their own.

    Where an answer tells what comes next, `next_field` is the path to it, its names parted by dots: a link, absolute or relative, or,
    with `cursor_param`, a value for that query parameter. Links to other hosts are refused, since requests carry secrets. Such
    answers follow one another in one task, which holds one of them at a time; null, an empty text or false ends them.

    A request that meets a passing failure is made up to `tries` times, after what Retry-After says, or `pause` seconds, doubled each time.
    """

    url: str
    method: str = "GET"
    headers: dict[str, str] = field(default_factory=dict)
    query: dict[str, str] = field(default_factory=dict)
    body: object = None
    auth: dict[str, str] = field(default_factory=dict)
    page_param: str = ""
    pages: list[str] = field(default_factory=list)
    timeout: float = TIMEOUT_S
    next_field: str = ""
    cursor_param: str = ""
    tries: int = 5
    pause: float = 1.0


def auth_headers(auth: dict[str, str]) -> dict[str, str]:
    """Of the kinds none, apiKey, bearer, oauth2 and basic."""
    kind = auth.get("kind", "none") or "none"
    if kind == "none":
        return {}
    if kind == "apiKey":
        return {auth.get("header") or "X-Api-Key": auth["key"]}
    if kind in ("bearer", "oauth2"):
        return {"Authorization": f"Bearer {auth['token']}"}
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{auth['user']}:{auth['password']}".encode()).decode()}
    raise ValueError(f"there is no authentication {kind!r}")


def graphql(url: str, query: str, variables: dict | None = None, **more: object) -> Request:
    return Request(url, "POST", body={"query": query, "variables": variables or {}}, **more)


def items(document: object) -> list:
    if isinstance(document, dict):
        return next((document[k] for k in ENVELOPES if isinstance(document.get(k), list)), [document])
    return document if isinstance(document, list) else [document]


def address(r: Request, query: dict[str, str]) -> str:
    return r.url + ("&" if "?" in r.url else "?") * bool(query) + urllib.parse.urlencode(query)


def fetch(r: Request, url: str) -> object:
    """The document of an answer."""
    data = None if r.body is None else json.dumps(r.body).encode()
    headers = {"Accept": "application/json"} | ({"Content-Type": "application/json"} if data else {}) | auth_headers(r.auth) | r.headers
    for left in reversed(range(max(1, r.tries))):
        told = None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=r.method), timeout=r.timeout) as answer:
                found = answer.read(MOST_BYTES + 1)
            break
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or not left:
                raise
            told = e.headers.get("Retry-After", "")
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if not left:
                raise
        time.sleep(float(told) if told and told.isdigit() else r.pause * 2 ** (r.tries - 1 - left))
    if len(found) > MOST_BYTES:
        raise ValueError(f"{url} answers with more than {MOST_BYTES} bytes")
    return json.loads(found)


def following(r: Request, url: str, document: object) -> str:
    """The address that an answer tells to come next, or an empty text."""
    told = document
    for part in r.next_field.split("."):
        told = told.get(part) if isinstance(told, dict) else None
    if not r.next_field or told in (None, "", False):
        return ""
    if r.cursor_param:
        return address(r, r.query | {r.cursor_param: str(told)})
    link = urllib.parse.urljoin(url, str(told))
    if urllib.parse.urlsplit(link)[:2] != urllib.parse.urlsplit(r.url)[:2]:
        raise ValueError(f"{url} leads to another host, {link}")
    return link


def item_rows(document: object) -> Iterator[tuple[str]]:
    for x in items(document):
        yield (json.dumps(x if isinstance(x, dict) else {"value": x}),)


class Page(InputPartition):
    def __init__(self, page: str | None) -> None:
        self.page = page


class RestReader(DataSourceReader):
    def __init__(self, request: Request) -> None:
        self.request = request

    def partitions(self) -> list[Page]:
        return [Page(p) for p in self.request.pages] or [Page(None)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        r = self.request
        url = address(r, r.query | ({r.page_param: partition.page} if partition.page is not None else {}))
        seen = set()
        while url:
            if url in seen:
                raise ValueError(f"{url} comes again after itself")
            seen.add(url)
            document = fetch(r, url)
            yield from item_rows(document)
            url = following(r, url, document)


class RestStream(SimpleDataSourceStreamReader):
    """A batch for each answer. The offset is the address of the answer that comes next, so a stream that starts again goes on there.

    After the last answer the stream asks for it again at each trigger until it tells what comes next; its items were given already.
    """

    def __init__(self, request: Request) -> None:
        self.request = request

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": address(self.request, self.request.query), "given": False}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        url, given = start["next"], start["given"]
        document = fetch(self.request, url)
        after = following(self.request, url, document)
        if given and not after:
            return iter([]), start
        if given:  # what was the last answer has got a successor
            url, document = after, fetch(self.request, after)
            after = following(self.request, url, document)
        return iter(list(item_rows(document))), {"next": after or url, "given": not after}  # Spark copies the iterator

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:  # noqa: N802
        now = start
        while now != end:
            rows, after = self.read(now)
            yield from rows
            if after == now:
                raise ValueError(f"{now['next']} doesn't lead to {end['next']} any more")
            now = after


class RestSource(DataSource):
    """`spark.read.format("rest").option("request", json)`: a JSON object for each row."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: object) -> RestReader:
        return RestReader(Request(**json.loads(self.options["request"])))

    def simpleStreamReader(self, schema: object) -> RestStream:  # noqa: N802
        return RestStream(Request(**json.loads(self.options["request"])))


#: Names in backticks, words, and signs of a type that a variant tells of itself.
TYPE_TOKENS = re.compile(r"`(?:[^`]|``)*`|\w+|\S")
#: Types of variants that columns haven't, and what stands for them.
COLUMN_TYPES = {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING", "DECIMAL": "DOUBLE"}


def column_type(variant_type: str) -> str:
    """The type of a column for what `schema_of_variant` tells; names of fields stay, whatever they are."""
    tokens, out, at = TYPE_TOKENS.findall(variant_type), [], 0
    while at < len(tokens):
        token = tokens[at]
        if tokens[at + 1 : at + 2] == [":"]:  # a field's name
            out += [token if token.startswith("`") else f"`{token}`", ": "]
            at += 2
        elif token == "DECIMAL":
            out.append(COLUMN_TYPES[token])
            at = tokens.index(")", at) + 1
        else:
            out.append(COLUMN_TYPES.get(token, token))
            at += 1
    return "".join(out)


def read_rest(spark: SparkSession, request: Request, schema: str | None = None) -> DataFrame:
    """The items of the answers. Without a schema it is taken from all of them, which are written to the shared folder first, so that no request is made twice."""
    spark.dataSource.register(RestSource)
    rows = spark.read.format("rest").option("request", json.dumps(request.__dict__)).load()
    if schema is None:
        rows = cut(rows, "rest")
        found = rows.select(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0]
        if not found or not found.startswith("OBJECT<"):
            return rows
        schema = column_type(found)
    return rows.select(F.from_json("value", schema).alias("v")).select("v.*")


def stream_rest(spark: SparkSession, request: Request, schema: str) -> DataFrame:
    """A stream of the items of answers that follow one another, one answer a batch; the driver holds that one."""
    spark.dataSource.register(RestSource)
    rows = spark.readStream.format("rest").option("request", json.dumps(request.__dict__)).load()
    return rows.select(F.from_json("value", schema).alias("v")).select("v.*")


#: How each engine's address is spelled, and the query for its tables.
ADDRESSES = {"postgres": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}", "sqlite": "jdbc:sqlite:{database}", "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}"}
PORTS = {"postgres": 5432, "mysql": 3306, "sqlserver": 1433}
TABLES = {
    "postgres": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = database()",
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'",
    "sqlserver": "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "derby": "SELECT tablename AS table_name FROM sys.systables WHERE tabletype = 'T'",
}
#: Engines that skip rows by LIMIT and OFFSET; others do so by the standard's OFFSET and FETCH.
LIMITING = ("postgres", "mysql", "sqlite")


@dataclass
class Database:
    """A database by its engine and address, or by a JDBC address alone."""

    engine: str = ""
    host: str = "localhost"
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = ""
    url: str = ""

    def address(self) -> str:
        if self.url:
            return self.url
        if self.engine not in ADDRESSES:
            raise ValueError(f"there is no engine {self.engine!r}")
        return ADDRESSES[self.engine].format(host=self.host, port=self.port or PORTS.get(self.engine, 0), database=self.database)

    def query(self, spark: SparkSession, sql: str, limit: int | None = None, **options: object) -> DataFrame:
        """A query's rows, at most `limit` if it is set. Options partitionColumn, lowerBound, upperBound and numPartitions deal a `dbtable` over tasks; Spark pushes filters and columns down."""
        reader = spark.read.format("jdbc").option("url", self.address()).options(**options)
        if self.user:
            reader = reader.option("user", self.user).option("password", self.password)
        rows = reader.option("dbtable", f"({sql}) q").load()
        rows = rows.select(*(F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes))
        return rows.limit(limit) if limit else rows

    def parted(self, spark: SparkSession, table: str, key: str, parts: int) -> DataFrame:
        """A table read by `parts` tasks of about equally many rows: the database is asked for the key's quantiles, whatever their distribution, and each task for a range.

        Null keys are in the first part. A key that repeats is in one part, so where one value has many rows there are fewer parts.
        """
        n = self.query(spark, f"SELECT COUNT({key}) AS n FROM {table}").first()[0]
        one = (lambda i: f"LIMIT 1 OFFSET {i}") if self.engine in LIMITING else (lambda i: f"OFFSET {i} ROWS FETCH NEXT 1 ROWS ONLY")
        places = sorted({n * i // parts for i in range(1, parts)} - {0})
        found = [self.query(spark, f"SELECT {key} AS bound FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} {one(i)}").first()[0] for i in places]
        bounds = [repr(b) if isinstance(b, (int, float)) else "'" + str(b).replace("'", "''") + "'" for b in dict.fromkeys(found)]
        ranges = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
        wanted = [f"{key} < {bounds[0]} OR {key} IS NULL", *ranges, f"{key} >= {bounds[-1]}"] if bounds else ["1 = 1"]
        properties = {"user": self.user, "password": self.password} if self.user else {}
        return spark.read.jdbc(self.address(), table, predicates=wanted, properties=properties)

    def tables(self, spark: SparkSession) -> list[str]:
        return sorted(r[0] for r in self.query(spark, TABLES[self.engine]).collect())

    def ping(self, spark: SparkSession, sql: str = "SELECT 1 AS one") -> bool:
        return self.query(spark, sql, limit=1).count() == 1
