"""Readers, format detection, exports, services and databases."""

import hashlib
import http.server
import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftflow import queries
from weftflow.sources import exports, files, services


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id,name,id\n1,Alice,10\n2,\n3,Bob,30,x\n")
    df = files.read(spark, path)
    assert df.columns == ["id", "name"] and rows(df) == [("10", "Alice"), ("30", "Bob"), (None, None)]
    assert rows(files.read_csv(spark, path, preserve_empty=True))[0] == ("", "")
    assert files.read_csv(spark, path, header=False).columns == ["column_1", "column_2", "column_3"]
    assert len(files.read(spark, put(tmp_path, "b.tsv", "a\tb\tc\n1\t2\t3\n")).columns) == 3
    assert rows(files.read_csv(spark, put(tmp_path, "q.csv", 'a,b\n"x\ny","say ""hi"""\n'), multi_line=True)) == [("x\ny", 'say "hi"')]


def test_json(spark, tmp_path):
    assert rows(files.read(spark, put(tmp_path, "a.json", '[{"a": 1}, {"a": 2, "b": "x"}]'))) == [(1, None), (2, "x")]
    assert rows(files.read(spark, put(tmp_path, "b.json", '{"meta": 1, "items": [{"a": 1}]}'))) == [(1,)]
    assert rows(files.read(spark, put(tmp_path, "c.json", '{"a": 1}'))) == [(1,)]
    assert rows(files.read(spark, put(tmp_path, "d.json", "[1, 2]"))) == [("1",), ("2",)]
    assert rows(files.read(spark, put(tmp_path, "e.ndjson", '{"id": 1}\n\nbad\n{"id": 2, "n": "x"}\n'))) == [(1, None), (2, "x")]


@pytest.mark.parametrize(("name", "lines", "expected"), [("x.csv", [], "csv"), ("x.dat", ["a;b", "1;2"], "csv"), ("x.dat", ['{"a": 1}', '{"a": 2}'], "ndjson"), ("x.dat", ["["], "json"), ("x.JSONL", [], "ndjson"), ("x.parquet", [], "parquet"), ("x.txt", ["a"], "csv")])
def test_detection(name, lines, expected):
    assert files.detect_format(name, lines) == expected


def test_detection_fails():
    with pytest.raises(ValueError, match="isn't known"):
        files.detect_format("x.bin", ["abc"])
    assert files.detect_delimiter(["a|b|c", "1|2|3", "x,y"]) == "|" and files.detect_delimiter([]) == ","


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([("it's | <&> \"q\"", 1.5, True), (None, None, False), ("k: v", 3.0, None)], "`a b` string, n double, f boolean").coalesce(1)


@pytest.mark.parametrize(("form", "expected"), [
    ("csv", ["a b,n,f", '"it\'s | <&> ""q""",1.5,true', ",,false", "k: v,3,"]),
    ("markdown", ["| a b | n | f |", "| --- | --- | --- |", '| it\'s \\| <&> "q" | 1.5 | true |', "|  |  | false |", "| k: v | 3 |  |"]),
    ("yaml", ['-\n  a b: "it\'s | <&> \\"q\\""\n  n: 1.5\n  f: true', "-\n  a b: null\n  n: null\n  f: false", '-\n  a b: "k: v"\n  n: 3\n  f: null']),
    ("xml", ["<rows>", "  <row>\n    <a_b>it's | &lt;&amp;&gt; &quot;q&quot;</a_b>\n    <n>1.5</n>\n    <f>true</f>\n  </row>", "  <row>\n    <a_b></a_b>\n    <n></n>\n    <f>false</f>\n  </row>", "  <row>\n    <a_b>k: v</a_b>\n    <n>3</n>\n    <f></f>\n  </row>", "</rows>"]),
    ("sql", ['INSERT INTO weftflow_export ("a b", "n", "f") VALUES\n  (\'it\'\'s | <&> "q"\', 1.5, TRUE),\n  (NULL, NULL, FALSE),\n  (\'k: v\', 3, NULL);']),
])
def test_exports(odd, form, expected):
    assert [r[0] for r in exports.export_lines(odd, form).collect()] == expected


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_json_documents(spark, tmp_path, parts):
    """Each part is a document, of an empty partition too, and none is cut; read back, they are the table."""
    kind = "i long, t string"
    rows = [(i, None if i % 5 == 1 else f'a"}},\n[{i}]') for i in range(40)]
    df = spark.createDataFrame(rows, kind).repartition(parts, F.col("i") % 2 + 1)  # the partitions of two keys at most have rows
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        exports.write(df, str(tmp_path / "d"), "json", documents=True)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = [json.loads(p.read_text()) for p in (tmp_path / "d").glob("part-*")]
    assert len(found) == parts
    assert sorted(x["i"] for d in found for x in d) == list(range(40))
    assert sorted(tuple(r) for r in files.read_json(spark, str(tmp_path / "d"), kind).collect()) == rows
    exports.write(df.filter("i < 0"), str(tmp_path / "none"), "json", documents=True)
    assert files.read_json(spark, str(tmp_path / "none"), kind).collect() == []


def test_documents_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The tables of documents and customers are written in as many parts as they are read in."""
    paths, work_dir = [], queries.work_dir
    monkeypatch.setattr(queries, "work_dir", lambda spark, name: paths.append(work_dir(spark, name)) or paths[-1])
    for table, sf_columns, query in (("documents", ("doc_id", "text"), "source_json_documents"), ("customer", ("c_custkey", "c_name", "c_mktsegment"), "source_tsv_detected")):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(4).write.parquet(str(tmp_path / f"{table}.parquet"))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            plain = spark.read.parquet(str(tmp_path / f"{table}.parquet")).select(*sf_columns)
            got = queries.QUERIES[query](spark, str(tmp_path))
            assert len(list(Path(f"{paths[-1]}/{query}".removeprefix("file://")).glob("part-*"))) >= 4
            assert got.count() == plain.count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_export(odd, tmp_path):
    exports.write(odd, str(tmp_path / "out"), "json")
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(whole)[1] == {"a b": None, "n": None, "f": False} and len(json.loads(whole)) == 3
    with pytest.raises(ValueError, match="no format"):
        exports.export_lines(odd, "pdf")


def test_sql_batches(spark):
    got = [r[0] for r in exports.export_lines(spark.range(501), "sql").collect()]
    assert len(got) == 2 and got[0].count("\n") == 500 and got[1].endswith("VALUES\n  (500);")


class Answers(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        page = self.path.rpartition("page=")[2]
        ok = self.headers.get("Authorization") == "Bearer t"
        self.reply({"items": [{"page": page, "ok": ok}]})

    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.reply([1, sent["variables"]["x"]])

    def reply(self, what):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(what).encode())

    def log_message(self, *_):
        pass


def test_rest(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        paged = services.Request(url, auth={"kind": "bearer", "token": "t"}, page_param="page", pages=["1", "2"])
        assert rows(services.read_rest(spark, paged, "page string, ok boolean")) == [("1", True), ("2", True)]
        assert rows(services.read_rest(spark, services.graphql(url, "q", {"x": 7}))) == [(1,), (7,)]
    finally:
        server.shutdown()
    assert services.auth_headers({"kind": "apiKey", "key": "k"}) == {"X-Api-Key": "k"} and services.auth_headers({"kind": "basic", "user": "a", "password": "b"})["Authorization"].startswith("Basic ")
    with pytest.raises(ValueError, match="no authentication"):
        services.auth_headers({"kind": "nosuch"})


def test_database(spark):
    db = services.Database(url="jdbc:derby:memory:x;create=true")
    assert db.ping(spark, "SELECT 1 AS one FROM sysibm.sysdummy1")
    assert db.query(spark, "SELECT tablename FROM sys.systables", limit=3).count() == 3
    assert services.Database("postgres", "h", database="d").address() == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError, match="no engine"):
        services.Database("nosuch").address()


def test_csv_with_line_feeds_by_default(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'a,"b\nc"\n"x\ny",1\nz,"2\n\n3"\n')
    df = files.read(spark, path)
    assert df.columns == ["a", "b\nc"] and rows(df) == [("x\ny", "1"), ("z", "2\n\n3")]
    assert files.read_csv(spark, put(tmp_path, "p.csv", "a,b\n1,2\n3,4\n"), multi_line=False).count() == 2


def test_database_gives_all_rows(spark):
    db = services.Database(url="jdbc:derby:memory:x;create=true")
    ones = "(SELECT 1 AS one FROM sys.syscolumns FETCH FIRST 60 ROWS ONLY)"
    assert db.query(spark, f"SELECT 1 AS one FROM {ones} a, {ones} b, {ones} c").count() == 216_000


def test_rest_names_of_types(spark):
    """Fields named like types, and such as need backticks, keep their names and values."""
    assert services.column_type("OBJECT<VOIDED: BIGINT, VARIANT: VOID, `a b`: DECIMAL(3,1), `x``:`: ARRAY<OBJECT<OBJECT: BOOLEAN>>>") == "STRUCT<`VOIDED`: BIGINT,`VARIANT`: STRING,`a b`: DOUBLE,`x``:`: ARRAY<STRUCT<`OBJECT`: BOOLEAN>>>"
    rows = spark.createDataFrame([('{"id":1,"VOIDED":5,"OBJECT":"x","a b":1.5,"c:d":null,"VARIANT":{"VOID":[1]}}',)], "value string")
    from pyspark.sql import functions as F

    found = rows.select(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0]
    got = rows.select(F.from_json("value", services.column_type(found)).alias("v")).select("v.*").first().asDict(recursive=True)
    assert got == {"id": 1, "VOIDED": 5, "OBJECT": "x", "a b": 1.5, "c:d": None, "VARIANT": {"VOID": [1]}}


def test_tables_and_even_parts(spark):
    """The tables of a database, and one with a skewed key read in even parts."""
    from pyspark.sql import functions as F

    db = services.Database("derby", url="jdbc:derby:memory:parts;create=true")
    skewed = spark.range(4000).select(F.pow(F.lit(1.004), "id").cast("long").alias("K"), F.col("id").alias("V")).unionAll(spark.createDataFrame([(None, -1)], "K long, V long"))
    skewed.write.jdbc(db.url, "SKEWED", mode="overwrite")
    assert db.tables(spark) == ["SKEWED"]
    found = db.parted(spark, "SKEWED", "K", 8)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert rows(found) == rows(skewed) and len(sizes) == 8 and max(sizes) <= 2 * min(sizes)
    assert rows(db.parted(spark, "SKEWED", "K", 1)) == rows(skewed)
    names = spark.createDataFrame([(f"it's {i:03d}",) for i in range(40)], "N string")
    names.write.jdbc(db.url, "NAMES", mode="overwrite", properties={"createTableColumnTypes": "N VARCHAR(20)"})
    assert rows(db.parted(spark, "NAMES", "N", 4)) == rows(names)


def test_stream_of_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.json", '{"n": 1, "items": [{"a": 1}, {"a": 2}]}')
    stream = files.stream_json(spark, str(folder), "n long, items array<struct<a long>>")
    for more in (None, '{"items": [{"a": 3}]}', "{}"):
        if more:
            put(folder, f"{len(more)}.json", more)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1,), (2,), (3,)]


def test_preview(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(500)))
    assert rows(files.preview(spark, path, 3)) == [("0", "x\ny"), ("1", "x\ny"), ("2", "x\ny")] and files.preview(spark, path).count() == files.PREVIEW_ROWS
    assert rows(files.preview(spark, put(tmp_path, "b.json", '[{"a": 1}, {"a": 2}]'), 1)) == [(1,)]
    spark.range(5).write.parquet(str(tmp_path / "p.parquet"))
    assert files.preview(spark, str(tmp_path / "p.parquet"), 2).count() == 2


def test_quoted_csv_keeps_all_texts(spark, tmp_path):
    texts = [None, "", " ", " a", "a ", "\ta\n", "\n", "\n\na", "a\r\nb", "\r", "\ra\r", "a\r\r\n", "\r\n", "a\0b", "\0", '"', '""', '"a\n"b', "a,b\n;;;\n;;;\n;;;\n;;;", '" ', "\\", "\x1c", "﻿a", "x\n" * 3000]
    made = spark.createDataFrame([*enumerate(texts), (None, "id")], "doc_id long, text string")
    made.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = rows(queries.QUERIES["source_csv_quoted"](spark, str(tmp_path)))
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert found == sorted([*((str(i), digest(t)) for i, t in enumerate(texts)), (None, digest("id"))], key=repr)


def test_detection_passes_over_quoted_texts():
    assert files.detect_delimiter(['"a","b"', '"1","x;y;z', "x;y;z", "x;y;z", "x;y;z"]) == ","
    assert files.detect_delimiter(['5" a;b', '7" c;d', "e,f;g"]) == ";"
