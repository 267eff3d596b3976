"""Answers that tell what comes next, read in a batch and as a stream, with failures that pass and restarts."""

import http.server
import json
import threading
import urllib.error
import urllib.parse
from collections import Counter

import pytest

from weftflow.sources import services

PAGES = {"": ([1, 2], "b"), "b": ([3], "c"), "c": ([4, 5], None), "d": ([6], None)}


class Server(http.server.BaseHTTPRequestHandler):
    asked, failing, ends = Counter(), {}, {}

    def do_GET(self):
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        at, cls = query.get("after", ""), type(self)
        cls.asked[at] += 1
        if cls.failing.get(at):
            return self.answer(cls.failing[at].pop(0), {"Retry-After": "0"}, {})
        numbers, after = PAGES[at]
        after = cls.ends.get(at, after)
        link = "http://example.invalid/x" if query.get("far") else after and f"/x?after={after}"
        self.answer(200, {}, {"items": [{"n": n} for n in numbers], "paging": {"cursor": after, "link": link}})

    def answer(self, status, headers, what):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(json.dumps(what).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.asked, Server.failing, Server.ends = Counter(), {}, {}
    yield f"http://127.0.0.1:{server.server_port}/x"
    server.shutdown()


def numbers(df):
    return sorted(r["n"] for r in df.collect())


@pytest.mark.parametrize("how", [{"next_field": "paging.cursor", "cursor_param": "after"}, {"next_field": "paging.link"}])
def test_batch(spark, url, how):
    Server.failing = {"b": [429, 503]}
    assert numbers(services.read_rest(spark, services.Request(url, pause=0.01, **how), "n long")) == [1, 2, 3, 4, 5]
    assert Server.asked == {"": 1, "b": 3, "c": 1}


def test_failures_that_stay(url):
    Server.failing = {"": [429] * 9}
    with pytest.raises(urllib.error.HTTPError):
        services.fetch(services.Request(url, tries=3, pause=0.01), url)
    assert Server.asked[""] == 3
    Server.failing = {"": [404]}
    with pytest.raises(urllib.error.HTTPError):
        services.fetch(services.Request(url, pause=0.01), url)
    assert Server.asked[""] == 4  # what doesn't pass isn't tried again


def test_links_that_lead_astray(url):
    request = services.Request(url, next_field="paging.link")
    with pytest.raises(ValueError, match="another host"):
        services.following(request, url, services.fetch(request, f"{url}?far=1"))
    Server.ends = {"c": "b"}
    with pytest.raises(ValueError, match="comes again"):
        list(services.RestReader(request).read(services.Page(None)))


def test_stream_that_starts_again(spark, url, tmp_path):
    Server.failing = {"": [429]}
    request = services.Request(url, pause=0.01, next_field="paging.cursor", cursor_param="after")

    def go(until):
        out = services.stream_rest(spark, request, "n long").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            for _ in range(120):
                out.processAllAvailable()
                if (tmp_path / "out" / "_spark_metadata").exists() and numbers(spark.read.schema("n long").parquet(str(tmp_path / "out"))) == until:
                    return
                out.awaitTermination(0.5)
            raise AssertionError(numbers(spark.read.schema("n long").parquet(str(tmp_path / "out"))))
        finally:
            out.stop()

    Server.ends = {"b": ""}  # there is nothing after b yet
    go([1, 2, 3])
    first = Server.asked[""]
    Server.ends = {"c": ""}
    go([1, 2, 3, 4, 5])
    Server.ends = {"c": "d"}
    go([1, 2, 3, 4, 5, 6])
    assert Server.asked[""] == first  # the answers before aren't asked for again


def test_batches_made_again(url):
    stream = services.RestStream(services.Request(url, next_field="paging.cursor", cursor_param="after"))
    offsets, rows = [stream.initialOffset()], []
    for _ in range(3):
        found, after = stream.read(offsets[-1])
        rows.append(list(found))
        offsets.append(after)
    assert [list(stream.readBetweenOffsets(a, b)) for a, b in zip(offsets, offsets[1:], strict=False)] == rows
    assert stream.read(offsets[-1])[1] == offsets[-1]
    Server.ends = {"c": "d"}  # the last answer got a successor
    found, after = stream.read(offsets[-1])
    assert list(found) == [('{"n": 6}',)] and after["given"]
