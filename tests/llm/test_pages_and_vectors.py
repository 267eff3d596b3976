"""Archives, page texts and nearest neighbours against plain versions."""

import base64
import hashlib
import io

import numpy as np
import pytest
from oracle import spark_rows, sql_rows

from weftflow.llm import hnsw, html_main, queries, warc
from weftflow.llm.common import table, work_dir

SF = "/root/testdata/sf0.001"
PAGES = [(3, "http://a/ü b", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (5, "u", ""), (None, "n", "<p>same</p>"), (3, "http://a/ü b", "<p>same</p>"), (9, "big", "<p>" + "xé" * 300_000)]


def test_warc_sql(spark):
    assert spark_rows(queries.op5_warc(spark, SF)) == sql_rows(queries.ORACLE_SQL["op5_warc"], SF)


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    folder = work_dir(spark, "archives")
    rows = warc.read_archives(warc.write_archives(warc.plan_records(df), folder), folder, payloads=True).collect()
    assert sorted((r.page_id or 0, r.url or "", r.record_type, r.refers_to or 0) for r in rows) == [(0, "n", "revisit", 1), (1, "", "response", 0), (2, "u", "response", 0), (3, "http://a/ü b", "revisit", 1), (3, "http://a/ü b", "revisit", 1), (5, "u", "revisit", 2), (9, "big", "response", 0)]
    for r in rows:
        want = next((p[2] or "").encode() for p in PAGES if p[0] == r.page_id and p[1] == r.url)
        assert r.payload_bytes == len(want) and r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode() and r.payload == (b"" if r.record_type == "revisit" else want)
    empty = warc.write_archives(warc.plan_records(df.limit(0)), folder)
    assert empty.count() == 0 and warc.read_archives(empty, folder).count() == 0
    few = warc.plan_records(df, min_bytes=100)
    assert few.filter("first_id is not null").count() == 0


class Kept(io.BytesIO):
    def close(self):
        pass


def test_warc_validation():
    stream = Kept()
    writer = warc.ArchiveWriter(stream)
    for i in range(100):
        writer.add(warc.record(i, "u", f"<p>page {i} {'text ' * 300}</p>".encode(), None))
    writer.close()
    data = stream.getvalue()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [warc.parse(x)["page_id"] for x in warc.frames(io.BytesIO(data), 100)] == list(range(100))
    good = warc.record(1, "u", b"payload", None)
    for bad in (good.replace(b"payload", b"payl0ad"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    for cut in (data[:-3], data[:50], data + b"\0\0"):
        with pytest.raises(Exception):  # noqa: B017
            list(map(warc.parse, warc.frames(io.BytesIO(cut))))


def test_best_region():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(-4, 4, rng.integers(0, 12)).astype(float)
        a, b = html_main.best_region(x)
        most = max([0.0, *(x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert x[a:b].sum() == most


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First   para with <b>bold</b>word &#233;&nbsp;x &lt;b&gt;.</p><!-- hidden --><p>Second<br>line</p><aside>Related</aside><form><input value="q">Search</form><ul><li>one<li>two</ul></article>
<section id="comments"><p>Nice post, says a reader with a long comment of many words</p></section><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "c"), (3, "v", "", "c"), (4, "w", "<p>un<closed", "c"), (1, "u", PAGE, "clash")], "page_id long, url string, html string, text string")
    weights = html_main.fit(table(spark, SF, "pages"))
    got = html_main.main_text(df, weights).collect()
    want = "Head & line\nFirst para with boldword é x <b>.\nSecond line\none\ntwo"
    assert [r.text for r in got if r.page_id == 1] == [want] * 2 and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_main.main_text(df.limit(0), html_main.fit(df.limit(0))).count() == 0
    rows = queries.op9_main_text(spark, SF).collect()
    assert len(rows) == table(spark, SF, "pages").count() and all(r.n_chars == len(r.text) for r in rows) and sum(bool(r.text) for r in rows) > 0.8 * len(rows)


def test_stray_quotes_in_tags():
    plain = lambda page: html_main.extract(page, html_main.Weights()).split()
    assert plain('<p><a href="x" title="5" wide">two</a> three</p><p>four five six</p><p class="q">seven</p>') == "two three four five six seven".split()
    assert plain("<p data-x=it's>one two three</p><p>don't four</p>") == "one two three don't four".split()
    assert plain("<p a=b'c>one</p><p '>two</p><p =\">three</p><p x = >four</p><p y=/?q=\"z>five</p>") == "one two three four five".split()
    assert plain("<p a='>' b = \"x > y\" c=d>one</p><p a=\"it's\"b='\">'>two</p>") == ["one", "two"]


def test_parts_by_whole_names():
    plain = lambda page: html_main.extract(page, html_main.Weights())
    for names in ("class='layout has-sidebar'", "class=no-comments", "id='with-banner'", 'class="elementor-widget elementor-widget-text-editor"', "title='see class=ad'"):
        assert plain(f"<div {names}><h1>a b</h1><p>c d e</p></div>") == "a b\nc d e"
    for names in ("class='box ad'", "id=comments", "class='cookie-notice'", "role=navigation", "CLASS=Social_Share"):
        assert plain(f"<div {names}><p>a b</p></div><p>c d e</p>") == "c d e"
    for outer in ("div class=sidebar", "form", "aside id=menu"):
        for inner in ("article", "main"):
            assert plain(f"<nav>x</nav><{outer}><div class=banner><{inner}><p>a b</p><div class=ad>c</div></{inner}></div></{outer.split()[0]}>") == "a b"
    assert plain("<main><div class=banner><article>a b c<div class=comments><article>d e</article></div></article></div><div id=comments><article>f g</article></div></main>") == "a b c"


def brute(rows, queries_, k):
    m = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in queries_:
        s = m @ np.array(v, np.float64)
        out[q] = sorted(((-x, i) for x, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q))[:k]
    return out


def test_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = queries.op4_neighbours(spark, sf).collect()
    found = {q: [] for q in want}
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((-r.score, r.vec_id))
        assert r.score == pytest.approx(float((vectors[r.query_id] * vectors[r.vec_id]).sum()), abs=1e-12)
    assert all(len(f) == 20 and f == sorted(f) for f in found.values())
    recall = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want) / (20 * len(want))
    assert recall >= 0.97


def test_neighbours_with_copies_and_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 8)).round(3)
    rows = [(i, base[i % 150 if i < 300 else 7].tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = hnsw.neighbours(df, asked, k=20, shard_rows=200).collect()
    hits = 0
    for q in want:
        mine = [(round(-r.score, 9), r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        hits += len({i for _, i in mine} & {i for _, i in want[q]})
        assert len(mine) == 20 and mine == sorted(mine)
    assert hits >= 0.97 * 20 * len(want)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [-1.0, 0.5]), (8, [-1.0, 0.5]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.neighbours(df, df, k=5).collect())
    assert got == [(0, 1, 1, 2.5), (0, 2, 8, 0.0), (1, 1, 0, 2.5), (1, 2, 8, 0.0), (8, 1, 0, 0.0), (8, 2, 1, 0.0)]
    assert hnsw.neighbours(df.limit(0), df).count() == 0 and hnsw.neighbours(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0
