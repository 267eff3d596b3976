"""The methods themselves against plain versions: windows, prints, regions, graphs, records, ids, meetings."""

import struct
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftflow.llm import hnsw, html_main, jaccard, packing, queries, simhash, toxicity, warc
from weftflow.llm.common import free_name, table

from test_copies import brute, words_of

SF = "/root/testdata/sf0.001"


def test_toxic_documents_of_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) >= 0.70 and hit / sum(r.toxic for r in got) >= 0.60  # README tells what it varies by


def test_window_lengths():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    docs = [" ".join(rng.choice(words, 50)) for _ in range(260)]
    bad = [t.replace(" ", " Grukzorb ", 4) for t in docs[:80]]
    model = toxicity.train([*docs[80:], *bad], [0] * 180 + [1] * 80)
    assert b"grukzorb" in model.toxic and len(model.ordinary) > 1000
    w = toxicity.WindowWeights(model)

    def plain(dictionary, window):  # a compressor of its own for each window
        p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=18, hash_log=17, chain_log=17, search_log=4, write_checksum=False, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(dictionary + b"\0 " + bytes(range(1, 32)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window + bytes(range(1, 32))))

    text = f"{docs[0]} grukzorb {docs[1]} grukzorb! {docs[2]} GRUKZORB {docs[3]}"
    split = text.lower().split()
    windows = toxicity.windows(text)
    assert windows == [f" {' '.join(split[i : i + 4])} ".encode() for i in range(0, len(split) - 1, 3)]
    cells = w.cells(windows)
    for i, x in enumerate(windows):
        a, b = plain(model.ordinary, x), plain(model.ordinary + model.toxic, x)
        assert tuple(cells[:, i]) == (min(a // 4, 15), min(max(a - b, 0), 23))
    assert toxicity.score_text(text, w) > 0.5 > toxicity.score_text(docs[1], w)


def plain_print(text):
    """The bits of both halves that more than half of the terms set."""
    w = text.split()
    n, votes = len(w), np.zeros((2, 64), int)
    for i in range(n):
        term = [x.encode() for x in w[i : i + 3]]
        for k, parts in enumerate((term, [*term[::-1], struct.pack("<i", 1)])):
            h = 42
            for x in parts:
                h = xxhash.xxh64_intdigest(x, seed=h)
            votes[k] += [h >> b & 1 for b in range(64)]
    return tuple(sum(1 << b for b in range(64) if 2 * v[b] > n) for v in votes)


def test_fingerprint_bits(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").limit(60).collect()} | {-1: "", -2: "one", -3: "one two", -4: "a b c d é 😀"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.high & (1 << 64) - 1, r.low & (1 << 64) - 1) for r in simhash.fingerprints(df, ["doc_id"]).collect()}
    assert got == {i: plain_print(t) for i, t in texts.items()}


def test_neighbours_of_frequent_ids(spark):
    rows = [(7, f"t {i % 40}") for i in range(400)] + [(None, None)] * 300 + [(None, f"n{i}") for i in range(100)] + [(i, f"x {i}") for i in range(20, 60)] + [(3, "a"), (3, "b"), (3, "a"), (1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 50):
        got = simhash.edited_neighbours(df, ranges=5, hot_rows=hot).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)
        assert Counter(r.text for r in got) == Counter(r.next_text for r in got)
    prints = simhash.edited_fingerprints(df, ranges=5, hot_rows=50)
    assert prints.count() == len(rows) and prints.filter("next is null or own is null or edited is null").count() == 0


def test_regions_and_depth():
    rng = np.random.default_rng(1)
    tags = ["p", "div", "ul", "li", "b", "section"]
    for _ in range(60):
        page = "".join(rng.choice([f"<{t}>", f"</{t}>", "one two ", "three", "<br>"]) for t in rng.choice(tags, 14))
        found = html_main.tokens(page, html_main.Weights())
        scores = html_main.scores_of(found, html_main.Weights())
        most = max([0.0, *(scores[i:j].sum() for i in range(len(found)) for j in range(i + 1, len(found) + 1))])
        i, j = html_main.best_region(scores)
        assert abs(scores[i:j].sum() - most) < 1e-9
        want = " ".join(x.text for x in found[i:j] if x.kind == "word").split()
        assert "".join(html_main.extract(page, html_main.Weights()).split()) == "".join(want)
    began = time.time()
    assert html_main.extract("<div>" * 100_000 + "a b c" + "</div>" * 100_000, html_main.Weights()) == "a b c"
    assert time.time() - began < 10  # 1.1 MB; quadratic time would be hours
    body = "<p>one two three four</p>"
    for names in ("page with-sidebar", "post has-share", "layout no-comments"):
        assert html_main.extract(f"<div class='{names}'><article>{body}</article></div>", html_main.Weights()) == "one two three four"


def test_learned_names():
    pages = [f"<nav><ul><li><a>m{i}</a></li></ul></nav><div class='zzq'>buy this and that now</div><article><div class='inner'><p>text number {i} of the article</p></div></article>" for i in range(30)]
    w = html_main.learn(pages)
    assert w.names[".zzq"] < -2 < w.names[".inner"] and {"nav", "ul", "li", "a", "div", "p"} <= w.tags.keys() and w.tags["a"] < w.tags["p"]
    assert html_main.extract("<p>a b c d e</p><div class=zzq>f g h</div><p>i j</p>", w) == "a b c d e\ni j"


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_recall_of_a_shard(spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3100, 48))
    x *= np.exp(rng.normal(size=(len(x), 1)) * spread) / np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1e160  # a long one doesn't drown the others
    shard = hnsw.Shard(hnsw.shard_of(np.arange(3000), x[:3000], 0))
    hits = sum(len({i for i, _ in shard.nearest(-1, q, 20)} & set(np.argsort(-(x[:3000] @ q), kind="stable")[:20].tolist())) for q in x[3000:])
    assert hits >= 0.95 * 20 * 100


def test_records_have_own_ids_and_urls_stay(spark):
    urls = ["http://a/x%20y", "http://a/x y", " http://b ", "ü%zz%", "", "http://c/?q=1&r=[2]#f", None]
    for url in urls:
        assert warc.parse(warc.record(1, url, b"x", None))["url"] == url
    rows = [(1, "u", "a"), (1, "v", "a"), (2, "w", "a"), (2, "w", "a"), (None, None, "b"), (None, None, "b"), (1, "u", "c")]
    planned = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    heads = [warc.headers(warc.record(r.page_id, r.url, r.html.encode(), r.first_id, r.serial), "r")[1] for r in planned]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(rows) and all(h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(categories=["Cc", "Cf", "Zs", "Zl", "Zp", "Mn", "Lu", "Lt", "Ll", "Nd", "Po", "Sm"]), st.sampled_from([" ", ".", ",", "Σ", "İ", "a", "'", "s"])), max_size=40), st.sampled_from(["", "<|endoftext|>", "<|STARTOFTEXT|>"]))
def test_packed_ids_of_any_text(text, added):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(test_packed_ids_of_any_text, "library") else test_packed_ids_of_any_text.library
    test_packed_ids_of_any_text.library = library
    text = text[:20] + added + text[20:]
    words = packing.WordIds(library)
    found = words.words(text)
    if isinstance(found, list):
        words.learn(set(found))
    assert words.encode(found, 2).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_packed_words_are_encoded_once_and_past_the_rules(monkeypatch):
    """The tokenizer's rules aren't run on plain words, with marks or without, and words that come back are still known when many others came between."""
    library, given_to = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, text, **kw):
            given_to.append(text)
            return library.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            given_to.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    def encoded(text):
        given_to.clear()
        assert words.encode_texts([text], 2)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
        return sorted(given_to)

    words = packing.WordIds(Counted())
    assert encoded("Größe mañana, (привет) ελλάδα!! ça. Word word. don't x2") == ["!!", "(привет)", ",", ".", "don't", "x2"]
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    for i in range(4):
        assert "x2" not in encoded(f"word x2 {i} a{i}")
    rng = np.random.default_rng(0)
    letters, marks = [chr(c) for c in range(0x530) if chr(c).isalpha()], [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    for _ in range(300):
        encoded(" ".join("".join(rng.choice(letters, rng.integers(1, 9))) + "".join(rng.choice(marks, rng.integers(0, 4))) for _ in range(8)))


def test_meetings():
    rng = np.random.default_rng(0)
    met, pairs = jaccard.Meetings(), set()
    for node in range(50):
        keys = rng.integers(0, 60, 5).astype(np.uint64)
        met.add(keys, node)
        pairs |= {(int(k), node) for k in keys}
    least = {}
    for k, node in pairs:
        least[k] = min(node, least.get(k, node))
    got = list(met.take())
    assert {(int(k), int(n)) for kind, a, b in got if kind == jaccard.MET for k, n in zip(a, b, strict=True)} == set(least.items())
    assert {(int(k), int(n)) for kind, a, b in got if kind == jaccard.TIED for k, n in zip(a, b, strict=True)} == {(node, least[k]) for k, node in pairs if node != least[k]}
    assert not met.held and list(met.take()) == []


def test_join_of_texts_with_a_common_passage(spark, monkeypatch):
    """A large cluster that only a passage ties is parted, and its true links stay."""
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    rng = np.random.default_rng(6)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(0, 80, 2):
        own = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        near = own.copy()
        near[3] = "other"
        rows += [(i, " ".join(passage + own)), (i + 1, " ".join(passage + (near if i % 3 == 0 else [f"v{x}" for x in rng.integers(0, 5000, 40)])))]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    want = brute(rows, 4, 85)
    assert got == want and 1 < len(set(want.values())) < len(want) and words_of(rows[0][1])


def test_join_frees_meetings_and_parts_large_clusters(spark, monkeypatch):
    """Where the first sample misses what ties a large cluster, it is parted before its sets are written; ranges of keys are tied one by one and deleted."""
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    monkeypatch.setattr(jaccard, "FEW_MEETINGS", 0, raising=False)
    first, seen = jaccard.common_shingles, []
    monkeypatch.setattr(jaccard, "common_shingles", lambda docs, size, *n: seen.append(n) or (first(docs, size, *n) if n else np.zeros(0, np.uint64)))
    merge, left = jaccard.merge_tiles, []
    monkeypatch.setattr(jaccard, "merge_tiles", lambda held, *a: left.append(held.count()) or merge(held, *a))
    by_kind, paths = jaccard.by_kind, []
    monkeypatch.setattr(jaccard, "by_kind", lambda *a: paths.append((made := by_kind(*a)).cut_path) or made)
    rng = np.random.default_rng(7)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(0, 80, 2):
        own = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        near = own.copy()
        near[3] = "other"
        rows += [(i, " ".join(passage + own)), (i + 1, " ".join(passage + (near if i % 3 == 0 else [f"v{x}" for x in rng.integers(0, 5000, 40)])))]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85) and len(seen) > 1
    kept = spark.read.parquet(paths[0])
    assert sum(left) < 60  # all 80 are in one cluster at first
    assert len(paths) > 1 and kept.filter("kind = 0").count() == len(rows) and kept.filter("kind < -1").count() == 0


def test_columns_of_the_pipeline_survive(spark):
    docs = table(spark, SF, "documents").limit(40).withColumn("_score", F.lit("s")).withColumn("_place", F.lit("p")).withColumn("_key", F.col("doc_id")).withColumn("_group", F.lit(1))
    twice = docs.unionAll(docs.limit(3))
    for stage, given_ in ((corpus_pipeline.keep_good, docs), (corpus_pipeline.drop_toxic, docs), (corpus_pipeline.drop_near_copies, docs), (corpus_pipeline.drop_near_copies, twice)):
        out = stage(spark, given_, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r["_score"] == "s" and r["_place"] == "p" and r["_key"] == r["doc_id"] and r["_group"] == 1 for r in got)
    assert free_name(docs, "_score") == "__score"
