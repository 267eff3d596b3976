"""Tokens, packing, fingerprints and classifiers against plain versions."""

import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from weftflow.llm import bpe, packing, quality, queries, simhash, toxicity, wordpiece
from weftflow.llm.common import table

SF, SMALL = "/root/testdata/sf0.001", "doc_id long, text string, score string, word string"
ODD = [(1, "the cat", "x", "y"), (1, "the cat", "x", "y"), (2, None, None, None), (None, "", "x", None), (None, None, None, None), (3, "  \n\t ", "", ""), (4, "word " * 30_000 + "É😀İΣ end.", "x", "y"), (5, "a b​c don't 12345 <|endoftext|>", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SMALL)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, texts, odd):
    enc = tik()
    want = {i: enc.encode_ordinary(t or "") for i, t in texts.items()}
    got = {r.doc_id: r for r in queries.op7_bpe(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, ids in want.items():
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert sorted((r.decoded or b"").decode() for r in bpe.decode(bpe.encode(odd)).collect()) == sorted((x[1] or "") for x in ODD)
    assert bpe.encode(odd.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 \n'tsé😀. ", max_size=60), st.integers(1, 9))
def test_bpe_pieces(text, size):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert bpe.encode_text(enc, text, size).tolist() == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc\0", min_size=1, max_size=4).filter(lambda s: "\0" not in s[:-1] and s != "\0"), max_size=12), st.text("abc", max_size=12))
def test_automaton(entries, word):
    assert wordpiece.Automaton(entries).count(word) == wordpiece.greedy(word, entries)


def test_token_counts(spark, texts, odd):
    entries = wordpiece.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    machine = wordpiece.automaton(public_tokenizers.path("word_bpe_49k.json"))
    words = {w for t in texts.values() for w in wordpiece.WORDS.findall((t or "").lower())}
    assert all(machine.count(w) == wordpiece.greedy(w, entries) for w in list(words)[:3000])
    got = {r.doc_id: r for r in queries.op3_token_counts(spark, SF).collect()}
    for i in list(texts)[:40]:
        each = [wordpiece.greedy(w, entries) for chunk in (texts[i] or "").split() for w in wordpiece.WORDS.findall(chunk.lower())]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len((texts[i] or "").split()), sum(each) + each.count(0), each.count(0))
    assert wordpiece.token_counts(odd).count() == len(ODD) and wordpiece.token_counts(odd.limit(0)).count() == 0


def test_token_counts_of_any_bytes(spark):
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        entries = set(json.load(f)["model"]["vocab"])
    as_written = ByteLevel(add_prefix_space=False, use_regex=False)

    def pieces(word):
        *rest, last = "".join(x for x, _ in as_written.pre_tokenize_str(word))
        rest, n = [*rest, last + "</w>"], 0
        while rest:
            rest = rest[next(k for k in range(len(rest), 0, -1) if "".join(rest[:k]) in entries) :]
            n += 1
        return n

    words = ["größe", "straße", "weiß", "mañana", "ça", "ê", "человек", "данные", "한국어", "漢字", "😀", "\x1c", "thre", "cat"]
    machine = wordpiece.automaton(public_tokenizers.path("word_bpe_49k.json"))
    assert len(wordpiece.vocabulary(public_tokenizers.path("word_bpe_49k.json"))) == len(entries) == 49_406
    assert [machine.count(w) for w in words] == [pieces(w) for w in words]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a\x1cb\x1f c\u00a0d")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in wordpiece.token_counts(df).collect()}
    assert got == {1: (len(words), sum(map(pieces, words)), 0), 2: (3, sum(map(pieces, ["a", "\x1c", "b", "\x1f", "c", "d"])), 0)}


def pieces_are_whole(rows, texts):
    """Each document's ids lie in its pieces once, sequences have no gaps, and only powers of two are short."""
    own, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    enc = tokenizer()
    assert own.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for group in seq.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    return sum(4096 - n if (n := sum(r.length for r in g)) & (n - 1) else 0 for g in seq.values())


def test_packing(spark, texts):
    rows = queries.op10_packing(spark, SF).collect()
    padding = pieces_are_whole(rows, texts)
    assert padding <= 0.02 * sum(r.length for r in rows)


def test_packing_oddities(spark, odd):
    rows = packing.pack(odd).collect()
    assert sorted({r.doc_id or 0 for r in rows}) == [0, 1, 2, 3, 4, 5] and packing.pack(odd.limit(0)).count() == 0
    ids = tokenizer().encode(ODD[6][1], add_special_tokens=False).ids
    assert sum(r.length for r in rows if r.doc_id == 4) == len(ids) + 1
    assert {r.doc_tokens for r in rows if r.doc_id == 5} == {len(tokenizer().encode(ODD[7][1], add_special_tokens=False).ids) + 1}


def test_packing_of_control_characters_and_added_tokens(spark, tmp_path):
    controls = [chr(c) for c in [*range(32), *range(127, 160)]]
    texts = ["a\x1cb", "a\x1f.\x1d b", "".join(f"cat{c}dog. {c} x,{c}" for c in controls), *(f"a{c}b c.{c}" for c in controls), "one<|endoftext|>two <|startoftext|>", "<|ENDOFTEXT|> Σ\x1eΣ", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for rows in (queries.op10_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        got = defaultdict(list)
        for x in sorted(rows.collect(), key=lambda x: x.start):
            got[x.doc_id].append(x)
        assert got.keys() == want.keys()
        for i, ids in want.items():
            assert all(x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) for x in got[i]), texts[i]
            assert sum(x.length for x in got[i]) == len(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30))
def test_pack_group(lengths):
    got, size = list(packing.pack_group(lengths, 16)), 16
    done, seq = Counter(), Counter()
    for doc, _, n, s, at in got:
        done[doc] += n
        assert at == seq[s]
        seq[s] += n
    assert all(done[i] == n for i, n in enumerate(lengths)) and all(n <= size for n in seq.values())
    # first-fit decreasing puts each item into the first bin that has room
    bins: list[int] = []
    for n in sorted((x % size for x in lengths if x % size), reverse=True):
        at = next((i for i, used in enumerate(bins) if used + n <= size), len(bins))
        bins[at : at + 1] = [(bins[at] if at < len(bins) else 0) + n]
    short = [x % size for x in lengths if x % size]
    assert sorted(sum(short[i] for i in b) for b in packing.first_fit_decreasing(short, size)) == sorted(bins)


def plain_print(text):
    w = [x for x in (text or "").split() if x]
    return [tuple(w[i : i + 3]) for i in range(len(w))]


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in queries.op8_fingerprints(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(order)
    by_text = defaultdict(set)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert rows[i].n_chars == len(own) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[own].add(rows[i].fingerprint)
        by_text[edited].add(rows[i].edited_fingerprint)
        a, b = (int(x, 16) for x in (rows[i].fingerprint, rows[order[(k + 1) % len(order)]].fingerprint))
        assert abs(rows[i].near_next - (1 - (a ^ b).bit_count() / 128)) < 1e-12
        assert abs(rows[i].near_edited - (1 - (a ^ int(rows[i].edited_fingerprint, 16)).bit_count() / 128)) < 1e-12
    assert all(len(x) == 1 for x in by_text.values())
    far = [r.near_next for i, r in rows.items() if rows[i].n_chars > 300]
    assert 0.4 < sum(far) / len(far) < 0.75


def test_fingerprint_oddities(spark, odd):
    got = simhash.fingerprints(odd.withColumn("row", F.monotonically_increasing_id()), ["row"]).collect()
    assert len(got) == len(ODD) and sum(r.high == 0 and r.low == 0 for r in got) == 4
    near = simhash.edited_neighbours(odd, ranges=4).collect()
    assert len(near) == len(ODD)
    want = sorted(ODD, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    pairs = {((a[0], a[1] or ""), b[1] or "") for a, b in zip(want, [*want[1:], want[0]], strict=True)}
    assert {((r.doc_id, r.text), r.next_text) for r in near} == pairs
    assert simhash.edited_neighbours(odd.limit(0)).count() == 0


def test_within_radius(spark):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(16)) for _ in range(20)]
    prints = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for bit in rng.choice(128, rng.integers(1, 6), replace=False):
                y ^= 1 << int(bit)
            prints.add(y)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    split = lambda v: (signed(v >> 64), signed(v & (1 << 64) - 1))
    got = simhash.within_radius(spark.createDataFrame([split(p) for p in [*prints, *base]], "high long, low long"), 3).collect()
    want = {tuple(sorted((split(a), split(b)))): (a ^ b).bit_count() for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert len(got) == len(want) > 20 and {((r.high, r.low), (r.other_high, r.other_low)): r.distance for r in got} == want


@pytest.mark.parametrize(("query", "label", "least"), [("op1_quality", "quality", 0.97), ("op6_toxicity", "toxic", 0.90)])
def test_classifiers_on_the_held_out_fold(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[query](spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    assert len(got) > 900 and sum(r.predicted == r.y for r in got) >= least * len(got) and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_oddities(spark, odd, module):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(odd, labels)
    got = module.score(odd, model)
    assert got.columns == ["doc_id", "text", "word", "score"] and got.count() == len(ODD) and got.filter("score is null or not score between 0 and 1").count() == 0
    assert got.filter("doc_id = 1").select("score").distinct().count() == 1
    assert module.score(odd, module.fit(odd, labels.limit(0))).filter("score <> 0.5").count() == 0
    assert module.score(odd.limit(0), model).count() == 0


def test_quality_features_do_not_depend_on_pieces(monkeypatch):
    text = "one two two three été 😀 " * 50
    s = quality.Settings()
    whole = Counter(np.concatenate(list(quality.features(text, s))).tolist())
    monkeypatch.setattr(quality, "PIECE_WORDS", 7)
    assert Counter(np.concatenate(list(quality.features(text, s))).tolist()) == whole


def test_toxic_words_among_others():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(400)]
    plain = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    bad = [t.replace(" ", " zorkgrub ", 3) for t in plain[:60]]
    model = toxicity.train([x for p in zip(plain[60:], [*bad, *plain[60:240]], strict=True) for x in p], [y for i in range(240) for y in (0, int(i < 60))])
    w = toxicity.WindowWeights(model)
    assert toxicity.score_text("ZORKGRUB " + plain[0], w) > 0.5 > toxicity.score_text(plain[1], w)
    assert json.dumps(toxicity.unlike(["a b c d", "a b c d", "x y z"])) == "[0, 2]"
