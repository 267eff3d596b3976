"""Alignment of tokenizers, divergence of sources and personal data against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from weftflow.llm import align, divergence, pii, queries
from weftflow.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "the cat's  <|endoftext|> sat\tdown, e.g. <s> <0x41>", "en", "a"), (1, "the cat's  <|endoftext|> sat\tdown, e.g. <s> <0x41>", "en", "a"), (2, None, None, None), (None, "", "en", None),
    (None, None, None, None), (3, "  \n\t ", "", ""), (4, "wörd " * 3000 + "É😀İΣ end.  x 　 y", "de", "a"), (5, "a ▁ b", "en", "b"), (6, "x" * 5000 + " y", "en", "b"), (7, "a  b ​ c\r\n d  ", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("unit", "uid", "block", "row", "groups", "kind", "term", "part")})


def sides(text):
    """Each side's (id, end) of a text, none where the bytes differ."""
    (a, a_bytes), (b, b_bytes) = align.byte_level(public_tokenizers.path("byte_bpe_50k.json")), align.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if not text or b"".join(a_bytes[i] for i in left) != whole or b"".join(b_bytes[i] for i in right) != whole:
        return [], []
    return [[(i, int(e)) for i, e in zip(ids, np.cumsum([len(sizes[i]) for i in ids]), strict=True)] for ids, sizes in ((left, a_bytes), (right, b_bytes))]


def plain_alignment(texts):
    """What `align` gives for texts, token by token over whole texts."""
    each = [sides(t or "") for t in texts]
    links = [[(x, y) for (x, y) in ((dict((e, i) for i, e in a).get(end), i) for i, end in b) if x is not None] for a, b in each]
    counts = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (a, b), found in zip(each, links, strict=True):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = [";".join("|".join(",".join(str(i) for i, e in side if low < e <= high) for side in (a, b)) for low, high in zip([0, *cuts], cuts, strict=False))] if len(a) < 5000 else [None]
        out.append((len(a), len(b), len(cuts), len(found), sum(counts[p] == best[p[1]] for p in found), sum(counts[p] for p in found), groups[0] if a else None))
    return out


def test_alignment(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(docs, plain_alignment([r.text for r in docs]), strict=True)}
    got = {r.doc_id: r for r in queries.op11_alignment(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (*counts, groups) in want.items():
        assert [got[i][c] for c in align.COUNTS] == counts
        if groups is not None:
            assert got[i].groups_sha256 == hashlib.sha256(groups.encode()).hexdigest()


def test_alignment_of_odd_texts(odd):
    order = lambda rows: sorted(rows, key=repr)
    want = [(x[0], *w) for x, w in zip(ODD, plain_alignment([x[1] for x in ODD]), strict=True)]
    got = [(r.doc_id, *(r[c] for c in align.COUNTS), r.groups) for r in align.align(odd).collect()]
    assert order(x[:7] for x in got) == order(x[:7] for x in want)
    long = {4, 6}
    assert order(x for x in got if x[0] not in long) == order(x for x in want if x[0] not in long)
    assert {x[0]: x[1] for x in got}[5] == 0  # U+2581 doesn't come back
    assert align.align(odd.limit(0)).collect() == []


@pytest.mark.parametrize("most", [0, 3, 1 << 17])
def test_frequent_units_stay_out_of_dictionaries(spark, monkeypatch, most):
    """Units that are sent to all tasks stand in no block's dictionary, and rows are the same whatever their number."""
    texts = [f"the cat's {'and so on ' * (i % 3)}w{i} the the {'x' * 80} {'x' * 80}" for i in range(30)]
    tables, cut = {}, align.cut
    monkeypatch.setattr(align, "cut", lambda df, name: tables.setdefault(name, cut(df, name)))
    monkeypatch.setattr(align, "OFTEN_UNITS", most)
    found = align.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    known = {r.unit for r in tables["known"].collect()}
    assert (" the" in known) == (most == 0)
    assert " w7" in known
    assert " " + "x" * 80 in known
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == plain_alignment(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.'  \n\té😀<s> ,1-", min_size=1, max_size=40))
def test_units_keep_tokens(text):
    """Tokens of units are those of the whole text, on both sides."""
    a, _ = align.byte_level(public_tokenizers.path("byte_bpe_50k.json"))
    b, _ = align.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    parts = re.split(align.BETWEEN, " " + text)
    assert [i for p in parts for i in a.encode(p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in b.encode(p[1:])] == b.encode(text)


def test_both_engines_cut_units_alike(spark):
    texts = [r.text for r in table(spark, SF, "documents").filter("text <> ''").select("text").collect()] + [x[1] for x in ODD if x[1]]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", align.units(F.col("text")).alias("u")).collect()
    assert all(r.u == re.split(align.BETWEEN, " " + r.text) for r in got)


def test_divergence(spark):
    assert spark_rows(queries.op12_divergence(spark, SF)) == sql_rows(queries.ORACLE_SQL["op12_divergence"], SF)


def plain_audit(rows, least_docs, top):
    each = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in each}:
        own = [x for x in each if x[0] == lang]
        docs = Counter(t for _, _, words in own for t in set(words))
        kept = sorted((t for t in docs if docs[t] >= least_docs), key=str.encode)
        counts = {s: Counter(t for _, s2, words in own if s2 == s for t in words if docs[t] >= least_docs) for s in {x[1] for x in own}}
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        whole = sum(counts.values(), Counter())
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(-sum(f(share(c, t), share(o, t)) for t in kept), other) for other, o in counts.items() if other != s]
            marks = [(-f(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", marks)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top])]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "top", "parts"), [(1, 3, 1), (2, 200, 5), (9, 5, 2)])
def test_audit_of_odd_texts(spark, odd, least_docs, top, parts):
    more = [(i, f"Wort{i % 3} wört {'Ω' * (i % 2 + 1)} the the", "en" if i % 2 else "de", "abc"[i % 3]) for i in range(20)]
    docs = odd.select("doc_id", "text", "lang", "source", "term", "part").unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=least_docs, top=top, parts=parts).collect())
    assert got == plain_audit([*ODD, *more], least_docs, top)
    assert divergence.audit(odd.limit(0)).collect() == []


def test_tries_given_out_early(spark, monkeypatch):
    """Tries that are given out and begun anew, and blocks of sources, change nothing."""
    want = sorted(tuple(r) for r in divergence.audit(table(spark, SF, "documents")).collect())
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "RANGE_TERMS", 50)
    assert sorted(tuple(r) for r in divergence.audit(table(spark, SF, "documents"), parts=7).collect()) == want
    texts = ["b a a", "a c", "", "ab a"]
    whole = divergence.Trie.of_texts(divergence.pa.array([t.encode() for t in texts], divergence.pa.binary()), np.array([0, 1, 1, 0]))
    parts = [divergence.Trie.of_texts(divergence.pa.array([t.encode()], divergence.pa.binary()), np.array([s])) for t, s in zip(texts, [0, 1, 1, 0], strict=True)]
    both = divergence.Trie.merge(parts)
    assert both.terms.to_pylist() == whole.terms.to_pylist() == [b"a", b"ab", b"b", b"c"]
    for name in ("docs", "leaf", "source", "n"):
        assert getattr(both, name).tolist() == getattr(whole, name).tolist()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 50), st.integers(1, 1 << 52))
def test_shares_are_exact(count, more):
    total = count + more
    assert int(divergence.share(np.array([count]), np.array([total]))[0]) == 1 + 1_000_000_000 * (count + 1) // total


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    luhn = sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in value.split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text, re.ASCII) if valid(k, m[0])]


def test_personal_data(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_personal_data(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]


TRICKY = [
    "a@b.c_d@e.f", "x@y@z.com", "a@b.c.@d.e é.q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111-1 4111-1111-1111-1111", "+1 (555) 010-9999. +12 +123456789) +1234567890123456",
    "+49 30 12345+4 4111111111111111", "😀 joe@ex.org 😀 10.0.0.1", "1" * 3000 + ".1.1.1", "a" * 3000, "a" * 2000 + "@b" + ".c" * 2000, "1 " * 2000 + "x", "+1" + " " * 2000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "", "no data",
]


def test_personal_data_of_tricky_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TRICKY)] + [(None, None, "x", "y"), (3, TRICKY[3], "x", "y")], "doc_id long, text string, spans string, row string")
    got = pii.find(docs).collect()
    assert len(got) == len(TRICKY) + 2
    for r in got:
        text = TRICKY[r.doc_id] if r.doc_id is not None else ""
        assert [(x.kind, x.start, x.end) for x in r.spans if x.base] == base_spans(text)
    assert pii.find(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a@.-_+1 4()é", max_size=30), min_size=20, max_size=20))
def test_base_forms(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = pii.mentions(pii.scan(docs)).filter(F.col("kind") < pii.ADDRESS).join(pii.scan(docs).select("row", "id"), "row").collect()
    got = defaultdict(list)
    for r in found:
        got[r.id].append((pii.KINDS[r.kind], r.start, r.end))
    assert all(sorted(got[i]) == sorted(base_spans(t)) for i, t in enumerate(texts))


def test_contexts_find_what_forms_miss(spark):
    """Patterns that stand beside phone numbers alone find numbers without a plus; a word that stands beside everything finds nothing."""
    seeds = [f"Call hotline +1 555 010 {1000 + i} today. The +1 777 010 {2000 + i}, the 10.1.1.{i}, the a{i}@b.org, the {90000000 + i}." for i in range(12)]
    unseen = ["Call hotline (555) 020 7777 today.", "the 12345678 end", "Order 12345678 now", "1 555 010 1003", "write to a3 (at) b (dot) org", "Hotline: 555-030-8888!"]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    texts = [t for t in seeds + unseen]
    extra = {i: [(x.kind, texts[i][x.start : x.end]) for x in r.spans if not x.base] for i, r in found.items()}
    assert [extra[i] for i in range(12, 18)] == [[("phone", "(555) 020 7777")], [], [], [("phone", "1 555 010 1003")], [("email", "a3 (at) b (dot) org")], [("phone", "555-030-8888")]]
    assert not any(extra[i] for i in range(12))
    masked = docs.join(pii.find(docs), "doc_id").select("doc_id", pii.mask(F.col("text"), F.col("spans")).alias("m")).collect()
    by_id = {r.doc_id: r.m for r in masked}
    assert by_id[12] == "Call hotline [phone] today." and by_id[13] == "the 12345678 end" and by_id[0].startswith("Call hotline [phone] today. The [phone], the [ip], the [email], the 90000000.")


def plain_scores(edges, seeds, least_seeds, least_confidence, turns):
    """The graph's scores with plain dictionaries: edges are (pattern, meaning), seeds meaning to kind."""
    by_pattern = defaultdict(set)
    for p, m in edges:
        by_pattern[p].add(m)
    now = {(m, k): 1.0 for m, k in seeds.items()}
    for _ in range(turns):
        sure = {}
        for p, members in by_pattern.items():
            for k in range(4):
                total = sum(s for (m, kind), s in now.items() if m in members and kind == k)
                enough = any(sum(seeds.get(m) == kind for m in members) >= least_seeds for kind in range(4))
                if enough and total >= least_seeds and total / len(members) >= least_confidence:
                    sure[p, k] = total / len(members)
        now = {(m, k): 1.0 for m, k in seeds.items()}
        for (p, k), c in sure.items():
            for m in by_pattern[p] - seeds.keys():
                now[m, k] = max(now.get((m, k), 0), c)
    return now


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_of_a_graph(spark, seed):
    rng = np.random.default_rng(seed)
    seeds = {f"s{i}": int(rng.integers(0, 4)) for i in range(40)}
    rows = [(m, k, [f"p{k}" if rng.random() < 0.8 else f"q{rng.integers(0, 5)}" for _ in range(2)]) for m, k in seeds.items()]
    rows += [(f"u{i}", pii.NUMBER, [f"p{rng.integers(0, 4)}" if rng.random() < 0.3 else f"q{rng.integers(0, 5)}"]) for i in range(12)]
    found = spark.createDataFrame(rows, "meaning string, kind int, patterns array<string>")
    got = {(r.meaning, r.kind): r.score for r in pii.scores(found, 3, 0.6, 3).collect()}
    want = plain_scores([(p, m) for m, _, ps in rows for p in ps], seeds, 3, 0.6, 3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("known", [True, False])
def test_texts_of_bytes_that_differ_count_for_nothing(spark, monkeypatch, known):
    """Whether it is known beforehand or found by its units, a document whose bytes differ has no tokens, and none of its links count."""
    if not known:
        monkeypatch.setattr(align, "contains_space", lambda text: F.lit(False))
    docs = spark.createDataFrame([(1, "a b"), (2, "a ▁ b"), (3, "b")], "doc_id long, text string")
    got = {r.doc_id: r for r in align.align(docs).collect()}
    assert len(got) == 3 and got[2].n_a == 0 and got[2].groups is None and got[1].count_sum == 3 and got[3].count_sum == 2
