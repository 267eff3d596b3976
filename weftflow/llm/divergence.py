"""How far the sources of a language differ in their words: sums over pairs of sources, and the terms that mark a source.

Terms are counted in byte tries, whose leaves count the occurrences of a term by source and its documents. Each task fills
tries for the languages it meets and gives out their leaves in the order of UTF-8; tries that have grown to some MOST_LEAVES leaves are
given out and begun anew, which is right since tries merge: leaves are dealt by ranges of language and term, and a task merges
the sorted leaves of its range, as one walk over many tries. A second walk over the merged leaves, the totals of their language before
them, streams the sums of all pairs of sources and the first candidates of each source, ties in the order of the terms.

All arithmetic is exact: `share` divides in steps of a thousand, so that products stay below 2^63.

Nulls: null texts, languages and sources count as ''. A group of a language and a source without terms takes part with no occurrences.
Repeated rows, repeated and null ids are documents each; other columns, whatever their names, aren't read. An empty table gives no rows. A term may be
as long as a text. Nothing but the tables' own rows reaches the driver, and nothing is broadcast.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_in_arrow

#: Documents of a language that a term is in, at least, to be kept.
LEAST_DOCS = 3
#: Ranks of marking terms.
TOP_TERMS = 200
#: Leaves and bytes of labels at which a task gives out its tries.
MOST_LEAVES, MOST_BYTES = 1_000_000, 64 << 20
#: Rows of a batch of leaves that a task gives out.
BATCH = 5000
#: Sources of one block of items; each block of a range of terms is walked on its own.
SOURCES = 1024
#: Terms of one range that is scored, about.
RANGE_TERMS = 200_000
#: Counters of terms by source that are scored at once.
CELLS = 1 << 18

#: Letters: A-Z become a-z, all other bytes below 128 part terms.
LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], "u1")


class Trie:
    """A radix trie over bytes, as arrays in the order of its walk.

    `terms` are the leaves' paths in the order of their bytes, so leaves below one node stand together and two tries merge like sorted
    lists. `docs` counts a leaf's documents; its counters by source are entries (leaf, source, occurrences), by leaf and source.
    """

    def __init__(self, terms: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """Terms in any order, each once; several entries of a leaf and source are added up."""
        order = pc.sort_indices(terms).to_numpy()
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        self.terms, self.docs = terms.take(pa.array(order)), docs[order]
        width = int(source.max()) + 1 if len(source) else 1
        key = place[leaf] * width + source
        by_key = np.argsort(key, kind="stable")
        key, n = key[by_key], n[by_key]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.leaf, self.source = np.divmod(key[first], width)
        self.n = np.add.reduceat(n, first) if len(first) else n

    def __len__(self) -> int:
        return len(self.docs)

    @classmethod
    def of_texts(cls, texts: pa.Array, sources: np.ndarray) -> Trie:
        """The terms of texts, each with its source's number."""
        data = LETTERS[np.frombuffer(texts.buffers()[2] or b"", "u1")]
        spaced = pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data), offset=texts.offset)
        lists = pc.ascii_split_whitespace(spaced)
        words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        full = pc.greater(pc.binary_length(words), 0)
        words, doc = words.filter(full).dictionary_encode(), doc[full.to_numpy(zero_copy_only=False)].astype("i8")
        size = max(len(words.dictionary), 1)
        (doc, term), n = np.divmod((pair := np.unique(doc * size + words.indices.to_numpy(), return_counts=True))[0], size), pair[1]
        return cls(words.dictionary.cast(pa.binary()), np.bincount(term, minlength=len(words.dictionary)), term, sources[doc], n)

    @classmethod
    def merge(cls, tries: list[Trie]) -> Trie:
        both = pa.concat_arrays([t.terms for t in tries]).dictionary_encode()
        at = both.indices.to_numpy().astype("i8")
        starts = np.cumsum([0, *map(len, tries)])
        docs = np.zeros(len(both.dictionary), "i8")
        np.add.at(docs, at, np.concatenate([t.docs for t in tries]))
        leaf = at[np.concatenate([t.leaf + s for t, s in zip(tries, starts, strict=False)])]
        return cls(both.dictionary, docs, leaf, np.concatenate([t.source for t in tries]), np.concatenate([t.n for t in tries]))

    def batches(self, lang: str, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The leaves in order, as rows of LEAVES."""
        edges = np.searchsorted(self.leaf, np.arange(len(self) + 1))
        sources = pa.array(names, pa.string())
        for a in range(0, len(self), BATCH):
            b = min(a + BATCH, len(self))
            i, j, ends = edges[a], edges[b], pa.array((edges[a : b + 1] - edges[a]).astype("i4"))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (sources.take(pa.array(self.source[i:j])), pa.array(self.n[i:j]))]
            yield pa.record_batch([pa.array([lang] * (b - a)), self.terms.slice(a, b - a), pa.array(self.docs[a:b]), *lists], ["lang", "term", "docs", "sources", "counts"])


LEAVES = "lang string, term binary, docs long, sources array<string>, counts array<long>"


class Names(dict):
    """Numbers of names, in the order in which they come."""

    def __missing__(self, name: str) -> int:
        self[name] = len(self)
        return self[name]


def count_terms(docs: DataFrame) -> DataFrame:
    """Leaves of (lang, source, text): the tries of each task, which are merged as they grow and given out by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = Names(), {}, 0
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            sources = np.array([names[s] for s in batch.column("source").to_pylist()], "i8")
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(langs.indices.to_numpy() == k)
                held.setdefault(lang, []).append(Trie.of_texts(batch.column("text").take(pa.array(own)), sources[own]))
                size += len(held[lang][-1])
            if size > MOST_LEAVES or sum(t.terms.nbytes for tries in held.values() for t in tries) > MOST_BYTES:
                held = {lang: [Trie.merge(tries)] for lang, tries in held.items()}
                size = sum(len(t) for (t,) in held.values())
                if size > MOST_LEAVES // 2 or sum(t.terms.nbytes for (t,) in held.values()) > MOST_BYTES // 2:
                    yield from given(held, names)
                    names, held, size = Names(), {}, 0
        yield from given(held, names)

    def given(held: dict[str, list[Trie]], names: Names) -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            yield from Trie.merge(held[lang]).batches(lang, list(names))

    return map_in_arrow(docs.select("lang", "source", F.col("text").cast("binary").alias("text")), run, LEAVES)


def merge(leaves: DataFrame, parts: int, least_docs: int) -> DataFrame:
    """(lang, part, term, sources, counts) of the terms in `least_docs` documents of their language at least; `part` is the range of terms.

    The leaves of a range arrive in order, so of each language and term all stand together; the last term of a batch waits for the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = pc.and_(pc.equal(batch.column("lang"), batch.column("lang")[-1]), pc.equal(batch.column("term"), batch.column("term")[-1]))
            last = batch.num_rows - int(pc.sum(same).as_py())
            if last or waiting and (waiting[-1].column("term")[-1] != batch.column("term")[0] or waiting[-1].column("lang")[-1] != batch.column("lang")[0]):
                yield from merged([*waiting, batch.slice(0, last)])
                waiting = []
            waiting.append(batch.slice(last))
        yield from merged(waiting)

    def merged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        for lang in rows.column("lang").unique().to_pylist() if rows else []:
            own = rows.filter(pc.equal(rows.column("lang"), lang)).combine_chunks()
            sources, counts = own.column("sources").combine_chunks(), own.column("counts").combine_chunks()
            known = sources.flatten().dictionary_encode()
            terms = own.column("term").combine_chunks().dictionary_encode()
            at = terms.indices.to_numpy().astype("i8")
            docs = np.zeros(len(terms.dictionary), "i8")
            np.add.at(docs, at, own.column("docs").to_numpy())
            leaf = at[pc.list_parent_indices(sources).to_numpy()]
            found = Trie(terms.dictionary, docs, leaf, known.indices.to_numpy().astype("i8"), counts.flatten().to_numpy())
            for batch in found.batches(lang, known.dictionary.to_pylist()):
                yield batch.filter(pc.greater_equal(batch.column("docs"), least_docs))

    ranged = leaves.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return map_in_arrow(ranged, run, LEAVES).select("lang", F.spark_partition_id().alias("part"), "term", "sources", "counts")


def share(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(1000000000 * (counts + 1) / totals), exact for totals below 2^53."""
    rest, found = counts + 1, np.zeros(np.broadcast(counts, totals).shape, "i8")
    whole, rest = np.divmod(rest, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        found = found * 1000 + digit
    return 1 + whole * 1_000_000_000 + found


class Scores:
    """Sums over pairs of sources, and the first terms of each, of one language, one range of terms and one block of items."""

    def __init__(self, lang: str, block: int, names: list[str], occurrences: list[int], n_terms: int, top: int) -> None:
        self.lang, self.block, self.names, self.top = lang, block, names, top
        self.place = {s: i for i, s in enumerate(names)}
        self.totals = np.array(occurrences, "i8") + n_terms
        self.all_total = sum(occurrences) + n_terms
        self.items = range(block * SOURCES, min(len(names), (block + 1) * SOURCES))
        self.sums = np.zeros((len(names), len(self.items)), "i8")
        self.best: list[list[tuple]] = [[] for _ in names]
        self.rows: list[tuple] = []
        self.most_rows = max(1, CELLS // len(names))

    def add(self, term: bytes, sources: list[str], counts: list[int]) -> None:
        self.rows.append((term, sources, counts))
        if len(self.rows) >= self.most_rows:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        held = np.zeros((len(self.rows), len(self.names)), "i8")
        for i, (_, sources, counts) in enumerate(self.rows):
            held[i, [self.place[s] for s in sources]] = counts
        p = share(held, self.totals)
        for at, item in enumerate(self.items):
            q = p[:, item : item + 1]
            self.sums[:, at] += ((p - q) ** 2 // q).sum(0)
        if self.block == 0:
            q = share(held.sum(1, keepdims=True), np.array(self.all_total))
            value = (p - q) ** 2 // q
            marks = (held > 0) & (p > q)
            for s, best in enumerate(self.best):
                for i in np.flatnonzero(marks[:, s]).tolist():
                    one = (-int(value[i, s]), self.rows[i][0])
                    if len(best) < self.top or one < best[-1]:
                        insort(best, one)
                        del best[self.top :]
        self.rows = []

    def results(self) -> Iterator[tuple]:
        self.flush()
        for s, name in enumerate(self.names):
            for at, item in enumerate(self.items):
                if item != s:
                    yield self.lang, name, "pair", self.names[item].encode(), int(self.sums[s, at])
            for value, term in self.best[s]:
                yield self.lang, name, "term", term, -value


def score(terms: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item binary, value) of each range of terms: sums over its terms, and its first candidates.

    Each range of a language gets the language's totals by source as its first rows; languages of many sources are walked once for each block of SOURCES items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, now, first = None, None, []
            for batch in batches:
                for lang, part, block, kind, term, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (lang, part, block) != at:
                        if now:
                            yield from now.results()
                        at, now, first = (lang, part, block), None, []
                    if kind == 0:
                        first.append((sources[0], *counts))
                        continue
                    if now is None:
                        now = Scores(lang, block, [x[0] for x in first], [x[1] for x in first], first[0][2], top)
                    now.add(term, sources, counts)
            if now:
                yield from now.results()

        held: list[tuple] = []
        for row in rows():
            held.append(row)
            if len(held) >= BATCH:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    types, names = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()), ["lang", "source", "part", "item", "value"]
    size = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    where = terms.select("lang", "part").distinct().join(size, "lang").select("lang", "part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_sources") - 1) / SOURCES).cast("int"))).alias("block"))
    first = where.join(totals, "lang").select("lang", "part", "block", F.lit(0).alias("kind"), F.col("source").cast("binary").alias("term"), F.array("source").alias("sources"), F.array("occurrences", "n_terms").alias("counts"))
    then = terms.join(where, ["lang", "part"]).select("lang", "part", "block", F.lit(1).alias("kind"), "term", "sources", "counts")
    order = ["lang", "part", "block", "kind", "term"]
    dealt = first.unionAll(then).repartition("lang", "part", "block").sortWithinPartitions(*order)
    return map_in_arrow(dealt.select(*order, "sources", "counts"), run, "lang string, source string, part string, item binary, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, parts: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group its divergence from each other source of the language, and its marking terms."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    groups = cut(rows.select("lang", "source").distinct(), "groups")
    leaves = cut(count_terms(rows), "leaves")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = cut(merge(leaves, parts, least_docs), "terms")
    drop(leaves)
    by_source = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("occurrences"))
    n_terms = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    totals = cut(groups.join(by_source, ["lang", "source"], "left").join(n_terms, "lang", "left").select("lang", "source", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")), "totals")
    # a range gives a row for each pair of sources, so it takes as many terms as make that little
    wide = max(1, min(parts, terms.count() // RANGE_TERMS))
    found = cut(score(terms.withColumn("part", F.floor(F.col("part") * wide / parts)), totals, top), "scores")
    item = F.col("item").cast("string").alias("item")
    # each other source of the language is a row of the result, also where no term is kept
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    sums = found.filter("part = 'pair'").select("lang", "source", item, "value")
    pairs = sums.unionAll(others).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    marks = found.filter("part = 'term'").select("lang", "source", "part", item, "value")
    ranked = marks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionAll(ranked)
