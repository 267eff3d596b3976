"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, as joins and windows over token rows.

A is a byte-level BPE over a space and the text, B a piece model over the text, which adds that space itself. Texts are
cut into units: a space, then everything up to the next single space between two characters that aren't white space.
No token of either side spans such a place (A's splitting pattern starts a match there; no piece of B has its space sign
behind another character, which is checked when the model is loaded), so both sides always end together at the end of a
unit, and what holds for a text is what holds for its units, one after the other. So each different unit is tokenised and
aligned once, with its number of occurrences, and documents are put together from their units by a join.

Units are aligned by relations alone: exploded tokens with positions, windowed sums of lengths for their ends, an equi-join
on unit and end (as a grouping), whose matches are cuts and links, a running count of cuts for group numbers, joins of links with corpus-wide counts.
Documents are put together from their units in Arrow, block by block; the most frequent units, a bounded number, are sent to all tasks
instead of standing in nearly every block's dictionary.

Nulls: a null or empty text has no tokens, and neither has one whose bytes B doesn't give back (it holds U+2581). Repeated rows and
ids, null ids included, are documents each. Extra columns, whatever their names, are left behind. An empty table gives no rows.
A unit may be as long as a text without spaces; it is one row. Blocks of about BLOCK_BYTES of text have a dictionary each,
so that documents are shuffled whole, and a frequent unit stands once in each block.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import public_tokenizers
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import cut, drop, forget, map_in_arrow, settings, slices

#: Characters that are surely neither white space nor controls, as ranges that Java and Python read alike.
VISIBLE = r"!-~\u00A1-\u167F\u1681-\u1FFF\u2010-\u2027\u2030-\u205E\u2070-\u2FFF\u3001-\uD7FF\uF900-\uFEFE"
#: Where units begin: a single space between two of them.
BETWEEN = rf"(?= [{VISIBLE}])(?<=[{VISIBLE}])"
#: Bytes of text of a block of documents, about.
BLOCK_BYTES = 16 << 20
#: Units that are sent to all tasks, at most, and bytes of one, at most.
OFTEN_UNITS, OFTEN_BYTES = 1 << 17, 64
SPACE = "▁"

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _bytes(path: str) -> bytes:
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[Tokenizer, list[bytes]]:
    """The tokenizer and the bytes of each of its entries."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_str(_bytes(path).decode())
    found.encode_special_tokens = True
    back = {c: b for b, c in enumerate_bytes()}
    entries = [b""] * (max(found.get_vocab().values()) + 1)
    for entry, i in found.get_vocab().items():
        entries[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return found, entries


def enumerate_bytes() -> Iterator[tuple[int, str]]:
    """Each byte and the character that byte-level vocabularies write for it: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    assert len(ByteLevel.alphabet()) == 256
    after = 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            yield b, chr(b)
        else:
            yield b, chr(after)
            after += 1


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The piece model and the bytes of each piece."""
    found = sentencepiece.SentencePieceProcessor(model_proto=_bytes(path))
    names = [found.id_to_piece(i) for i in range(found.get_piece_size())]
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError("a piece spans the beginning of a word, so texts can't be cut into units")
    return found, [bytes([int(n[3:-1], 16)]) if found.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]


def units(text: Column) -> Column:
    """The units of a text that isn't empty, each with its leading space."""
    return F.split(F.concat(F.lit(" "), text), BETWEEN, -1)


def contains_space(text: Column) -> Column:
    """Whether a text holds the sign that B writes for a space."""
    return F.contains(text, F.lit(SPACE))


def tokenise(found: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(unit, times, same, a, a_sizes, b, b_sizes) of (unit, times): both sides' tokens and their sizes in bytes, and whether they have the same bytes."""

    def lists(rows: list[list[int]], sizes: np.ndarray) -> list[pa.ListArray]:
        flat = np.fromiter((i for x in rows for i in x), "i4", sum(map(len, rows)))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype("i4"))
        return [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (flat, sizes[flat] if len(flat) else flat)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, a_bytes), (b, b_bytes) = byte_level(a_file), pieces(b_file)
        a_sizes, b_sizes = (np.array([len(x) for x in side], "i4") for side in (a_bytes, b_bytes))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            left = [x.ids for x in a.encode_batch_fast(texts, add_special_tokens=False)]
            right = b.encode([t[1:] for t in texts], num_threads=1) if texts else []
            whole = [t.encode() for t in texts]
            same = [b"".join([a_bytes[i] for i in x]) == w == b"".join([b_bytes[i] for i in y]) for w, x, y in zip(whole, left, right, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(same, pa.bool_()), *lists(left, a_sizes), *lists(right, b_sizes)], ["unit", "times", "same", "a", "a_sizes", "b", "b_sizes"])

    ids = "array<int>"
    return map_in_arrow(found.select("unit", "times"), run, f"unit string, times long, same boolean, a {ids}, a_sizes {ids}, b {ids}, b_sizes {ids}")


def ends(held: DataFrame) -> DataFrame:
    """(uid, times, end, a, b): a row for each offset where a token of A, of B or of both ends, with their ids.

    The two sides meet by unit and end, as in a full join. They are grouped rather than joined, since that keeps them where their unit is.
    """
    along = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    exploded = {c: held.select("uid", "times", F.posexplode(F.arrays_zip(c, f"{c}_sizes")).alias("pos", "t")) for c in "ab"}
    none = F.lit(None).cast("int")
    sides = [
        df.select("uid", "times", F.sum(f"t.{c}_sizes").over(along).alias("end"), *((F.col(f"t.{c}") if k == c else none).alias(k) for k in "ab"))
        for c, df in exploded.items()
    ]
    return sides[0].unionAll(sides[1]).groupBy("uid", "end").agg(F.max("times").alias("times"), F.max("a").alias("a"), F.max("b").alias("b"))


def grouped(found: DataFrame) -> DataFrame:
    """(uid, times, n_a, groups, links) of each unit: groups as text `a1,a2|b1;a3|b2`, links as an array of numbers with A's id above B's."""
    cuts = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    before = Window.partitionBy("uid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.withColumn("grp", F.coalesce(F.sum(cuts).over(before), F.lit(0).cast("long")))
    side = lambda k, c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct("grp", F.lit(k).alias("kind"), "end", F.col(c).alias("id"))))
    links = F.collect_list(F.when(cuts == 1, F.call_function("shiftleft", F.col("a").cast("long"), F.lit(32)).bitwiseOR(F.col("b").cast("long"))))
    per = numbered.groupBy("uid").agg(
        F.max("times").alias("times"), F.count("a").alias("n_a"), F.sort_array(F.concat(side(0, "a"), side(1, "b"))).alias("t"), links.alias("links"),
    )
    last = lambda i: F.get("t", i - 1)
    sign = lambda x, i: F.when(i == 0, "").when(last(i)["grp"] < x["grp"], ";").when(last(i)["kind"] < x["kind"], "|").otherwise(",")
    text = F.array_join(F.transform("t", lambda x, i: F.concat(sign(x, i), x["id"].cast("string"))), "")
    return per.select("uid", "times", "n_a", text.alias("groups"), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, links, best) of (pair, times): how many links of the whole corpus hold a pair, A's id above B's in one number, and whether no pair of that B has more."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("links")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame) -> DataFrame:
    """(uid, n_best, count_sum) of the stored table that `grouped` gives.

    The counts are broadcast: of two tokens that end together one's bytes end the other's, so the vocabularies bound the number of
    pairs, by the sum of their entries' lengths, whatever the corpus.
    """
    links = aligned.select("uid", "times", F.explode("links").alias("pair"))
    scored = links.select("uid", "pair").join(F.broadcast(pair_counts(links)), "pair")
    return scored.groupBy("uid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("links").alias("count_sum"))


def least_times(stats: DataFrame) -> Column:
    """Which units are sent to all tasks: short ones from that number of occurrences on from which there are OFTEN_UNITS at most."""
    step = F.floor(8 * F.log2("times"))
    short = F.octet_length("unit") <= OFTEN_BYTES
    room, least = OFTEN_UNITS, None
    for r in sorted(stats.filter(short & (F.col("times") > 1)).groupBy(step.alias("step")).count().collect(), reverse=True):  # a few hundred rows
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return short & (step >= least) if least is not None else F.lit(False)


def counted(found: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Groups and COUNTS of units; each group has one link, that of the two tokens at its end."""
    groups = found["groups"].combine_chunks()
    n_a, best, total = (found[c].to_numpy() for c in ("n_a", "n_best", "count_sum"))
    n_groups = pc.count_substring(groups, "|").to_numpy()
    n_b = pc.count_substring(groups, ",").to_numpy() + 2 * n_groups - n_a
    return groups, np.stack([n_a, n_b, n_groups, n_groups, best, total], axis=1).astype("i8")


@functools.lru_cache(maxsize=1)
def indexed(often: Broadcast) -> tuple[dict[str, int], pa.Array, np.ndarray]:
    """The places of the frequent units, their groups and their counts, once for each Python worker."""
    return {u: i for i, u in enumerate(often.value["unit"].to_pylist())}, *counted(often.value)


def together(left: pa.Table, right: pa.Table, often: Broadcast) -> pa.Table:
    """The documents of a block, from their units, the frequent units and the block's dictionary of others."""
    places, *shared = indexed(often)
    own = {u: i for i, u in enumerate(right["unit"].to_pylist(), len(places))}
    groups, counts = (f(x) for f, x in zip((pa.concat_arrays, np.concatenate), zip(shared, counted(right), strict=True), strict=True))
    cut_at, place, done = re.compile(BETWEEN), places.get, []
    for batch in slices(left.to_batches(), 64):
        parts = [cut_at.split(" " + text) for text in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, parts)])
        at = np.fromiter((own[u] if (i := place(u)) is None else i for p in parts for u in p), "i8", ends[-1])
        sums = np.add.reduceat(counts[at], ends[:-1], axis=0)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype("i4")), groups.take(pa.array(at))), ";")
        done.append(pa.record_batch([batch.column("id"), *(pa.array(c) for c in sums.T), text], ["id", *COUNTS, "groups"]))
    return pa.Table.from_batches(done)


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    a_file: str = public_tokenizers.path("byte_bpe_50k.json"), b_file: str = public_tokenizers.path("piece_bpe_32k.model"),
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document.

    `groups` is the text of a document's groups (`a1,a2|b1;a3|b2,b3`), null where it has no tokens.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_docs, n_bytes = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    per_block = max(1, BLOCK_BYTES * n_docs // max(n_bytes, 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BLOCK_BYTES))
    # documents that Spark reads after one another make up a block: there a unit is counted before it is shuffled
    row = F.monotonically_increasing_id()
    block = F.shiftright(row, 33) * (1 << 24) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / per_block)  # small numbers, which shuffles compress
    with settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        rows = cut(texts.select(row.alias("row"), "id", "text", block.alias("block")), "texts")
        # B writes a space for its own sign, so texts that hold it don't come back; nor may others of another model, and their links mustn't count
        full, lost = rows.filter((F.col("text") != "") & ~contains_space(F.col("text"))), None
        while True:
            pairs = cut(full.select("block", F.explode(units(F.col("text"))).alias("unit")).groupBy("block", "unit").count(), "pairs")
            forget(spark)
            different = cut(tokenise(pairs.groupBy("unit").agg(F.sum("count").alias("times")), a_file, b_file).withColumn("uid", F.monotonically_increasing_id()), "different")
            forget(spark)
            bad = different.filter("not same").select("unit")
            if lost is not None or bad.isEmpty():
                break
            lost = cut(full.select("row", F.explode(units(F.col("text"))).alias("unit")).join(bad, "unit", "left_semi").select("row").distinct(), "lost")
            full = full.join(lost, "row", "left_anti")
            drop(pairs, different)
        with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):  # one shuffle by uid serves windows, join and grouping
            aligned = cut(grouped(ends(different.repartition(parts, "uid"))), "aligned")
        forget(spark)
        facts = aligned.select("uid", "groups", "n_a").join(link_sums(aligned), "uid")
        stats = cut(different.select("unit", "uid", "times").join(facts, "uid").drop("uid"), "stats")
        drop(different, aligned)
        forget(spark)
        # blocks' dictionaries are written, so that what they are made of is gone before documents are shuffled
        is_often = least_times(stats)
        told = ("unit", "groups", "n_a", "n_best", "count_sum")
        often = spark.sparkContext.broadcast(stats.filter(is_often).select(*told).toArrow())
        rest = pairs.select("block", "unit").join(F.broadcast(stats.filter(is_often).select("unit")), "unit", "left_anti")
        known = cut(rest.join(stats.filter(~is_often).select(*told), "unit"), "known")
        drop(pairs, stats)
        forget(spark)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return together(left, right, often)

    each = full.select("block", "id", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"id long, {', '.join(f'{c} long' for c in COUNTS)}, groups string")
    gone = rows.filter((F.col("text") == "") | contains_space(F.col("text"))).select("id")
    if lost is not None:
        gone = gone.unionAll(rows.join(lost, "row", "left_semi").select("id"))
    without = gone.select("id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit(None).cast("string").alias("groups"))
    return each.unionAll(without).withColumnRenamed("id", id_col)
