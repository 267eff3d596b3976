"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are runs of three words; each occurrence of a term votes with the bits of its two 64-bit hashes, so a term's
weight is its number of occurrences. A set bit of the fingerprint is one that more than half of the votes set.
Votes are counted two to a long: (hash >> i) & 0x0000000100000001 adds to the counters of bits i and i + 32 at once,
so 64 plain sums hold 128 counters, which don't overflow below four thousand million terms. The sums are aggregated
before the shuffle, where the terms of a text are together.

`within_radius` finds all pairs of different fingerprints within a Hamming radius by permuted block tables.

Nulls: a null text counts as empty. A text without words has no votes and the fingerprint 0. Repeated rows are
fingerprinted each. Extra columns, whatever their names, are left behind. An empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 128
LANES = 0x0000000100000001


def words(text: Column) -> Column:
    """The words of a text: what stands between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def terms(found: Column) -> Column:
    """An array of structs of three words in a row, from an array of words. Runs at the end of a text are shorter."""
    size = F.greatest(F.size(found), F.lit(1))
    return F.arrays_zip(found.alias("a"), F.slice(found, F.lit(2), size).alias("b"), F.slice(found, F.lit(3), size).alias("c"))


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, high long, low long) of each combination of keys; the rows of a key are taken as one text."""
    split = df.select(*keys, words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))  # a column of its own, so that a text is split once
    run = split.select(*keys, F.inline_outer(terms(F.col("_w")))).toDF(*keys, "_a", "_b", "_c")
    hashed = run.select(*keys, F.col("_a").isNotNull().cast("long").alias("_n"), F.xxhash64("_a", "_b", "_c").alias("_h0"), F.xxhash64("_c", "_b", "_a", F.lit(1)).alias("_h1"))
    votes = [F.sum(F.when(F.col("_n") == 1, F.shiftrightunsigned(f"_h{k}", i).bitwiseAND(F.lit(LANES))).otherwise(F.lit(0).cast("long"))).alias(f"_v{k}_{i}") for k in range(2) for i in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("_n").alias("_n"), *votes)
    return summed.select(*keys, *(decide(k).alias(name) for k, name in ((0, "high"), (1, "low"))))


def decide(k: int) -> Column:
    """The long whose bits have more than half of the votes."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        votes = F.col(f"_v{k}_{i}")
        for at, count in ((i, votes.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(votes, 32))):
            bit = (1 << at) - (1 << 64 if at == 63 else 0)
            bits = bits.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(bit)).otherwise(F.lit(0).cast("long")))
    return bits


def as_text(high: Column, low: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(*four: Column) -> Column:
    """The share of equal bits: 1 for equal fingerprints, about one half for unrelated texts."""
    return (F.lit(1.0) - distance(*four) / F.lit(float(BITS))).cast("double")


def within_radius(prints: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """(high, low, other_high, other_low, distance): all pairs of different fingerprints at most `radius` apart, smaller first.

    The bits are dealt into radius + spare blocks. Two fingerprints within the radius differ in at most `radius`
    blocks, so they agree in `spare` whole blocks at least: for each choice of that many blocks there is a table keyed
    by them, and pairs meet in the table of one such choice. The pair is kept in the first table where it meets.
    Equal fingerprints are one entry, whatever their number. Adaptive execution splits hot keys.
    """
    blocks = radius + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = prints.select("high", "low").distinct()

    def block(i: int, high: Column, low: Column) -> Column:
        keep = lambda x, a, b: x.bitwiseAND(F.lit(_signed(((1 << (b - a)) - 1) << a)))  # noqa: E731  bits a to b of a long
        a, b = edges[i], edges[i + 1]
        return F.struct(keep(low, min(a, 64), min(b, 64)).alias("l"), keep(high, max(a, 64) - 64, max(b, 64) - 64).alias("h"))

    tables = list(combinations(range(blocks), spare))
    entry = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.array(*(block(i, F.col("high"), F.col("low")) for i in choice)).alias("key")) for t, choice in enumerate(tables))))
    rows = each.select("high", "low", entry.alias("e")).select("high", "low", F.col("e.t").alias("t"), F.xxhash64("e.t", "e.key").alias("key"))
    other = rows.select(F.col("high").alias("other_high"), F.col("low").alias("other_low"), "t", "key")
    met = rows.join(other, ["t", "key"]).filter((F.col("high") < F.col("other_high")) | ((F.col("high") == F.col("other_high")) & (F.col("low") < F.col("other_low"))))
    apart = distance(F.col("high"), F.col("low"), F.col("other_high"), F.col("other_low"))
    same = F.array(*(block(i, F.col("high"), F.col("low")) == block(i, F.col("other_high"), F.col("other_low")) for i in range(blocks)))
    first = F.coalesce(*(F.when(F.forall(F.array(*(same[i] for i in choice)), lambda x: x), F.lit(t)) for t, choice in enumerate(tables)))
    return met.withColumn("distance", apart).filter((F.col("distance") <= radius) & (first == F.col("t"))).select("high", "low", "other_high", "other_low", "distance")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: Documents of an id range, about; ranges at most; bounds that are compared at a time; rows from which on an id's are dealt over several ranges.
RANGE_ROWS, MOST_RANGES, BLOCK_BOUNDS, HOT_ROWS = 256, 1 << 16, 256, 4096
#: Ids that may have so many rows, at most; parts of one id at most, a power of two.
MOST_HOT, MOST_PARTS = 10_000, 16
#: Repeats of a row that one task gives out at a time.
REPEATS = 1000


def slot_of(id_: Column, bounds: list[int]) -> Column:
    """The number of bounds above an id, so 0 for the largest ids; null ids have a slot of their own after all others.

    Bounds lie in blocks: an id is compared with the first of each block, then with those of one block. They reach the
    plan as one literal, whatever their number.
    """
    blocks = [bounds[i : i + BLOCK_BOUNDS] for i in range(0, len(bounds), BLOCK_BOUNDS)]
    firsts = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>")
    at = F.size(F.filter(firsts, lambda b: b <= id_))
    within = F.size(F.filter(F.get(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), at - 1), lambda b: b <= id_))
    below = F.when(at == 0, F.lit(0)).otherwise((at - 1) * BLOCK_BOUNDS + within)
    return F.when(id_.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - below).cast("long")


def in_order(docs: DataFrame, ranges: int | None = None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Each document beside the next one in descending id order (after the last the first): (slot, place, doc_id, text, next_text, times).

    Ids fall into ranges at approximate quantiles, about RANGE_ROWS documents each and MOST_RANGES at most; only their bounds and
    the first place of each reach the driver, and that table is broadcast. The documents are shuffled once, by range; the first
    document of a range is also dealt to the range above, whose last document it follows: there it has place null and no next text.

    Null ids come last, repeated ids in the order of their texts. An id with more than `hot_rows` rows, which few can have, is dealt
    over ranges of its own by a hash of the text, and its rows come in the order of that hash; equal ones are one row, `times` tells
    how many such there are. slot and place number the rows in order. The second result tells whether `times` can be more than 1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("times"))
    ids = rows.select("doc_id")
    n = ids.count()
    ranges = ranges or max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 8 * ranges)).first()[0] if ranges > 1 else []
    # an id's share of the rows bounds how many there can be
    hot = {r["doc_id"]: r["count"] for r in ids.groupBy("doc_id").count().filter(F.col("count") > max(hot_rows, n // MOST_HOT)).collect()}
    slot = slot_of(F.col("doc_id"), sorted({*(bounds or []), *(x for i in hot if i is not None for x in (i, i + 1))}))
    hashed, part = F.lit(0).cast("long"), F.lit(0).cast("long")
    if hot:
        bits = {i: min(MOST_PARTS, max(1, (c // RANGE_ROWS).bit_length())) for i, c in hot.items()}
        known_bits = F.from_json(F.lit(json.dumps({str(i): b for i, b in bits.items()})), "map<string,int>")[F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))]
        rows = rows.withColumn("bits", known_bits)
        again = rows.filter("bits is not null").groupBy("doc_id", "text", "bits").agg(F.sum("times").alias("times"))
        rows = rows.filter("bits is null").unionByName(again)
        hashed = F.when(F.col("bits").isNotNull(), F.xxhash64("text")).otherwise(hashed)
        part = F.when(F.col("bits").isNotNull(), F.call_function("shiftright", hashed, F.lit(64) - F.col("bits")) + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits") - 1)).otherwise(part)
    rows = rows.withColumn("hashed", hashed).withColumn("slot", slot * (1 << MOST_PARTS) + part)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("i"), F.col("hashed").alias("h"))
    heads = sorted((r["slot"], tuple(r["head"])) for r in rows.groupBy("slot").agg(F.min(order).alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], "slot long, place long, doc_id long, text string, next_text string, times long"), False
    # each range with its head and the range before it; the first range's head follows the last range
    known = spark.createDataFrame([(s, *h, heads[i - 1][0]) for i, (s, h) in enumerate(heads)], "slot long, n boolean, i long, h long, before long")
    leads = (order["n"] == F.col("n")) & order["i"].eqNullSafe(F.col("i")) & (order["h"] == F.col("h"))
    own, other = (F.struct(F.col(c).alias("slot"), F.lit(k).alias("copy")) for k, c in enumerate(("slot", "before")))
    met = rows.join(F.broadcast(known), "slot")
    placed = met.select("doc_id", "text", "times", "hashed", F.explode(F.when(leads, F.array(own, other)).otherwise(F.array(own))).alias("to")).select("to.slot", "to.copy", "doc_id", "text", "times", "hashed")
    w = Window.partitionBy("slot").orderBy("copy", F.desc_nulls_last("doc_id"), "hashed", "text")
    placed = placed.select("slot", F.row_number().over(w).cast("long").alias("k"), F.lag("copy").over(w).alias("was"), "copy", "doc_id", "text", F.lead("text").over(w).alias("after"), "times")
    # of the heads dealt to the range above the first is enough; of equal rows all but the last are followed by themselves
    kept = placed.filter("copy = 0 or was = 0")
    last = F.struct(F.col("after").alias("next_text"), F.lit(1).cast("long").alias("times"), F.lit(1).alias("v"))
    each = F.when(F.col("times") > 1, F.array(F.struct(F.col("text").alias("next_text"), (F.col("times") - 1).alias("times"), F.lit(0).alias("v")), last)).otherwise(F.array(last))
    if hot:
        kept = kept.withColumn("e", F.explode(F.when(F.col("copy") == 0, each).otherwise(F.array(last))))
    else:
        kept = kept.withColumn("e", last)
    found = kept.select("slot", F.when(F.col("copy") == 0, 2 * F.col("k") + F.col("e.v")).alias("place"), "doc_id", "text", F.when(F.col("copy") == 0, F.col("e.next_text")).alias("next_text"), F.col("e.times").alias("times"))
    return found, bool(hot)


def repeated(df: DataFrame, any_: bool) -> DataFrame:
    """Each row as often as its column `times` tells, which goes; the repeats of one row are dealt over tasks."""
    if not any_:
        return df.drop("times")
    parts = df.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS)))).repartition(df.sparkSession.sparkContext.defaultParallelism)
    size = F.least(F.lit(REPEATS), F.col("times") - REPEATS * F.col("at")).cast("int")
    return parts.withColumn("each", F.explode(F.array_repeat(F.lit(0), size))).drop("times", "at", "each")


def edited_neighbours(docs: DataFrame, ranges: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(slot, place, doc_id, text, next_text) of each document, as `in_order`, each row on its own."""
    rows, again = in_order(docs, ranges, hot_rows)
    return repeated(rows.filter("place is not null"), again)


def edited_fingerprints(docs: DataFrame, ranges: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, own, edited, next) of each document: prints as structs (high, low) of its text, its edited text and the next document's text.

    Own prints are made once and handed to the document before; edited texts exist within the stage only.
    """
    rows, again = in_order(docs, ranges, hot_rows)
    edited = F.when(F.col("place").isNotNull(), edit(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited).withColumn("sha", F.unhex(F.sha2(F.encode("edited", "utf-8"), 256)))
    keys = ["slot", "place", "times", "doc_id", "n_chars", "sha"]
    own, other = (F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited")))
    kinds = rows.select(*keys, F.explode(F.when(F.col("place").isNotNull(), F.array(own, other)).otherwise(F.array(own))).alias("k")).select(*keys, "k.kind", "k.text")
    prints = fingerprints(kinds, [*keys, "kind"])
    each = prints.groupBy(*keys).agg(*(F.max(F.when(F.col("kind") == k, F.struct("high", "low"))).alias(c) for k, c in enumerate(("own", "edited"))))
    after = F.lead("own").over(Window.partitionBy("slot").orderBy(F.asc_nulls_last("place")))
    found = each.select("times", "place", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "own", "edited", after.alias("next")).filter("place is not null").drop("place")
    return repeated(found, again)


def edit(text: Column, next_text: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))
