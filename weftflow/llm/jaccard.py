"""N-gram Jaccard join: the components that links between documents with alike shingle sets form. The links are not given.

1. Shingles are hashed to 64 bits; equal sets are one class from here on, so copies cost nothing.
2. Candidates. Bands of set sizes are such that linked sets lie in one band or in two that adjoin. In the lower band of
   a pair, linked sets differ in at most d shingles, d known from the band. The hash space is cut into d + 1 parts and
   some more; at least one part that isn't empty is then the same in both sets. (A set that leaves more parts empty than
   there are spare ones, a matter of luck in very few, meets others at its empty parts too.) Sets meet where a part is the same, and
   each is tied to the first set there, which gives candidate clusters that no link leaves. Nothing is emitted per pair.
   Shingles that many texts share, of which a sample tells most, are left out of the parts, so that a common passage
   ties few documents.
3. Tiles. A cluster's sets go into tiles by size band (and by hash where a band holds more than a tile's worth). In a
   tile, bitmap signatures are compared: every bit set in one signature only stands for at least one shingle outside the
   intersection, so bit counts bound the overlap from above. Pairs that may link are decided by intersecting the sorted
   arrays. Pairs in the same component aren't compared any more.
   Clusters beyond one tile are parted anew by keys without the shingles that are common within them, as long as that helps:
   the larger a table is, the more unlike texts are tied through what some others share.
4. Clusters of one tile are then done. In larger ones the tiles' components are joined through delegates, level by level.
   Clusters whose components still differ are parted anew by keys without the shingles that are common within them, and pairs
   of tiles whose components differ are compared in full.

Nulls: a null text is empty; empty texts have no shingles and link with nothing. A null id gets the component of equal
sets with an id, else null. Rows that repeat an id are one document: reachability is between ids. Extra columns are left
behind. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, forget, map_in_arrow, remove, slices, work_dir
from .components import components

U = np.uint64
#: Sets of a tile, shingles of a tile.
TILE_SETS, TILE_SHINGLES = 1024, 2_000_000
#: Members of each component of a tile that meet those of other tiles first.
DELEGATES = 4
#: Rows of up to 40 bytes that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Standard deviations by which the parts that a set fills may fall below their mean.
FEW_FILLED = 5.0
#: Bits of a bitmap signature, at most.
MOST_BITS = 8192
#: Documents of the sample in which common shingles are looked for, about; texts that share a common one at least; common ones at most.
SAMPLE_DOCS, COMMON_TEXTS, MOST_COMMON = 32_768, 12, 200_000
#: Share of a large cluster's labels that a round of delegates must merge for another one.
WORTH_A_ROUND = 0.05
#: Ranges of keys whose meetings are shuffled one after another, where these have more rows than that; their bits in a key.
KEY_RANGES, FEW_MEETINGS, RANGE_BITS = 4, 512, 2
#: Share of the sets in large clusters that parting them anew must free for another time.
WORTH_PARTING = 0.2
#: Words whose hashes a task keeps; keys that it brings together before they are shuffled; numbers of an array.
KEPT_WORDS, COMBINED_KEYS, ARRAY = 100_000, 500_000, 8192
#: Shingles that a task counts together before they are shuffled.
COUNTED_SHINGLES = 4_000_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class WordHashes(dict):
    """Hashes by word, of KEPT_WORDS words at most; one for each task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, size: int, known: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; with fewer words of the whole sequence; without words none.

    Letters A to Z are lower-cased; words are what stands between the six ASCII white-space characters.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    known = WordHashes() if known is None else known
    hashes = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, U)
        for i in range(n):
            total = mix(total * U(0x100000001B3) ^ hashes[i : len(words) - n + 1 + i], i)
    return np.unique(total)


@functools.lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """The least size of each band: sets of which one's size is at least percent/100 of the other's are at most one band apart."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    return np.array(low, np.int64)


def band_of(n: int, percent: int) -> int:
    return int(np.searchsorted(bands(percent), n, side="right")) - 1


@functools.lru_cache(maxsize=4096)
def parts_of(band: int, percent: int) -> tuple[int, int]:
    """(d, spare): shingles in which sets that link differ at most, if the smaller lies in this band; parts beyond d + 1.

    With enough spare parts hardly any set leaves more than `spare` of them empty: the parts that n shingles fill are d + 1
    at least up to FEW_FILLED standard deviations below their mean. Otherwise many unlike sets would meet at empty parts.
    """
    n, most = int(bands(percent)[band]), int(bands(percent)[band + 1]) - 1
    d = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    spare = 1
    while spare <= 4 * n + 8:
        k = d + 1 + spare
        load = n / k
        empty = math.exp(-load)
        if k * (1 - empty) - FEW_FILLED * math.sqrt(max(0.0, k * empty * (1 - (1 + load) * empty))) >= d + 1:
            break
        spare += 1 + spare // 16
    return d, spare


def meeting_keys(found: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Keys such that linked sets that differ have one in common at least.

    Shingles in `common`, whatever they are, can be left out of the parts: what is left of two sets differs in no more
    shingles than they do. A set that doesn't fill d + 1 parts then meets others at the parts of all its shingles too.
    """
    rest = found
    if common is not None and len(common):
        at = np.searchsorted(common, found)
        at[at == len(common)] = 0
        rest = found[common[at] != found]
    keys, own = [], band_of(len(found), percent)
    for band in {own, max(0, own - 1)}:
        d, spare = parts_of(band, percent)
        if d == 0:  # such sets link only if they are equal
            continue
        k = d + 1 + spare
        for whole, s in ((0, rest), (1, found)):
            mark = U((band << 40) + (whole << 39))
            part = ((s >> U(32)) * U(k)) >> U(32)  # grows with the hash
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(s) else np.zeros(0, np.int64)
            if len(starts):
                with np.errstate(over="ignore"):
                    keys.append(mix(np.add.reduceat(mix(s, 3), starts) ^ mix(part[starts] + mark, 5), 7))
            if len(starts) > d:
                break
        else:  # so many empty parts that only empty ones may agree
            empty = np.setdiff1d(np.arange(k, dtype=U), part[starts])
            keys.append(mix(mix(empty + mark, 5), 7))
    return np.concatenate(keys) if keys else np.zeros(0, U)


def common_shingles(docs: DataFrame, size: int, n: int | None = None) -> np.ndarray:
    """Sorted hashes of shingles that many different texts of a bounded sample share, MOST_COMMON at most.

    They only spare needless meetings, whichever they are: links don't depend on them. So a sample drawn by a hash of the text will do. `n` is the number of documents, if known.
    """
    n = docs.count() if n is None else n
    share = min(1_000_000, -(-SAMPLE_DOCS * 1_000_000 // max(n, 1)))
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            yield pa.record_batch([long(np.concatenate([shingles(t, size, known) for t in batch.column(0).to_pylist()]))], ["h"])

    counted = map_in_arrow(texts.dropDuplicates(["text"]), run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON_TEXTS)
    found = counted.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toPandas()["h"].to_numpy(np.int64)
    forget(docs.sparkSession)  # the sample's shingles
    return np.sort(found.view(U))


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Meetings:
    """Keys and the nodes that have them, brought together within a task, so that a key in very many nodes is shuffled once for each block."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, node: int) -> None:
        self.keys.append(keys)
        self.nodes.append(np.full(len(keys), node, np.int64))
        self.held += len(keys)

    def full(self) -> bool:
        return self.held >= COMBINED_KEYS

    def take(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(MET, keys, least node of each) and (TIED, nodes, the least node that shares a key), in arrays of ARRAY numbers."""
        if not self.held:
            return
        keys, nodes = np.concatenate(self.keys).view(np.int64), np.concatenate(self.nodes)
        self.__init__()
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = nodes[new]
        least = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(keys))))
        ties = np.unique(np.stack([nodes, least])[:, nodes != least], axis=1)
        met = keys[new]
        edges = [0, *np.searchsorted(met >> (64 - RANGE_BITS), np.arange(1 - KEY_RANGES // 2, KEY_RANGES // 2)).tolist(), len(met)]
        for kind, a, b in (*((MET, met[i:j], first[i:j]) for i, j in zip(edges, edges[1:], strict=False)), (TIED, *ties)):
            for i in range(0, len(a), ARRAY):
                yield kind, a[i : i + ARRAY], b[i : i + ARRAY]

    def rows(self) -> list[pa.Array]:
        """The columns (kind, a, b) of what `take` gives: TIED, or MET less the number of the keys' range."""
        found = [(kind - (int(a[0] >> (64 - RANGE_BITS)) + KEY_RANGES // 2) if kind == MET else kind, a, b) for kind, a, b in self.take()]
        return [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]


#: Kinds of rows that hold ties and meetings; the latter's are MET and less, one for each range of keys.
TIED, MET = -1, -2


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, a, b, kind): the set's number of shingles and two hashes of it; other rows, of a kind below 0, hold the meetings of the sets' keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))  # MOST_COMMON hashes at most
    names, none = ["doc_id", "n", "h1", "h2", "a", "b", "kind"], pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), Meetings()

        def meetings() -> pa.RecordBatch:
            kinds, a, b = met.rows()
            gone = pa.nulls(len(kinds), pa.int64())
            return pa.record_batch([gone, gone, gone, gone, a, b, kinds], names)

        for batch in slices(batches):
            sets = [shingles(t, size, known) for t in batch.column(1).to_pylist()]
            with np.errstate(over="ignore"):
                h1, h2 = (np.array([mix(s, k).sum(dtype=U) for s in sets], U) for k in (11, 13))
            for s, node in zip(sets, h1.view(np.int64).tolist(), strict=True):
                if len(s):
                    met.add(meeting_keys(s, percent, shared.value), node)
            gone = pa.nulls(len(sets), none)
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), long(h1), long(h2), gone, gone, pa.array([0] * len(sets), pa.int64())], names)
            if met.full():
                yield meetings()
        if met.held:
            yield meetings()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_in_arrow(rows, run, "doc_id long, n long, h1 long, h2 long, a array<long>, b array<long>, kind long")


def by_kind(rows: DataFrame, name: str) -> DataFrame:
    """Written and read back as `cut` does, with a folder for each kind, so that the meetings can be deleted once they are tied."""
    path = f"{work_dir(rows.sparkSession, name)}/table"
    rows.write.partitionBy("kind").parquet(path)
    found = rows.sparkSession.read.schema(rows.schema).parquet(path)
    found.cut_path = path
    return found


def tied(rows: DataFrame) -> DataFrame:
    """(a, b): nodes that share a key, from rows (kind, a, b) that `by_kind` gave, whose meetings are gone then.

    Of each key there is a row for each block of a task at most. Where there are many, a range of keys is shuffled at a time, and what it takes of the disk is freed before the next.
    """
    spark, pairs = rows.sparkSession, lambda where: rows.filter(where).select(F.inline(F.arrays_zip("a", "b")))
    # the first node at each key; the frame ends at the current row, so a key's rows pass by one at a time
    w = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = lambda where: pairs(where).withColumn("first", F.first("b").over(w)).filter("b <> first").select(F.col("b").alias("a"), F.col("first").alias("b"))
    kinds = [MET - i for i in range(KEY_RANGES)]
    found = pairs(F.col("kind") == TIED)
    for chosen in ([kinds] if rows.filter(F.col("kind") <= MET).count() <= FEW_MEETINGS else [[k] for k in kinds]):
        found = found.unionAll(cut(ties(F.col("kind").isin(chosen)), "ties"))
        for k in chosen:
            remove(spark, f"{rows.cut_path}/kind={k}")
        if len(chosen) == 1:
            forget(spark)
    return found


def candidate_clusters(sigs: DataFrame) -> DataFrame:
    """(h1, cluster): sets that meet, directly or through others. Sets that meet no other are left out."""
    return components(tied(sigs), "candidates").select(F.col("node").alias("h1"), F.col("component").alias("cluster"))


def beyond_a_tile(wanted: DataFrame) -> DataFrame:
    return wanted.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s")).filter((F.col("m") > TILE_SETS) | (F.col("s") > TILE_SHINGLES)).select("cluster")


def parted(docs: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """`wanted` (rep, h1, h2, n, cluster) with clusters beyond one tile parted anew, without the sets that then meet no other.

    What is common is looked for in a sample of these clusters' sets alone, so it is less and less that ties unlike sets. Linked sets
    lie in one cluster and meet by keys without whatever is common, so no link is lost.
    """
    texts, before = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")), math.inf
    while True:
        large = cut(wanted.join(beyond_a_tile(wanted), "cluster").select(*wanted.columns), "beyond")
        count = large.count()
        if not count or count > (1 - WORTH_PARTING) * before:
            return wanted
        before = count
        side = large.select("rep", "h1", "cluster")
        held = texts.join(F.broadcast(side) if count <= BROADCAST_ROWS else side, "rep").select("text", "h1", "cluster")
        shared = docs.sparkSession.sparkContext.broadcast(common_shingles(held, size, count))

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, met = WordHashes(), Meetings()
            for batch in slices(batches):
                for text, h1, cluster in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = shingles(text, size, known)
                    with np.errstate(over="ignore"):
                        # another text of the same id has other hashes
                        if int(mix(found, 11).sum(dtype=U).view(np.int64)) == h1:
                            met.add(mix(meeting_keys(found, percent, shared.value) ^ U(cluster & 0xFFFFFFFFFFFFFFFF), 17), h1)
                if met.full():
                    yield pa.record_batch(met.rows(), ["kind", "a", "b"])
            if met.held:
                yield pa.record_batch(met.rows(), ["kind", "a", "b"])

        rows = by_kind(map_in_arrow(held, meet, "kind long, a array<long>, b array<long>"), "meetings")
        groups = components(tied(rows), "parted").select(F.col("node").alias("h1"), F.col("component").alias("cluster"))
        again = large.drop("cluster").join(groups, "h1").select(*wanted.columns)
        wanted = cut(wanted.join(beyond_a_tile(wanted), "cluster", "left_anti").select(*wanted.columns).unionAll(again), "clustered")
        forget(docs.sparkSession)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; bits beyond twice the largest set don't help."""
    bits = min(MOST_BITS, max(64, 1 << (2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), bits // 64), U)
    for row, s in zip(out, sets, strict=True):
        at = s & U(bits - 1)
        np.bitwise_or.at(row, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def link_tile(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """The labels after merging those that a link joins. Every pair of different labels is decided, by its bound or exactly."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, size = [sets[i] for i in order], np.array([len(sets[i]) for i in order], np.int64)
    label, bits = labels[order].copy(), bitmaps(sets)
    for i in range(1, len(sets)):
        n = size[i]
        low = int(np.searchsorted(size, -(-percent * n // 100)))
        other = low + np.flatnonzero(label[low:i] != label[i])
        if not len(other):
            continue
        mine, theirs = bits[i], bits[other]
        most = np.minimum(size[other] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64), n - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64))
        may = np.flatnonzero(100 * most >= percent * (size[other] + n - most))
        for j in other[may[np.argsort(-most[may], kind="stable")]]:
            if label[j] == label[i]:
                continue
            both = overlap(sets[i], sets[j])
            if 100 * both >= percent * (size[j] + n - both):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    back = np.empty_like(label)
    back[order] = label
    return back


def decide_tiles(members: DataFrame, percent: int) -> DataFrame:
    """(cluster, item, label): the items of each tile of two or more, and the smallest item that links in the tile lead to.

    members: (tile, cluster, item, shingles binary); sets of one item aren't compared. A tile's rows stand together, so a task holds one tile at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(cluster: int, rows: set[tuple]) -> pa.RecordBatch:
            rows = sorted(rows)
            items = np.array([x for x, _ in rows], np.int64)
            labels = link_tile([np.frombuffer(s, U) for _, s in rows], items, percent)
            items, first = np.unique(items, return_index=True)
            return pa.record_batch([pa.array([cluster] * len(items), pa.int64()), pa.array(items), pa.array(labels[first])], ["cluster", "item", "label"])

        at, held = None, set()
        for batch in slices(batches):
            for tile, cluster, item, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (tile, cluster):
                    if held:
                        yield decided(at[1], held)
                    at, held = (tile, cluster), set()
                held.add((item, data))
        if held:
            yield decided(at[1], held)

    rows = members.select("tile", "cluster", "item", "shingles")
    return map_in_arrow(rows.repartition("tile").sortWithinPartitions("tile", "cluster"), run, "cluster long, item long, label long")


def linked(docs: DataFrame, classes: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """(cluster, rep, label): class representatives and the smallest one of their component."""
    wanted = parted(docs, cut(classes.join(clusters, "h1").filter("rep is not null").select("rep", "h1", "h2", "n", "cluster"), "clustered"), size, percent)
    low = [int(x) for x in bands(percent)]
    count, top = wanted.agg(F.count("*"), F.max("n")).first()
    band = sum(((F.col("n") >= x).cast("int") for x in low if x <= (top or 0)), F.lit(-1))
    wanted = wanted.withColumn("band", band)
    each = wanted.groupBy("cluster", "band").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    whole = each.groupBy("cluster").agg(F.sum("m").alias("all_m"), F.sum("s").alias("all_s"))
    one = (F.col("all_m") <= TILE_SETS) & (F.col("all_s") <= TILE_SHINGLES)
    room = F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("s") / TILE_SHINGLES))
    plan = each.join(whole, "cluster").select("cluster", "band", one.alias("one"), F.when(one, F.lit(1)).otherwise(room).cast("int").alias("tiles"))
    tile = F.when(F.col("one"), F.xxhash64("cluster", F.lit(-1))).otherwise(F.xxhash64("cluster", "band", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("tiles"))))
    wanted = cut(wanted.join(plan, ["cluster", "band"]).withColumn("tile", tile).select("rep", "h1", "h2", "cluster", "band", "one", "tile"), "tiled")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, known = ["tile", "cluster", "band", "one", "item"], WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, size, known) for t in batch.column("text").to_pylist()]
            with np.errstate(over="ignore"):
                h = np.array([(mix(s, 11).sum(dtype=U), mix(s, 13).sum(dtype=U)) for s in sets], U).reshape(-1, 2).view(np.int64)
            same = (h[:, 0] == batch.column("h1").to_numpy()) & (h[:, 1] == batch.column("h2").to_numpy())
            data = pa.array([s.tobytes() if ok else None for s, ok in zip(sets, same, strict=True)], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in kept), data], [*kept, "shingles"])

    # the clustered ids are broadcast if they are few enough, else the texts are shuffled to them
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def found(those: DataFrame) -> DataFrame:
        side = F.broadcast(those) if count <= BROADCAST_ROWS else those
        return map_in_arrow(texts.join(side, "rep").withColumnRenamed("rep", "item"), arrays, "tile long, cluster long, band int, one boolean, item long, shingles binary").filter("shingles is not null")

    large = wanted.filter("not one")
    if large.isEmpty():
        return decide_tiles(found(wanted), percent).select("cluster", F.col("item").alias("rep"), "label")
    done = cut(decide_tiles(found(wanted.filter("one")), percent).select("cluster", F.col("item").alias("rep"), "label"), "done")
    forget(docs.sparkSession)
    # sets of clusters of several tiles are kept, as they are read more than once
    held = cut(found(large).drop("one"), "large-sets")
    merged = cut(merge_tiles(held, cut(decide_tiles(held, percent).select("cluster", F.col("item").alias("rep"), "label"), "labels"), percent), "merged-labels")
    drop(held)
    forget(docs.sparkSession)
    return done.unionAll(merged)


def merge_tiles(held: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The labels (cluster, rep, label) after joining the tiles of each cluster.

    Delegates of each label meet in tiles, all of a label in one, as long as a round merges many labels. The sets of clusters that
    are open then meet again by keys without the shingles that are common among them, which parts most of them (`regrouped`);
    what still meets is compared in full where labels differ.
    """
    level = 0
    while True:
        open_ = labels.groupBy("cluster").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("cluster")
        if open_.isEmpty():
            return labels
        level += 1
        chosen = labels.join(open_, "cluster").groupBy("cluster", "label").agg(*(F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep")).alias(f"d{k}") for k in range(DELEGATES)))
        chosen = chosen.select("cluster", F.col("label"), F.explode(F.array_distinct(F.array(*(F.col(f"d{k}.rep") for k in range(DELEGATES))))).alias("item"))
        met = delegates = cut(held.drop("tile", "band").join(chosen, ["cluster", "item"]), "delegates")
        tiles = met.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum(F.octet_length("shingles")) / (8 * TILE_SHINGLES))).cast("int").alias("tiles"))
        met = met.join(tiles, "cluster").withColumn("tile", F.xxhash64("cluster", F.pmod(F.xxhash64("label", F.lit(level)), "tiles"))).select("tile", "cluster", F.col("label").alias("item"), "shingles")
        merged = cut(decide_tiles(met, percent).filter("item <> label").select("cluster", F.col("item").alias("label"), F.col("label").alias("to")), "merged")
        drop(delegates)
        count, merges = labels.join(open_, "cluster").select("label").distinct().count(), merged.count()
        if merges:
            labels = cut(labels.join(merged, ["cluster", "label"], "left").select("cluster", "rep", F.coalesce("to", "label").alias("label")), "labels")
        if merges < WORTH_A_ROUND * count:
            left = held.join(open_, "cluster").join(labels.withColumnRenamed("rep", "item"), ["cluster", "item"])
            links = cross_links(regrouped(left, percent), percent)
            merged = components(links.select(F.col("item").alias("a"), F.col("label").alias("b")), "cross").select(F.col("node").alias("label"), F.col("component").alias("to"))
            return labels.join(merged, "label", "left").select("cluster", "rep", F.coalesce("to", "label").alias("label"))


def regrouped(labelled: DataFrame, percent: int) -> DataFrame:
    """(cluster, band, tile, item, label, shingles) in new, smaller clusters: those of sets that meet by keys without what is common in theirs.

    Shingles are counted over all sets of the clusters that are left; so many times as often as COMMON_TEXTS, or more where there
    would be over MOST_COMMON of them, is common. Left out may be any: linked sets still meet.
    """
    labelled = cut(labelled.select("cluster", "band", "item", "label", "shingles"), "open-sets")
    long_ = pa.int64()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(h, long_), pa.array(n, long_)], ["h", "n"])

        for batch in slices(batches):
            held += [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            many += sum(map(len, held[-batch.num_rows :]))
            if many >= COUNTED_SHINGLES:
                yield counted()
                held, many = [], 0
        if held:
            yield counted()

    total = labelled.agg(F.sum(F.octet_length("shingles") / 8)).first()[0] or 0
    counted = map_in_arrow(labelled.select("shingles"), counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # those with so many of all shingles each are MOST_COMMON at most
    found = counted.filter(F.col("n") >= max(COMMON_TEXTS, math.ceil(total / MOST_COMMON))).select("h").toPandas()["h"].to_numpy(np.int64)
    shared = labelled.sparkSession.sparkContext.broadcast(np.sort(found.view(U)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Meetings()
        for batch in slices(batches):
            for cluster, item, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with np.errstate(over="ignore"):
                    met.add(mix(meeting_keys(np.frombuffer(data, U), percent, shared.value) ^ U(cluster & 0xFFFFFFFFFFFFFFFF), 17), item)
            if met.full():
                yield pa.record_batch(met.rows(), ["kind", "a", "b"])
        if met.held:
            yield pa.record_batch(met.rows(), ["kind", "a", "b"])

    forget(labelled.sparkSession)
    rows = by_kind(map_in_arrow(labelled.select("cluster", "item", "shingles"), meet, "kind long, a array<long>, b array<long>"), "meetings")
    groups = components(tied(rows), "regrouped").select(F.col("node").alias("item"), F.col("component").alias("group"))
    sets = cut(labelled.drop("cluster").join(groups, "item").withColumnRenamed("group", "cluster"), "regrouped-sets")
    drop(labelled)
    forget(sets.sparkSession)
    each = sets.groupBy("cluster", "band").agg(F.count("*").alias("m"), F.sum(F.octet_length("shingles") / 8).alias("s"))
    plan = each.select("cluster", "band", F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("s") / TILE_SHINGLES)).alias("tiles"))
    return sets.join(plan, ["cluster", "band"]).withColumn("tile", F.xxhash64("cluster", "band", F.pmod(F.xxhash64("item", F.lit(7)), F.col("tiles")))).drop("tiles")


def cross_links(labelled: DataFrame, percent: int) -> DataFrame:
    """(cluster, item, label) of labels that links merge, for each tile and for each two of one band or of adjoining ones that hold different labels."""
    labelled = cut(labelled, "cross-sets")
    tiles = cut(labelled.groupBy("cluster", "band", "tile").agg(F.min("label").alias("least"), F.max("label").alias("most")), "tiles")
    other = tiles.select("cluster", *(F.col(c).alias(f"other_{c}") for c in ("band", "tile", "least", "most")))
    near = (F.col("other_band") - F.col("band")).isin(0, 1) & ((F.col("band") < F.col("other_band")) | (F.col("tile") <= F.col("other_tile")))
    pairs = tiles.join(other, "cluster").filter(near & ((F.col("least") != F.col("other_most")) | (F.col("most") != F.col("other_least"))))
    to = pairs.select(F.xxhash64("tile", "other_tile").alias("to"), F.explode(F.array_distinct(F.array("tile", "other_tile"))).alias("tile"))
    met = labelled.join(to, "tile").select(F.col("to").alias("tile"), "cluster", F.col("label").alias("item"), "shingles")
    return decide_tiles(met, percent).filter("item <> label")


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_equal) of each row of (doc_id, text).

    Sets link when 100 * intersection >= percent * union. component_id is the smallest id that links reach; n_equal is the
    number of rows with an equal set. Neither the links nor their number is given: pairs within a component aren't compared.
    """
    met = by_kind(signatures(docs, size, percent), "signatures")
    sigs = met.filter("kind = 0").select("doc_id", "n", "h1", "h2")
    classes = cut(sigs.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_equal")), "classes")
    labels = cut(linked(docs, classes, candidate_clusters(met), size, percent).select("rep", "label").distinct(), "linked")
    ids = sigs.filter("n > 0").select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"])
    named = ids.join(labels, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), "n_equal")
    # an id that is repeated with sets of different components joins them
    twice = sigs.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    if not twice.isEmpty():
        again = components(named.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionAll(labels.select(F.col("rep").alias("a"), F.col("label").alias("b"))), "repeated")
        rows = sigs.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "n_shingles", "rep", "n_equal")
        named = rows.join(again, F.coalesce("doc_id", "rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "n_equal")
    empty = sigs.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_equal"))
    return named.unionAll(empty)
