"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards by a hash of id and vector, a task builds one shard and writes it as one file to the shared folder:
ids, vectors and the graphs as flat arrays of neighbour numbers. The queries are written there too; a task opens one shard and
streams a part of the queries past it, so neither graphs nor queries are shuffled. The shards' results are merged.

Inner products are turned into distances between points on a sphere by one more component, which makes every vector as long as the
longest; with vectors of one length that changes nothing. Very unlike lengths would leave no differences, so a shard has a graph
for each band of lengths up to a factor of two, and keeps vectors of bands with few of them in a block that is compared as a
whole. Equal vectors of a shard are one node, which lists their ids, so copies neither flood a graph nor hide one another. While a
graph is built, its last nodes are searched for before they are added, and the width of later searches is raised until they find
RECALL of their nearest nodes. What the graphs find is scored again with the original vectors in double precision.

A vector that is null, empty, of another length than most, zero, or that holds null or non-finite components takes no
part; neither does a row without an id. A row that repeats an id with an equal vector counts once; of an id with several vectors
the best one counts as a candidate, the least one in the order of its components as a query. Extra columns, whatever their names,
are left behind. Without vectors there are no rows.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_in_arrow, work_dir

#: Vectors of a shard, on average.
SHARD_ROWS = 8192
#: Queries that a task holds at a time; tasks for each core at least, where there are few shards.
BLOCK_ROWS, TASKS_PER_CORE = 512, 2
#: Neighbours of a node above the lowest level; twice as many there. Candidates kept while building, and while searching at least.
LINKS, BUILD, SEARCH = 16, 80, 160
#: Vectors of a band of lengths that have a graph at least.
LEAST_NODES = 256
#: Nodes of a graph that the width of its searches is set by, nearest nodes of each, and the share to be found.
PROBES, PROBE_NEAREST, RECALL = 48, 20, 0.97


class Graph:
    """links[level] is an array (nodes, places) of node numbers, -1 where a place is free; nodes are in random order of level."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], levels: np.ndarray, entry: int) -> None:
        self.vectors, self.links, self.levels, self.entry = vectors, links, levels, entry
        self.seen = np.zeros(len(vectors), np.int64)
        self.mark = 0

    def search(self, query: np.ndarray, starts: list[tuple[float, int]], keep: int, level: int) -> list[tuple[float, int]]:
        """The `keep` nearest found from the starts: (distance, node), nearest first."""
        self.mark += 1
        links, seen, mark, vectors = self.links[level], self.seen, self.mark, self.vectors
        for _, node in starts:
            seen[node] = mark
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, n) for d, n in starts]
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= keep:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            for x, n in zip((-(vectors[near] @ query)).tolist(), near.tolist(), strict=True):
                if len(best) < keep:
                    heapq.heappush(best, (-x, n))
                    heapq.heappush(todo, (x, n))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, n))
                    heapq.heappush(todo, (x, n))
        return sorted((-d, n) for d, n in best)

    def descend(self, query: np.ndarray, level: int) -> list[tuple[float, int]]:
        """The nearest node found on the levels above `level`."""
        at = [(-float(self.vectors[self.entry] @ query), self.entry)]
        for above in range(int(self.levels[self.entry]), level, -1):
            at = self.search(query, at, 1, above)
        return at

    def nearest(self, query: np.ndarray, keep: int) -> list[int]:
        return [n for _, n in self.search(query, self.descend(query, 0), keep, 0)]


def spread(vectors: np.ndarray, found: list[tuple[float, int]], places: int) -> list[int]:
    """Neighbours in different directions: one is taken if it is nearer to the node than to any taken before; then the nearest others."""
    nodes = np.array([n for _, n in found])
    between = -(vectors[nodes] @ vectors[nodes].T)
    taken: list[int] = []
    for i, (d, _) in enumerate(found):
        if not taken or d <= between[i, taken].min():
            taken.append(i)
            if len(taken) == places:
                break
    held = set(taken)
    taken += [i for i in range(len(found)) if i not in held][: places - len(taken)]
    return nodes[taken].tolist()


def build(vectors: np.ndarray, links: int = LINKS, keep: int = BUILD, seed: int = 0) -> tuple[Graph, int]:
    """The graph, and how wide searches of it should be. vectors: float32 and of one length, so that a larger inner product is a smaller distance."""
    rng = np.random.default_rng(seed)
    levels = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(links)).astype(np.int64)
    top, wide = int(levels.max()), SEARCH
    graph = Graph(vectors, [np.full((len(vectors), links * (1 + (level == 0))), -1, np.int32) for level in range(top + 1)], levels, 0)
    for node in range(1, len(vectors)):
        if node == len(vectors) - PROBES:
            wide = width(graph, node)
        query, level = vectors[node], int(levels[node])
        at = graph.descend(query, level)
        for below in range(min(level, int(levels[graph.entry])), -1, -1):
            at = graph.search(query, at, keep, below)
            table = graph.links[below]
            mine = spread(vectors, at, links)
            table[node, : len(mine)] = mine
            for other in mine:
                row = table[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    all_ = np.append(row, node)
                    far = -(vectors[all_] @ vectors[other])
                    order = np.argsort(far, kind="stable")
                    kept = spread(vectors, [(float(far[i]), int(all_[i])) for i in order], len(row) - 4)
                    row[:] = -1
                    row[: len(kept)] = kept
        if level > levels[graph.entry]:
            graph.entry = node
    return graph, wide


def width(graph: Graph, size: int) -> int:
    """Candidates that a search keeps so that RECALL of the nearest among the first `size` nodes are found, for queries like the nodes after them."""
    asked = graph.vectors[size:].copy()
    asked[:, -1] = 0.0  # queries aren't lifted
    near = np.argsort(-(asked @ graph.vectors[:size].T), axis=1)[:, :PROBE_NEAREST]
    wide = SEARCH
    while wide < size:
        found = [graph.nearest(q, wide) for q in asked]
        if sum(len(np.intersect1d(a, b)) for a, b in zip(found, near, strict=True)) >= RECALL * near.size:
            break
        wide *= 2
    return wide


def vectors_of(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, size)


def usable(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == size))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return rows.filter(finite & F.exists("v", lambda x: x != 0.0))


def bands_of(vectors: np.ndarray) -> np.ndarray:
    """The power of two nearest to each vector's length, so that lengths of about 1 are one band."""
    most = np.abs(vectors).max(1)
    return np.rint(np.log2(most) + np.log2(np.sqrt(((vectors / most[:, None]) ** 2).sum(1)))).astype(np.int64)


def shard_of(ids: np.ndarray, vectors: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Flat arrays: the ids of node k are ids[first[k]:first[k + 1]], ascending; nodes are float64; of graph b the nodes start[b] to start[b + 1]."""
    vectors = vectors + 0.0  # one zero
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
    again = np.concatenate([[False], ~new[1:] & (ids[1:] == ids[:-1])])
    ids, vectors, new = ids[~again], vectors[~again], new[~again]
    first = np.append(np.flatnonzero(new), len(ids))
    nodes = vectors[first[:-1]]
    band = bands_of(nodes)
    kinds, counts = np.unique(band, return_counts=True)
    large = kinds[counts >= LEAST_NODES]
    rank = np.where(np.isin(band, large), np.searchsorted(large, band), len(large))  # those without a graph come last
    mix = np.lexsort((np.random.default_rng(seed).permutation(len(nodes)), rank))  # a sorted order would build a worse graph
    out = {
        "ids": np.concatenate([ids[first[k] : first[k + 1]] for k in mix]), "first": np.concatenate([[0], np.cumsum(np.diff(first)[mix])]), "nodes": nodes[mix],
        "start": np.searchsorted(rank[mix], np.arange(len(large) + 1)),
    }
    for b in range(len(large)):
        graph, wide = build(lifted(out["nodes"][out["start"][b] : out["start"][b + 1]]), seed=seed)
        out |= {f"links{b}": np.concatenate([x.ravel() for x in graph.links]), f"levels{b}": graph.levels, f"shape{b}": np.array([graph.entry, wide])}
    return out


def index(rows: DataFrame, shards: int, size: int, folder: str) -> DataFrame:
    """(shard int, file string, nodes long) of each shard, whose file below `folder` holds its flat arrays; written to the shared folder. rows: distinct (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard = t["shard"][0].as_py()
        arrays = shard_of(np.asarray(t["id"]), vectors_of(t["v"], size), shard)
        data, name = io.BytesIO(), f"{shard:08}-{uuid.uuid4().hex}.npz"
        np.savez(data, **arrays)
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(data.getbuffer())
        yield pa.record_batch([pa.array([shard], pa.int32()), [name], [len(arrays["nodes"])]], ["shard", "file", "nodes"])

    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    return cut(map_in_arrow(dealt.repartitionById(shards, F.col("shard")), run, "shard int, file string, nodes long"), "hnsw")


def lifted(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors of one length whose inner products with (query, 0) keep the order of the original ones."""
    vectors = vectors / (np.abs(vectors).max() or 1.0)
    square = (vectors * vectors).sum(1)
    scale = float(np.sqrt(square.max())) or 1.0
    rest = np.sqrt(np.maximum(0.0, 1.0 - square / (scale * scale)))
    return np.concatenate([vectors / scale, rest[:, None]], 1).astype(np.float32)


class Shard:
    """A shard's arrays, ready to be searched."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.ids, self.first, self.nodes, self.start = (arrays[k] for k in ("ids", "first", "nodes", "start"))
        self.graphs: list[tuple[int, Graph, int]] = []
        for b in range(len(self.start) - 1):
            vectors, levels, flat, links, at = lifted(self.nodes[self.start[b] : self.start[b + 1]]), arrays[f"levels{b}"], arrays[f"links{b}"], [], 0
            for level in range(int(levels.max()) + 1):
                places = LINKS * (1 + (level == 0))
                links.append(flat[at : at + len(vectors) * places].reshape(-1, places))
                at += len(vectors) * places
            entry, wide = arrays[f"shape{b}"].tolist()
            self.graphs.append((int(self.start[b]), Graph(vectors, links, levels, entry), wide))

    def nearest(self, query_id: int, v: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(id, score) of the k nearest found, without the query's own id."""
        asked = np.append(v / np.abs(v).max(), 0.0).astype(np.float32)
        near = np.concatenate([*(start + np.array(graph.nearest(asked, max(wide, k + 1))) for start, graph, wide in self.graphs), np.arange(self.start[-1], len(self.nodes))]).astype(np.int64)
        exact = (self.nodes[near] * v).sum(1)
        found: list[tuple[float, int]] = []
        for j in np.argsort(-exact, kind="stable"):
            if len(found) > k and exact[j] < found[k][0]:
                break
            # of equal vectors the smallest ids can be among the k nearest, one more for the query's own
            found += [(float(exact[j]), int(x)) for x in self.ids[self.first[near[j]] : self.first[near[j] + 1]][: k + 1]]
        return [(x, s) for s, x in sorted({x: (s, x) for s, x in sorted(found) if x != query_id}.values(), key=lambda y: (-y[0], y[1]))[:k]]


def search(shards: DataFrame, queries: DataFrame, count: int, folder: str, size: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (id, v), without the query's own id."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-TASKS_PER_CORE * cores // count))
    asked = cut(queries.groupBy("id").agg(F.min("v").alias("v")).repartition(parts), "queries")
    files = sorted(asked.inputFiles())  # a path for each of `parts` files
    work = shards.select("shard", "file", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True):
                fs, path = pa.fs.FileSystem.from_uri(folder)
                with fs.open_input_stream(f"{path}/{name}") as stream:
                    shard = Shard(dict(np.load(io.BytesIO(stream.read()))))
                for file in files[part::parts]:
                    own, at = pa.fs.FileSystem.from_uri(file)
                    with own.open_input_file(at) as source:
                        for block in pq.ParquetFile(source).iter_batches(BLOCK_ROWS):
                            vectors = np.asarray(block.column("v").flatten()).reshape(-1, size)
                            out = [(q, x, s) for q, v in zip(block.column("id").to_pylist(), vectors, strict=True) for x, s in shard.nearest(q, v, k)]
                            yield pa.record_batch([pa.array([x[c] for x in out], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "vec_id", "score"])

    met = work.repartitionById(count * parts, (F.col("shard") * parts + F.col("part")).cast("int"))
    found = map_in_arrow(met, run, "query_id long, vec_id long, score double").repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank int, vec_id, score double) of each usable row of `queries`, which has the columns of `df`."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = df.groupBy(F.size(F.col(vector_col)).alias("size")).count().filter("size > 0").orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    rows = cut(usable(df, id_col, vector_col, sizes["size"]).dropDuplicates(["id", "v"]), "vectors")
    n = rows.count()
    if not n:
        return empty
    count, folder = max(1, -(-n // shard_rows)), work_dir(spark, "shards")
    return search(index(rows, count, sizes["size"], folder), usable(queries, id_col, vector_col, sizes["size"]), count, folder, sizes["size"], k)
