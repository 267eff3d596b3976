"""Large CSV files and JSON documents over many tasks: what a range means follows from all ranges before it.

Whether a place in a file is within quotes, and how deep it is nested, depends on the whole file before it. So each range
first tells what it does to either assumption at its start; a prefix over a file's ranges, as windows over one row a range, turns that
into facts; then ranges are cut into records apart from one another. Only the first and last record of a range may need its
neighbours: these parts are few, and are joined by range numbers.

Ranges are those in which Spark's text reader splits files, so any store that Spark reads will do. The passes over a file must
see the same ranges: a range that was not seen before is an error, not a wrong row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import cut

CHANGED = "the ranges of a file changed between two passes over it; fix them by spark.sql.files.minPartitionNum"


def lines(spark: SparkSession, path: str | list[str], separator: str = "\n") -> DataFrame:
    """(file, start, value): the parts of files between separators, with the range that each begins in, in the order of the file within a range."""
    return spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches of one range each, with the range's columns `file` and `start`; those of a range follow one another."""
    for batch in batches:
        starts, names = batch.column("start").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(names) != 0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges, edges[1:], strict=False):
            yield (batch.column("file")[a].as_py(), int(starts[a])), batch.slice(a, b - a)


def known(rows: DataFrame, states: DataFrame) -> DataFrame:
    """The rows with their range's state. There is one state a range, that is one for each task or less, so they may be broadcast."""
    return rows.join(F.broadcast(states), ["file", "start"], "left")


def check(batch: pa.RecordBatch) -> None:
    if "seen" in batch.schema.names and not batch.column("seen")[0].as_py():
        raise ValueError(CHANGED)


# CSV --------------------------------------------------------------------------------------------------------------------


class Quoting:
    """Whether a line ends within quotes, if it begins at a record (`closes`) or within quotes (`leaves`).

    A quote opens a field only as its first character; quotes are doubled within; after the closing one all up to the delimiter belongs to the field.
    """

    def __init__(self, delimiter: str) -> None:
        d = re.escape(delimiter)
        field = rf'(?:"(?:[^"]++|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)'
        self.closes = re.compile(rf"{field}(?:{d}{field})*+", re.DOTALL).fullmatch
        self.leaves = re.compile(rf'(?:[^"]++|"")*+"[^{d}]*+(?:{d}{field})*+', re.DOTALL).fullmatch

    def step(self, line: str, within: bool) -> bool:
        return not (self.leaves if within else self.closes)(line)


def quoted_lines(batch: pa.RecordBatch) -> list[int]:
    """The places of the lines that hold a quote; others change nothing."""
    return np.flatnonzero(pc.match_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)).tolist()


def csv_states(rows: DataFrame, delimiter: str) -> DataFrame:
    """(file, start, within, after, seen): whether a range begins within quotes, and whether it ends so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoting, at, ends = Quoting(delimiter), None, [False, True]
        of = lambda at, ends: pa.record_batch([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]])], ["file", "start", "plain", "quoted"])
        for key, batch in runs(batches):
            if key != at:
                if at:
                    yield of(at, ends)
                at, ends = key, [False, True]
            values = batch.column("value")
            for i in quoted_lines(batch):
                line = values[i].as_py()
                ends = [quoting.step(line, e) for e in ends] if ends[0] != ends[1] else [quoting.step(line, ends[0])] * 2
        if at:
            yield of(at, ends)

    each = rows.mapInArrow(run, "file string, start long, plain boolean, quoted boolean")
    # a range either settles how it ends, or turns the state about, or leaves it: the last settled end counts, and the turns since
    settled, turn = F.col("plain") == F.col("quoted"), (F.col("plain") & ~F.col("quoted")).cast("int")
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    counted = each.withColumn("turns", F.sum(turn).over(upto))
    counted = counted.withColumn("base", F.when(settled, (F.col("plain").cast("int") + F.col("turns")) % 2))
    ends = (F.coalesce(F.last("base", ignorenulls=True).over(upto), F.lit(0)) + F.col("turns")) % 2 == 1
    ended = counted.withColumn("after", ends)
    return ended.select("file", "start", F.coalesce(F.lag("after").over(Window.partitionBy("file").orderBy("start")), F.lit(False)).alias("within"), "after", F.lit(True).alias("seen"))


class Cutter:
    """The records of one range, line by line; what belongs to records of other ranges as well is kept apart as parts."""

    def __init__(self, quoting: Quoting, at: tuple[str, int], within: bool) -> None:
        self.quoting, self.at, self.within = quoting, at, within
        self.head, self.led, self.held, self.parts = within, at[1] > 0, [], []

    def close(self, tail: bool) -> None:
        self.parts.append((*self.at, tail, "\n".join(self.held), tail and not self.led))
        self.held = []

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """The batch's records as (record, leads)."""
        values, done, out = batch.column("value"), 0, []
        for i in [*quoted_lines(batch), len(values)]:
            if self.within:
                self.held.extend(values.slice(done, i - done).to_pylist())
            elif i > done:
                out.append(values.slice(done, i - done))
            done = i + 1
            if i == len(values):
                break
            line = values[i].as_py()
            after = self.quoting.step(line, self.within)
            if not self.within and not after:
                out.append(values.slice(i, 1))
            else:
                self.held.append(line)
                if not after and self.head:
                    self.close(False)
                    self.head = False
                elif not after:
                    out.append(pa.array(["\n".join(self.held)], values.type))
                    self.held = []
            self.within = after
        if not out:
            return None
        records = pa.concat_arrays(out)
        leads = np.zeros(len(records), bool)
        if not self.led:
            full = np.flatnonzero(pc.not_equal(pc.utf8_rtrim(records, "\r"), "").to_numpy(zero_copy_only=False))
            leads[full[:1]] = True
            self.led = len(full) > 0
        return pa.record_batch([records, pa.array(leads)], ["record", "leads"])

    def end(self) -> list[tuple]:
        if self.within:
            self.close(not self.head)
        return self.parts


def cut_lines(found: DataFrame, delimiter: str, parts: bool) -> DataFrame:
    """The records of ranges with states: (record, leads) of those that begin and end within a range, or, as `parts`, (file, start, tail, record, leads) of the others.

    A part is what a range holds of a record that began before it, or of one that isn't ended in it (`tail`). `leads` tells a file's first record.
    """
    names = ["file", "start", "tail", "record", "leads"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoting, now = Quoting(delimiter), None

        def ended() -> Iterator[pa.RecordBatch]:
            if now and parts and (rows := now.end()):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for key, batch in runs(batches):
            if now is None or key != now.at:
                check(batch)
                yield from ended()
                now = Cutter(quoting, key, batch.column("within")[0].as_py())
            whole = now.add(batch)
            if whole and not parts:
                yield whole
        yield from ended()

    return found.mapInArrow(run, "file string, start long, tail boolean, record string, leads boolean" if parts else "record string, leads boolean")


def joined(parts: DataFrame, *more: Column) -> DataFrame:
    """(file, first, text, *more) of records over several ranges: a tail and what follows it up to the next one. `more` are taken from the tail."""
    order = Window.partitionBy("file").orderBy("start", "tail").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("grp", F.sum(F.col("tail").cast("int")).over(order))
    text = F.transform(F.sort_array(F.collect_list(F.struct("start", "tail", "record"))), lambda x: x["record"])
    return numbered.groupBy("file", "grp").agg(text.alias("texts"), *more)


def csv_records(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """(record, leads): the records of CSV files, with line feeds within quotes, read in ranges; `leads` tells the first of each file.

    A first pass finds how each range begins; it runs when this is called. Where records lie over ranges, these ranges are read once more.
    """
    rows = lines(spark, path)
    states = cut(csv_states(rows, delimiter), "ranges")
    whole = cut_lines(known(rows, states), delimiter, parts=False)
    over = states.filter("within or after")
    if over.isEmpty():
        return whole
    parts = cut_lines(rows.join(F.broadcast(over), ["file", "start"]), delimiter, parts=True)
    return whole.unionByName(joined(parts, F.max("leads").alias("leads")).select(F.array_join("texts", "\n").alias("record"), "leads"))


# JSON documents ---------------------------------------------------------------------------------------------------------

ESCAPED = re.compile(rb"\\.", re.DOTALL)
KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)
QUOTE, COMMA = 0x22, 0x2C
OPENING, CLOSING = (0x7B, 0x5B), (0x7D, 0x5D)


def outside(data: bytes, within: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """The bytes, which of them lie outside of strings, and whether the end lies within one."""
    raw = np.frombuffer(ESCAPED.sub(b"  ", data) if b"\\" in data else data, "u1")
    quotes = raw == QUOTE
    state = (np.cumsum(quotes) + within) & 1
    return raw, (state == 0) & ~quotes, bool(state[-1]) if len(state) else within


def steps(raw: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What each byte adds to the depth."""
    return (out & np.isin(raw, OPENING)).astype("i8") - (out & np.isin(raw, CLOSING))


def data_of(batch: pa.RecordBatch, separator: str) -> bytes:
    """A batch's parts of a file with their separators. Behind a file's last part one may be too many, where it changes nothing any more."""
    return "".join(v + separator for v in batch.column("value").to_pylist()).encode()


def json_states(rows: DataFrame, separator: str) -> DataFrame:
    """(file, start, within, depth, lead, seen) of each range: whether it begins in a string, how deep, and the file's first character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, [False, 0, 0, ""]

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x], t) for x, t in zip((*at, *now), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "start", "turns", "plain", "quoted", "lead"])

        for key, batch in runs(batches):
            if key != at:
                if at:
                    yield row()
                at, now = key, [False, 0, 0, ""]
            data = data_of(batch, separator)
            for k in (0, 1):  # what the range adds to the depth if it begins outside of strings, and within one
                raw, out, end = outside(data, now[0] != bool(k))
                now[1 + k] += int(steps(raw, out).sum())
            now[0] = end != True  # noqa: E712  the second assumption's end is the first one's contrary
            now[3] = now[3] or data.decode().lstrip("﻿ \t\r\n")[:1]
        if at:
            yield row()

    each = rows.mapInArrow(run, "file string, start long, turns boolean, plain long, quoted long, lead string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    within = each.withColumn("within", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    depth = F.coalesce(F.sum(F.when(F.col("within"), F.col("quoted")).otherwise(F.col("plain"))).over(before), F.lit(0).cast("long"))
    lead = F.first("lead").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return within.select("file", "start", "within", depth.alias("depth"), lead.alias("lead"), F.lit(True).alias("seen"))


class Walk:
    """The items of arrays at one depth in a range, and the brackets that open at it; a range's first and last item may belong to others as well."""

    def __init__(self, level: int, within: bool, depth: int) -> None:
        self.level, self.within, self.depth = level, within, depth
        self.head = depth >= level
        self.segment, self.carry = 0, b""
        self.opened: list[tuple[int, str, str]] = []  # segment, bracket, key before it
        self.items: list[tuple[int, bytes]] = []
        self.first: bytes | None = None

    def add(self, data: bytes) -> None:
        raw, out, self.within = outside(data, self.within)
        change = steps(raw, out)
        depth = self.depth + np.cumsum(change)
        level = self.level
        comma = out & (raw == COMMA)
        marks = np.flatnonzero(((change > 0) & (depth == level)) | ((change < 0) & (depth == level - 1)) | (comma & ((depth == level) | (depth == level - 1))))
        done = 0
        for i, kind, at in zip(marks.tolist(), raw[marks].tolist(), depth[marks].tolist(), strict=True):
            text = self.carry + data[done:i]
            self.carry, done = b"", i + 1
            if kind in OPENING:
                self.segment += 1
                key = KEY.search(text.decode(errors="replace"))
                self.opened.append((self.segment, chr(kind), key[1] if key else ""))
            elif kind == COMMA and at < level:
                continue
            elif self.head:
                self.head, self.first = False, text
            else:
                self.items.append((self.segment, text))
        self.carry += data[done:]
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def end(self) -> list[tuple[int, bool, bytes]]:
        """(segment, tail, text) of the first and last item, where they belong to other ranges too."""
        parts = [(0, False, self.first)] if self.first is not None else []
        if self.head:
            return [(0, False, self.carry)]
        return [*parts, (self.segment, True, self.carry)] if self.depth >= self.level else parts


def walked(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[tuple[tuple, pa.RecordBatch, Walk, bool]]:
    """(range, its first batch, walk, whether it is over), each time that a batch was added."""
    at, first, walk = None, None, None
    for key, batch in runs(batches):
        if key != at:
            if walk:
                yield at, first, walk, True
            at, first = key, batch
            check(batch)
            walk = Walk(batch.column("level")[0].as_py(), batch.column("within")[0].as_py(), batch.column("depth")[0].as_py())
        walk.add(data_of(batch, separator))
        yield at, first, walk, False
    if walk:
        yield at, first, walk, True


def json_outline(found: DataFrame, separator: str) -> DataFrame:
    """(file, start, segment, bracket, key, tail, text) of ranges with states: the brackets opened at the items' depth, and the parts of items over several ranges."""
    names = ["file", "start", "segment", "bracket", "key", "tail", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _, walk, over in walked(batches, separator):
            walk.items = []
            if over:
                rows = [(*at, s, b, k, None, None) for s, b, k in walk.opened] + [(*at, s, None, None, t, x.decode()) for s, t, x in walk.end()]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return found.mapInArrow(run, "file string, start long, segment long, bracket string, key string, tail boolean, text string")


def json_within(found: DataFrame, separator: str) -> DataFrame:
    """(item) of ranges with states: the items of the wanted segments that lie within one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, first, walk, _ in walked(batches, separator):
            wanted = {first.column("own")[0].as_py()} | ({0} if first.column("carried")[0].as_py() else set())
            texts = [text for s, x in walk.items if s in wanted and (text := x.decode().strip())]
            walk.items = []
            if texts:
                yield pa.record_batch([pa.array(texts)], ["item"])

    return found.mapInArrow(run, "item string")


def json_items(spark: SparkSession, path: str | list[str], envelopes: tuple[str, ...]) -> DataFrame:
    """(item): the texts of the items of JSON documents, one document a file, read in ranges.

    Items are those of a document that is an array, or of the first of the `envelopes` that is an array in one that is an object; else the document itself.
    Two passes find how ranges begin and where arrays open; they run when this is called, and leave one row for each range, one for each
    array that is an object's field, and the items over several ranges. Ranges end where objects end, or at commas where the first item is no object.
    """
    head = spark.read.option("lineSep", ",").text(path).head(1)
    separator = "}" if head and "{" in head[0][0] else ","
    rows = lines(spark, path, separator)
    states = cut(json_states(rows, separator).withColumn("level", F.when(F.col("lead") == "[", 1).when(F.col("lead") == "{", 2)), "ranges")
    outline = cut(json_outline(known(rows, states).filter("level is not null or seen is null"), separator), "outline")
    by_place = F.struct("start", "segment")
    rank = F.array_position(F.array(*map(F.lit, envelopes)), F.col("key"))
    opened = outline.filter("bracket is not null").join(states.filter("start = 0").select("file", "level"), "file")
    # of a field that stands twice the last counts
    wanted = opened.filter("bracket = '['").withColumn("rank", F.when(F.col("level") == 1, 1).otherwise(rank)).filter("rank > 0")
    wanted = wanted.groupBy("file").agg(F.max_by(by_place, F.struct(-F.col("rank"), "start", "segment")).alias("wanted"))
    last = opened.groupBy("file", "start").agg(F.max(by_place).alias("last"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = states.join(last, ["file", "start"], "left").withColumn("open", F.last("last", ignorenulls=True).over(before)).join(wanted, "file")
    own = F.when(F.col("wanted.start") == F.col("start"), F.col("wanted.segment"))
    places = cut(places.select("file", "start", "within", "depth", "level", own.alias("own"), F.coalesce(F.col("open") == F.col("wanted"), F.lit(False)).alias("carried")), "places")
    inner = json_within(rows.join(F.broadcast(places), ["file", "start"]), separator)
    mine = F.when(F.col("segment") == 0, F.col("carried")).otherwise(F.coalesce(F.col("segment") == F.col("own"), F.lit(False)))
    parts = outline.filter("tail is not null").join(places.select("file", "start", "own", "carried"), ["file", "start"])
    parts = parts.select("file", "start", "tail", F.col("text").alias("record"), mine.alias("mine"))
    over = joined(parts, F.max(F.when(F.col("tail"), F.col("mine"))).alias("mine")).filter("mine").select(F.trim(F.array_join("texts", "")).alias("item")).filter("item <> ''")
    found = inner.unionByName(over)
    single = [r[0] for r in states.select("file").distinct().join(places.select("file").distinct(), "file", "left_anti").collect()]  # names that Spark lists on the driver anyway
    if single:
        found = found.unionByName(spark.read.text(single, wholetext=True).select(F.regexp_replace("value", r"\A[\x{FEFF}\s]+|\s+\z", "").alias("item")).filter("item <> ''"))
    return found
