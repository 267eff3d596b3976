"""Packing of documents into token sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt at random into groups. Within a group each document is tokenised, full sequences are cut
from long ones, and the rest go into bins by first-fit decreasing: the tree's inner nodes hold the largest room
below them, so the first bin with enough room is found in logarithmic time. Afterwards the emptiest bins are cut
up to fill the room that others have left; what remains of the last bin is cut at powers of two, which need no
padding. A group never holds more than `group_docs` documents, whatever the input's size.

Nulls: a null text counts as empty, a document then has the end token alone; null ids stay null. Repeated rows
are packed each. Extra columns, whatever their names, are left behind. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import map_in_arrow, slices
from .wordpiece import BYTE_CHARS

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Documents of a group.
GROUP_DOCS = 2048
#: Bytes of text at which a group is closed early, so that long texts don't fill a worker.
GROUP_BYTES = 8 << 20
#: Characters of text whose words are held at once; few, so that a processor's caches hold them between looking them up and joining their ids.
BLOCK_CHARS = 128 << 10
#: Words after which those kept before are set aside, and those set aside before are dropped: a worker keeps at most twice as many, beyond those of a block.
KEPT_WORDS = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Ids by word, as packed unsigned 32-bit integers. Words kept before the last KEPT_WORDS came are in `older`, until they are met again.

    The tokenizer drops white space and never joins over it, so the words of a text are encoded once and kept. A word of
    letters alone gives ids of which the last, and only the last, has the end mark; many such words are encoded in one call
    and told apart by it. Where the tokenizer's rules leave letters as they are, its model gets their bytes without them.
    ASCII marks that follow such letters to the end of a word are encoded apart. Texts that hold a character that only Python
    takes as white space, or an added token, are encoded whole.
    """

    #: White space of str.split that the tokenizer keeps.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    #: Latin, Greek and Cyrillic letters that stay one character when normalised.
    LETTERS = "".join(c for c in map(chr, range(ord("a"), 0x530)) if c.isalpha() and c.lower() == c and unicodedata.is_normalized("NFC", c))

    #: Letters, and all but the apostrophe of ASCII's marks to the end of a word.
    MARKED = re.compile(rf"([{LETTERS}]+)([!-&(-/:-@\[-`{{-~]+)")

    #: The characters of a byte-level vocabulary, by byte; a space stays one, so that it parts words.
    BYTES = "".join(" " if b == ord(" ") else BYTE_CHARS[b] for b in range(256))

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = tokenizer
        self.added = [] if tokenizer.encode_special_tokens else [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        mark = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        if mark:
            self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        ruled, bare = (t.encode_batch_fast(x, add_special_tokens=False) for t, x in ((tokenizer, list(self.LETTERS)), (self.model, [self.byte_chars(c) for c in self.LETTERS])))
        self.letters = frozenset(c for c, x, y in zip(self.LETTERS, ruled, bare, strict=True) if x.ids == y.ids)

    def byte_chars(self, text: str) -> str:
        return codecs.charmap_decode(text.encode(), "strict", self.BYTES)[0]

    def words(self, text: str) -> list[str] | bytes:
        """The words, or the ids of a text that is encoded whole."""
        lower = text.lower()
        if any(c in text for c in self.SEPARATORS) or any(t in lower for t in self.added):
            return self.ids(text)
        if "\u03a3" not in text and "\u0130" not in text:  # the others have one lower case each, whatever stands around them
            text = lower
        return text.split()

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = data = self.older[word]
        return data

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't kept yet, many in one call. If there are too many, those of the time before last go."""
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        new = {w for w in words if w not in self and w not in self.older}
        marked = {w: m.groups() for w in new if not w.isalpha() and (m := self.MARKED.fullmatch(w))}
        new = {w for w in new.union(*marked.values()) if w not in self and w not in self.older and w not in marked}
        bare = [w for w in new if self.letters.issuperset(w)]
        ruled = [w for w in new.difference(bare) if w.isalpha()]
        rest = list(new.difference(bare, ruled))
        for word, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[word] = np.array(got.ids, "<u4").tobytes()
        self.learn_letters(self.tokenizer, ruled, str)
        self.learn_letters(self.model, bare, self.byte_chars)
        self.update((w, self[letters] + self[marks]) for w, (letters, marks) in marked.items())

    def learn_letters(self, tokenizer: Tokenizer, words: list[str], text_of: Callable[[str], str]) -> None:
        blocks = [words[i : i + 512] for i in range(0, len(words), 512)]
        encoded = tokenizer.encode_batch_fast([text_of(" ".join(b)) for b in blocks], add_special_tokens=False)
        for block, got in zip(blocks, encoded, strict=True):
            ids = np.array(got.ids, "<u4")
            data, after = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(after) == len(block) and after[-1] == len(data):
                self.update(zip(block, map(data.__getitem__, map(slice, [0, *after], after)), strict=False))
            else:  # a word was split after all
                self.update((w, self.ids(w)) for w in block)

    def encode(self, words: list[str] | bytes, end_id: int) -> np.ndarray:
        data = words if isinstance(words, bytes) else b"".join(map(self.__getitem__, words))
        return np.frombuffer(data + np.array([end_id], "<u4").tobytes(), "<u4")

    def encode_texts(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        pieces = [self.words(t) for t in texts]
        self.learn(set().union(*(itertools.filterfalse(self.__contains__, p) for p in pieces if isinstance(p, list))))
        return [self.encode(p, end_id) for p in pieces]


@functools.lru_cache(maxsize=2)
def tokenizer_of(vocabulary: str, added_ids: bool) -> Tokenizer:
    fs, path = pa.fs.FileSystem.from_uri(vocabulary)
    with fs.open_input_stream(path) as f:
        tokenizer = Tokenizer.from_buffer(f.read())
    tokenizer.encode_special_tokens = not added_ids
    return tokenizer


@functools.lru_cache(maxsize=2)
def word_ids(vocabulary: str, added_ids: bool) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordIds(tokenizer_of(vocabulary, added_ids))


class RoomTree:
    """A tournament tree over bins; a node holds the most room of the bins below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1)).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with room for `need`."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.most[node] < need:
                node += 1
        return node - self.leaves

    def take(self, at: int, need: int) -> None:
        node = at + self.leaves
        self.most[node] -= need
        while node > 1:
            node //= 2
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers; each length is from 1 to size. Ties keep the items' order."""
    tree = RoomTree(len(lengths), size)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.first(lengths[i])
        tree.take(at, lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack_group(lengths: list[int], size: int = SEQUENCE_TOKENS) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, sequences counted from 0."""
    sequence, items = 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            yield doc, start, size, sequence, 0
            sequence += 1
        if n % size:
            items.append((doc, n - n % size, n % size))
    bins = [[items[i] for i in b] for b in first_fit_decreasing([x[2] for x in items], size)]
    filled = sorted(bins, key=lambda b: -sum(x[2] for x in b))
    room = [size - sum(x[2] for x in b) for b in filled]
    # the emptiest bin, last, is cut up as long as the others have room for all of it
    total, into = sum(room), 0
    while len(filled) > 1 and total - room[-1] >= size - room[-1]:
        total -= room[-1]
        loose = filled.pop()
        total -= size - room.pop()
        while loose:
            doc, start, n = loose.pop()
            while room[into] == 0:
                into += 1
            part = min(n, room[into])
            filled[into].append((doc, start, part))
            room[into] -= part
            if part < n:
                loose.append((doc, start + part, n - part))
    for k, b in enumerate(filled):
        n = size - room[k]
        # what is left of the last bin: sequences at powers of two; any other bin stays one sequence
        ends = [n]
        if k == len(filled) - 1 and n & (n - 1):
            ends = np.cumsum([1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]).tolist()
        at, begin, e = 0, 0, 0
        for doc, start, length in b:
            while length:
                if at == ends[e]:
                    sequence, begin, e = sequence + 1, at, e + 1
                part = min(length, ends[e] - at)
                yield doc, start, part, sequence, at - begin
                start, length, at = start + part, length - part, at + part
        sequence += 1


def pack(df: DataFrame, vocabulary: str = public_tokenizers.path("word_bpe_49k.json"), size: int = SEQUENCE_TOKENS, group_docs: int = GROUP_DOCS, end_id: int = END_ID, added_ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) with their places in sequences of at most `size` tokens.

    One shuffle deals the texts out by a random hash; a task packs its rows group by group and returns a row per piece.
    Rows are sorted by that hash in each task, so a task that runs again packs alike. With `added_ids` an added token that
    stands in a text, as <|endoftext|>, gives its own id, as the tokenizer's defaults have it; without, the ids of its characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary, added_ids)
        sequence = TaskContext.get().partitionId() << 40

        def packed(docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sequence
            out = pd.DataFrame([(docs[d], start, n, zlib.crc32(ids[d][start : start + n]), len(ids[d]), sequence + s, at) for d, start, n, s, at in pack_group([len(x) for x in ids], size)], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            sequence += int(out["sequence_id"].max() - sequence) + 1
            out["doc_id"] = out["doc_id"].astype("Int64")
            return pa.RecordBatch.from_pandas(out, preserve_index=False)

        # a group's words would take ten times its ids' memory, so texts are encoded a block at a time
        docs, ids, texts, held, block = [], [], [], 0, 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text or "")
                held, block = held + len(texts[-1]), block + len(texts[-1])
                full = len(docs) >= group_docs or held >= GROUP_BYTES
                if full or block >= BLOCK_CHARS:
                    ids += words.encode_texts(texts, end_id)
                    texts, block = [], 0
                if full:
                    yield packed(docs, ids)
                    docs, ids, held = [], [], 0
        if docs:
            yield packed(docs, ids + words.encode_texts(texts, end_id))

    # rows that repeat, as those without id and text, are told apart by where they stand; equal rows are packed alike wherever they go
    dealt = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_in_arrow(rows.withColumn("deal", dealt).repartition("deal").sortWithinPartitions("deal", "doc_id").drop("deal"), run, SCHEMA)
