"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary entry at each point of a word. The automaton finds its length
in one pass: the vocabulary is a trie, and each node has a failure link, to the node of what remains after the longest
entries have been popped from the front of its string, and the number of tokens popped. Where the next character has no
child, the pass adds that number and follows the link. No piece is built.

The vocabulary's entries are pieces inside of words, or at a word's end where they carry the end mark. They are strings of
bytes, and the automaton reads a word's UTF-8 byte by byte, so an entry may begin or end within a character; the last byte
and the end mark are one step, as no entry is the mark alone. Words are lower-cased and split at the vocabulary's white
space and, as its own rules ask, into runs of letters, single digits and runs of other characters. A vocabulary with all
single bytes, as the given one, splits any word; with another one, a word that can't be split into entries to its end
counts as one unknown token.

Nulls: a null text counts as empty and has no tokens. Repeated rows are counted each. Extra columns, whatever their names, are left behind. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, slices

#: Stands for the end of a word.
END = "\0"
#: Words whose counts a task keeps.
KEPT_WORDS = 150_000
#: The vocabulary's own pattern: what its splitting rule keeps of a text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space of the vocabulary's pattern. Python's str.split also takes these four as white space, the pattern keeps them.
SPACE, SEPARATORS = regex.compile(r"\s+"), regex.compile("[\x1c-\x1f]")
# The character that stands for each byte in the vocabulary file.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}


def byte_chars(word: str) -> str:
    """A word's UTF-8 as the vocabulary writes it, one character for each byte."""
    return word.encode().decode("latin-1").translate(BYTE_CHARS)


def steps(piece: str) -> list[str]:
    """What the automaton reads one after the other: bytes, the last one together with the end mark."""
    return [*piece[:-2], piece[-2:]] if piece.endswith(END) else list(piece)


def chunks_of(text: str) -> list[str]:
    """What stands between white space."""
    return [c for c in SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()


class Automaton:
    """Nodes are numbered in breadth-first order; node 0 is the root."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.fail: list[int] = [-1]
        self.pops: list[int] = [0]
        is_entry = [False]
        for entry in sorted(set(entries), key=lambda e: (len(e), e)):
            node = 0
            for c in steps(entry):
                after = self.child[node].get(c)
                if after is None:
                    after = len(self.child)
                    self.child[node][c] = after
                    self.child.append({})
                    self.fail.append(-1)
                    self.pops.append(0)
                    is_entry.append(False)
                node = after
            is_entry[node] = node != 0
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for c, node in self.child[above].items():
                queue.append(node)
                if is_entry[node]:  # the node's whole string is popped
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                link, popped = self.fail[above], self.pops[above]
                while link >= 0 and c not in self.child[link]:
                    popped += self.pops[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[node], self.pops[node] = self.child[link][c], popped

    def count(self, word: str) -> int:
        """Tokens of a word; 0 where greedy matching gets stuck."""
        node, total = 0, 0
        for c in steps(byte_chars(word) + END):
            while c not in self.child[node]:
                total += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return 0
            node = self.child[node][c]
        while node > 0:
            total += self.pops[node]
            node = self.fail[node]
        return total if node == 0 else 0


def greedy(word: str, entries: set[str]) -> int:
    """The same by building the pieces, for tests."""
    rest, total = steps(byte_chars(word) + END), 0
    while rest:
        size = next((n for n in range(len(rest), 0, -1) if "".join(rest[:n]) in entries), 0)
        if not size:
            return 0
        rest, total = rest[size:], total + 1
    return total


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> frozenset[str]:
    """All entries as the file writes them, one printable character for each byte, with END for its end mark."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        model = json.loads(f.read())["model"]
    mark = model["end_of_word_suffix"]
    return frozenset(e.removesuffix(mark) + END if e.endswith(mark) else e for e in model["vocab"])


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


class WordCounts(dict):
    """(known tokens, unknown tokens) of what stands between white space, as one complex number."""

    def __init__(self, machine: Automaton) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, chunk: str) -> complex:
        if len(self) >= KEPT_WORDS:
            self.clear()
        counts = [self.machine.count(w) for w in WORDS.findall(unicodedata.normalize("NFC", chunk).lower())]
        found = self[chunk] = complex(sum(counts), counts.count(0))
        return found


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    """(id_col, n_words long, n_tokens long, n_unknown long): words between white space, tokens with unknown ones, unknown ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(automaton(path))
        for batch in slices(batches):
            words, found = [], []
            for text in batch.column(1).to_pylist():
                chunks = chunks_of(text or "")
                words.append(len(chunks))
                found.append(sum(map(counts.__getitem__, chunks), 0j))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array([int(x.real + x.imag) for x in found], pa.int64()), pa.array([int(x.imag) for x in found], pa.int64())], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return map_in_arrow(rows, run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
