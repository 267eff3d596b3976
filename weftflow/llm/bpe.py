"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

`encode` gives each text its token ids, `decode` gives ids back as raw bytes. Long texts are cut beforehand
at places where the splitting pattern always ends a match, so that the library works on bounded pieces and the
ids stay those of the whole text.

Nulls: a null text counts as empty and has no ids; null ids decode to no bytes. Other columns, whatever their
names, are left behind except the id column. Repeated rows are encoded each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, slices

#: Code points after which a text is cut at the next safe boundary.
PIECE_CHARS = 65_536

#: Where the pattern always ends a match: white space after anything else, and the changes between letters and numbers.
#: A contraction holds an apostrophe and letters only, and an optional space stands only before a match.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    fs, path = pa.fs.FileSystem.from_uri(rank_file)
    with fs.open_input_stream(path) as f:
        lines = f.read().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that end at safe boundaries; a piece is longer than `size` only where there is no boundary."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """The ids as little-endian unsigned 32-bit integers."""
    found = [np.array(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text, size) if p]
    return np.concatenate(found) if found else np.zeros(0, "<u4")


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rank_file: str = public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(id_col, n_tokens long, ids binary): the ids packed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in slices(batches):
            ids = [encode_text(enc, t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["id", "n_tokens", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_in_arrow(rows, run, "id long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
    rank_file: str = public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(id_col, n_tokens long, ids binary, decoded binary): raw bytes, which needn't be whole UTF-8 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in slices(batches):
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            back = [enc.decode_bytes(x.tolist()) for x in ids]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), batch.column(1), pa.array(back, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return map_in_arrow(rows, run, "id long, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)
