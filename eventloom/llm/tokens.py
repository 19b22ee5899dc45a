"""Token ids of whole texts by a byte-level tokenizer, with offsets, and back.

Texts are encoded in Arrow batches by the tokenizers library, a bounded number of characters at a time, so
that a very long text makes no batch larger than itself. Byte-level tokens are strings over an alphabet of
256 printable characters, one per byte; decoding reverses that table and joins bytes before it reads them
as UTF-8, so characters split over tokens come out whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
SLICE = 1 << 19  # characters encoded at once


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, on one thread: a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.exists(path):  # an executor without the folder has the file from ``shipped``
        path = SparkFiles.get(os.path.basename(path))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def tokenizer_path(name: str = TOKENIZER, folder: str = FOLDER) -> str:
    return f"{folder}/{name}.json"


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """Character of the byte alphabet -> byte: printable Latin-1 characters stand for themselves, the other
    bytes for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def shipped(df: DataFrame, path: str | None) -> str:
    """The path of a tokenizer's file, which is sent to the executors."""
    path = path or tokenizer_path()
    df.sparkSession.sparkContext.addFile(path)
    return path


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids (list of integers) of every row, without special tokens; strings that look like special
    tokens are ordinary text. Empty and null texts have the empty list. One row per input row, repeats
    included; extra columns are ignored. A pass over the table without a shuffle."""
    path = shipped(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1).to_pylist()):
                flat, ends = array("i"), [0]
                for e in tokenizer.encode_batch_fast(part, add_special_tokens=False):
                    flat.fromlist(e.ids)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), ids], names=[id_col, "ids"])
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens of every row; 0 for empty and null texts."""
    path = shipped(docs, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            sizes: list[int] = []
            for part in slices(batch.column(1).to_pylist()):
                sizes += [len(e) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(count, f"`{id_col}` {kind}, n_tokens bigint")


def token_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids, starts, ends: each token with the half-open range of characters it comes from. Tokens that
    share a split character all name that character. Empty and null texts have empty lists."""
    path = shipped(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1).to_pylist()):
                ids, starts, ends = [], [], []
                for text, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
                    spans = byte_spans(text, [len(tokenizer.id_to_token(i)) for i in e.ids])
                    ids.append(e.ids)
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                arrays = [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *arrays], names=[id_col, "ids", "starts", "ends"])
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def byte_spans(text: str, lengths: list[int]) -> list[tuple[int, int]]:
    """Character ranges of tokens with the given numbers of bytes, by a byte-to-character map."""
    if text.isascii():
        of = range(len(text))
    else:
        of = [i for i, c in enumerate(text) for _ in range(len(c.encode("utf-8")))]
    out, at = [], 0
    for n in lengths:
        out.append((of[at], of[at + n - 1] + 1))
        at += n
    return out


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id, text: the texts that were encoded, exactly. Ids that the vocabulary lacks, or bytes that are no
    UTF-8 (of lists that are no whole encoding), become U+FFFD; null lists have null texts."""
    path = shipped(encoded, path)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table = load(path), byte_table()
        known: dict[int, bytes] = {}

        def piece(i: int) -> bytes:
            if i not in known:
                token = tokenizer.id_to_token(i)
                known[i] = "�".encode() if token is None else bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
            return known[i]

        for batch in batches:
            texts = [None if ids is None else b"".join(map(piece, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(back, f"`{id_col}` {kind}, text string")
