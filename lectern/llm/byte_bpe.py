"""Byte-level BPE: ids of whole texts by a local rank file, and the bytes the ids stand for.

Each match of the split pattern is encoded by itself, so a text may be cut wherever a match
must end. ``pieces`` uses that to keep what the tokenizer gets at a time bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import ready, slices

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 1 << 16
#: No match goes from a letter or digit to white space, from a letter to a digit, or back.
SAFE = regex.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

#: Runs of white space that are too long for the tokenizer's own matching, which recurses.
BLANK = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}+")
#: Fixed value: how a pattern ends that gives such a run one match, less a last character that something follows.
BLANK_END = r"|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank in a line. Its size bounds the broadcast."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of ``size`` characters or little more, each ending at a safe boundary.

    A text with no such boundary after ``size`` characters stays whole from there.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Codec:
    """The tokenizer of a worker process, made once for each rank table and pattern."""

    _made: dict[str, tiktoken.Encoding] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
        if name not in self._made:
            self._made[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encoding = self._made[name]
        self.blanks = pattern.endswith(BLANK_END)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        start = 0
        for run in BLANK.finditer(text) if self.blanks else ():
            # the last character may begin the next match; the others are a match of their own
            end = run.end() - (run.end() < len(text))
            self._add(text[start : run.start()], out)
            out += self.encoding._encode_single_piece(text[run.start() : end])
            start = end
        self._add(text[start:], out)
        return out

    def _add(self, text: str, out: list[int]) -> None:
        for piece in pieces(text):
            out += self.encoding.encode_ordinary(piece)

    def raw(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def encode(
    spark: SparkSession, df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``ids`` (array<int>) and ``decoded`` (binary) of every row of ``df``.

    Null text counts as empty: no ids, no bytes; texts and white space of any length are encoded. Rows are neither merged nor dropped, repeated
    keys included; other columns of ``df`` are not read. Special tokens are never produced.
    The rank file is read on the driver and broadcast, a bounded table.
    """
    ranks = ready(spark).sparkContext.broadcast(read_ranks(path))
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for part in slices(batches, "text"):
            ids = [codec.ids(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([codec.raw(x) for x in ids], pa.binary()),
                ],
                ["key", "ids", "decoded"],
            )

    out = rows.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>, decoded binary")
    return out.withColumnRenamed("key", key)
