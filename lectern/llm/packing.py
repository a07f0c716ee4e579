"""Packing of tokenized documents into sequences by first-fit decreasing.

Documents are cut into pieces of at most one sequence. Pieces are dealt to
groups by a seeded hash of their document; each group is packed by itself,
longest pieces first, into the first bin with room, found by a tournament tree
over the room left in the bins. Only ids, lengths and checksums are shuffled.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
GROUP_PIECES = 8192
#: words that a worker remembers, and as many pre-tokens at most
REMEMBERED = 800_000
LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: pre-tokens of lower-case text without white space, as the vocabulary's file states them
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\s0-9A-Za-zª-µºÀ-ÖØ-öø-ÿ]+")


class Remembered(dict):
    """Answers that were given before; what is missing is made once. Starts anew when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = got
        return got


class WordEncoder:
    """Ids of white-space-separated words, packed as little-endian 32-bit numbers.

    No token of this vocabulary spans white space, so a text's ids are those
    of its words in a row. Words seen before are remembered up to a bound.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Remembered(self._word), Remembered(self._piece)
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
        moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.alphabet = {b: chr(moved.get(b, b)) for b in range(256)}

    def _word(self, word: str) -> bytes:
        if LATIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """Pieces of every document: key, start, length, ids_crc32, doc_tokens and the ``ids`` themselves as bytes.

    ``tokenizer`` names a file of the installed public tokenizers, opened on
    the executors. Every document ends with ``end_id``; a null or empty text
    is that id alone. Pieces start at multiples of ``length``.
    """
    end = struct.pack("<I", end_id)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        own = encoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            keys, rows, parts, starts, totals = batch.column(0), [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = own.encode(t.as_py() or "") + end
                for at in range(0, len(ids), 4 * length):
                    rows.append(i)
                    starts.append(at // 4)
                    totals.append(len(ids) // 4)
                    parts.append(ids[at : at + 4 * length])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()),
                 pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(totals, pa.int64()), pa.array(parts, pa.binary())],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


class Tournament:
    """Bins in a row, over them the larger room of each two, up to the root."""

    def __init__(self, bins: int, room: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room before) of the first bin that can take the size."""
        at, room = 1, self.room
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        bin_ = at - self.width
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of lengths that are already in descending order."""
    tree = Tournament(len(lengths), capacity)
    placed = [tree.place(int(n)) for n in lengths]
    bins = np.array([b for b, _ in placed], dtype=np.int64)
    return bins, np.array([capacity - had for _, had in placed], dtype=np.int64)


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 11, rows: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity``.

    Documents go to groups by a seeded hash of their key; ``rows`` (the count
    of documents, counted if not given) sets the number of groups, so that a
    group has about ``group_pieces`` documents. Null keys share a group by
    their content. Equal pieces are interchangeable. An offset is the sum of
    the lengths before it in its sequence.
    """
    total = rows if rows is not None else pieces.where(F.col("start") == 0).count()
    groups = max(1, -(-total // group_pieces))
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null"), F.col("ids_crc32").cast("string"))), F.lit(seed))
    laid = pieces.withColumn("_group", F.pmod(hashed, F.lit(groups)))
    names = pieces.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(ordered["length"].to_numpy(), capacity)
        return ordered[names].assign(sequence_id=(int(group[0]) << 32) + bins, offset=offsets)

    return laid.groupBy("_group").applyInPandas(run, f"{kinds}, sequence_id bigint, offset bigint")
