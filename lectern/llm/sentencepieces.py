"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct units of a batch (a run of spaces with the word behind it, which
no piece crosses) are laid end to end and indexed by a suffix array. Every piece
of the vocabulary is looked up in it by binary search, all pieces at once, which
gives the ranges of its occurrences. Occurrences become edges, sorted by where
they end, and are relaxed from left to right. The vocabulary at hand is a merge
(BPE) vocabulary, so an edge extends the path before it only if merging the two
pieces' text gives just these two pieces; exactly one edge into each position
does, and the path through these edges is the encoding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: stands between units, beyond all characters
CUT = 0x110000
#: rows encoded together
ROWS = 512
REMEMBERED = 700_000
#: characters that one suffix array indexes, unless one unit alone has more
INDEXED = 1 << 18


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` characters, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width, order = 1, np.argsort(rank)
    while width < depth:
        ahead = np.zeros_like(rank)
        ahead[: max(0, len(rank) - width)] = rank[width:] + 1
        both = rank * (len(rank) + 1) + ahead
        order = np.argsort(both)
        step = np.empty(len(order), dtype=np.int64)
        step[0:1] = 0
        step[1:] = np.diff(both[order]) != 0
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        width *= 2
        if len(order) and rank[order[-1]] == len(order) - 1:
            break
    return order


class Vocabulary:
    """Pieces of a model file, and the checks that relaxing needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {self.piece[i]: model.get_score(i) for i in plain}
        self.ids = {self.piece[i]: i for i in plain}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        whole = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.longest = max(map(len, whole))
        self.usable = np.array([self.ids[p] for p in whole])
        self.lengths = np.array([len(p) for p in whole])
        self.letters = np.zeros((len(whole), self.longest), dtype=np.int64)
        for i, p in enumerate(whole):
            self.letters[i, : len(p)] = [ord(c) for c in p]
        self.unit = self._unit()
        self.fits: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.raw: list[bytes] = []

    def _unit(self) -> re.Pattern:
        """Spaces with what follows them, cut where no piece joins two neighbours: at line breaks
        and around signs that no piece has beside any other character."""
        pairs = {x + y for p in self.ids for x, y in zip(p, p[1:]) if x != SPACE}
        apart = set("\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        while joined := {c for x, y in pairs for c in ((x,) if y not in apart else ()) + ((y,) if x not in apart else ()) if c in apart}:
            apart -= joined
        signs = re.escape("".join(sorted(apart)))
        return re.compile(f"{SPACE}*[^{SPACE}{signs}]+|{SPACE}*[{signs}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """What merging the best-scored neighbours, leftmost first, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        key = a * self.size + b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            got = self.fits[key] = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return got

    def _ranges(self, text: np.ndarray, order: np.ndarray, upper: bool) -> np.ndarray:
        """For every piece the first place in the suffix array that is not before it (or behind it)."""
        lo, hi = np.zeros(len(self.usable), np.int64), np.full(len(self.usable), len(order), np.int64)
        padded = np.append(text, np.full(self.longest, -1))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(order) - 1)
            at = order[mid]
            state = np.zeros(len(mid), dtype=np.int64)  # sign of suffix - piece over the piece's length
            for k in range(self.longest):
                open_ = (state == 0) & (k < self.lengths)
                if not open_.any():
                    break
                state = np.where(open_, np.sign(padded[at + k] - self.letters[:, k]), state)
            right = (state < 0) | (upper & (state == 0))
            active = lo < hi
            lo, hi = np.where(active & right, mid + 1, lo), np.where(active & ~right, mid, hi)
        return lo

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, piece) of every occurrence of every piece, sorted by end."""
        order = suffix_array(text, self.longest)
        first, last = self._ranges(text, order, False), self._ranges(text, order, True)
        n = last - first
        which = np.repeat(np.arange(len(n)), n)
        at = order[np.repeat(first, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        end = at + self.lengths[which]
        by_end = np.argsort(end)
        return end[by_end], self.lengths[which][by_end], self.usable[which][by_end]

    def relax(self, codes: np.ndarray) -> tuple[list[int], list[int]]:
        """The piece that leads into every position, and its length; 0 where no piece does."""
        end, length, piece = self.edges(codes)
        cuts = np.searchsorted(end, np.arange(len(codes) + 2)).tolist()
        length, piece, is_cut = length.tolist(), piece.tolist(), (codes == CUT).tolist()
        into, size = [0] * (len(codes) + 1), [1] * (len(codes) + 1)
        fits, follows, wide = self.fits, self.follows, self.size
        for j in range(1, len(codes) + 1):
            if is_cut[j - 1]:
                continue
            for e in range(cuts[j], cuts[j + 1]):
                n, p = length[e], piece[e]
                before = into[j - n]
                # behind a cut or an unknown character nothing can merge
                ok = before == 0 or fits.get(before * wide + p)
                if ok is None:
                    ok = follows(before, p)
                if ok:
                    into[j], size[j] = p, n
                    break
        return into, size

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of each unit as little-endian 32-bit numbers."""
        out = {}
        at, batch = 0, []
        for u in [*units, None]:
            if batch and (u is None or at + len(u) > INDEXED):
                raw = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                ends = np.cumsum([len(b) for b in batch])
                into, size = self.relax(np.insert(raw, ends, CUT))
                for k, (b, end) in enumerate(zip(batch, ends.tolist())):
                    j, stop, ids = end + k, end + k - len(b), []
                    while j > stop:
                        if into[j]:
                            ids.append(into[j])
                        else:
                            ids += [self.byte[x] for x in reversed(b[j - stop - 1].encode("utf-8", "surrogatepass"))]
                        j -= size[j]
                    out[b] = struct.pack(f"<{len(ids)}I", *reversed(ids))
                at, batch = 0, []
            if u is not None:
                batch.append(u)
                at += len(u)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; only units not seen before are matched."""
        cut = self.unit.findall
        rows = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        here = set().union(*rows)
        if len(self.units) > REMEMBERED:
            self.units = {u: self.units[u] for u in here & self.units.keys()}
        known = self.units
        known.update(self.learn(sorted(here - known.keys())))
        return [b"".join(map(known.__getitem__, row)) for row in rows]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces: bytes are put together, the space in front is dropped, what is no UTF-8 is replaced."""
        raw = b"".join(map(self._bytes().__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def _bytes(self) -> list[bytes]:
        if not self.raw:
            self.raw = [
                bytes([self.value[i]]) if i in self.value else p.replace(SPACE, " ").encode() if p in self.ids else b""
                for i, p in enumerate(self.piece)
            ]
        return self.raw


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """One for each worker process; the file is one of the installed public tokenizers."""
    if name not in _vocabularies:
        import public_tokenizers

        _vocabularies[name] = Vocabulary(public_tokenizers.path(name))
    return _vocabularies[name]


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, ids_crc32) of every row: what the model's own encoder returns for the whole text.

    A null or empty text has no ids. Characters without a piece become their
    UTF-8 bytes. Repeated rows stay. The checksum is of little-endian 32-bit ids.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                rows = own.encode([t or "" for t in some.column(1).to_pylist()])
                offsets = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
                values = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([zlib.crc32(r) for r in rows], pa.int64())],
                    names=[key, "ids", "ids_crc32"],
                )

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, ids_crc32 bigint")


def decode_pieces(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """All columns with ``decoded`` added: the text that the ids stand for (null and empty ids: an empty text).

    Decoding undoes encoding but for U+2581, which comes back as a space.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")
