"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to three bytes is counted on a
bounded sample and then frozen. A context predicts the bytes seen after it and
escapes to its shorter suffix for all others; the suffix's distribution is
renormalised over what the longer context has not seen. All code lengths are
worked out in advance, so a text is scored with two array look-ups per byte,
straight from the Arrow buffers. The language with the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: bound of the training sample, per language
SAMPLE_DOCS, SAMPLE_CHARS = 300, 4_000
#: contexts that are worked on at a time while a model is built
BLOCK = 4096
ORDER = 3
PAD = 10
SLICE = 1 << 21


def training_rows(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(~training_rows(key), F.lit(False))


class Model:
    """Frozen code lengths: ``cost[context * symbols + symbol]`` holds bits for each language."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = np.zeros(256, dtype=bool)
        seen[PAD] = True
        for docs in texts.values():
            for d in docs:
                seen[np.frombuffer(d, dtype=np.uint8)] = True
        size = self.symbols = int(seen.sum()) + 1
        self.code = np.where(seen, np.cumsum(seen), 0).astype(np.int32)
        unseen = 257 - size
        streams = {}
        for lang, docs in texts.items():
            rows = [[] for _ in range(ORDER + 1)]
            for d in docs:
                codes = np.concatenate([np.full(ORDER, self.code[PAD], np.int32), self.code[np.frombuffer(d, dtype=np.uint8)].astype(np.int32)])
                for k in range(ORDER + 1):
                    rows[k].append(codes[ORDER - k : len(codes) - k])
            streams[lang] = [np.concatenate(r) if r else np.zeros(0, np.int32) for r in rows]
        contexts = [np.zeros(1, np.int32)]
        packed = {lang: [np.zeros(len(s[0]), np.int32)] for lang, s in streams.items()}
        for k in range(1, ORDER + 1):
            for lang, s in streams.items():
                packed[lang].append(packed[lang][k - 1] + s[k] * size ** (k - 1))
            contexts.append(np.unique(np.concatenate([packed[lang][k] for lang in streams] or [np.zeros(0, np.int32)])))
        floor = np.full(size, 1 / 256)
        floor[0] = unseen / 256
        out = []
        for lang in self.languages:
            below = None
            levels = []
            for k in range(ORDER + 1):
                seen = np.zeros((len(contexts[k]), size), np.int32)
                np.add.at(seen, (np.searchsorted(contexts[k], packed[lang][k]), streams[lang][0]), 1)
                parent = np.searchsorted(contexts[k - 1], contexts[k] % size ** (k - 1)) if k else np.zeros(1, np.int64)
                own = np.empty(seen.shape, np.float32)
                # some contexts at a time, so that only the tables themselves are large
                for lo in range(0, len(seen), BLOCK):
                    counts, shorter = seen[lo : lo + BLOCK], (below[parent[lo : lo + BLOCK]] if k else floor[None, :]).astype(np.float64)
                    total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
                    rest = np.where(counts > 0, 0, shorter)
                    rest /= rest.sum(axis=1, keepdims=True)
                    own[lo : lo + BLOCK] = np.where(total > 0, (counts + kinds * rest) / np.maximum(1, total + kinds), shorter)
                below = own
                levels.append(own)
            out.append(levels)
        rows = sum(len(c) for c in contexts)
        self.cost = np.empty((rows * size, len(out)), np.float32)
        for column, levels in enumerate(out):
            at = 0
            for k, level in enumerate(levels):
                levels[k] = None
                for lo in range(0, len(level), BLOCK):
                    bits = -np.log2(level[lo : lo + BLOCK])
                    bits[:, 0] += np.float32(np.log2(max(1, unseen)))
                    self.cost[at * size : (at + len(bits)) * size, column] = bits.ravel()
                    at += len(bits)
        base, table = 0, np.zeros(1, np.int32)
        for k in range(1, ORDER + 1):
            base += len(contexts[k - 1])
            table = np.tile(table, size)
            if len(contexts[k]):
                table[contexts[k]] = base + np.arange(len(contexts[k]))
        self.context = table.astype(np.int32)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text in every language; texts lie one after the other in ``data``."""
        starts, n = offsets[:-1], len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        size, pad = self.symbols, self.code[PAD]
        first, last = int(offsets[0]), int(offsets[-1])
        for lo in range(first, last, SLICE):
            hi = min(last, lo + SLICE)
            reach = max(first, lo - ORDER)
            codes = self.code[data[reach:hi]]
            inside = starts[np.searchsorted(starts, reach) : np.searchsorted(starts, hi)] - reach
            ctx = np.zeros(len(codes), dtype=np.int32)
            for k in range(1, ORDER + 1):
                before = np.empty_like(codes)
                before[:k] = pad
                before[k:] = codes[:-k]
                for step in range(k):
                    at = inside + step
                    before[at[at < len(codes)]] = pad
                ctx += before * size ** (k - 1)
            bits = self.cost[self.context[ctx] * size + codes][lo - reach :]
            owner_lo = int(np.searchsorted(offsets, lo, side="right")) - 1
            edges = offsets[owner_lo : int(np.searchsorted(offsets, hi, side="left")) + 1]
            begins, ends = np.clip(edges[:-1], lo, hi) - lo, np.clip(edges[1:], lo, hi) - lo
            filled = ends > begins
            rows = owner_lo + np.flatnonzero(filled)
            out[rows] += np.add.reduceat(bits, begins[filled], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> Model:
    """Context trees of all languages from about ``per_language`` training documents of each.

    Only documents with a language, a text and a place on the training side of
    the fold are used, those with the smallest seeded hash. Of a text over
    ``max_chars`` characters one window of that length is used, at a seeded
    place, so a language with long documents only is learned too. The sample
    and the model are bounded whatever the size of the input; how well the
    model does on held-out documents is a test.
    """
    size = F.length(text)
    start = 1 + F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.greatest(F.lit(1), size - max_chars + 1).cast("bigint"))
    window = F.substring(F.col(text), start.cast("int"), F.lit(max_chars))
    usable = docs.where(training_rows(key) & F.col(lang).isNotNull() & (size >= 1))
    counts = {r["l"]: r["n"] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({})
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(1_000_000))
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(lang) == name, F.lit(int(1_000_000 * min(1.0, 1.5 * per_language / n)) + 1)).otherwise(share)
    rows = usable.where(draw < share).select(F.col(lang).alias("l"), window.alias("t"), draw.alias("d"), F.col(key).alias("k")).collect()
    texts: dict[str, list[bytes]] = {name: [] for name in counts}
    for r in sorted(rows, key=lambda r: (r["d"], r["k"])):
        if len(texts[r["l"]]) < per_language:
            texts[r["l"]].append(r["t"].encode("utf-8"))
    return Model({k: v for k, v in texts.items() if v})


FOUND = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds a struct ``language`` to every row: lang_pred, score, bits_per_byte.

    ``score`` is the posterior of the best language under equal priors; of
    equal code lengths the first language by name wins. A text that is null or
    has no letter is ``und`` with score 0, and so is every text if nothing was
    learned. A text of any length is scored whole. Repeated rows are scored each
    by itself, an empty table stays empty. Other columns stay as they are, but
    one named ``language`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        own = shipped.value
        names = np.array([*own.languages, "und"], dtype=object)
        n, lettered = len(texts), letters.to_numpy(zero_copy_only=False).astype(bool)
        if own.languages and n:
            wide = pa.types.is_large_string(texts.type)
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
            data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
            bits = own.code_lengths(data, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(n), best]
            score = 1 / np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(axis=1)
            rate = least / np.maximum(1, np.diff(offsets))
        else:
            best, score, rate, lettered = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        best = np.where(lettered, best, len(own.languages))
        return pa.StructArray.from_arrays(
            [pa.array(names[best], pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(rate)],
            names=[f.name for f in FOUND.fields],
        )

    found = F.arrow_udf(run, FOUND)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("language", found(F.coalesce(F.col(text), F.lit("")), lettered))
