"""Near copies by SimHash, found at the anchors of a covering code.

A fingerprint has 64 bits, cut into three blocks. If two fingerprints differ in
at most 4 bits, some block differs in at most one. Anchors of a block are the
4096 words of the binary Golay code of length 23: every block (padded with
zeros) lies within 3 bits of exactly one anchor, its home, and a block that
differs from it in one bit lies within 4 bits of that anchor. So each
fingerprint goes home once per block, visits the five or six anchors within 4
bits, and every link is met at some anchor. Anchors with many homes are cut
into parts. A part gives at most one link for each visitor and home beyond those
that connect them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lectern.settings import staged

#: lowest bit and length of each block
BLOCKS = [(0, 22), (22, 21), (43, 21)]
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code
GOLAY = 0b110001110101
#: homes of one part of an anchor
PART_HOMES = 4096


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text; the vote of each bit is counted in bytes, eight bits of a number at once."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    whole, starts, at = b" ".join(words), [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])], dtype=np.uint64)
    ones, votes = np.uint64(0x0101010101010101), np.zeros(64, dtype=np.int64)
    cuts = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & ones, cuts)
        votes[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    found = np.fromiter((fingerprint_of(t) for t in texts), dtype=np.uint64, count=len(texts))
    return pd.Series(found.view(np.int64))


def _residue(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: equal for words that differ by an anchor."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where((out >> bit) & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


@lru_cache(maxsize=1)
def patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each remainder, the difference to the home (first) and to all anchors within 4 bits."""
    flips = [sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)]
    flips = np.array(flips, dtype=np.int64)
    weight = np.bitwise_count(flips)
    rest = _residue(flips)
    order = np.lexsort((flips, weight, rest))
    starts = np.searchsorted(rest[order], np.arange(2048))
    counts = np.diff(np.append(starts, len(order)))
    return flips[order], starts, counts


def anchors_of(fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of fingerprints in one block."""
    low, length = BLOCKS[block]
    words = ((fp >> np.uint64(low)) & np.uint64((1 << length) - 1)).astype(np.int64)
    flips, starts, counts = patterns()
    rest = _residue(words)
    n = counts[rest]
    row = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    anchor = words[row] ^ flips[starts[rest[row]] + nth]
    return row, anchor | (block << 23), nth == 0


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        fp = signed.view(np.uint64)
        for block in range(len(BLOCKS)):
            row, anchor, home = anchors_of(fp, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(signed[row])], names=["anchor", "home", "fp"]
            )


class _Groups:
    """Union-find over positions 0..n-1; the smaller position leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, k: int) -> bool:
        a, b = self.find(i), self.find(k)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links_of(homes: np.ndarray, visitors: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the distance, a forest over homes and visitors."""
    out: list[tuple[int, int]] = []
    n = len(homes)
    groups = _Groups(n + len(visitors))
    step = max(1, (1 << 20) // max(1, n))
    for at in range(0, len(visitors), step):
        some = visitors[at : at + step]
        near = np.bitwise_count(some[:, None] ^ homes[None, :]) <= distance
        for i, k in zip(*np.nonzero(near)):
            if some[i] != homes[k] and groups.join(int(k), n + at + int(i)):
                out.append((int(some[i]), int(homes[k])))
    return out


def _meet(distance: int):
    """Reads rows sorted by (anchor, part, homes first); holds the homes of one part and one batch of visitors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, solid = None, [], None
        for batch in batches:
            anchor = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            home = batch.column(2).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            both = (anchor << 32) | part
            cuts = np.flatnonzero(np.diff(both)) + 1
            links: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(both)]):
                if both[lo] != key:
                    key, homes, solid = both[lo], [], None
                inside = home[lo:hi]
                if inside.any():
                    homes.append(fp[lo:hi][inside])
                    solid = None
                guests = fp[lo:hi][~inside]
                if len(guests) and homes:
                    if solid is None:
                        solid = np.concatenate(homes)
                    links += _links_of(solid, guests, distance)
            if links:
                a = np.array(links, dtype=np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])
    return run


def links(fps: DataFrame, distance: int = 4, part_homes: int = PART_HOMES) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the distance."""
    if distance > 4:
        raise ValueError("the three blocks meet differences of up to 4 bits")
    routed = fps.select("fp").mapInArrow(_routes, "anchor int, home boolean, fp bigint")
    # one row for each anchor that is cut into parts: at most 3 x 4096
    hot = routed.where("home").groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_homes)
    sized = routed.join(F.broadcast(hot), F.col("anchor") == F.col("_anchor"), "left")
    parts = F.coalesce(F.ceil(F.col("_n") / part_homes).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts.cast("bigint")).cast("int")
    dealt = sized.select("anchor", F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part"), "home", "fp")
    # a home also visits: pairs inside one part and between parts of an anchor
    again = sized.where("home").select("anchor", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(False).alias("home"), "fp")
    laid = dealt.unionByName(again).repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"), "fp")
    return laid.mapInArrow(_meet(distance), "a bigint, b bigint")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the links, root the smallest node reachable.

    Each round points every node at the smallest node around it and at that
    node's own pointer, until nothing changes. Rounds are checkpointed.
    """
    edges = staged(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    roots = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    for _ in range(rounds):
        around = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        near = roots.join(around, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = staged(near.join(jump, "root", "left").select("node", "old", F.least("root", "far").alias("root")))
        changed = step.where(F.col("old") != F.col("root")).limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("components did not settle")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """Adds ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable by links.

    Fingerprints link at ``distance`` or fewer differing bits. Null and blank
    texts have fingerprint zero and link like any other. Null keys never name
    a component unless all its keys are null. Repeated rows stay. The result
    has the key and these two columns.
    """
    marked = staged(docs.select(F.col(key).alias("id"), fingerprints(F.col(text)).alias("fp")))
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(distinct, distance))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    final = joined.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(final, "fp").select(F.col("id").alias(key), hex_of(F.col("fp")).alias("fingerprint"), "component_id")
