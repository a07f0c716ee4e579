"""Ranked lexical search: item bundles travel through the owners of their terms.

Documents are dealt to blocks, and each block's terms are turned into postings.
Terms have owners, the rare ones the first, the common ones the last. For every
block an item's bundle, its terms with their weights and a sparse accumulator
of documents, is cogrouped with the postings of one owner after the other; each
adds its integer contributions. Between owners an accumulator drops documents
that cannot reach the block's k-th score any more, whatever the later owners
add: results are exact, and what travels is small because rare terms come
first. After the last owner the k best documents of each block are left, and
the best of those are the answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.settings import staged

TOP = 10
BLOCK_DOCS = 4096
BUNDLE_ITEMS = 256
#: an owner takes the terms that stand in less than this share of all documents
OWNERS = (1 / 32, 1 / 6, 2.0)
#: bits of the filter of query terms; equal hashes only let a term through for nothing
FILTER_BITS = 1 << 20
#: above any value of the frequency part of a contribution
LIMIT = 1_000_000
#: what is no part of a term becomes a space, A-Z becomes lower-case; a term is a run of what is left
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term) of every item, once each."""
    kind = items.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            terms = pa.array([t.decode() for f in found for t in f], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), terms], names=["item", "term"])

    named = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, f"item {kind.simpleString()}, term string").distinct()


def _packed(values, kind) -> bytes:
    return np.asarray(values, dtype=kind).tobytes()


def _postings(docs: DataFrame, key: str, text: str, wanted: np.ndarray, blocks: int) -> DataFrame:
    """Postings of every block: (block, term, docs, tfs), and under a null term its documents' keys and lengths.

    Documents of a block are numbered in the order of their keys, null first.
    """
    kind = docs.schema[key].dataType.simpleString()
    bits = wanted.tobytes()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = np.frombuffer(bits, np.uint8), {}
        for batch in batches:
            lengths, names, counts = [], [], []
            for t in batch.column(2):
                tf = Counter(terms_of(t.as_py()))
                if len(known) > 500_000:
                    known.clear()
                for term in tf:
                    if term not in known:
                        known[term] = bool(asked[xxhash.xxh64_intdigest(term, 42) % FILTER_BITS])
                kept = [term for term in tf if known[term]]
                lengths.append(sum(tf.values()))
                names.append(b" ".join(kept).decode())
                counts.append(_packed([tf[term] for term in kept], "<u4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(names, pa.string()), pa.array(counts, pa.binary())],
                names=["block", "doc", "n", "terms", "tfs"],
            )

    def inverted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("n", "ascending")])
        nulls = table.filter(pc.is_null(table["doc"]))
        table = pa.concat_tables([nulls, table.filter(pc.is_valid(table["doc"]))])
        rows: dict[str, tuple[list, list]] = {}
        for i, (names, counts) in enumerate(zip(table["terms"], table["tfs"])):
            if len(names.as_py()):
                for term, tf in zip(names.as_py().split(" "), np.frombuffer(counts.as_py(), "<u4").tolist()):
                    at, tfs = rows.setdefault(term, ([], []))
                    at.append(i)
                    tfs.append(tf)
        block = table["block"][0].as_py()
        order = sorted(rows)
        some = len(order) + 1
        lengths = table["n"].to_numpy()
        keys = pa.array([None] * len(order) + [table["doc"].to_pylist()], pa.list_(table.schema.field("doc").type))
        return pa.table({
            "block": pa.array([block] * some, pa.int64()), "term": pa.array([*order, None], pa.string()),
            "docs": pa.array([*(_packed(rows[t][0], "<u4") for t in order), None], pa.binary()),
            "tfs": pa.array([*(_packed(rows[t][1], "<u4") for t in order), _packed(lengths, "<i8")], pa.binary()),
            "count": pa.array([*(len(rows[t][0]) for t in order), int((lengths > 0).sum())], pa.int64()),
            "length": pa.array([*([0] * len(order)), int(lengths.sum())], pa.int64()),
            "keys": keys,
        })

    # rows are dealt evenly, whatever their keys; the answer does not depend on it
    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    narrow = dealt.mapInArrow(counted, f"block bigint, doc {kind}, n bigint, terms string, tfs binary")
    return narrow.groupBy("block").applyInArrow(inverted, f"block bigint, term string, docs binary, tfs binary, count bigint, length bigint, keys array<{kind}>")


def _at_owner(owner: int, top: int, total: int, length: int, last: bool):
    """Adds the contributions of one owner to the bundles of a block; the last one picks the best documents."""
    def kth(scores: np.ndarray) -> int:
        return int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0

    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        found, sizes, keys = {}, None, None
        for term, docs, tfs, ids in zip(*(postings[c] for c in ("term", "docs", "tfs", "keys"))):
            if term.as_py() is None:
                sizes, keys = np.frombuffer(tfs.as_py(), "<i8"), ids
            else:
                found[term.as_py()] = (np.frombuffer(docs.as_py(), "<u4"), np.frombuffer(tfs.as_py(), "<u4").astype(np.int64))
        n_docs = 0 if sizes is None else len(sizes)
        m = 10 + (90 * sizes * total) // length if n_docs else None
        impacts: dict[str, np.ndarray] = {}
        out_docs, out_scores, ranked = [], [], []
        for i, (terms, weights, owners, docs, scores) in enumerate(zip(*(bundles[c] for c in ("terms", "weights", "owners", "docs", "scores")))):
            own = list(zip(terms.as_py(), weights.as_py(), owners.as_py()))
            carried, had = np.frombuffer(docs.as_py(), "<u4"), np.frombuffer(scores.as_py(), "<i8")
            total_scores = np.zeros(n_docs, np.int64)
            total_scores[carried] = had
            ahead = LIMIT * sum(w for _, w, o in own if o >= owner)
            # a document that no owner before has met can only be among the best if this owner and the later ones can lift it there
            closed = len(carried) >= top and ahead < kth(had)
            for term, weight, o in own:
                if o == owner and term in found:
                    at, tf = found[term]
                    if term not in impacts:
                        impacts[term] = impact(tf, m[at])
                    total_scores[at] += weight * impacts[term]
            if closed:
                met = np.zeros(n_docs, bool)
                met[carried] = True
                total_scores[~met] = 0
            rest = LIMIT * sum(w for _, w, o in own if o > owner)
            left = np.flatnonzero((total_scores > 0) & (total_scores + rest >= kth(total_scores))) if n_docs else np.zeros(0, np.int64)
            if last:
                # documents are numbered by key, so a stable order settles ties
                best = left[np.argsort(-total_scores[left], kind="stable")][:top]
                ranked += [(i, int(d), int(total_scores[d])) for d in best]
            else:
                out_docs.append(_packed(left, "<u4"))
                out_scores.append(_packed(total_scores[left], "<i8"))
        if not last:
            lists = {"terms": pa.string(), "weights": pa.int64(), "owners": pa.int32()}
            kept = [bundles[c].cast(pa.list_(kind)) for c, kind in lists.items()]
            return pa.table([bundles["bundle"], bundles["item"], *kept, bundles["block"], pa.array(out_docs, pa.binary()), pa.array(out_scores, pa.binary())],
                            names=["bundle", "item", *lists, "block", "docs", "scores"])
        picked = pa.array([d for _, d, _ in ranked], pa.int64())
        doc_keys = keys.values.take(picked) if keys is not None else pa.array([], postings.schema.field("keys").type.value_type)
        return pa.table({
            "item": bundles["item"].take(pa.array([i for i, _, _ in ranked], pa.int64())), "doc": doc_keys, "score": pa.array([s for _, _, s in ranked], pa.int64()),
        })

    return run


def rank_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    top: int = TOP, block_docs: int = BLOCK_DOCS, bundle_items: int = BUNDLE_ITEMS, owners: tuple[float, ...] = OWNERS,
) -> DataFrame:
    """(item, ``rank``, key, ``score``): the ``top`` best documents of every item with a score above 0.

    Every document row is ranked by itself, so repeated rows take ranks of
    their own; equal scores go by key, null first. Rows of ``items`` with equal
    keys, null included, are one item with all their terms. A null, empty or
    term-less text has no terms: such a document does not count, such an item
    has no rows. Texts of any length are read whole. Empty tables give no rows.
    Other columns are not read.
    """
    wanted = staged(_item_terms(items, item_key, item_text))
    item_kind, key_kind = items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    # at most FILTER_BITS numbers, whatever the number of items
    hashed = wanted.select(F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)).cast("int").alias("at")).distinct()
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[[r["at"] for r in hashed.collect()]] = 1
    blocks = max(1, -(-docs.count() // block_docs))
    postings = staged(_postings(docs, key, text, bits, blocks))
    total, length = postings.where(F.col("term").isNull()).agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    frequency = postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1)))
    owner = F.lit(len(owners) - 1)
    for k in reversed(range(len(owners) - 1)):
        owner = F.when(F.col("df") < owners[k] * total, k).otherwise(owner)
    weighed = wanted.join(frequency, "term").select("item", "term", weight.alias("weight"), owner.alias("owner")).where(F.col("weight") > 0)
    own_terms = F.sort_array(F.collect_list(F.struct("term", "weight", "owner")))
    groups = max(1, -(-items.count() // bundle_items))
    # one row an item; a block's documents are bounded, so each item visits every block
    bundles = staged(weighed.groupBy("item").agg(own_terms.alias("own")).select(
        F.pmod(F.xxhash64("item"), F.lit(groups)).alias("bundle"), "item", F.col("own.term").alias("terms"),
        F.col("own.weight").alias("weights"), F.col("own.owner").alias("owners"),
    ))
    asked = bundles.select(F.col("bundle").alias("to"), F.explode(F.arrays_zip("terms", "owners")).alias("t")).select(
        "to", F.col("t.terms").alias("asked"), F.col("t.owners").alias("owner")).distinct()
    empty = F.lit(b"").cast("binary")
    moving = bundles.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))), "docs": empty, "scores": empty})
    shape = f"bundle bigint, item {item_kind}, terms array<string>, weights array<bigint>, owners array<int>, block bigint, docs binary, scores binary"
    columns = ["block", "to", "term", "docs", "tfs", "keys"]
    tables = postings.where(F.col("term").isNull()).withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))).select(*columns)
    for k in range(len(owners)):
        mine = postings.join(asked.where(F.col("owner") == k), F.col("term") == F.col("asked")).select(*columns)
        last = k == len(owners) - 1
        moving = moving.groupBy("block", "bundle").cogroup(mine.unionByName(tables).groupBy("block", "to")).applyInArrow(
            _at_owner(k, top, total, length, last), f"item {item_kind}, doc {key_kind}, score bigint" if last else shape)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_first())
    ranked = moving.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")


def oracle_sql(top: int = TOP) -> str:
    """The query's rows by DuckDB: every contribution as a row, added up."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
d AS (SELECT row, doc_id, words, len(words) AS n FROM w WHERE len(words) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM d),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
c AS (SELECT item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total) // length))))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {top}
"""
