"""Merkle fingerprints of texts over sections, paragraphs and sentences.

Sections are separated by an empty line, paragraphs by a line break; the leaves
of a paragraph are its sentences. Each level hashes the digests below it, so
equal roots mean equal texts, and branches that differ lead to the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_EDGE = r"(?<=[.!?] )"


def leaf_tree(text: Column) -> Column:
    """Digests of the leaves by section and paragraph; no character is left out."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n\n"),
        lambda section: F.transform(
            F.split(section, "\n"), lambda paragraph: F.transform(F.split(paragraph, LEAF_EDGE), lambda leaf: F.md5(leaf))
        ),
    )


def _joined(digests: Column) -> Column:
    return F.md5(F.array_join(digests, ""))


def paragraph_digests(tree: Column) -> Column:
    return F.transform(tree, lambda section: F.transform(section, _joined))


def fingerprint(tree: Column) -> Column:
    """Root, then short digests of all leaves with ``.`` between paragraphs and ``/`` between sections."""
    root = _joined(F.transform(paragraph_digests(tree), _joined))
    short = lambda leaves: F.array_join(F.transform(leaves, lambda d: F.substring(d, 1, 8)), "")
    body = F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, short), ".")), "/")
    return F.concat(root, F.lit(":"), body)


def leaves_of(tree: Column) -> Column:
    """Distinct short digests, what a fingerprint holds of its leaves."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(tree)), lambda d: F.substring(d, 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaves, 0 to 1."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """The paragraphs whose branch stands in one of two trees only, by (side, section, paragraph).

    ``side`` is 0 for what only ``a`` holds and 1 for what only ``b`` holds. Branches
    are aligned by their digests, not their places, so one inserted paragraph is
    one edit; a paragraph that stands several times is named by its first place.
    Digests of both trees are sorted together, and what has no equal neighbour of
    the other side is an edit.
    """
    def placed(tree: Column, side: int) -> Column:
        return F.flatten(F.transform(paragraph_digests(tree), lambda s, i: F.transform(s, lambda p, k: F.struct(
            p.alias("digest"), F.lit(side).alias("side"), i.alias("section"), k.alias("paragraph")))))

    def shifted(rows: Column, by: int) -> Column:
        none = F.array(F.lit(None).cast("struct<digest:string,side:int,section:int,paragraph:int>"))
        return F.concat(none, F.slice(rows, F.lit(1), F.size(rows) - 1)) if by > 0 else F.concat(F.slice(rows, F.lit(2), F.size(rows)), none)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def firsts(rows: Column) -> Column:
        pairs = F.filter(F.arrays_zip(rows.alias("row"), shifted(rows, 1).alias("last")), lambda x: ~(
            x["row"]["digest"].eqNullSafe(x["last"]["digest"]) & x["row"]["side"].eqNullSafe(x["last"]["side"])))
        return F.transform(pairs, lambda x: x["row"])

    def alone(rows: Column) -> Column:
        around = F.arrays_zip(rows.alias("row"), shifted(rows, 1).alias("last"), shifted(rows, -1).alias("next"))
        kept = F.filter(around, lambda x: ~x["row"]["digest"].eqNullSafe(x["last"]["digest"]) & ~x["row"]["digest"].eqNullSafe(x["next"]["digest"]))
        return F.sort_array(F.transform(kept, lambda x: F.struct(
            x["row"]["side"].alias("side"), x["row"]["section"].alias("section"), x["row"]["paragraph"].alias("paragraph"))))

    return once(F.sort_array(F.concat(placed(a, 0), placed(b, 1))), lambda rows: once(firsts(rows), alone))


def listed_edits(edits: Column) -> Column:
    """Edits as text: ``-section.paragraph`` for what is gone, ``+section.paragraph`` for what is new."""
    return F.array_join(F.transform(edits, lambda e: F.concat(
        F.when(e["side"] == 0, "-").otherwise("+"), e["section"].cast("string"), F.lit("."), e["paragraph"].cast("string"))), ",")


def with_next(docs: DataFrame, key: str, columns: list[str], pieces: int) -> DataFrame:
    """Adds ``next_<column>`` of the following row by ascending ``key``; the last row is followed by the first.

    Rows are dealt by quantiles of the key into pieces that are ordered by
    themselves; the first rows of a piece also go to the piece before it, as
    guests that are only looked at. Null keys come first; rows with one key
    follow in the order of ``columns``. One row is its own successor.
    """
    low = -(1 << 63)
    laid = docs.withColumn("_k", F.coalesce(F.col(key).cast("bigint"), F.lit(low)))
    shares = [i / pieces for i in range(1, pieces)]
    got = laid.agg(F.percentile_approx("_k", F.lit(shares) if shares else F.lit([0.5]), 20000)).first()[0] or []
    bounds = sorted(set(got)) if shares else []
    chunk = max(1, round(len(bounds) ** 0.5))
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    coarse = [bounds[i] for i in range(chunk - 1, len(bounds), chunk)]
    upper = F.array(*[F.lit(b).cast("bigint") for b in coarse]) if coarse else F.array().cast("array<bigint>")
    reached = lambda arr: F.size(F.filter(arr, lambda b: b <= F.col("_k")))
    laid = laid.withColumn("_skip", reached(upper) * chunk)
    laid = laid.withColumn("_piece", F.col("_skip") + reached(F.slice(table, F.col("_skip") + 1, F.lit(chunk))))
    heads = sorted((r["_piece"], r["h"]) for r in laid.groupBy("_piece").agg(F.min("_k").alias("h")).collect())  # one for each piece
    first_of, before_of = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, (piece, head) in enumerate(heads):
        first_of[piece], before_of[piece] = head, heads[i - 1][0]
    listed = lambda xs, kind: F.split(F.lit(",".join("" if x is None else str(x) for x in xs)), ",").cast(f"array<{kind}>")
    is_head = F.col("_k") == F.get(listed(first_of, "bigint"), F.col("_piece"))
    guests = F.when(is_head, F.array(F.get(listed(before_of, "int"), F.col("_piece")))).otherwise(F.array().cast("array<int>"))
    wrap = F.lit(heads[0][0] if heads else 0)
    seats = F.transform(F.concat(F.array(F.col("_piece")), guests), lambda p, i: F.struct(
        p.alias("piece"), (i > 0).alias("guest"), ((i > 0) & (F.col("_piece") == wrap)).alias("wrapped")))
    seated = laid.withColumn("_seat", F.explode(seats))
    order = Window.partitionBy("_seat.piece").orderBy(F.col("_seat.wrapped"), F.col("_k"), *[F.col(f"`{c}`") for c in columns], F.col("_seat.guest"))
    ahead = seated.withColumns({f"next_{c}": F.lead(F.col(f"`{c}`"), 1).over(order) for c in columns})
    return ahead.where(~F.col("_seat.guest")).drop("_k", "_skip", "_piece", "_seat")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness.

    The edited text is the text with the last half of its code points replaced
    by the first as many of the next document. A null text is an empty one.
    Equal texts have equal fingerprints and likeness 1. ``edits`` are the
    paragraphs that differ between a text and its edited text. Repeated rows
    follow each other, an empty table stays empty, texts of any length are read
    whole. Rows are narrowed to the key and the results.
    """
    pieces = pieces or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pair = with_next(given, key, ["t"], pieces)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    texts = pair.select(
        F.col(key), "t", "next_t", n.cast("bigint").alias("n_chars"),
        F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half)).alias("edited"),
    )
    trees = texts.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), leaf_tree(F.col("t")).alias("tree"),
        leaf_tree(F.col("edited")).alias("edited_tree"), leaf_tree(F.col("next_t")).alias("next_tree"),
    )
    sets = trees.select(
        key, "n_chars", "edited_sha256", fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), leaves_of(F.col("tree")).alias("a"),
        leaves_of(F.col("edited_tree")).alias("b"), leaves_of(F.col("next_tree")).alias("c"),
        differing_paragraphs(F.col("tree"), F.col("edited_tree")).alias("edits"),
    )
    return sets.select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), "edits",
    )


def oracle_sql() -> str:
    split = "string_split(regexp_replace(p, '([.!?] )', '\\1' || chr(1), 'g'), chr(1))"
    tree = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform({split}, lambda l: md5(l))))"
    para = lambda t: f"list_transform({t}, lambda s: list_transform(s, lambda p: md5(array_to_string(p, ''))))"
    root = lambda t: f"md5(array_to_string(list_transform({para(t)}, lambda s: md5(array_to_string(s, ''))), ''))"
    body = lambda t: f"array_to_string(list_transform({t}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda l: l[1:8]), '')), '.')), '/')"
    flat = lambda t: f"list_distinct(list_transform(flatten(flatten({t})), lambda l: l[1:8]))"
    like = lambda a, b: f"2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


    def places(tree_: str, side: int) -> str:
        return f"""s{side} AS (SELECT doc_id, unnest({para(tree_)}) AS ps, generate_subscripts({tree_}, 1) - 1 AS i FROM f),
u{side} AS (SELECT doc_id, i, unnest(ps) AS d, generate_subscripts(ps, 1) - 1 AS k FROM s{side}),
p{side} AS (SELECT doc_id, {side} AS side, d, min([i, k]) AS place FROM u{side} GROUP BY doc_id, d)"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST, t), first_value(t) OVER (ORDER BY doc_id NULLS FIRST, t)) AS nt FROM d),
e AS (SELECT *, length(t) AS k, substring(t, 1, length(t) - length(t) // 2) || substring(nt, 1, length(t) // 2) AS et FROM n),
f AS (SELECT *, {tree("t")} AS a, {tree("et")} AS b, {tree("nt")} AS c FROM e),
g AS (SELECT *, {flat("a")} AS sa, {flat("b")} AS sb, {flat("c")} AS sc FROM f),
{places("a", 0)}, {places("b", 1)},
m AS (SELECT * FROM p0 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.doc_id = p0.doc_id AND p1.d = p0.d)
      UNION ALL SELECT * FROM p1 WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.doc_id = p1.doc_id AND p0.d = p1.d)),
x AS (SELECT doc_id, string_agg(CASE side WHEN 0 THEN '-' ELSE '+' END || place[1] || '.' || place[2], ',' ORDER BY side, place) AS edits FROM m GROUP BY doc_id)
SELECT doc_id, CAST(k AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, {root("a")} || ':' || {body("a")} AS fingerprint,
  {root("b")} || ':' || {body("b")} AS edited_fingerprint, {like("sa", "sb")} AS near_edited, {like("sa", "sc")} AS near_next, coalesce(edits, '') AS edits
FROM g LEFT JOIN x USING (doc_id)
"""
