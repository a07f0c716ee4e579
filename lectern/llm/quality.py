"""Quality rules: line and word rules, and a hashed n-gram likelihood ratio.

The n-grams of a text are its words, the last three characters of each word and
its word pairs, hashed into buckets. Bucket counts of trusted texts and of the whole corpus give
two multinomials, and a text is judged by its mean log-likelihood ratio per
n-gram against a fixed threshold. Counting is a map-side-combined aggregate, so
only bucket counts are shuffled; judging is one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.spans import finished

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: a power of two
BUCKETS = 1 << 14
#: bound of the trusted sample
MAX_TRUSTED = 20_000
#: nats per n-gram below which a text is not kept
MIN_RATIO = -1.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def buckets_of(word: Column, before: Column, buckets: int) -> list[Column]:
    """Buckets of the n-grams that one word gives: itself, its last three characters, and it with the word before (none: empty)."""
    return [F.hash(*part).bitwiseAND(F.lit(buckets - 1)) for part in ([word], [F.substring(word, -3, 3)], [before, word])]


def paired(words: Column) -> Column:
    """Every word with the word before it, the first one with an empty one."""
    return F.arrays_zip(words.alias("word"), F.slice(F.concat(F.array(F.lit("")), words), F.lit(1), F.size(words)).alias("before"))


def fit_ratios(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED
) -> list[float]:
    """Log ratio of each bucket, trusted texts against all texts, both smoothed by one.

    Every document counts for the corpus. Trusted are documents labelled with
    quality 1, at most about ``max_trusted`` of them, those with the smallest
    seeded hash; so their ids can be broadcast and no text is shuffled. Without
    any trusted document all ratios are 0. The result has one number for each
    bucket, whatever the size of the corpus. A null key is never trusted; a
    key that is labelled twice counts once.
    """
    good_keys = labels.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(F.col(key).alias("trusted_key"))
    share = int(1_000_000 * min(1.0, max_trusted / max(1, good_keys.count())))
    trusted = good_keys.where(F.pmod(F.xxhash64("trusted_key", F.lit(23)), F.lit(1_000_000)) < share).distinct()
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("row_text"))
    # about max_trusted ids at most
    marked = rows.join(F.broadcast(trusted), rows["row_key"] == trusted["trusted_key"], "left")
    trusted_row = F.col("trusted_key").isNotNull().cast("long").alias("hit")
    words = marked.select(words_of(F.col("row_text")).alias("words"), trusted_row).select(F.explode(paired(F.col("words"))).alias("w"), "hit")
    grams = words.select(F.explode(F.array(*buckets_of(F.col("w.word"), F.col("w.before"), buckets))).alias("bucket"), "hit")
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("n_trusted")).collect()
    raw, good = sum(r["n"] for r in counts), sum(r["n_trusted"] for r in counts)
    if not good:
        return [0.0] * buckets
    ratios = [math.log((raw + buckets) / (good + buckets))] * buckets
    for r in counts:
        ratios[r["bucket"]] = math.log((r["n_trusted"] + 1) / (good + buckets)) - math.log((r["n"] + 1) / (raw + buckets))
    return ratios


def _repeated_starts(windows: Column, packed: Column, room: Column) -> Column:
    """Positions of windows that occur twice or more, in order.

    ``packed`` holds one sorted number for each window: its hash, with its
    position in the low bits below ``room``. Equal windows are neighbours
    there, and neighbours are compared word by word.
    """
    at = lambda x: x.bitwiseAND(room - 1).cast("int")
    pairs = F.filter(
        F.arrays_zip(packed.alias("a"), F.slice(packed, F.lit(2), F.size(packed)).alias("b")),
        lambda x: x["a"].bitwiseXOR(x["b"]) < room,
    )
    same = F.filter(pairs, lambda x: F.get(windows, at(x["a"])) == F.get(windows, at(x["b"])))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(at(x["a"]), at(x["b"]))))))


def _covered(starts: Column) -> Column:
    """Words in the union of 3-word windows at these ordered positions."""
    return F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def judge_quality(docs: DataFrame, ratios: list[float], text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """Adds a struct ``quality`` to every row: the counts of the rules, ``ratio``, ``base_failed``, ``kept``.

    A null or blank text has no words, ratio 0 and fails; a text of any length
    is read whole. Repeated rows are judged each by itself, an empty table stays
    empty; other columns stay as they are, but one named ``quality`` is replaced.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    table = F.split(F.lit(",".join(repr(r) for r in ratios)), ",").cast("array<double>")
    n = F.size("words")
    tail = lambda k: F.slice("words", F.lit(k), F.greatest(n - (k - 1), F.lit(0)))
    stage = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), given.alias("t"), words_of(F.col(text)).alias("words")
    ).select(
        "*",
        F.slice(
            F.arrays_zip(F.col("words").alias("a"), tail(2).alias("b"), tail(3).alias("c")),
            F.lit(1), F.greatest(n - 2, F.lit(0)),
        ).alias("windows"),
        F.pow(F.lit(2.0), F.ceil(F.log2(n + 2))).cast("bigint").alias("room"),
    ).select(
        "*",
        F.sort_array(F.transform(
            "windows", lambda w, i: F.xxhash64(w).bitwiseAND(-F.col("room")).bitwiseOR(i.cast("bigint"))
        )).alias("packed"),
    )
    repeated = _covered(_repeated_starts(F.col("windows"), F.col("packed"), F.col("room")))

    def gain(acc: Column, w: Column) -> Column:
        for bucket in buckets_of(w["word"], w["before"], len(ratios)):
            acc = acc + F.get(table, bucket)
        return acc

    lines = F.filter(F.split(F.col("t"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluated once
    measured = stage.select(
        "row", n.cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(F.col("t"), f"[{SYMBOLS}]")) - 1).cast("bigint").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.when(n > 0, F.aggregate(paired(F.col("words")), F.lit(0.0), gain) / (3 * n)).otherwise(F.lit(0.0)).alias("ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    result = F.struct(*names, "ratio", failed.alias("base_failed"), (~failed & (F.col("ratio") >= min_ratio)).alias("kept"))
    return finished(measured, docs.columns, result, "quality")
