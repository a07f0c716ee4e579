"""Translation memory, termbase and chunk packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.casts import bool_listed
from lectern.functions.text import norm_slide, norm_tm, speech_text, utf8_size
from lectern.operators.chunking import greedy_chunks
from lectern.operators.scan import OrderedScan
from lectern.operators.segments import SEGMENT_ORDER


# -- packing ----------------------------------------------------------------


def pack_chunks(segments: DataFrame, max_count: int = 12, max_chars: int = 2800, split: bool | None = None) -> DataFrame:
    """Chunk number of every non-empty segment: a segment that would overflow a limit opens the next chunk."""
    rows = segments.where(F.trim("text") != "").select("video_id", *SEGMENT_ORDER, F.length("text").alias("size"))
    packed = greedy_chunks(rows, "video_id", SEGMENT_ORDER, {"size": (max(400, max_chars), 0)}, max_count, split=split)
    return packed.select("video_id", "segment_id", "chunk_index")


def speech_byte_budget(prompt_bytes: int, max_text: int = 3800, max_prompt: int = 4000, max_request: int = 7900) -> int:
    if prompt_bytes <= 0 or prompt_bytes > max_prompt or prompt_bytes >= max_request:
        raise ValueError(f"a prompt of {prompt_bytes} bytes leaves no room for text")
    return max(200, min(max_text, max_request - prompt_bytes))


def pack_speech_chunks(
    segments: DataFrame, prompt_bytes: int, *, max_chars: int = 3200, max_segments: int = 40,
    max_text: int = 3800, max_prompt: int = 4000, max_request: int = 7900, single_max_ms: int = 620_000, split: bool | None = None,
) -> DataFrame:
    """Chunks for speech synthesis, limited in characters, segments and UTF-8 bytes.

    A short transcript that fits one request stays whole.  A segment that is
    larger than the byte budget by itself is marked ``oversize``.
    """
    budget = speech_byte_budget(prompt_bytes, max_text, max_prompt, max_request)
    text = speech_text(F.col("translated_text"), F.col("text"))
    rows = segments.withColumn("tts_text", text).where(F.col("tts_text").isNotNull()).select(
        "video_id", *SEGMENT_ORDER, F.length("tts_text").alias("size_a"), utf8_size(F.col("tts_text")).alias("size_b"))
    whole = rows.groupBy("video_id").agg(
        (F.sum("size_b") + F.count(F.lit(1)) - 1 <= budget).alias("__fits"),
        (F.max("end_ms") - F.min("start_ms") <= single_max_ms).alias("__short"),
    )
    limits = {"size_a": (max(200, max_chars), 1), "size_b": (budget, 1)}
    packed = greedy_chunks(rows, "video_id", SEGMENT_ORDER, limits, max_segments, split=split).join(
        rows.select(F.col("video_id").alias("__v"), F.col("segment_id").alias("__s"), "size_b"),
        F.col("video_id").eqNullSafe(F.col("__v")) & F.col("segment_id").eqNullSafe(F.col("__s")))
    single = F.col("__fits") & F.col("__short")
    return (
        packed.join(whole, "video_id")
        .select("video_id", "segment_id",
                F.when(single, F.lit(1).cast("bigint")).otherwise(F.col("chunk_index")).alias("chunk_index"),
                F.when(single, "single_request").otherwise("chapter_chunks").alias("mode"),
                (~single & (F.col("size_b") > budget)).alias("oversize"))
    )


def number_batches(rows: DataFrame, keys: list[str], order: list[str], size: int, split: bool | None = None) -> DataFrame:
    """Batches of a fixed size in key order."""
    scanned = OrderedScan(rows, keys, order).row_number("__n").apply(split)
    return scanned.withColumn("batch_no", F.floor((F.col("__n") - 1) / max(1, size)).cast("bigint") + 1).drop("__n")


# -- translation memory -------------------------------------------------------


def tm_lookup(texts: DataFrame, entries: DataFrame, text: str = "source_text", language: str = "target_language") -> DataFrame:
    """Exact hits on the normalized text; both sides may be large, so the join is left to Spark."""
    found = entries.select(
        F.col("source_text_norm").alias("__norm"), F.col("target_language").alias("__lang"),
        F.col("target_text").alias("tm_target_text"), F.lit(True).alias("__hit"),
    )
    keyed = texts.withColumn("source_text_norm", norm_tm(F.col(text)))
    return (
        keyed.join(
            found, (F.col("source_text_norm") == F.col("__norm")) & (F.col(language) == F.col("__lang"))
            & (F.col("source_text_norm") != ""), "left")
        .withColumn("tm_exact_hit", F.coalesce("__hit", F.lit(False)))
        .drop("__norm", "__lang", "__hit")
    )


def tm_merge(entries: DataFrame, new: DataFrame, now: Column, status: str = "machine_unreviewed") -> DataFrame:
    """Upsert: the last new pair per (text, language) wins; empty keys and targets are ignored.

    ``new``: run_id, pos, target_language, source_text, target_text.  A later
    pair without run id does not clear an earlier one.  The old row keeps its
    hit count and creation time.
    """
    lang = F.trim("target_language")
    usable = (
        new.withColumns({"source_text_norm": norm_tm(F.col("source_text")), "target_language": lang,
                         "target_text": F.trim("target_text"), "run_id": F.trim(F.coalesce("run_id", F.lit("")))})
        .where((F.col("source_text_norm") != "") & (F.col("target_language") != "") & (F.col("target_text") != ""))
    )
    at = F.struct("run_id", "pos")
    last = usable.groupBy("source_text_norm", "target_language").agg(
        F.max_by(F.struct("source_text", "target_text"), at).alias("n"),
        F.max_by("run_id", F.when(F.col("run_id") != "", at)).alias("n_run"),
    )
    old = entries.select(
        "source_text_norm", "target_language", F.struct("source_text", "target_text", "status", "origin_run_id",
                                                         "hit_count", "created_at", "updated_at").alias("o"))
    zero = F.lit(0).cast("bigint")
    fresh = F.col("n").isNotNull()
    return old.join(last, ["source_text_norm", "target_language"], "full").select(
        "source_text_norm", "target_language",
        F.coalesce("n.source_text", "o.source_text").alias("source_text"),
        F.coalesce("n.target_text", "o.target_text").alias("target_text"),
        F.when(fresh, F.lit(status)).otherwise(F.col("o.status")).alias("status"),
        F.coalesce("n_run", "o.origin_run_id", F.lit("")).alias("origin_run_id"),
        F.coalesce("o.hit_count", zero).alias("hit_count"),
        F.coalesce("o.created_at", now).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def tm_bootstrap(runs: DataFrame, now: Column, entries: DataFrame | None = None) -> DataFrame:
    """A memory from the pairs of all runs, in run order."""
    if entries is None:
        norm = F.lit(None).cast("string")
        entries = runs.limit(0).select(
            norm.alias("source_text_norm"), "target_language", "source_text", "target_text", norm.alias("status"),
            norm.alias("origin_run_id"), F.lit(0).cast("bigint").alias("hit_count"), now.alias("created_at"),
            now.alias("updated_at"))
    return tm_merge(entries, runs, now, status="bootstrap")


def tm_add_hits(entries: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Add the number of exact hits of a batch to the memory."""
    counts = hits.where("tm_exact_hit").groupBy("source_text_norm", "target_language").agg(
        F.count(F.lit(1)).alias("__n"))
    return (
        entries.join(counts, ["source_text_norm", "target_language"], "left")
        .withColumn("hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0)))
        .withColumn("updated_at", F.when(F.col("__n").isNotNull(), now).otherwise(F.col("updated_at")))
        .drop("__n")
    )


def repeat_hits(rows: DataFrame, keys: list[str], chunk: str = "chunk_index") -> DataFrame:
    """A repeated text hits only if its first occurrence was in an earlier chunk.

    The first chunk comes from a pre-aggregated table, so a text that fills a
    third of the rows is not gathered in one task.
    """
    first = rows.groupBy(*keys).agg(F.min(chunk).alias("first_chunk"))
    return rows.join(first, keys).withColumn("repeat_hit", F.col(chunk) > F.col("first_chunk"))


# -- termbase -----------------------------------------------------------------


def select_termbase(rows: DataFrame, target: str) -> DataFrame:
    """Usable terms for a language; ``term_order`` puts longer terms first, then file order.

    ``rows``: pos, source_text, target_language, target_text, case_sensitive.
    """
    source, lang = F.trim(F.coalesce("source_text", F.lit(""))), F.trim(F.coalesce("target_language", F.lit("")))
    out = F.trim(F.coalesce("target_text", F.lit("")))
    keep = (source != "") & (out != "")
    if target:
        keep &= lang.isin(target, "*", "")
    return rows.where(keep).select(
        "pos", source.alias("source_text"), F.coalesce(F.nullif(lang, F.lit("")), F.lit(target)).alias("target_language"),
        out.alias("target_text"), bool_listed(F.col("case_sensitive")).alias("case_sensitive"),
        F.struct((-F.length(source)).alias("neg_length"), F.col("pos")).alias("term_order"),
    )


def exact_termbase(terms: DataFrame) -> DataFrame:
    """First target per normalized term, in term order."""
    return (
        terms.withColumn("source_text_norm", norm_slide(F.col("source_text")))
        .where(F.col("source_text_norm") != "")
        .groupBy("source_text_norm").agg(F.min_by("target_text", F.col("term_order")).alias("target_text"))
    )


def match_termbase(candidates: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that are a whole term (frozen), and the others (pending)."""
    lookup = exact_termbase(terms)
    frozen = candidates.join(lookup, "source_text_norm").withColumns(
        {"origin": F.lit("termbase"), "status": F.lit("frozen")})
    return frozen, candidates.join(lookup, "source_text_norm", "left_anti")


PROTECTED = "struct<text:string,keys:array<string>,targets:array<string>>"
_WORKING = "struct<text:string,targets:array<string>>"
#: a termbase of so many terms is sent to the texts, a larger one is joined to them
FEW_TERMS = 256
#: what a term or a text is looked up by: its words, and its signs for terms without a word
_PARTS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def _look_up_key(term: Column) -> Column:
    """The longest word of a term (the first of several), or its first sign.

    A word inside a term is a whole word wherever the term stands in a text, so
    this one equality finds every place; long words are the rarer ones.
    """
    words = F.regexp_extract_all(F.lower(term), F.lit(r"([\p{L}\p{N}]+)"))
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.coalesce(F.nullif(longest, F.lit("")), F.substring(F.lower(term), 1, 1))


def _term_pattern(term: Column, case_sensitive: Column) -> Column:
    """A term is found as a whole word where its edge is a letter or a digit, literally elsewhere."""
    def edge(at: str, look: str) -> Column:
        return F.when(term.rlike(at), F.lit(look)).otherwise(F.lit(""))

    literal = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(
        F.when(case_sensitive, F.lit("")).otherwise(F.lit("(?iu)")), edge(r"^[\p{L}\p{N}]", r"(?<![\p{L}\p{N}_])"),
        literal, edge(r"[\p{L}\p{N}]$", r"(?![\p{L}\p{N}_])"))


def _replaced(text: Column, terms: Column) -> Column:
    """The terms of a text replaced one after the other; placeholders are numbered in that order."""
    def placeholder(number: Column) -> Column:
        return F.format_string("__TERM_%04d__", number.cast("int"))

    def step(acc: Column, term: Column) -> Column:
        before = F.size(acc["targets"])

        def joined(pieces: Column) -> Column:
            marked = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(placeholder(before + i), p)))
            return F.struct(
                F.array_join(marked, "").alias("text"),
                F.concat(acc["targets"], F.array_repeat(term["target_text"], F.size(pieces) - 1)).alias("targets")).cast(_WORKING)

        # one element, so that a text is cut once and not wherever its pieces are named
        return F.element_at(F.transform(F.array(F.split(acc["text"], term["pattern"])), joined), 1)

    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("targets")).cast(_WORKING)
    return F.aggregate(terms, start, step, lambda acc: F.struct(
        acc["text"].alias("text"), F.transform(acc["targets"], lambda _t, i: placeholder(i + 1)).alias("keys"),
        acc["targets"].alias("targets")).cast(PROTECTED))


def protect_terms(rows: DataFrame, text: str, terms: DataFrame, few_terms: int = FEW_TERMS) -> DataFrame:
    """Adds ``protected`` (text, keys, targets) and ``termbase_hits``.

    The terms one of whose words a text contains are replaced in term order.  A
    termbase of up to ``few_terms`` terms goes to the texts; otherwise each
    distinct text is joined to its terms by equality, and only the digest of a
    text takes part in that join.
    """
    patterns = terms.select(
        _look_up_key(F.col("source_text")).alias("__part"),
        F.struct("term_order", _term_pattern(F.col("source_text"), F.col("case_sensitive")).alias("pattern"), "target_text").alias("t"))
    plain = rows.withColumn("__plain", F.coalesce(F.col(text), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("__plain"), F.lit(_PARTS), F.lit(0)))
    if patterns.limit(few_terms + 1).count() <= few_terms:
        listed = patterns.agg(F.array_sort(F.collect_list(F.struct("t", "__part"))).alias("__all")).scalar()
        # one element, so that the words are cut out once and not for each term
        own = plain.withColumn("__all", listed).withColumn("__terms", F.element_at(F.transform(
            F.array(words), lambda w: F.filter("__all", lambda x: F.array_contains(w, x["__part"]))), 1)).drop("__all")
        return own.withColumn("protected", _replaced(F.col("__plain"), F.col("__terms.t"))).drop("__plain", "__terms").withColumn(
            "termbase_hits", F.size("protected.keys").cast("bigint"))
    plain = plain.withColumn("__id", F.sha2("__plain", 256))
    texts = plain.select("__id", "__plain").dropDuplicates(["__id"])
    parts = texts.select("__id", F.explode(words).alias("__part"))
    found = parts.join(patterns, "__part").groupBy("__id").agg(F.array_sort(F.collect_list("t")).alias("__terms"))
    done = texts.join(found, "__id").select(
        "__id", _replaced(F.col("__plain"), F.col("__terms")).alias("protected"))
    none = F.array().cast("array<string>")
    untouched = F.struct(F.col("__plain").alias("text"), none.alias("keys"), none.alias("targets")).cast(PROTECTED)
    return plain.join(done, "__id", "left").withColumn("protected", F.coalesce("protected", untouched)).drop(
        "__id", "__plain").withColumn("termbase_hits", F.size("protected.keys").cast("bigint"))


def restore_terms(text: Column, keys: Column, targets: Column) -> tuple[Column, Column]:
    """The text with its terms back, and whether a placeholder was lost."""
    pairs = F.arrays_zip(keys.alias("keys"), targets.alias("targets"))
    restored = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["keys"], p["targets"]))
    lost = F.exists(keys, lambda k: ~F.contains(text, k))
    return restored, lost


# -- composition --------------------------------------------------------------


def segment_status(text: Column, tm_hit: Column, translated: Column, hits: Column) -> Column:
    return (
        F.when(F.trim(text) == "", "skipped_empty").when(tm_hit, "tm_exact")
        .when(translated.isNull(), "source_fallback").when(hits > 0, "translated_with_termbase")
        .otherwise("translated")
    )


def event_status(text: Column, failed: Column, tm_hits: Column, new: Column, term_hits: Column) -> Column:
    return (
        F.when(F.trim(text) == "", "skipped_empty").when(failed, "error")
        .when((tm_hits > 0) & (new == 0), "tm_exact").when(tm_hits > 0, "translated_with_tm")
        .when(term_hits > 0, "translated_with_termbase").otherwise("translated")
    )


def translate_with_memory(
    segments: DataFrame, entries: DataFrame, terms: DataFrame, translations: DataFrame, language: str,
    max_count: int = 12, max_chars: int = 2800,
) -> DataFrame:
    """Translated segments from memory, earlier chunks of the same video, or the given translations.

    ``translations(protected_text, target_language, translated_text)`` is the
    output of a translation model for the protected texts.
    """
    chunked = segments.join(pack_chunks(segments, max_count, max_chars), ["video_id", "segment_id"], "left")
    looked = tm_lookup(chunked.withColumn("target_language", F.lit(language)), entries, "text")
    marked = looked.withColumn("__missed", ~F.col("tm_exact_hit") & F.col("chunk_index").isNotNull())
    texts = protect_terms(marked.where("__missed").select("text").distinct(), "text", terms)
    # one row for each text: of several translations the first in text order
    given = translations.where(F.col("target_language") == language).groupBy(F.col("protected_text").alias("__p")).agg(
        F.min("translated_text").alias("__t"))
    restored, lost = restore_terms(F.col("__t"), F.col("protected.keys"), F.col("protected.targets"))
    done = texts.join(given, F.col("protected.text") == F.col("__p"), "left").select(
        F.col("text").alias("__text"), "termbase_hits", F.when(~lost, restored).alias("new_text"), F.coalesce(lost, F.lit(False)).alias("lost_terms"))
    fresh = marked.join(done, F.col("__missed") & (F.col("text") == F.col("__text")), "left").drop("__text")
    # the first chunk in which a spelling of the text got a translation writes it, and later chunks find what was written last there
    keys = ["video_id", "source_text_norm"]
    written = fresh.where(F.col("new_text").isNotNull()).groupBy(*keys).agg(
        F.min("chunk_index").alias("__first"), F.max_by("new_text", F.struct(-F.col("chunk_index"), *SEGMENT_ORDER)).alias("__earlier"))
    out = fresh.join(written, keys, "left")
    later = F.coalesce(F.col("__missed") & (F.col("chunk_index") > F.col("__first")), F.lit(False))
    hit = F.col("tm_exact_hit") | later
    translated = F.when(F.col("tm_exact_hit"), F.col("tm_target_text")).when(later, F.col("__earlier")).otherwise(F.col("new_text"))
    hits = F.when(hit | translated.isNull(), F.lit(0)).otherwise(F.coalesce("termbase_hits", F.lit(0))).cast("bigint")
    return out.select(
        "video_id", "segment_id", "start_ms", "end_ms", "text",
        F.coalesce(translated, F.col("text")).alias("translated_text"), F.lit(language).alias("target_language"),
        segment_status(F.col("text"), hit, translated, hits).alias("translation_status"),
        hit.cast("bigint").alias("tm_exact_hit"), hits.alias("termbase_hits"), "source_text_norm",
        F.coalesce("lost_terms", F.lit(False)).alias("lost_terms"),
    )


def glossary_lines(pairs: DataFrame, keys: list[str], order: str, style: str = "- {s} -> {t}") -> DataFrame:
    """Prompt lines of a glossary per key, in order."""
    s, t = style.split("{s}")[0], style.split("{s}")[1].split("{t}")
    line = F.concat(F.lit(s), F.col("source_text"), F.lit(t[0]), F.col("target_text"), F.lit(t[1]))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return pairs.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("glossary"))
