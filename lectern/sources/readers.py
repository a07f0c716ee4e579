"""Readers: files of many runs at once, keyed by the run in their path."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lectern import schemas
from lectern.functions.casts import bool_strict, int_or
from lectern.functions.text import collapse, norm_token, numbered, parse_ids, translate_code
from lectern.functions.times import to_ms
from lectern.sources.lines import number_lines

RUN_ID = r"(\d{8}_\d{6}|\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})"
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")


def run_of_path(path: Column) -> Column:
    """Run folder in a path, named by the run alone or as a partition (``run=...``), or null."""
    return F.nullif(F.regexp_extract(path, rf"/(?:\w+=)?{RUN_ID}/", 1), F.lit(""))


def _with_run(df: DataFrame) -> DataFrame:
    return df.withColumn("run_id", run_of_path(F.col("_metadata.file_path")))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    return _with_run(reader.json(path))


# -- transcripts ----------------------------------------------------------------


def explode_segments(payload: DataFrame) -> DataFrame:
    """One row per segment; the id defaults to the position, the end to the start."""
    s = payload.select("run_id", F.posexplode("segments").alias("p", "s"))
    start = F.coalesce("s.start_sec", F.lit(0.0))
    end = to_ms(F.coalesce("s.end_sec", start))
    return s.where(F.col("s").isNotNull()).select(
        "run_id", F.coalesce("s.segment_id", (F.col("p") + 1).cast("bigint")).alias("segment_id"),
        to_ms(start).alias("start_ms"), F.greatest(to_ms(start), end).alias("end_ms"),
        collapse(F.coalesce("s.text", F.lit(""))).alias("text"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return explode_segments(_json(spark, path, schemas.SEGMENTS_JSON))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    payload = _json(spark, path, schemas.SEGMENTS_JSON)
    s = payload.select("run_id", "target_language", F.posexplode("segments").alias("pos", "s"))
    return s.select(
        "run_id", "pos", F.col("s.segment_id").alias("segment_id"), "s.translated_text",
        F.coalesce(F.nullif("s.target_language", F.lit("")), "target_language").alias("target_language"))


def read_slide_changes(spark: SparkSession, path: str) -> DataFrame:
    df = _with_run(spark.read.schema(schemas.SLIDE_CHANGES_CSV).option("recursiveFileLookup", True).csv(path, header=True))
    return df.select("run_id", "event_id", "transition_no", "frame_id_0", "frame_id_1", "event_frame",
                     to_ms(F.col("time_sec")).alias("time_ms"), "timecode")


def _frames(spark: SparkSession, path: str, schema: str, place: str) -> DataFrame:
    rows = (
        spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("enforceSchema", True).option("recursiveFileLookup", True).csv(path, header=True))
    numbered_rows = number_lines(rows, place).withColumn("run_id", run_of_path(F.col("file"))).drop("file")
    return numbered_rows.withColumn(place, F.col(place) - 1)


def read_frame_runs(spark: SparkSession, path: str) -> DataFrame:
    """Frame runs with ``seg_idx``, their place in the file from 0."""
    return _frames(spark, path, schemas.FRAME_RUNS_CSV, "seg_idx")


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """Transitions with ``row_idx``, their place in the file from 0."""
    return _frames(spark, path, schemas.TRANSITIONS_CSV, "row_idx")


def parse_slide_map(payload: DataFrame) -> DataFrame:
    """Lenient event rows of slide maps."""
    e = payload.select("run_id", F.posexplode("events").alias("pos", "e"))
    event = int_or(F.col("e.event_id"), 0)
    target = F.col("e.merge_target_event_id").try_cast("bigint")
    blank = F.lit("")
    return e.select(
        "run_id", "pos", event.alias("event_id"), F.coalesce("e.bucket_id", numbered("event_", event)).alias("bucket_id"),
        to_ms(F.col("e.slide_start")).alias("slide_start_ms"), to_ms(F.col("e.slide_end")).alias("slide_end_ms"),
        bool_strict(F.col("e.is_no_slide")).alias("is_no_slide"), target.alias("merge_target_event_id"),
        *[F.trim(F.coalesce(f"e.{c}", blank)).alias(c) for c in ("text", "translated_text", "target_language")],
        F.coalesce("e.segments_count", F.lit(0).cast("bigint")).alias("segments_count"),
        parse_ids(F.regexp_replace(F.coalesce("e.source_segment_ids", blank), r"[\[\]\s]", "")).alias("source_segment_ids"))


def number_slides(rows: DataFrame, split: bool | None = None) -> DataFrame:
    """Second reading of a slide map: real events only, numbered in file order."""
    from lectern.operators.scan import OrderedScan

    return OrderedScan(rows.where("event_id > 0"), ["run_id"], ["pos"]).row_number("slide_index").apply(split)


def read_slide_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_slide_map(_json(spark, path, schemas.SLIDE_MAP_JSON))


def read_termbase(spark: SparkSession, path: str) -> DataFrame:
    """Rows of termbase files; ``pos`` is their place, by file name and then line, whatever the partitions."""
    rows = spark.read.schema(schemas.TERMBASE_CSV).csv(path, header=True, multiLine=True)
    return number_lines(rows, "pos", whole=True).drop("file")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.GLOSSARY_JSON).select("run_id", F.posexplode("entries").alias("entry_order", "e")).select(
        "run_id", "entry_order", "e.*")


def explode_alignment(payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (last entry per id) and words of alignment files."""
    s = payload.select("run_id", F.posexplode("segments").alias("p", "s")).where(F.col("s.segment_id") > 0)
    times = [to_ms(F.col(f"s.{n}_sec")).alias(f"{n}_ms") for n in ("source_start", "source_end", "tts_start", "tts_end")]
    segments = s.groupBy("run_id", F.col("s.segment_id").alias("segment_id")).agg(
        F.max_by(F.struct(*times), F.col("p")).alias("v")).select("run_id", "segment_id", "v.*")
    w = payload.select("run_id", F.posexplode("words").alias("p", "w")).where(F.col("w").isNotNull())
    start = to_ms(F.col("w.start_sec"))
    end = F.coalesce(to_ms(F.col("w.end_sec")), start)
    text = F.coalesce("w.text", F.lit(""))
    words = w.select(
        "run_id", F.col("p").cast("bigint").alias("word_idx"), text.alias("text"),
        F.coalesce(F.nullif(F.trim("w.normalized"), F.lit("")), norm_token(text)).alias("normalized"),
        start.alias("start_ms"), F.greatest(start, end).alias("end_ms"))
    return segments, words


def read_alignment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return explode_alignment(_json(spark, path, schemas.ALIGNMENT_JSON))


def clean_languages(rows: DataFrame) -> DataFrame:
    """Languages with label and code; the translation code is derived when it is not given."""
    blank = F.lit("")
    label, code = F.trim(F.coalesce("label", blank)), F.trim(F.coalesce("tts_language_code", blank))
    given = F.nullif(F.trim(F.coalesce("translate_language_code", blank)), blank)
    return rows.where((label != "") & (code != "")).select(
        label.alias("label"), code.alias("tts_language_code"), F.coalesce(given, translate_code(code)).alias("translate_language_code"),
        F.trim(F.coalesce("launch_readiness", blank)).alias("launch_readiness"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return clean_languages(spark.read.schema(schemas.LANGUAGES_JSON).option("multiLine", True).json(path))


# -- plain text -------------------------------------------------------------------


def parse_config(lines: DataFrame) -> DataFrame:
    """``KEY=value`` lines; comments and blank lines skipped, quotes stripped."""
    text = F.trim("line")
    value = F.trim(F.regexp_replace(text, r"^[^=]*=", ""))
    bare = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    return lines.where((text != "") & ~text.startswith("#") & F.contains(text, F.lit("="))).withColumns(
        {"key": F.trim(F.regexp_extract(text, r"^([^=]*)=", 1)), "value": bare}).drop("line")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Settings with ``line_no``, their line in the file; of equal keys the last line counts."""
    lines = number_lines(spark.read.option("recursiveFileLookup", True).text(path).withColumnRenamed("value", "line"))
    return parse_config(lines.withColumn("run_id", run_of_path(F.col("file"))).drop("file"))


def read_step_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Log lines of runs with ``line_no`` from 1; a run has one log file.

    A stream takes each file as one row, since its splits come without an order
    among them; in a batch a file may have any number of splits.
    """
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", True)
    run = run_of_path(F.col("file")).alias("run_id")
    if not stream:
        return number_lines(reader.text(path)).select(run, "line_no", F.col("value").alias("line"))
    whole = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    ended = F.regexp_replace("value", r"\r?\n$", "")
    lines = whole.select("file", F.posexplode(F.split(ended, r"\r?\n")).alias("at", "line"))
    return lines.select(run, (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


# -- file listings ------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times below a folder; the content column is pruned and never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"),
                F.element_at(F.split("path", "/"), -1).alias("name"))
    )


def discover_runs(files: DataFrame) -> DataFrame:
    """Run folders that hold at least one file, with their newest time."""
    return files.withColumn("run_id", run_of_path(F.col("path"))).where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("files"))


def media_catalog(files: DataFrame, root: str, max_depth: int = 8) -> DataFrame:
    """Video files with their depth below ``root``."""
    rest = F.regexp_replace("path", "^(file:)?/*" + root.strip("/") + "/", "")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    return files.withColumns({"relative": rest, "depth": F.size(F.split(rest, "/")) - 1, "suffix": suffix}).where(
        suffix.isin(*VIDEO_SUFFIXES) & (F.col("depth") <= max_depth))


def parse_png(files: DataFrame) -> DataFrame:
    """Width and height from the fixed header bytes; null for other content."""
    head = F.hex(F.substring("content", 1, 24))
    is_png = head.startswith("89504E470D0A1A0A") & (F.length(head) == 48)

    def number(at: int) -> Column:
        return F.when(is_png, F.conv(F.substring(head, at, 8), 16, 10).cast("bigint"))

    return files.withColumns({"width": number(33), "height": number(41)}).drop("content")


def scan_png(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_png(files.select("path", F.col("length").alias("bytes"), "content"))


_WAV = StructType([
    StructField("channels", LongType()), StructField("width", LongType()), StructField("rate", LongType()),
    StructField("frames", LongType()), StructField("duration_sec", DoubleType()),
])


@pandas_udf(_WAV)
def _wav(content: pd.Series) -> pd.DataFrame:
    out = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                rate = w.getframerate() or 24000
                out.append((w.getnchannels(), w.getsampwidth(), rate, w.getnframes(), round(w.getnframes() / rate, 3)))
        except (wave.Error, EOFError):
            # raw samples: one channel, two bytes, 24 kHz
            frames = len(data) // 2
            out.append((1, 2, 24000, frames, round(len(data) / 2 / 24000, 3)))
    return pd.DataFrame(out, columns=[f.name for f in _WAV.fields])


def parse_wav(files: DataFrame) -> DataFrame:
    return files.withColumn("w", _wav("content")).drop("content").select("*", "w.*").drop("w")


def scan_wav(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_wav(files.select("path", F.col("length").alias("bytes"), "content"))


def joined_duration(wavs: DataFrame, keys: list[str]) -> DataFrame:
    """Length of a set of recordings put together; ``compatible`` is false when their formats differ."""
    kinds = F.count_distinct(F.struct("channels", "width", "rate"))
    return wavs.groupBy(*keys).agg(
        F.round(F.sum("frames") / F.max("rate"), 3).alias("duration_sec"), (kinds == 1).alias("compatible"))


# -- model output --------------------------------------------------------------------


def parse_llm_json(responses: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Translations by index from model answers, one row per expected index.

    ``responses``: keys, raw; ``expected``: keys, index.  A code fence around the
    answer is removed; the list may be bare or wrapped in ``translations``,
    ``text_elements`` or ``translated``.  Status per row: ok, missing, empty or unreadable.
    """
    fenced = r"(?s)^\s*```[^\n]*\n(.*)\n```\s*$"
    raw = F.trim("raw")
    body = F.when(raw.rlike(fenced), F.regexp_extract(raw, fenced, 1)).otherwise(raw)
    bare = F.from_json(body, schemas.LLM_ITEMS)
    wrapped = F.from_json(body, ", ".join(f"{n} {schemas.LLM_ITEMS}" for n in ("translations", "text_elements", "translated")))
    items = F.when(F.ltrim(body).startswith("["), bare).otherwise(
        F.coalesce(wrapped["translations"], wrapped["text_elements"], wrapped["translated"]))
    parsed = responses.select(*keys, items.alias("items"))
    rows = parsed.select(*keys, F.posexplode("items").alias("p", "i")).where(F.col("i.index") >= 0)
    by_index = rows.groupBy(*keys, F.col("i.index").alias("index")).agg(
        F.trim(F.coalesce(F.max_by("i.translated_text", F.col("p")), F.lit(""))).alias("translated_text"),
        F.bool_or(F.trim(F.coalesce("i.translated_text", F.lit(""))) == "").alias("__empty"))
    readable = parsed.select(*keys, F.col("items").isNotNull().alias("__readable"))
    status = (
        F.when(~F.coalesce("__readable", F.lit(False)), "unreadable").when(F.col("__empty"), "empty")
        .when(F.col("translated_text").isNull(), "missing").otherwise("ok")
    )
    return expected.join(by_index, [*keys, "index"], "left").join(readable, keys, "left").select(
        *keys, "index", "translated_text", status.alias("status"))
