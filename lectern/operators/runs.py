"""Catalogues over runs: counters, costs, artifacts, assets, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Artifact levels of a run from lowest to highest, with labels.
ARTIFACT_LEVELS = [
    ("base_events", "base events"), ("final_slides", "final slides"), ("translated_slides", "translated slides"),
    ("upscaled_slides", "upscaled slides"), ("translated_upscaled_slides", "translated upscaled slides"),
    ("tts", "tts audio"), ("video_export", "video export"),
]


def stage_counters(rows: DataFrame, keys: list[str], counters: dict[str, Column], total: str = "total") -> DataFrame:
    """How many rows of each key meet each condition."""
    aggs = [F.count(F.lit(1)).alias(total)]
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counters.items()]
    return rows.groupBy(*keys).agg(*aggs)


def predict_cost_e7(predict_ms: Column, price_e6_per_s: int = 225) -> Column:
    """Estimated cost in 1e-7 dollars, rounded to six decimals of a dollar."""
    zero = F.lit(0).cast("bigint")
    micro = F.bround(F.greatest(zero, predict_ms) * price_e6_per_s / 1000.0).cast("bigint")
    return micro * 10


def manifest_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, times and cost of one manifest, derived from its items."""
    done = F.col("status").isin("upscaled", "succeeded")
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items_processed"), F.count_if(done).alias("upscaled"),
        F.count_if(~done).alias("fallback"), F.sum("predict_ms").alias("predict_ms"),
        F.sum("cost_e7_usd").alias("cost_e7_usd"),
    )


def merge_summaries(stored: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the items beat the stored ones; manifests without items keep what is stored."""
    names = ["items_processed", "upscaled", "fallback", "cost_e7_usd"]
    s = stored.select(*keys, *[F.col(n).alias(f"__s_{n}") for n in names])
    zero = F.lit(0).cast("bigint")
    return s.join(derived, keys, "full").select(*keys, *[F.coalesce(n, f"__s_{n}", zero).alias(n) for n in names])


def run_cost(items: DataFrame) -> DataFrame:
    """Cost of a run over its manifests; the provider is that of the first manifest.

    ``items`` adds manifest_no to the key of ``manifest_summary``.
    """
    per = items.groupBy("run_id", "manifest_no").agg(
        F.min("provider").alias("provider"), F.sum("cost_e7_usd").alias("cost_e7_usd"))
    return per.groupBy("run_id").agg(
        F.min_by("provider", F.when(F.col("provider") != "", F.col("manifest_no"))).alias("provider"),
        F.count(F.lit(1)).alias("manifest_count"), F.sum("cost_e7_usd").alias("cost_e7_usd"))


def artifact_counts(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Number of files of each kind per run; the kinds are given, so one aggregation is enough."""
    return files.groupBy("run_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.max("mtime").alias("mtime"))


def highest_artifact(counts: DataFrame) -> DataFrame:
    """Readiness flags and the highest artifact level a run has reached."""
    name, label = F.lit("none"), F.lit("no output yet")
    for level, text in ARTIFACT_LEVELS:
        ready = F.col(level) > 0
        name, label = F.when(ready, F.lit(level)).otherwise(name), F.when(ready, F.lit(text)).otherwise(label)
    flags = {f"{level}_ready": F.col(level) > 0 for level, _t in ARTIFACT_LEVELS}
    return counts.withColumns({**flags, "highest_available": name, "highest_available_label": label})


#: what a level is made of: all of the first group, or, where a second is given, any of that
LEVEL_PARTS = {
    "base_events": ["base_table"], "final_slides": ["final_table", "final_images"], "translated_slides": ["translated_images"],
    "upscaled_slides": ["upscaled_images"], "translated_upscaled_slides": ["translated_upscaled_images"], "video_export": ["video_files"],
}
ANY_PARTS = {"tts": ["alignment_table", "audio_files"]}
#: levels with a flag of their own that are no step of the ladder
SIDE_PARTS = {"translated_text": ["translated_table"]}


def level_counts(parts: DataFrame) -> DataFrame:
    """Counts of the artifact levels from those of their parts: tables count by their rows, folders by their files.

    ``parts(run_id, part, n)``. A level needs a row or file of each of its
    parts, speech of any. Parts that do not occur count as none; an unknown part
    is ignored.
    """
    names = sorted({p for group in (LEVEL_PARTS, ANY_PARTS, SIDE_PARTS) for ps in group.values() for p in ps})
    counted = parts.groupBy("run_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).cast("bigint").alias(p) for p in names])
    fewest = lambda ps: F.least(*ps) if len(ps) > 1 else F.col(ps[0])
    every = {level: fewest(ps) for level, ps in {**LEVEL_PARTS, **SIDE_PARTS}.items()}
    some = {level: F.greatest(*ps) for level, ps in ANY_PARTS.items()}
    return counted.select("run_id", *[c.alias(level) for level, c in {**every, **some}.items()])


def run_readiness(parts: DataFrame) -> DataFrame:
    """Readiness flags of each run and the highest artifact level it has reached."""
    levels = highest_artifact(level_counts(parts))
    sides = {f"{level}_ready": F.col(level) > 0 for level in SIDE_PARTS}
    return levels.withColumns(sides).drop(*LEVEL_PARTS, *ANY_PARTS, *SIDE_PARTS)


def base_events_view(changes: DataFrame, assets: DataFrame) -> DataFrame:
    """The slide changes of runs with their picture, in file order.

    ``changes``: run_id, row_no and the columns of a slide change; ``assets``:
    run_id, event_id, directory, name. Rows without a positive event id are left
    out but counted by ``index``. The first event shows the full frame where
    there is one, the others the slide.
    """
    key = ["run_id", "event_id"]
    index = F.row_number().over(Window.partitionBy("run_id").orderBy("row_no")).cast("bigint")
    first = F.col("event_id") == 1
    pictures = pick_asset(assets.where(first), key, ["full", "slide"]).unionByName(pick_asset(assets.where(~first), key, ["slide", "full"]))
    found = changes.withColumn("index", index).where(F.col("event_id") > 0).join(pictures, key, "left")
    path = F.when(F.col("name").isNotNull(), F.concat_ws("/", "directory", "name")).otherwise("")
    return found.withColumns({"image_path": path, "image_name": F.coalesce("name", F.lit(""))}).drop("row_no", "directory", "name")


def missing_requirements(runs: DataFrame, needs: dict[str, Column]) -> DataFrame:
    """What a run still lacks for a job; ``needs`` maps a name to the condition that it is there."""
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in needs.items()]))
    return runs.withColumn("missing_requirements", lacking).withColumn("ready", F.size("missing_requirements") == 0)


def run_catalog(counts: DataFrame, costs: DataFrame, config: DataFrame, status: DataFrame) -> DataFrame:
    """One row per run: artifacts, cost, configured mode and status.

    ``config(run_id, key, value)``; the caller orders by mtime where it shows the list.
    """
    mode = config.where(F.col("key") == "FINAL_SLIDE_UPSCALE_MODE").groupBy("run_id").agg(
        F.max_by("value", F.col("line_no")).alias("upscale_mode_used"))
    blank = F.lit("")
    return (
        highest_artifact(counts).join(costs, "run_id", "left").join(mode, "run_id", "left").join(status, "run_id", "left")
        .withColumns({"upscale_mode_used": F.coalesce("upscale_mode_used", blank), "status": F.coalesce("status", blank),
                      "cost_e7_usd": F.coalesce("cost_e7_usd", F.lit(0).cast("bigint"))})
    )


def latest_run(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest run, the later id on ties."""
    newest = F.max_by(F.struct("run_id", "mtime"), F.struct("mtime", "run_id")).alias("r")
    grouped = runs.groupBy(*keys).agg(newest) if keys else runs.agg(newest)
    return grouped.select(*(keys or []), "r.*")


def newest_file(files: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Newest file with a suffix per key."""
    hit = F.lower("name").endswith(suffix.lower())
    return files.where(hit).groupBy(*keys).agg(F.max_by("name", F.struct("mtime", "name")).alias("name"))


def preview(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def pick_asset(assets: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """First directory by priority that has a file, then its first name."""
    rank = F.lit(None).cast("int")
    for n, directory in reversed(list(enumerate(priority))):
        rank = F.when(F.col("directory") == directory, F.lit(n)).otherwise(rank)
    return assets.withColumn("__rank", rank).where(F.col("__rank").isNotNull()).groupBy(*keys).agg(
        F.min(F.struct("__rank", "directory", "name")).alias("a")).select(*keys, "a.directory", "a.name")


def usable_overrides(overrides: DataFrame) -> DataFrame:
    """Only numbered events and the two modes count."""
    return overrides.withColumn("event_id", F.col("event_id").try_cast("bigint")).where(
        F.col("event_id").isNotNull() & F.col("mode").isin("slide", "full"))


def resolve_image_mode(event_id: Column, has_slide: Column, has_full: Column, override: Column) -> tuple[Column, Column]:
    """Default and chosen image mode of an event; empty when it has no image."""
    default = F.when(event_id == 1, F.lit("full")).otherwise(F.lit("slide"))

    def available(mode: Column) -> Column:
        return ((mode == "slide") & has_slide) | ((mode == "full") & has_full)

    first = F.when(has_slide, "slide").when(has_full, "full").otherwise("")
    default = F.when(available(default), default).otherwise(first)
    wanted = F.when(override.isin("slide", "full"), override).otherwise(default)
    return default, F.when(available(wanted), wanted).otherwise(default)


def final_slide_view(slides: DataFrame, assets: DataFrame, overrides: DataFrame, translated: DataFrame, notes: DataFrame) -> DataFrame:
    """Final slides with image mode, translation and note; joined on (run_id, event_id)."""
    key = ["run_id", "event_id"]
    has = assets.groupBy(*key).agg(
        F.bool_or(F.col("directory") == "slide").alias("has_slide"), F.bool_or(F.col("directory") == "full").alias("has_full"))
    o = usable_overrides(overrides).select(*key, "mode")
    no = F.lit(False)
    rows = (
        slides.where(F.col("event_id") > 0).join(has, key, "left").join(o, key, "left")
        .join(translated.select(*key, "translated_text"), key, "left").join(notes.select(*key, "note"), key, "left")
        .withColumns({"has_slide": F.coalesce("has_slide", no), "has_full": F.coalesce("has_full", no)})
    )
    default, mode = resolve_image_mode(F.col("event_id"), F.col("has_slide"), F.col("has_full"), F.col("mode"))
    blank = F.lit("")
    return rows.withColumns({
        "default_image_mode": default, "image_mode": mode,
        "translated_text": F.trim(F.coalesce("translated_text", blank)), "translation_note": F.coalesce("note", blank),
    }).drop("mode", "note")


def slide_metadata(images: DataFrame, events: DataFrame) -> DataFrame:
    """Slide index of an image by its event, else its own position."""
    e = events.select("run_id", "event_id", F.col("slide_index").alias("__i"))
    return images.join(e, ["run_id", "event_id"], "left").withColumn(
        "slide_index", F.coalesce("__i", "position")).drop("__i")


def resume_pending(items: DataFrame, manifest: DataFrame, files: DataFrame, keys: list[str], final: list[str]) -> DataFrame:
    """Items still to do: those whose status is final and whose output exists are left out."""
    done = manifest.where(F.col("status").isin(*final)).join(files.select(*keys), keys, "left_semi")
    return items.join(done.select(*keys), keys, "left_anti")


def edit_eligibility(slides: DataFrame, skip_first: int = 1) -> DataFrame:
    """Status and reason of slides that need no edit; null status = to be edited.

    ``slides``: slide_index, source_mode, readable, has_mask.
    """
    index = F.col("slide_index")
    ladder = [
        (index.isNotNull() & (index <= max(0, skip_first)), "skipped", "skip_window"),
        (index.isNotNull() & (F.col("source_mode") == "full"), "skipped", "full_source"),
        (~F.coalesce("readable", F.lit(False)), "fallback", "read_failed"),
        (~F.coalesce("has_mask", F.lit(False)), "skipped", "no_mask"),
    ]
    status, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, s, r in reversed(ladder):
        cond = F.coalesce(cond, F.lit(False))
        status, reason = F.when(cond, F.lit(s)).otherwise(status), F.when(cond, F.lit(r)).otherwise(reason)
    return slides.withColumns({"status": status, "reason": reason})


def pick_attempt(attempts: DataFrame, keys: list[str], max_attempts: int) -> DataFrame:
    """First attempt that passed; otherwise a fallback with the reason of the last one."""
    tried = attempts.where(F.col("attempt") <= max_attempts)
    ok = F.min(F.when(F.col("passed"), F.col("attempt")))
    return tried.groupBy(*keys).agg(ok.alias("accepted_attempt"), F.max_by("reason", F.col("attempt")).alias("__last")).select(
        *keys, "accepted_attempt", F.when(F.col("accepted_attempt").isNull(), "fallback").otherwise("edited").alias("status"),
        F.when(F.col("accepted_attempt").isNull(), F.coalesce("__last", F.lit("all_attempts_failed"))).alias("reason"))


def error_code(message: Column) -> Column:
    """Code of a recognition error from its text."""
    text = F.upper(F.coalesce(message, F.lit("")))
    disabled = F.contains(text, F.lit("SERVICE_DISABLED")) | (
        F.contains(text, F.lit("API HAS NOT BEEN USED")) & F.contains(text, F.lit("DISABLED")))
    return F.when(disabled, "SERVICE_DISABLED").when(
        F.contains(text, F.lit("PERMISSION_DENIED")), "PERMISSION_DENIED").otherwise("UNKNOWN")


def provider_gate(runs: DataFrame, segments: DataFrame, fallback_allowed: bool = True) -> DataFrame:
    """Whether the transcription of a run is kept, repeated with another provider, or failed.

    ``runs``: run_id, exit_code, message; ``segments``: run_id, text, translated_text.
    """
    spoken = (F.trim(F.coalesce("text", F.lit(""))) != "") | (F.trim(F.coalesce("translated_text", F.lit(""))) != "")
    counts = segments.groupBy("run_id").agg(F.count_if(spoken).alias("segment_count"))
    known = error_code(F.col("message")).isin("SERVICE_DISABLED", "PERMISSION_DENIED")
    failed, allowed = F.col("exit_code") != 0, F.lit(fallback_allowed)
    empty = F.col("segment_count") <= 0
    decision = (
        F.when(failed & known & allowed, "fallback_unavailable").when(failed, "failed")
        .when(empty & allowed, "fallback_empty").when(empty, "failed").otherwise("kept")
    )
    return runs.join(counts, "run_id", "left").withColumn(
        "segment_count", F.coalesce("segment_count", F.lit(0).cast("bigint"))).withColumn("decision", decision)


def resolve_language(rows: DataFrame, languages: DataFrame, label: str) -> DataFrame:
    """Language codes by label; an unknown label stays as an error row."""
    lang = languages.select(F.col("label").alias("__l"), "tts_language_code", "translate_language_code")
    return rows.join(lang, F.trim(label) == F.col("__l"), "left").withColumn(
        "unknown_language", F.col("__l").isNull()).drop("__l")


def image_ratio(pairs: DataFrame) -> DataFrame:
    """Size of a candidate image against its original, from scanned headers."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(a) > 0, F.round(F.col(b) / F.col(a), 4)).otherwise(F.lit(0.0))

    def kib(n: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(F.col(n) / 1024.0, 1)), F.lit(" KiB"))

    return pairs.withColumns({
        "width_ratio": share("width", "candidate_width"), "height_ratio": share("height", "candidate_height"),
        "size_ratio": share("bytes", "candidate_bytes"), "size_text": kib("bytes"), "candidate_size_text": kib("candidate_bytes"),
    })


def roi_of(videos: DataFrame, regions: DataFrame) -> DataFrame:
    """Slide region of each video by its trimmed name."""
    r = regions.select(F.trim("video").alias("__v"), "x0", "y0", "x1", "y1")
    return videos.join(r, F.col("video") == F.col("__v"), "left").drop("__v")
