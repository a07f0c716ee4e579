"""Playback timeline and subtitles of a deck with synthesized speech."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import speech_text, tokens
from lectern.functions.times import srt_time
from lectern.operators.folding import fold_columns
from lectern.operators.intervals import TIME_BIN_MS, overlap_join
from lectern.operators.scan import OrderedScan

SLIDE = ["video_id", "slide_index"]


def segments_of_slide(slides: DataFrame, alignment: DataFrame) -> DataFrame:
    """Aligned segments of each slide, by its list of segment ids."""
    ids = slides.select(*SLIDE, "slide_start_ms", "slide_end_ms", F.explode("source_segment_ids").alias("segment_id"))
    return ids.join(alignment, ["video_id", "segment_id"])


def slide_audio_window(slides: DataFrame, alignment: DataFrame) -> DataFrame:
    """Earliest and latest speech time of a slide, mapped linearly inside its segments."""
    c = F.col
    start, end = F.greatest("slide_start_ms", "source_start_ms"), F.least("slide_end_ms", "source_end_ms")
    usable = (c("source_end_ms") > c("source_start_ms")) & (c("tts_end_ms") > c("tts_start_ms")) & (end > start)

    def mapped(t: Column) -> Column:
        share = (t - c("source_start_ms")) * (c("tts_end_ms") - c("tts_start_ms")) / (
            c("source_end_ms") - c("source_start_ms"))
        return c("tts_start_ms") + F.bround(share).cast("bigint")

    return segments_of_slide(slides, alignment).where(usable).groupBy(*SLIDE).agg(
        F.min(mapped(start)).alias("window_start_ms"), F.max(mapped(end)).alias("window_end_ms"))


def word_boundaries(words: DataFrame) -> DataFrame:
    """Sorted distinct starts and ends of the words of a video."""
    return words.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("boundary_ms")).distinct()


def snap_nearest(
    times: DataFrame, boundaries: DataFrame, total: str, max_delta_ms: int = 350, split: bool | None = None
) -> DataFrame:
    """Nearest word boundary of each time if it is close, the later one on ties; inside the recording.

    ``times``: video_id, time_id, time_ms and the column ``total``.  Both sides
    are merged in time order, so each time sees its neighbours in one scan.
    """
    c = F.col
    rows = times.withColumn("__kind", F.lit(0)).unionByName(
        boundaries.select("video_id", c("boundary_ms").alias("time_ms"), F.lit(1).alias("__kind")), allowMissingColumns=True)
    edge = F.when(c("__kind") == 1, c("time_ms"))
    near = (
        OrderedScan(rows, ["video_id"], ["time_ms", "__kind", "time_id"])
        .last_before("__left", edge).next_value("__right", edge).apply(split).where(c("__kind") == 0)
    )
    dl, dr = c("time_ms") - c("__left"), c("__right") - c("time_ms")
    best = F.when(c("__left").isNull() | (dr <= dl), c("__right")).otherwise(c("__left"))
    best = F.when(c("__right").isNull(), c("__left")).otherwise(best)
    chosen = F.when(F.abs(best - c("time_ms")) <= max_delta_ms, best).otherwise(c("time_ms"))
    zero = F.lit(0).cast("bigint")
    return near.withColumn("snapped_ms", F.greatest(zero, F.least(c(total), chosen))).drop("__kind", "__left", "__right")


def project_time(
    times: DataFrame, alignment: DataFrame, boundaries: DataFrame | None = None, bin_ms: int = TIME_BIN_MS,
    split: bool | None = None,
) -> DataFrame:
    """Source times on the speech time line.

    Inside a segment linear; on its edge between the speech on both sides; in a
    gap linear between the neighbours; before all segments 0, after them the
    whole length.  Null for a video without alignment.  ``times``: video_id,
    time_id, source_ms, total_ms.
    """
    c = F.col
    zero = F.lit(0).cast("bigint")
    rows = alignment.where((c("source_end_ms") > c("source_start_ms")) & (c("tts_end_ms") >= c("tts_start_ms")))
    seg = ["source_start_ms", "source_end_ms", "tts_start_ms", "tts_end_ms"]
    order = F.struct(*seg)

    # inside: a point against open intervals
    points = times.select("video_id", "time_id", "source_ms", (c("source_ms") + 1).alias("__p1"))
    inner = rows.select("video_id", *seg, (c("source_start_ms") + 1).alias("__open"))
    inside = (
        overlap_join(points, inner, "video_id", ("source_ms", "__p1"), ("__open", "source_end_ms"), bin_ms)
        .groupBy("video_id", "time_id").agg(F.min(order).alias("__in"))
    )
    # edges: equality with an end or a start
    ends = rows.groupBy("video_id", c("source_end_ms").alias("source_ms")).agg(F.max("tts_end_ms").alias("__le"))
    starts = rows.groupBy("video_id", c("source_start_ms").alias("source_ms")).agg(F.min("tts_start_ms").alias("__rs"))
    # neighbours: one scan over times, starts (before equal times) and ends (after them)
    marks = (
        times.select("video_id", "time_id", "source_ms", "total_ms", c("source_ms").alias("__t"), F.lit(0).alias("__kind"))
        .unionByName(rows.select("video_id", c("source_start_ms").alias("__t"), F.lit(-1).alias("__kind"), order.alias("__row")),
                     allowMissingColumns=True)
        .unionByName(rows.select("video_id", c("source_end_ms").alias("__t"), F.lit(1).alias("__kind"), order.alias("__row")),
                     allowMissingColumns=True)
    )
    near = (
        OrderedScan(marks, ["video_id"], ["__t", "__kind", "__row", "time_id"])
        .last_before("__l", F.when(c("__kind") == 1, c("__row")))
        .next_value("__r", F.when(c("__kind") == -1, c("__row")))
        .apply(split).where(c("__kind") == 0)
        .select("video_id", "time_id", "source_ms", "total_ms", "__l", "__r")
    )
    known = rows.select("video_id").distinct().withColumn("__known", F.lit(True))
    joined = (
        near.join(inside, ["video_id", "time_id"], "left").join(ends, ["video_id", "source_ms"], "left")
        .join(starts, ["video_id", "source_ms"], "left").join(known, "video_id", "left")
    )

    def line(t, s0, s1, t0, t1) -> Column:
        return t0 + F.bround((t - s0) * (t1 - t0) / (s1 - s0)).cast("bigint")

    i = [c(f"__in.{n}") for n in seg]
    ls, rs = c("__l.source_end_ms"), c("__r.source_start_ms")
    lt, rt = c("__l.tts_end_ms"), c("__r.tts_start_ms")
    value = (
        F.when(c("__known").isNull(), F.lit(None))
        .when(c("__in").isNotNull(), line(c("source_ms"), i[0], i[1], i[2], i[3]))
        .when(c("__le").isNotNull() & c("__rs").isNotNull(), F.bround((c("__le") + c("__rs")) / 2.0).cast("bigint"))
        .when(c("__le").isNotNull(), c("__le")).when(c("__rs").isNotNull(), c("__rs"))
        .when(c("__l").isNull(), zero).when(c("__r").isNull(), c("total_ms"))
        .otherwise(line(c("source_ms"), ls, rs, lt, rt))
    )
    exact = c("__in").isNotNull() | c("__le").isNotNull() | c("__rs").isNotNull() | (c("__l").isNotNull() & c("__r").isNotNull())
    out = joined.select("video_id", "time_id", "source_ms", "total_ms",
                        F.greatest(zero, F.least(c("total_ms"), value)).alias("time_ms"),
                        F.coalesce(exact, F.lit(False)).alias("__snap"))
    out = out.withColumn("time_ms", F.when(c("time_ms").isNotNull(), c("time_ms")))
    if boundaries is None:
        return out.withColumnRenamed("time_ms", "projected_ms").drop("__snap")
    snapped = snap_nearest(out, boundaries, "total_ms", split=split)
    return snapped.select("video_id", "time_id", "source_ms", "total_ms",
                          F.when(c("__snap"), c("snapped_ms")).otherwise(c("time_ms")).alias("projected_ms"))


def candidate_words(slides: DataFrame, alignment: DataFrame, words: DataFrame, pad_ms: int = 250, bin_ms: int = TIME_BIN_MS) -> DataFrame:
    """Words spoken around the segments of each slide."""
    c = F.col
    span = segments_of_slide(slides, alignment).groupBy(*SLIDE).agg(
        (F.min("tts_start_ms") - pad_ms).alias("__a"), (F.max("tts_end_ms") + pad_ms).alias("__b"))
    # closed ranges; shifted so that no bin starts below zero
    s = span.select(*SLIDE, (c("__a") + pad_ms).alias("__s"), (c("__b") + pad_ms + 1).alias("__e"))
    w = words.select("video_id", "word_idx", "normalized", "start_ms", "end_ms",
                     (c("start_ms") + pad_ms).alias("__ws"), (c("end_ms") + pad_ms + 1).alias("__we"))
    return overlap_join(s, w, "video_id", ("__s", "__e"), ("__ws", "__we"), bin_ms).drop("__s", "__e", "__ws", "__we")


def exact_phrases(phrases: DataFrame, candidates: DataFrame, keys: list[str] = SLIDE) -> DataFrame:
    """First place where all tokens of a phrase follow each other.

    Tokens meet equal words only; a start is a match when it collects as many
    tokens as the phrase has.  ``phrases``: keys, tokens.
    """
    c = F.col
    exploded = phrases.where(F.size("tokens") > 0).select(*keys, F.size("tokens").alias("__n"), "tokens").select(
        *keys, "__n", F.posexplode("tokens").alias("__k", "normalized"))
    return (
        exploded.join(candidates.select(*keys, "word_idx", "normalized"), [*keys, "normalized"])
        .groupBy(*keys, "__n", (c("word_idx") - c("__k")).alias("start_word_index"))
        .agg(F.count(F.lit(1)).alias("__hits"))
        .where(c("__hits") == c("__n"))
        .groupBy(*keys).agg(F.min("start_word_index").alias("start_word_index"), F.first("__n").alias("__n"))
        .withColumn("end_word_index", c("start_word_index") + c("__n") - 1).drop("__n")
    )


def _masks(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    masks: dict[str, int] = {}
    for at, char in enumerate(text):
        masks[char] = masks.get(char, 0) | (1 << at)
    return masks


def _common(text: str, masks: dict[str, int], low: int, high: int) -> int:
    """Length of the longest common subsequence of a text and the characters low to high of ``masks``."""
    full = (1 << (high - low)) - 1
    own = {char: (masks.get(char, 0) >> low) & full for char in set(text)}
    state = full
    for char in text:
        both = state & own[char]
        state = ((state + both) | (state - both)) & full
    return high - low - state.bit_count()


def _coverable(matcher: SequenceMatcher, words: list[str], target: str) -> int:
    """Most characters of the target that the matcher can find in any window of the words.

    In targets of 200 characters and more a frequent character starts no
    matching block: a block holds a rare one, or it begins both texts.
    """
    text, covered = " ".join(words), bytearray(len(target))

    def cover(i: int, j: int) -> None:
        low, high = 0, 0
        while i > low and j > low and text[i - low - 1] == target[j - low - 1]:
            low += 1
        while i + high < len(text) and j + high < len(target) and text[i + high] == target[j + high]:
            high += 1
        covered[j - low : j + high] = b"\1" * (low + high)

    for char, places in matcher.b2j.items():
        i = text.find(char)
        while i >= 0:
            for j in places:
                cover(i, j)
            i = text.find(char, i + 1)
    begin = 0
    for word in words:
        cover(begin, 0)
        begin += len(word) + 1
    return sum(covered)


def _ratio(matcher: SequenceMatcher, text: str, target: str, masks: dict[str, int], least: float) -> float | None:
    """``matcher.ratio()`` of a text and its target, or None as soon as it cannot reach ``least``."""
    matcher.set_seq1(text)
    total = len(text) + len(target)
    possible = len(target)
    parts = [(0, len(text), 0, len(target), possible)]
    while parts:
        a0, a1, b0, b1, most = parts.pop()
        i, j, n = matcher.find_longest_match(a0, a1, b0, b1)
        possible += n - most
        for c0, c1, d0, d1 in ((a0, i, b0, j), (i + n, a1, j + n, b1)) if n else ():
            if c0 < c1 and d0 < d1:
                parts.append((c0, c1, d0, d1, _common(text[c0:c1], masks, d0, d1)))
                possible += parts[-1][-1]
        if 2.0 * possible / total < least - 1e-9:
            return None
    return 2.0 * possible / total


class _Phrases:
    """Exact, then fuzzy match of each slide's words, searching on after the last match."""

    def __init__(self, min_ratio: float):
        self.min_ratio, self.start = min_ratio, 0

    def exact(self, words, ids, wanted):
        n = len(wanted)
        for at in range(len(words) - n + 1):
            if ids[at] >= self.start and words[at] == wanted[0] and words[at : at + n] == wanted:
                return at, at + n - 1
        return None

    def fuzzy(self, words, ids, wanted):
        """Best window of words by similarity ratio, the first one on ties.

        No ratio exceeds what the longest common subsequence allows.  Windows
        are compared in full from the highest such bound down, until none of
        the others can win.
        """
        target = " ".join(wanted)
        matcher = SequenceMatcher(None, "", target)
        masks, most = _masks(target), len(target)
        if matcher.bpopular:
            most = _coverable(matcher, words, target)
            if 2.0 * most / (most + len(target)) < self.min_ratio - 1e-9:
                return None
        best, found = self.min_ratio, None
        windows = self._windows(words, ids, masks, most, len(target), len(wanted))
        for bound, at, end in sorted(windows, key=lambda w: (-w[0], w[1:])):
            if bound < best - 1e-9:
                break
            score = _ratio(matcher, " ".join(words[at : end + 1]), target, masks, best)
            if score and (score > best or score == best and (found is None or (at, end) < found)):
                best, found = score, (at, end)
        return found

    def _windows(self, words, ids, masks, most, size, n_wanted):
        """(bound, first word, last word) of the windows whose bound reaches the least ratio.

        Without its first words a window has no longer subsequence in common
        with the target, only fewer characters.  So one pass from a word also
        bounds the windows that start later, and most of them need no pass.
        """
        full, least, width = (1 << size) - 1, self.min_ratio - 1e-9, max(2, n_wanted + 4)
        begins, at_char = [], 0
        for word in words:
            begins.append(at_char)
            at_char += len(word) + 1
        origin = None
        for at in range(len(words)):
            if ids[at] < self.start:
                continue
            last = min(len(words), at + width)
            for own in (False, True):
                if own or origin is None:
                    # commons: of the words from origin up to each word; needs: from which first character on a window up to it passes
                    origin, state, commons, needs = at, full, [], []
                for end in range(origin + len(commons), last):
                    for char in words[end] if end == origin else " " + words[end]:
                        both = state & masks.get(char, 0)
                        state = ((state + both) | (state - both)) & full
                    commons.append(min(most, size - state.bit_count()))
                    needs.append(begins[end] + len(words[end]) + size - 2.0 * commons[-1] / least - 1e-6 if least > 0 else 0)
                if origin == at or begins[at] < min(needs[at - origin : last - origin]):
                    break
            if origin == at:
                for end in range(at, last):
                    bound = 2.0 * commons[end - at] / (begins[end] + len(words[end]) - begins[at] + size)
                    if bound >= least:
                        yield bound, at, end

    def __call__(self, wanted, ids, words):
        if not wanted or not words:
            return None, None, None
        found, exact = self.exact(words, ids, wanted), True
        if found is None:
            found, exact = self.fuzzy(words, ids, wanted), False
        if found is None:
            return None, None, None
        self.start = ids[found[1]] + 1
        return ids[found[0]], ids[found[1]], exact


def match_phrases(slides: DataFrame, candidates: DataFrame, min_ratio: float = 0.78) -> DataFrame:
    """Word range of each slide's text, in slide order."""
    text = F.coalesce(speech_text(F.col("translated_text"), F.col("text")), F.lit(""))
    per_slide = candidates.groupBy(*SLIDE).agg(
        F.array_sort(F.collect_list(F.struct("word_idx", "normalized", "start_ms", "end_ms"))).alias("__ws"))
    rows = slides.select(*SLIDE, tokens(text).alias("__tokens")).join(per_slide, SLIDE, "left").withColumns(
        {"__ids": F.transform("__ws", lambda w: w["word_idx"]), "__words": F.transform("__ws", lambda w: w["normalized"])})
    # the search is costly per byte, so small inputs must not be merged into few tasks
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id")
    found = fold_columns(
        rows, ["video_id"], ["slide_index"], lambda: _Phrases(min_ratio), ["__tokens", "__ids", "__words"],
        {"start_word_index": "bigint", "end_word_index": "bigint", "exact": "boolean"})

    def time_of(index: str, field: str) -> Column:
        hit = F.filter("__ws", lambda w: w["word_idx"] == F.col(index))
        return F.try_element_at(hit, F.lit(1))[field]

    return found.select(
        *SLIDE, F.col("start_word_index").isNotNull().alias("matched"), "exact", "start_word_index", "end_word_index",
        time_of("start_word_index", "start_ms").alias("match_start_ms"), time_of("end_word_index", "end_ms").alias("match_end_ms"))


def timeline_segmented(
    slides: DataFrame, windows: DataFrame, *, min_slide_ms: int = 1200, tail_ms: int = 300, thumbnail_ms: int = 2000,
    lead_in_ms: int = 500, split: bool | None = None,
) -> DataFrame:
    """Each slide lasts as long as its speech with padding; slides follow each other."""
    c = F.col
    zero = F.lit(0).cast("bigint")
    text = speech_text(c("translated_text"), c("text"))
    rows = slides.join(windows, SLIDE, "left").withColumn("subtitle_text", F.coalesce(text, F.lit("")))
    silent = (c("slide_index") == 1) & (c("subtitle_text") == "")
    start = F.when(silent | c("window_start_ms").isNull(), zero).otherwise(F.greatest(zero, c("window_start_ms")))
    end = F.when(silent | c("window_end_ms").isNull(), zero).otherwise(F.greatest(start, c("window_end_ms")))
    clip = end - start
    lead = F.when((c("slide_index") == 1) & (clip > 0), F.lit(lead_in_ms)).otherwise(F.lit(0))
    spoken = F.when(clip > 0, F.greatest(F.lit(min_slide_ms), lead + clip + tail_ms)).otherwise(F.lit(min_slide_ms))
    duration = F.when(silent, F.lit(max(40, thumbnail_ms))).otherwise(spoken).cast("bigint")
    timed = rows.select(
        *SLIDE, "event_id", "bucket_id", "subtitle_text", duration.alias("duration_ms"),
        start.alias("audio_clip_start_ms"), end.alias("audio_clip_end_ms"), clip.alias("audio_clip_duration_ms"))
    return (
        OrderedScan(timed, ["video_id"], ["slide_index"]).running_sum("video_end_ms", "duration_ms").apply(split)
        .withColumn("video_start_ms", c("video_end_ms") - c("duration_ms"))
    )


def timeline_master(
    slides: DataFrame, matches: DataFrame, projected: DataFrame, windows: DataFrame, *, min_slide_ms: int = 1200,
    tail_ms: int = 300, thumbnail_ms: int = 2000, lead_in_ms: int = 500, split: bool | None = None,
) -> DataFrame:
    """Slides over one continuous speech track: end = max(previous end + a, b).

    ``b`` is the next slide's match, else the own match, the projected slide end
    or the audio window.  The recurrence is one max-plus scan.  ``slides``
    carries ``total_ms``; ``projected``: keys, projected_ms.
    """
    c = F.col
    zero = F.lit(0).cast("bigint")
    text = F.coalesce(speech_text(c("translated_text"), c("text")), F.lit(""))
    rows = (
        slides.withColumn("subtitle_text", text).join(matches, SLIDE, "left").join(projected.select(*SLIDE, "projected_ms"), SLIDE, "left")
        .join(windows, SLIDE, "left")
    )
    scanned = (
        OrderedScan(rows, ["video_id"], ["slide_index"]).lead("__next", "match_start_ms").lead("__more", F.lit(1))
        .whole_max("__spoken_first", F.when(c("slide_index") == 1, (c("subtitle_text") != "").cast("int"))).apply(split)
    )
    has_text = c("__spoken_first") == 1
    offset = F.when(has_text, F.lit(lead_in_ms)).otherwise(F.lit(thumbnail_ms)).cast("bigint")
    silent = (c("slide_index") == 1) & ~has_text

    def video(t: Column) -> Column:
        return offset + F.greatest(zero, F.least(c("total_ms"), t))

    own_end = F.when(c("match_end_ms").isNotNull(), video(c("match_end_ms")) + tail_ms)
    last = c("__more").isNull()
    a = (
        F.when(silent, F.lit(max(40, thumbnail_ms)))
        .when(~last & c("__next").isNotNull(), F.lit(40)).otherwise(F.lit(min_slide_ms)).cast("bigint")
    )
    projected_end = F.coalesce("projected_ms", F.when(~last, c("window_end_ms")))
    b = (
        F.when(silent, F.lit(None)).when(last, F.greatest(video(c("total_ms")) + tail_ms, own_end, video(c("projected_ms"))))
        .when(c("__next").isNotNull(), video(c("__next"))).when(own_end.isNotNull(), own_end)
        .when(projected_end.isNotNull(), video(projected_end)).cast("bigint")
    )
    timed = (
        OrderedScan(scanned, ["video_id"], ["slide_index"]).max_plus("video_end_ms", a, b).max_plus_before("video_start_ms", a, b).apply(split)
    )
    whole = c("match_start_ms").isNotNull()
    clip0 = F.when(silent, zero).when(whole, video(c("match_start_ms"))).when(
        c("window_start_ms").isNotNull(), video(c("window_start_ms"))).otherwise(c("video_start_ms"))
    clip1 = F.when(silent, zero).when(whole, video(c("match_end_ms"))).when(
        c("window_end_ms").isNotNull(), video(c("window_end_ms"))).otherwise(c("video_end_ms"))
    return timed.select(
        *SLIDE, "event_id", "bucket_id", "video_start_ms", "video_end_ms",
        F.greatest(F.lit(40).cast("bigint"), c("video_end_ms") - c("video_start_ms")).alias("duration_ms"),
        clip0.alias("audio_clip_start_ms"), F.greatest(clip0, clip1).alias("audio_clip_end_ms"),
        (F.greatest(clip0, clip1) - clip0).alias("audio_clip_duration_ms"), "subtitle_text")


def shift_timeline(timeline: DataFrame, intro_ms: int, outro_ms: int, split: bool | None = None) -> DataFrame:
    """Room for an intro before and an outro after; the last slide is held through the outro."""
    c = F.col
    spoken = c("audio_clip_duration_ms") > 0
    rows = OrderedScan(timeline, ["video_id"], ["slide_index"]).lead("__more", F.lit(1)).apply(split)
    end = c("video_end_ms") + intro_ms + F.when(c("__more").isNull(), outro_ms).otherwise(0)
    start = c("video_start_ms") + intro_ms
    return rows.withColumns({
        "video_start_ms": start, "video_end_ms": end, "duration_ms": F.greatest(F.lit(0).cast("bigint"), end - start),
        "audio_clip_start_ms": c("audio_clip_start_ms") + F.when(spoken, intro_ms).otherwise(0),
        "audio_clip_end_ms": c("audio_clip_end_ms") + F.when(spoken, intro_ms).otherwise(0),
    }).drop("__more")


def subtitle_cues(timeline: DataFrame, split: bool | None = None) -> DataFrame:
    """Numbered subtitle cues of the slides with text."""
    c = F.col
    spoken = c("audio_clip_duration_ms") > 0
    start = F.when(spoken, c("audio_clip_start_ms")).otherwise(c("video_start_ms"))
    end = F.when(spoken, c("audio_clip_end_ms")).otherwise(c("video_end_ms"))
    text = F.trim("subtitle_text")
    rows = timeline.where(text != "")
    cue = F.concat(c("cue_no").cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n"))
    return (
        OrderedScan(rows, ["video_id"], ["slide_index"]).row_number("cue_no").apply(split)
        .select("video_id", "cue_no", start.alias("start_ms"), end.alias("end_ms"), text.alias("text"), cue.alias("cue"))
    )
