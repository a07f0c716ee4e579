"""Input tables of the operators, derived from the given parquet tables.

Each fixture exists twice: as a Spark plan, and as a SQL common table
expression for the oracle.  All rows and whole texts are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.times import idiv
from lectern.operators.scan import OrderedScan
from lectern.settings import has_hot_key, parts_of

_RUN_ORDER = ["l_linenumber", "tag", "l_suppkey", "l_extendedprice"]


class Tables:
    """Lazy access to one folder of tables, with each hot-key check made once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._hot: dict[tuple[str, str], bool] = {}
        self._parts: dict[str, int] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def split(self, table: str, key: str) -> bool:
        at = (table, key)
        if at not in self._hot:
            self._hot[at] = has_hot_key(self.base(table).select(key), [key])
        return self._hot[at]

    def parts(self, table: str) -> int:
        if table not in self._parts:
            self._parts[table] = parts_of(self.spark, self.base(table).count())
        return self._parts[table]

    @property
    def by_conversation(self) -> bool:
        return self.split("conversations", "conv_id")

    @property
    def by_user(self) -> bool:
        return self.split("events", "user_id")

    @property
    def by_order(self) -> bool:
        return self.split("lineitem", "l_orderkey")

    @property
    def by_video(self) -> bool:
        return self.by_conversation or self.by_user

    # -- timed text -------------------------------------------------------

    def segments(self) -> DataFrame:
        spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
        dur = F.greatest(F.lit(200), F.least(F.lit(12000), (spaces + 1) * 100)).cast("bigint")
        rows = self.base("conversations").select(
            F.col("conv_id").alias("video_id"), (F.col("turn") + 1).alias("segment_id"), "text",
            dur.alias("dur"),
        )
        return (
            OrderedScan(rows, ["video_id"], ["segment_id"])
            .running_sum("end_ms", "dur")
            .apply(self.by_conversation)
            .select("video_id", "segment_id", (F.col("end_ms") - F.col("dur")).alias("start_ms"),
                    "end_ms", "text")
        )

    def slide_changes(self) -> DataFrame:
        rows = self.base("events").where(F.col("event_type") == "view").select(
            F.col("user_id").alias("video_id"), F.col("event_id").alias("__e"),
            ((F.col("event_id") * 7919) % 40000).alias("time_ms"),
        )
        return (
            OrderedScan(rows, ["video_id"], ["time_ms", "__e"])
            .row_number("event_id")
            .apply(self.by_user)
            .select("video_id", "event_id", "time_ms")
        )

    def translations(self) -> DataFrame:
        """Every third turn has no translation; some turns have two."""
        c = self.base("conversations").where(F.col("turn") % 3 != 1)
        text = F.concat(F.lit("de "), F.replace("text", F.lit("e"), F.lit("o")))
        first = c.select(
            F.col("conv_id").alias("video_id"), (F.col("turn") * 2).alias("pos"),
            (F.col("turn") + 1).cast("string").alias("segment_id"),
            text.alias("translated_text"), F.lit("German").alias("target_language"),
        )
        again = c.where(F.col("turn") % 4 == 0).select(
            F.col("conv_id").alias("video_id"), (F.col("turn") * 2 + 1).alias("pos"),
            (F.col("turn") + 1).cast("string").alias("segment_id"),
            F.concat(F.lit("neu "), F.col("text")).alias("translated_text"),
            F.lit("German").alias("target_language"),
        )
        bad = c.where(F.col("turn") == 0).select(
            F.col("conv_id").alias("video_id"), F.lit(99).cast("bigint").alias("pos"),
            F.lit("x").alias("segment_id"), F.lit("bad").alias("translated_text"),
            F.lit("German").alias("target_language"),
        )
        return first.unionByName(again).unionByName(bad)

    # -- frames -----------------------------------------------------------

    def _runs(self) -> DataFrame:
        """The frame runs with the end of the run before and the columns that order them; whole videos are dealt out once."""
        rows = self.base("lineitem").select(
            F.col("l_orderkey").alias("video_id"), "l_returnflag", F.col("l_partkey").alias("tag"),
            (F.col("l_quantity").cast("bigint") * 4).alias("len"),
            "l_linenumber", "l_suppkey", "l_extendedprice",
        )
        if not self.by_order:
            rows = rows.repartition(self.parts("lineitem"), "video_id")
        return (
            OrderedScan(rows, ["video_id"], _RUN_ORDER)
            .row_number("rn")
            .running_sum("f1", "len")
            .sum_before("prev_f1", "len")
            .apply(self.by_order)
            .select(
                "video_id", (F.col("rn") - 1).alias("seg_idx"),
                F.when(F.col("l_returnflag") == "R", F.lit(-1).cast("bigint")).otherwise(F.col("rn")).alias("slide_id"),
                (F.col("f1") - F.col("len") + 1).alias("f0"), "f1", "prev_f1", *_RUN_ORDER,
            )
        )

    def frame_runs(self) -> DataFrame:
        return self._runs().select("video_id", "seg_idx", "slide_id", "f0", "f1", "tag")

    def transitions(self) -> DataFrame:
        # the runs lie in this order already
        order = ["seg_idx"] if self.by_order else _RUN_ORDER
        runs = self._runs().where(F.col("prev_f1").isNotNull() & (F.col("tag") % 4 != 0))
        return (
            OrderedScan(runs, ["video_id"], order)
            .row_number("transition_no")
            .apply(self.by_order)
            .select("video_id", "transition_no", (F.col("prev_f1") + 1).alias("frame_id_0"),
                    (F.col("f0") + 1).alias("frame_id_1"))
        )

    def frame_diffs(self) -> DataFrame:
        rows = self.base("events").select(
            F.col("user_id").alias("video_id"), F.col("event_id").alias("__e"),
            ((F.col("event_id") * 7919) % 200).alias("diff_milli"),
        )
        return (
            OrderedScan(rows, ["video_id"], ["__e"])
            .row_number("frame_id")
            .apply(self.by_user)
            .select("video_id", "frame_id", "diff_milli")
        )

    def short_runs(self) -> DataFrame:
        """Frame ranges of 24 frames cut from the frame differences of a video."""
        return (
            self.frame_diffs()
            .withColumn("run_no", idiv(F.col("frame_id") - 1, 24) + 1)
            .groupBy("video_id", "run_no")
            .agg(F.min("frame_id").alias("f0"), F.max("frame_id").alias("f1"))
        )

    def person_boxes(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        return self.base("lineitem").select(
            (F.col("l_orderkey") % 500).alias("video_id"), F.col("l_linenumber").alias("frame_no"),
            ((p * 13) % 1280).alias("x"), ((p * 7) % 720).alias("y"),
            (40 + (s * 11) % 300).alias("w"), (60 + (s * 17) % 400).alias("h"),
            F.round(F.col("l_discount") * 100).cast("int").alias("weight_pct"),
        )

    # -- decks ------------------------------------------------------------

    def text_lines(self, by_document: bool = False) -> DataFrame:
        """Every non-empty line of every document.

        ``by_document`` deals the whole documents out before they are cut, so
        that no later step that groups or joins by document shuffles its lines.
        """
        d = self.base("documents")
        if by_document and not self.split("documents", "doc_id"):
            # as many parts as set: the lines of a part are several times as large as the documents that are dealt out
            d = d.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        return (
            d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("p", "line"))
            .where(F.length(F.trim("line")) > 0)
            .select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "lang", "source", "line")
        )

    def ocr_units(self, by_document: bool = False) -> DataFrame:
        """A document is a deck; six of its lines make a slide."""
        n, d = F.col("line_no"), F.col("doc_id")
        unit = (n - 1) % 6 + 1
        return self.text_lines(by_document).select(
            d.alias("deck_id"), (idiv(n - 1, 6) + 1).alias("slide_index"),
            (d * 100000 + idiv(n - 1, 6) + 1).alias("slide_id"), unit.alias("unit_id"),
            F.col("line").alias("source_text"),
            (40 + (d * 37 + n * 13) % 300).alias("x"), (60 + unit * 90).alias("y"),
            F.least(F.lit(900), 12 * F.length("line")).cast("bigint").alias("w"),
            (24 + (d * 7 + n * 11) % 40).alias("h"),
            (1 + n % 3).alias("line_count"), ((d + n) % 5 == 0).alias("list_marker"),
            ((d * 31 + n * 17) % 45).alias("graphic_score_tenths"),
            F.lit(1280).cast("bigint").alias("image_w"), F.lit(720).cast("bigint").alias("image_h"),
            "lang", "source",
        )

    def slide_elements(self) -> DataFrame:
        """Each slide of six lines is built up in five steps; every third deck breaks its chain."""
        step = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(1, 6)])).alias("s")
        u = self.ocr_units(by_document=True).select("deck_id", "slide_index", "unit_id", "source_text", step)
        return u.where(
            (F.col("unit_id") <= F.col("s") + 1)
            & ~((F.col("deck_id") % 3 == 0) & (F.col("s") == 4) & (F.col("unit_id") == 1))
        ).select(
            "deck_id", ((F.col("slide_index") - 1) * 5 + F.col("s")).alias("slide_index"),
            F.col("unit_id").alias("element_id"), F.col("source_text").alias("text"),
        )

    def translated_elements(self) -> DataFrame:
        """Translations of the slide elements; some are missing and some left as they were."""
        e = self.slide_elements()
        k = (F.col("deck_id") + F.col("element_id") + F.col("slide_index")) % 7
        return e.where(k != 3).withColumn(
            "text", F.when(k == 5, F.col("text")).otherwise(F.concat(F.lit("T:"), F.col("text")))
        )

    # -- memory -----------------------------------------------------------

    def tm_new(self) -> DataFrame:
        return self.text_lines().select(
            F.col("source").alias("run_id"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("pos"),
            F.col("lang").alias("target_language"), F.col("line").alias("source_text"),
            F.concat(F.lit("T:"), F.col("line"), F.lit(" #"), F.col("doc_id").cast("string")).alias("target_text"),
        )

    def tm_entries(self) -> DataFrame:
        """A memory that already knows the lines of every other document."""
        lines = self.text_lines().where(F.col("doc_id") % 2 == 0)
        return lines.groupBy(
            F.trim(F.regexp_replace("line", r"\s+", " ")).alias("source_text_norm"),
            F.col("lang").alias("target_language"),
        ).agg(
            F.min("line").alias("source_text"), F.concat(F.lit("old "), F.min("line")).alias("target_text"),
            F.lit("machine_unreviewed").alias("status"), F.lit("run-0").alias("origin_run_id"),
            F.count(F.lit(1)).alias("hit_count"), F.min("doc_id").alias("created_at"),
            F.min("doc_id").alias("updated_at"),
        )

    # -- runs -------------------------------------------------------------

    def upscale_items(self) -> DataFrame:
        q = F.col("l_quantity").cast("bigint")
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("item_no"),
            F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("provider"),
            F.when(F.col("l_returnflag") == "R", "fallback").otherwise("upscaled").alias("status"),
            (q * 100).alias("predict_ms"), (q * 225).alias("cost_e7_usd"),
        )

    def step_log(self) -> DataFrame:
        action = (
            F.when(F.col("event_type") == "view", "START").when(F.col("event_type") == "click", "DETAIL")
            .when(F.col("event_type") == "signup", "DONE").when(F.col("event_type") == "purchase", "SKIP")
            .otherwise("NOISE")
        )
        m = F.col("event_id") % 5
        step = (
            F.when(m == 0, "transcription").when(m == 1, "translate").when(m == 2, "tts")
            .when(m == 3, "unknown-step").otherwise("video-export")
        )
        line = F.concat(F.lit("@@STEP "), action, F.lit(" "), step, F.lit(" item_"),
                        F.col("event_id").cast("string"))
        rows = self.base("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("__e"),
                                          line.alias("line"))
        return (
            OrderedScan(rows, ["run_id"], ["__e"]).row_number("line_no").apply(self.by_user)
            .select("run_id", "line_no", "line")
        )

    # -- speech -----------------------------------------------------------

    def alignment(self) -> DataFrame:
        s = self.segments().where(F.col("segment_id") % 5 != 0)
        d = F.col("end_ms") - F.col("start_ms") + (F.col("segment_id") * 37) % 400
        return (
            OrderedScan(s.withColumn("d", d), ["video_id"], ["segment_id"])
            .running_sum("tts_end_ms", "d").apply(self.by_conversation)
            .select("video_id", "segment_id", F.col("start_ms").alias("source_start_ms"),
                    F.col("end_ms").alias("source_end_ms"),
                    (F.col("tts_end_ms") - F.col("d")).alias("tts_start_ms"), "tts_end_ms")
        )

    def words(self) -> DataFrame:
        """Words of the aligned segments, evenly spread over their speech time."""
        s = self.segments().select("video_id", "segment_id", "text")
        a = self.alignment().select("video_id", "segment_id", "tts_start_ms", "tts_end_ms")
        parts = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
        rows = (
            s.join(a, ["video_id", "segment_id"])
            .select("video_id", "segment_id", "tts_start_ms", "tts_end_ms", F.size(parts).alias("n"), parts.alias("ws"))
            .select("video_id", "segment_id", "tts_start_ms", "tts_end_ms", "n", F.posexplode("ws").alias("k", "normalized"))
        )
        span = F.col("tts_end_ms") - F.col("tts_start_ms")
        return (
            OrderedScan(rows, ["video_id"], ["segment_id", "k"]).row_number("rn").apply(self.by_conversation)
            .select(
                "video_id", (F.col("rn") - 1).alias("word_idx"), "segment_id", "normalized",
                (F.col("tts_start_ms") + idiv(F.col("k") * span, F.col("n"))).alias("start_ms"),
                (F.col("tts_start_ms") + idiv((F.col("k") + 1) * span, F.col("n"))).alias("end_ms"),
            )
        )


# ---------------------------------------------------------------------------
# The same tables for the oracle.

_RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

FIXTURE_SQL: dict[str, tuple[list[str], str]] = {
    "segments_fx": ([], f"""
SELECT video_id, segment_id,
       CAST(SUM(dur) OVER (PARTITION BY video_id ORDER BY segment_id {_RUNNING}) - dur AS BIGINT) AS start_ms,
       CAST(SUM(dur) OVER (PARTITION BY video_id ORDER BY segment_id {_RUNNING}) AS BIGINT) AS end_ms, text
FROM (SELECT conv_id AS video_id, turn + 1 AS segment_id, text,
             GREATEST(200, LEAST(12000, (LENGTH(text) - LENGTH(REPLACE(text, ' ', '')) + 1) * 100)) AS dur
      FROM conversations) t"""),
    "slide_changes_fx": ([], """
SELECT user_id AS video_id,
       ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 40000, event_id) AS event_id,
       (event_id * 7919) % 40000 AS time_ms
FROM events WHERE event_type = 'view'"""),
    "translations_fx": ([], """
SELECT conv_id AS video_id, turn * 2 AS pos, CAST(turn + 1 AS VARCHAR) AS segment_id,
       'de ' || replace(text, 'e', 'o') AS translated_text, 'German' AS target_language
FROM conversations WHERE turn % 3 <> 1
UNION ALL
SELECT conv_id, turn * 2 + 1, CAST(turn + 1 AS VARCHAR), 'neu ' || text, 'German'
FROM conversations WHERE turn % 3 <> 1 AND turn % 4 = 0
UNION ALL
SELECT conv_id, 99, 'x', 'bad', 'German' FROM conversations WHERE turn = 0"""),
    "frame_runs_fx": ([], f"""
SELECT video_id, rn - 1 AS seg_idx, CASE WHEN flag = 'R' THEN -1 ELSE rn END AS slide_id,
       CAST(SUM(len) OVER (PARTITION BY video_id ORDER BY rn {_RUNNING}) - len + 1 AS BIGINT) AS f0,
       CAST(SUM(len) OVER (PARTITION BY video_id ORDER BY rn {_RUNNING}) AS BIGINT) AS f1, tag
FROM (SELECT l_orderkey AS video_id, l_returnflag AS flag, l_partkey AS tag, CAST(l_quantity AS BIGINT) * 4 AS len,
             ROW_NUMBER() OVER (PARTITION BY l_orderkey
                                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) t"""),
    "transitions_fx": (["frame_runs_fx"], """
SELECT video_id, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY seg_idx) AS transition_no,
       prev_f1 + 1 AS frame_id_0, f0 + 1 AS frame_id_1
FROM (SELECT video_id, seg_idx, f0, tag, LAG(f1) OVER (PARTITION BY video_id ORDER BY seg_idx) AS prev_f1
      FROM frame_runs_fx) t
WHERE prev_f1 IS NOT NULL AND tag % 4 <> 0"""),
    "frame_diffs_fx": ([], """
SELECT user_id AS video_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS frame_id,
       (event_id * 7919) % 200 AS diff_milli
FROM events"""),
    "short_runs_fx": (["frame_diffs_fx"], """
SELECT video_id, (frame_id - 1) // 24 + 1 AS run_no, MIN(frame_id) AS f0, MAX(frame_id) AS f1
FROM frame_diffs_fx GROUP BY ALL"""),
    "person_boxes_fx": ([], """
SELECT l_orderkey % 500 AS video_id, l_linenumber AS frame_no, (l_partkey * 13) % 1280 AS x,
       (l_partkey * 7) % 720 AS y, 40 + (l_suppkey * 11) % 300 AS w, 60 + (l_suppkey * 17) % 400 AS h,
       CAST(round(l_discount * 100) AS INT) AS weight_pct
FROM lineitem"""),
    "text_lines_fx": ([], """
SELECT doc_id, line_no, lang, source, line
FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS line_no
      FROM documents) t
WHERE length(trim(line)) > 0"""),
    "ocr_units_fx": (["text_lines_fx"], """
SELECT doc_id AS deck_id, (line_no - 1) // 6 + 1 AS slide_index,
       doc_id * 100000 + (line_no - 1) // 6 + 1 AS slide_id, (line_no - 1) % 6 + 1 AS unit_id,
       line AS source_text, 40 + (doc_id * 37 + line_no * 13) % 300 AS x,
       60 + ((line_no - 1) % 6 + 1) * 90 AS y, LEAST(900, 12 * length(line)) AS w,
       24 + (doc_id * 7 + line_no * 11) % 40 AS h, 1 + line_no % 3 AS line_count,
       (doc_id + line_no) % 5 = 0 AS list_marker, (doc_id * 31 + line_no * 17) % 45 AS graphic_score_tenths,
       1280 AS image_w, 720 AS image_h, lang, source
FROM text_lines_fx"""),
    "slide_elements_fx": (["ocr_units_fx"], """
SELECT deck_id, (slide_index - 1) * 5 + s AS slide_index, unit_id AS element_id, source_text AS text
FROM ocr_units_fx JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS s) steps ON unit_id <= s + 1
WHERE NOT (deck_id % 3 = 0 AND s = 4 AND unit_id = 1)"""),
    "translated_elements_fx": (["slide_elements_fx"], """
SELECT deck_id, slide_index, element_id,
       CASE WHEN (deck_id + element_id + slide_index) % 7 = 5 THEN text ELSE 'T:' || text END AS text
FROM slide_elements_fx WHERE (deck_id + element_id + slide_index) % 7 <> 3"""),
    "tm_new_fx": (["text_lines_fx"], """
SELECT source AS run_id, doc_id * 100000 + line_no AS pos, lang AS target_language, line AS source_text,
       'T:' || line || ' #' || CAST(doc_id AS VARCHAR) AS target_text
FROM text_lines_fx"""),
    "tm_entries_fx": (["text_lines_fx"], r"""
SELECT trim(regexp_replace(line, '\s+', ' ', 'g')) AS source_text_norm, lang AS target_language,
       MIN(line) AS source_text, 'old ' || MIN(line) AS target_text, 'machine_unreviewed' AS status,
       'run-0' AS origin_run_id, COUNT(*) AS hit_count, MIN(doc_id) AS created_at, MIN(doc_id) AS updated_at
FROM text_lines_fx WHERE doc_id % 2 = 0 GROUP BY 1, 2"""),
    "upscale_items_fx": ([], """
SELECT l_orderkey AS run_id, l_linenumber AS item_no, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS provider,
       CASE WHEN l_returnflag = 'R' THEN 'fallback' ELSE 'upscaled' END AS status,
       CAST(l_quantity AS BIGINT) * 100 AS predict_ms, CAST(l_quantity AS BIGINT) * 225 AS cost_e7_usd
FROM lineitem"""),
    "step_log_fx": ([], """
SELECT user_id AS run_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
       '@@STEP ' || CASE event_type WHEN 'view' THEN 'START' WHEN 'click' THEN 'DETAIL' WHEN 'signup' THEN 'DONE'
                         WHEN 'purchase' THEN 'SKIP' ELSE 'NOISE' END
       || ' ' || CASE event_id % 5 WHEN 0 THEN 'transcription' WHEN 1 THEN 'translate' WHEN 2 THEN 'tts'
                      WHEN 3 THEN 'unknown-step' ELSE 'video-export' END
       || ' item_' || CAST(event_id AS VARCHAR) AS line
FROM events"""),
    "alignment_fx": (["segments_fx"], f"""
SELECT video_id, segment_id, start_ms AS source_start_ms, end_ms AS source_end_ms,
       CAST(SUM(d) OVER (PARTITION BY video_id ORDER BY segment_id {_RUNNING}) - d AS BIGINT) AS tts_start_ms,
       CAST(SUM(d) OVER (PARTITION BY video_id ORDER BY segment_id {_RUNNING}) AS BIGINT) AS tts_end_ms
FROM (SELECT *, (end_ms - start_ms) + (segment_id * 37) % 400 AS d FROM segments_fx WHERE segment_id % 5 <> 0) t"""),
    "words_fx": (["segments_fx", "alignment_fx"], """
SELECT video_id, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY segment_id, k) - 1 AS word_idx, segment_id,
       normalized, tts_start_ms + ((k - 1) * (tts_end_ms - tts_start_ms)) // n AS start_ms,
       tts_start_ms + (k * (tts_end_ms - tts_start_ms)) // n AS end_ms
FROM (SELECT video_id, segment_id, tts_start_ms, tts_end_ms, len(ws) AS n, unnest(ws) AS normalized,
             generate_subscripts(ws, 1) AS k
      FROM (SELECT s.video_id, s.segment_id, tts_start_ms, tts_end_ms,
                   list_filter(regexp_split_to_array(lower(s.text), '[^a-z0-9]+'), lambda w: w <> '') AS ws
            FROM segments_fx s JOIN alignment_fx a ON s.video_id = a.video_id AND s.segment_id = a.segment_id) q) t"""),
}


def with_fixtures(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` preceded by the named fixtures and those they need.

    ``body`` may itself start with further ``name AS (...)`` expressions followed
    by ``SELECT``; it is joined with a comma then.
    """
    seen: list[str] = []

    def add(name: str) -> None:
        for need in FIXTURE_SQL[name][0]:
            add(need)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURE_SQL[n][1]})" for n in seen]
    text = body.strip()
    if not text.upper().startswith("SELECT"):
        head, tail = ", ".join(ctes + [text]), ""
    else:
        head, tail = ", ".join(ctes), "\n" + text
    if not ctes and tail:
        return text
    return ("WITH RECURSIVE " if recursive else "WITH ") + head + tail


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
