"""Queries over files of many runs: tables written as the files they come in, and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.times import timecode
from lectern.operators import timeline
from lectern.settings import ensure_checkpoint_dir
from lectern.sources import readers, sinks
from lectern.sources.lines import number_lines
from lectern.suite import playback
from lectern.suite.fixtures import with_fixtures
from lectern.suite.registry import query


def _folder(t) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/files-{uuid4().hex}"


def _run(key: str) -> Column:
    """Sixty runs, named by their minute."""
    return F.format_string("20240301_12%02d00", (F.col(key) % 60).cast("int"))


RUN_SQL = "printf('20240301_12%02d00', {0} % 60)"


def _laid_out(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows of each run in their order, ready to be written into a folder a run."""
    sorted_rows = rows.withColumn("run", _run(key)).repartition("run").sortWithinPartitions("run", *order)
    return sorted_rows.select("run", *columns)


def _csv(t, rows: DataFrame, key: str, order: list[str], columns: list[str]) -> str:
    path = _folder(t)
    _laid_out(rows, key, order, columns).write.partitionBy("run").option("header", True).csv(path)
    return path


@query("read_frame_runs", with_fixtures(f"""
SELECT {RUN_SQL.format('video_id')} AS run_id, ROW_NUMBER() OVER (PARTITION BY video_id % 60 ORDER BY video_id, seg_idx) - 1 AS seg_idx, slide_id, f0, f1 FROM frame_runs_fx""", "frame_runs_fx"))
def q_frame_runs(t):
    path = _csv(t, t.frame_runs(), "video_id", ["video_id", "seg_idx"], ["slide_id", "f0", "f1"])
    return readers.read_frame_runs(t.spark, path).select("run_id", "seg_idx", "slide_id", "f0", "f1")


@query("read_transitions", with_fixtures(f"""
SELECT {RUN_SQL.format('video_id')} AS run_id, ROW_NUMBER() OVER (PARTITION BY video_id % 60 ORDER BY video_id, transition_no) - 1 AS row_idx, transition_no, frame_id_0, frame_id_1
FROM transitions_fx""", "transitions_fx"))
def q_transitions(t):
    path = _csv(t, t.transitions(), "video_id", ["video_id", "transition_no"], ["transition_no", "frame_id_0", "frame_id_1"])
    return readers.read_transitions(t.spark, path).select("run_id", "row_idx", "transition_no", "frame_id_0", "frame_id_1")


@query("read_slide_changes", with_fixtures(f"""
SELECT {RUN_SQL.format('video_id')} AS run_id, event_id, video_id AS transition_no, event_id * 2 AS frame_id_0, event_id * 2 + 1 AS frame_id_1, event_id * 2 + 1 AS event_frame, time_ms,
       printf('%02d:%02d:%02d.%03d', time_ms // 3600000, time_ms % 3600000 // 60000, time_ms % 60000 // 1000, time_ms % 1000) AS timecode FROM slide_changes_fx""", "slide_changes_fx"))
def q_slide_changes(t):
    e = F.col("event_id")
    rows = t.slide_changes().withColumns({
        "transition_no": F.col("video_id"), "frame_id_0": e * 2, "frame_id_1": e * 2 + 1, "event_frame": e * 2 + 1,
        "time_sec": F.col("time_ms") / 1000.0, "timecode": timecode(F.col("time_ms"))})
    path = _csv(t, rows, "video_id", ["video_id", "event_id"], ["event_id", "transition_no", "frame_id_0", "frame_id_1", "event_frame", "time_sec", "timecode"])
    return readers.read_slide_changes(t.spark, path)


@query("discover_runs", with_fixtures(f"""
SELECT DISTINCT {RUN_SQL.format('video_id')} AS run_id, 1 AS files FROM slide_changes_fx""", "slide_changes_fx"))
def q_runs(t):
    path = _csv(t, t.slide_changes(), "video_id", ["video_id", "event_id"], ["event_id", "time_ms"])
    return readers.discover_runs(readers.list_files(t.spark, path, "*.csv")).select("run_id", "files")


@query("step_log_files", with_fixtures(f"""
SELECT {RUN_SQL.format('run_id')} AS run_id, ROW_NUMBER() OVER (PARTITION BY run_id % 60 ORDER BY run_id, line_no) AS line_no, line FROM step_log_fx""", "step_log_fx"))
def q_step_files(t):
    path = _folder(t)
    _laid_out(t.step_log(), "run_id", ["run_id", "line_no"], ["line"]).write.partitionBy("run").text(path)
    return readers.read_step_log(t.spark, path)


@query("subtitle_files", with_fixtures(playback.FLAGSHIP + "," + playback.SLIDES + "," + playback.WINDOWS + "," + playback.SEGMENTED + f""",
cu AS (SELECT video_id, cue_no, cue_no || chr(10) || {playback.CLOCK.format('a')} || ' --> ' || {playback.CLOCK.format('b')} || chr(10) || text || chr(10) AS cue
  FROM (SELECT video_id, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY slide_index) AS cue_no, trim(subtitle_text) AS text,
               CASE WHEN c1 > c0 THEN c0 ELSE video_end_ms - duration_ms END AS a, CASE WHEN c1 > c0 THEN c1 ELSE video_end_ms END AS b FROM tl WHERE trim(subtitle_text) <> '') q),
ls AS (SELECT video_id, string_split(string_agg(cue, chr(10) ORDER BY cue_no), chr(10)) AS parts FROM cu GROUP BY 1)
SELECT video_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM ls""", *playback.SLIDE_FX))
def q_subtitle_files(t):
    path = _folder(t)
    sinks.write_srt(timeline.subtitle_cues(playback._segmented(t), t.by_video), path)
    lines = number_lines(t.spark.read.option("recursiveFileLookup", True).text(path))
    return lines.select(F.regexp_extract("file", r"video_id=(\d+)", 1).cast("bigint").alias("video_id"), F.col("value").alias("line"), "line_no")
