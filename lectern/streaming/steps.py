"""Step status of runs from their log lines, as a batch and as a stream.

The lines have no time of their own; their order is (run_id, line_no).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The steps of a run, in their order.
STEPS = [
    "slide-detection", "transcription", "text-translate", "transcript-mapping", "finalize-slides", "edit",
    "translate", "upscale", "tts", "tts-alignment", "video-export", "backup",
]
MARKER = r"^@@STEP\s+(START|DONE|SKIP|DETAIL)\s+([a-z0-9-]+)(?:\s+(.*))?$"
_STATUS = {"START": "running", "DONE": "done", "SKIP": "skipped"}


def parse_markers(lines: DataFrame) -> DataFrame:
    """Marker lines with a known action; ``step_known`` tells the steps apart."""
    text = F.trim("line")
    action, step = F.regexp_extract(text, MARKER, 1), F.regexp_extract(text, MARKER, 2)
    return lines.select(
        "run_id", "line_no", action.alias("action"), step.alias("step_id"),
        F.trim(F.regexp_extract(text, MARKER, 3)).alias("detail"), step.isin(*STEPS).alias("step_known"),
    ).where(F.col("action") != "")


def step_position(step: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STEPS]), step)


def step_state(lines: DataFrame) -> DataFrame:
    """Last status and detail of each step of each run.

    START, DONE and SKIP set the status.  A DETAIL turns a step that has no
    other status yet into a running one; later ones leave the status alone.
    """
    m = parse_markers(lines).where("step_known")
    sets = F.col("action") != "DETAIL"
    status = F.when(F.col("action") == "START", "running").when(F.col("action") == "DONE", "done").otherwise("skipped")
    # an empty detail of START keeps the one before
    tells = (F.col("action") != "START") | (F.col("detail") != "")
    return m.groupBy("run_id", "step_id").agg(
        F.coalesce(F.max_by(status, F.when(sets, F.col("line_no"))), F.lit("running")).alias("status"),
        F.coalesce(F.max_by("detail", F.when(tells, F.col("line_no"))), F.lit("")).alias("detail"),
        F.coalesce(F.max(F.when(F.col("action").isin("START", "DETAIL"), F.col("line_no"))), F.lit(0)).cast("bigint").alias("touch_line"),
    )


def current_step(state: DataFrame) -> DataFrame:
    """The step a run is in: the last one started or detailed if it still runs, else the first running one.

    After the last START or DETAIL steps can only finish, so the outcome does
    not depend on the order in which they did.
    """
    is_running = F.col("status") == "running"
    running = F.when(is_running, step_position(F.col("step_id")))
    last = F.max_by(F.when(is_running, F.struct("step_id", "detail")), F.when(F.col("touch_line") > 0, F.col("touch_line")))
    now = F.coalesce(last, F.min_by(F.struct("step_id", "detail"), running))
    return state.groupBy("run_id").agg(now.alias("__now")).select(
        "run_id", F.col("__now.step_id").alias("current_step"), F.col("__now.detail").alias("current_detail"))


def finalize_runs(state: DataFrame, ends: DataFrame) -> DataFrame:
    """Status of finished runs and of the step they were in.

    ``ends``: run_id, exit_code, stop_requested.
    """
    code, stop = F.col("exit_code"), F.col("stop_requested")
    final = F.when(stop, "stopped").when(code == 0, "done").otherwise("error")
    return ends.join(current_step(state), "run_id", "left").select(
        "run_id", final.alias("status"), "current_step",
        F.when(F.col("current_step").isNotNull(), final).alias("step_status"),
        F.when((code != 0) & ~stop, F.col("current_step")).alias("error_step"),
    )


def effective_status(runs: DataFrame, live: DataFrame, recorded: DataFrame) -> DataFrame:
    """Live status over recorded status over blank."""
    fields = ["status", "current_step"]
    a = live.where((F.col("status") != "") & (F.col("status") != "idle")).select("run_id", F.struct(*fields).alias("__live"))
    b = recorded.select("run_id", F.struct(*fields).alias("__rec"))
    blank = F.lit("")
    chosen = F.coalesce("__live", "__rec")
    return runs.join(a, "run_id", "left").join(b, "run_id", "left").select(
        "run_id", *[F.coalesce(chosen[f], blank).alias(f) for f in fields])


OUTPUT = ["run_id", "step_id", "status", "detail", "touch_line"]
_STEP_KEY = StructType([StructField("step_id", StringType())])
_STEP_VALUE = StructType([
    StructField("status", StringType()), StructField("status_line", LongType()), StructField("detail", StringType()),
    StructField("detail_line", LongType()), StructField("touch_line", LongType()),
])


class StepProcessor(StatefulProcessor):
    """Keeps one entry per step of a run; lines may arrive out of order."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", _STEP_KEY, _STEP_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[str, tuple] = {}
        for pdf in rows:
            for line_no, action, step, detail in zip(pdf["line_no"], pdf["action"], pdf["step_id"], pdf["detail"]):
                entry = touched.get(step)
                if entry is None:
                    entry = tuple(self.steps.getValue((step,))) if self.steps.containsKey((step,)) else ("running", 0, "", 0, 0)
                status, at, text, text_at, touch = entry
                line_no = int(line_no)
                if action != "DETAIL" and line_no > at:
                    status, at = _STATUS[action], line_no
                if (action != "START" or detail) and line_no > text_at:
                    text, text_at = detail, line_no
                if action in ("START", "DETAIL"):
                    touch = max(touch, line_no)
                touched[step] = (status, at, text, text_at, touch)
        for step, entry in touched.items():
            self.steps.updateValue((step,), entry)
        if self.idle_ms > 0:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if touched:
            yield pd.DataFrame(
                [(key[0], s, e[0], e[2], e[4]) for s, e in touched.items()], columns=OUTPUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.steps.clear()
        return iter([])

    def close(self) -> None:
        pass


def step_state_stream(lines: DataFrame, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Streaming form of ``step_state``: an update per changed step.

    The state of a run is at most one entry per step; it is dropped after the
    run has been idle, which is the only rule the batch form does not have.
    """
    m = parse_markers(lines).where("step_known").drop("step_known")
    fields = [m.schema["run_id"], *[StructField(c, StringType()) for c in OUTPUT[1:4]], StructField(OUTPUT[4], LongType())]
    return m.groupBy("run_id").transformWithStateInPandas(
        StepProcessor(idle_ms), StructType(fields), "Update", "ProcessingTime" if idle_ms > 0 else "None")
