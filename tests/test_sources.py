"""Readers and writers over small files."""

from __future__ import annotations

import json
import struct
import wave

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.sources import readers, sinks
from lectern.streaming import steps

RUN = "2024-05-06_07-08-09"


def _put(root, name, content):
    path = root / RUN / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_transcripts_and_maps(spark, tmp_path):
    p = _put(tmp_path, "t/transcript.json", json.dumps({"segments": [
        {"start_sec": 0, "end_sec": 1.2345, "text": " a \n b "}, {"segment_id": 9, "start_sec": 2, "end_sec": 1, "text": "c"}]}, indent=1))
    got = [tuple(r) for r in readers.read_segments(spark, p).orderBy("start_ms").collect()]
    assert got == [(RUN, 1, 0, 1234, "a b"), (RUN, 9, 2000, 2000, "c")]
    p = _put(tmp_path, "m/map.json", json.dumps({"events": [
        {"event_id": "0", "bucket_id": "no_slide_001", "is_no_slide": "True", "source_segment_ids": "2;1"},
        {"event_id": "4", "slide_start": 1.5, "slide_end": 2, "merge_target_event_id": "None", "source_segment_ids": "[3, 3, 1]"}]}))
    rows = readers.read_slide_map(spark, p).orderBy("pos").collect()
    assert rows[0].is_no_slide and rows[0].source_segment_ids == [1, 2]
    assert rows[1].bucket_id == "event_004" and rows[1].source_segment_ids == [1, 3] and rows[1].merge_target_event_id is None
    assert readers.number_slides(readers.read_slide_map(spark, p)).select("slide_index", "event_id").first()[:] == (1, 4)


def test_tables(spark, tmp_path):
    p = _put(tmp_path, "runs.csv", "Slide No, FrameID0, FrameID1\n1, 1, 20\n-1, 21, 30\n")
    assert [(r.seg_idx, *tuple(r)[:3]) for r in readers.read_frame_runs(spark, p).orderBy("seg_idx").collect()] == [(0, 1, 1, 20), (1, -1, 21, 30)]
    p = _put(tmp_path, "tr.csv", "Transition No, FrameID0, FrameID1\n1, 21, 22\n")
    assert readers.read_transitions(spark, p).first()[:3] == (1, 21, 22)
    p = _put(tmp_path, "changes.csv", "event_id,transition_no,frame_id_0,frame_id_1,event_frame,time_sec,timecode\n1,0,1,20,4,0.12,00:00:00.120\n")
    assert readers.read_slide_changes(spark, p).first().time_ms == 120
    p = _put(tmp_path, "terms.csv", "source_text,target_language,target_text,case_sensitive\n\"a, b\",de,x,1\n")
    assert readers.read_termbase(spark, p).first().source_text == "a, b"
    p = _put(tmp_path, "config.env", "# c\nA = \"x=y\"\n\nB='z'\nnothing\n")
    assert sorted((r.key, r.value, r.run_id) for r in readers.read_config(spark, p).collect()) == [("A", "x=y", RUN), ("B", "z", RUN)]
    p = _put(tmp_path, "lang.json", json.dumps([{"label": "Deutsch", "tts_language_code": "de-DE"}, {"label": "", "tts_language_code": "x"}]))
    assert [r.translate_language_code for r in readers.read_languages(spark, p).collect()] == ["de"]
    p = _put(tmp_path, "al.json", json.dumps({"segments": [{"segment_id": 1, "tts_end_sec": 1.0}, {"segment_id": 0}],
                                              "words": [{"text": "Äh", "start_sec": 1, "end_sec": 0.5}]}))
    seg, words = readers.read_alignment(spark, p)
    assert seg.count() == 1 and words.first().normalized == "ah" and words.first().end_ms == 1000


def _splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size < 10_000 else "4194304")


def test_lines_keep_their_numbers_in_any_splits(spark, tmp_path):
    runs = {f"2024-05-0{n}_07-08-09": [f"line {i} of {n}" if i % 7 else "" for i in range(1, 400 + n)] for n in range(1, 4)}
    for run, lines in runs.items():
        (tmp_path / run / "log").mkdir(parents=True)
        (tmp_path / run / "log" / "steps.txt").write_text("\n".join(lines) + "\n")
    want = sorted((run, i, line) for run, lines in runs.items() for i, line in enumerate(lines, start=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (300, 10_000_000):
            _splits(spark, size)
            got = readers.read_step_log(spark, str(tmp_path))
            assert (got.rdd.getNumPartitions() > 10) == (size == 300)
            assert sorted(map(tuple, got.collect())) == want
    finally:
        _splits(spark, int(before.rstrip("b")))


def test_places_in_files_do_not_depend_on_splits(spark, tmp_path):
    rows = "".join(f"{i % 5 - 1}, {i * 10 + 1}, {i * 10 + 10}\n" for i in range(300))
    p = _put(tmp_path, "many.csv", "Slide No, FrameID0, FrameID1\n" + rows)
    for name in ("b", "a"):
        _put(tmp_path, f"tb/{name}.csv", "source_text,target_language,target_text,case_sensitive\n" + "".join(f"{name}{i},de,x,1\n" for i in range(50)))
    c = _put(tmp_path, "c.env", "\n".join(f"K{i % 3}={i}" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (250, 10_000_000):
            _splits(spark, size)
            runs = sorted((r.seg_idx, r.f0, r.run_id) for r in readers.read_frame_runs(spark, p).collect())
            assert runs == [(i, i * 10 + 1, RUN) for i in range(300)]
            terms = [r.source_text for r in readers.read_termbase(spark, str(tmp_path / RUN / "tb")).orderBy("pos").collect()]
            assert terms == [f"{n}{i}" for n in "ab" for i in range(50)]
            last = {r.key: r.value for r in readers.read_config(spark, c).orderBy("line_no").collect()}
            assert last == {"K0": "297", "K1": "298", "K2": "299"}
    finally:
        _splits(spark, int(before.rstrip("b")))


def test_log_files_to_step_state(spark, tmp_path):
    runs = ("20240309_140500", RUN)
    for n, run in enumerate(runs):
        (tmp_path / "in" / run).mkdir(parents=True)
        text = ["noise", "@@STEP START transcription", "", "@@STEP DETAIL transcription part 1"] * 20 + ["@@STEP DONE transcription ok", "@@STEP START translate"][: n + 1]
        (tmp_path / "in" / run / "steps.log").write_text("\n".join(text))
    batch = {(r.run_id, r.step_id): r for r in steps.step_state(readers.read_step_log(spark, str(tmp_path / "in"))).collect()}
    assert {k[0] for k in batch} == set(runs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        lines = readers.read_step_log(spark, str(tmp_path / "in"), stream=True)
        q = (
            steps.step_state_stream(lines, idle_ms=0).writeStream.outputMode("update").format("memory").queryName("file_updates")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    live = {(r.run_id, r.step_id): r for r in spark.table("file_updates").collect()}
    assert {k: tuple(r) for k, r in live.items()} == {k: (r.run_id, r.step_id, r.status, r.detail, r.touch_line) for k, r in batch.items()}


def test_binary_headers_and_listings(spark, tmp_path):
    _put(tmp_path, "img/a.png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.scan_png(spark, str(tmp_path / RUN / "img")).collect()}
    assert (got["a.png"].width, got["a.png"].height) == (640, 480)
    wav = tmp_path / RUN / "wav" / "x.wav"
    wav.parent.mkdir()
    with wave.open(str(wav), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(b"\0\0" * 1500)
    (wav.parent / "y.wav").write_bytes(b"\0" * 48000)
    rows = readers.scan_wav(spark, str(wav.parent)).withColumn("k", F.lit(1))
    assert sorted(r.duration_sec for r in rows.collect()) == [1.0, 1.5]
    assert readers.joined_duration(rows, ["k"]).first().compatible is False
    _put(tmp_path, "deep/er/v.MP4", b"x")
    files = readers.list_files(spark, str(tmp_path))
    assert readers.discover_runs(files).first().run_id == RUN
    media = readers.media_catalog(files, str(tmp_path)).collect()
    assert [(r.name, r.depth) for r in media] == [("v.MP4", 3)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 1], True, None), (2, [], False, "t")], "video_id bigint, ids array<bigint>, flag boolean, note string")
    sinks.write_flat(df, str(tmp_path / "flat"))
    back = spark.read.csv(str(tmp_path / "flat"), header=True).orderBy("video_id").collect()
    assert (back[0].ids, back[0].flag) == ("3;1", "true")
    cues = spark.createDataFrame([(1, n, f"{n}\ncue\n") for n in (2, 1, 3)], "video_id bigint, cue_no bigint, cue string")
    sinks.write_srt(cues, str(tmp_path / "srt"))
    text = "\n".join(p.read_text() for p in (tmp_path / "srt" / "video_id=1").glob("*.txt"))
    assert [line for line in text.splitlines() if line.isdigit()] == ["1", "2", "3"]
    sinks.write_payloads(df, ["video_id"], ["note"], str(tmp_path / "json"))
    for n in (1, 2):
        sinks.publish(df.limit(n), str(tmp_path / "pub"), f"s{n}")
    assert sinks.read_published(spark, str(tmp_path / "pub")).count() == 2


def test_subtitle_files_are_dealt_out(spark, tmp_path):
    """Few bytes in many files are not left to one task."""
    by_video = Window.partitionBy("video_id").orderBy("cue")
    cues = spark.range(40).select(F.col("id").alias("video_id"), F.lit("cue\n").alias("cue")).withColumn("cue_no", F.row_number().over(by_video))
    sinks.write_srt(cues, str(tmp_path / "many"))
    tasks = {p.name.split("-")[1] for p in (tmp_path / "many").glob("*/*.txt")}
    assert len(tasks) > 1
    assert len(list((tmp_path / "many").glob("*/*.txt"))) == 40


def test_very_many_keys_in_few_files(spark, tmp_path):
    cues = spark.range(200_000).select(
        (F.col("id") % 100_000).alias("video_id"), F.floor(F.col("id") / 100_000).alias("cue_no"), F.concat(F.lit("cue "), "id").alias("cue"))
    path = str(tmp_path / "cues")
    sinks.write_bucketed(cues, ["video_id"], ["cue_no"], path, buckets=6)
    assert len(list((tmp_path / "cues" / "data").glob("*.parquet"))) <= 6
    for video in (0, 7, 99_999):
        got = sinks.read_bucketed(spark, path, {"video_id": video}, ["cue_no"]).collect()
        assert [r.cue for r in got] == [f"cue {video}", f"cue {video + 100_000}"]
    assert sinks.read_bucketed(spark, path, {"video_id": -1}, ["cue_no"]).count() == 0
    index = spark.read.parquet(path + "/index")
    assert index.count() == 100_000 and index.where("rows <> 2").count() == 0
    starts = index.groupBy("file").agg(F.sum("rows").alias("n"), F.max(F.col("first_row") + F.col("rows")).alias("end"))
    assert starts.where("n <> end").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SMALL

    from lectern.suite.fixtures import Tables

    lines = Tables(spark, SMALL).step_log()
    source = str(tmp_path / "log")
    for part in range(3):
        lines.where(F.col("line_no") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (
            steps.step_state_stream(stream, idle_ms=0).writeStream.outputMode("update").format("memory").queryName("step_updates")
            .option("checkpointLocation", str(tmp_path / "cp")).start()
        )
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    latest = {}
    for r in spark.table("step_updates").collect():
        latest[(r.run_id, r.step_id)] = r
    batch = {(r.run_id, r.step_id): r for r in steps.step_state(lines).collect()}
    assert set(latest) == set(batch)
    for k, r in batch.items():
        assert (latest[k].status, latest[k].detail, latest[k].touch_line) == (r.status, r.detail, r.touch_line)


def test_newest_snapshot_is_the_one_published_last(spark, tmp_path):
    from lectern.sources.sinks import publish, read_published

    for name in ("8", "9", "10"):
        publish(spark.range(int(name)), str(tmp_path / "table"), name)
    assert read_published(spark, str(tmp_path / "table")).count() == 10


def test_month_names(spark):
    from lectern.functions.text import run_label

    ids = ["2024-03-09_14-05-00", "2024-12-31_00-00", "2024-13-09_14-05-00", "2024-00-09_14-05", "other", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(run_label(F.col("i"))).collect()]
    assert got == ["09-Mar-2024, 14:05", "31-Dec-2024, 00:00", "09-13-2024, 14:05", "09-00-2024, 14:05", "other", "-"]


def test_a_repeated_translation_does_not_double_segments(spark):
    from lectern.operators.memory import translate_with_memory

    segments = spark.createDataFrame([(1, 1, 0, 900, "good day"), (1, 2, 900, 1800, "good night")],
                                     "video_id long, segment_id long, start_ms long, end_ms long, text string")
    entries = spark.createDataFrame([], "source_text_norm string, target_language string, target_text string")
    terms = spark.createDataFrame([], "source_text string, target_text string, case_sensitive boolean, term_order long, target_language string")
    given = spark.createDataFrame([("good day", "de", "Guten Tag"), ("good day", "de", "Tag")],
                                  "protected_text string, target_language string, translated_text string")
    assert translate_with_memory(segments, entries, terms, given, "de").count() == 2


def test_decks_without_a_sequence_stay(spark):
    from lectern.operators.consistency import consistency_report

    seq = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "deck_id long, slide_index long, run_no long")
    issues = spark.createDataFrame([], "deck_id long, slide_index long")
    got = consistency_report(seq, issues, spark.createDataFrame([(1,), (2,)], "deck_id long")).orderBy("deck_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0, 0), (2, 0, 0, 0, 0)]
