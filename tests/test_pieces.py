"""Folds in pieces and chunks by pointers against plain loops, at any piece size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import changes, chunking, final_slides, memory
from lectern.operators.chunking import greedy_chunks

SLIDE = "video_id bigint, event_id bigint, gid bigint"


def _like(a, b, threshold):
    return a is not None and b is not None and len(a) == len(b) and sum(abs(x - y) for x, y in zip(a, b)) / len(a) <= threshold


def _videos(seed):
    """Videos that stand still, drift, jump between two images, repeat in blocks, and hold gaps."""
    rnd = random.Random(seed)
    out = {1: [[0.5, 0.5]] * 40, 2: [[0.3 * i, 0.0] for i in range(40)], 3: [[float(i % 2), 1.0] for i in range(40)],
           4: [[float(rnd.randrange(3)), float(i // 15)] for i in range(60)], 5: [None, [1.0], [1.0, 2.0], None, [1.0, 2.0]], 6: [[1.0, 1.0]],
           7: [[rnd.random(), 0.0] for _ in range(50)]}
    return {**out, None: [[0.0, 0.0]] * 7}


@pytest.mark.parametrize("piece_rows", [2, 7, 10_000])
def test_duplicates_in_pieces(spark, piece_rows):
    videos = _videos(3)
    slides = [(v, g, g) for v, images in videos.items() for g in range(len(images) + 1)]
    images = [(v, g, image) for v, rows in videos.items() for g, image in enumerate(rows, start=1)]
    folded = spark.createDataFrame(slides, SLIDE).repartition(5)
    pictures = spark.createDataFrame(images, "video_id bigint, event_id bigint, image array<double>")
    got = {(r.video_id, r.gid): r.target_gid for r in final_slides.duplicate_targets(folded, pictures, 0.4, piece_rows).collect()}
    want = {}
    for v, rows in videos.items():
        last, want[(v, 0)] = None, 0
        for g, image in enumerate(rows, start=1):
            # a video without a key meets no image
            image = image if v is not None else None
            if last is None or not _like(image, last[1], 0.4):
                last = (g, image)
            want[(v, g)] = last[0]
    assert got == want


@pytest.mark.parametrize("piece_rows", [2, 10_000])
def test_late_candidates_in_pieces(spark, piece_rows):
    rnd = random.Random(8)
    rows, patches = [], []
    for v in range(6):
        for frame in range(1, 50):
            rows.append((v, frame, rnd.choice([0, 1, 1]), frame, frame, 0, rnd.random() < 0.6))
            if rnd.random() < 0.9:
                patches.append((v, frame, [float(rnd.randrange(2)) if v else 1.0]))
    df = spark.createDataFrame(rows, "video_id bigint, event_frame bigint, sort_priority int, frame_id_0 bigint, frame_id_1 bigint, transition_no bigint, updates_slide_state boolean")
    seen = spark.createDataFrame(patches, "video_id bigint, frame_id bigint, patch array<double>")
    got = sorted((r.video_id, r.event_frame) for r in changes.dedupe_backfills(df, seen, 0.1, piece_rows).collect())
    known, want = {(v, f): p for v, f, p in patches}, []
    for v in range(6):
        kept = slide = None
        for _v, frame, late, _a, _b, _t, updates in sorted(r for r in rows if r[0] == v):
            patch = known.get((v, frame))
            if patch is None or (late == 1 and (_like(patch, kept, 0.1) or (updates and _like(patch, slide, 0.1)))):
                continue
            kept, slide = patch, patch if updates else slide
            want.append((v, frame))
    assert got == sorted(want)


def _chunks(sizes, limit, joint, max_count):
    chunk, count, total, out = 1, 0, 0, []
    for n in sizes:
        if count and (count >= max_count or total + joint + n > limit):
            chunk, count, total = chunk + 1, 0, 0
        total, count = total + n + (joint if count else 0), count + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize(("piece_rows", "max_count", "split"), [(2, 3, False), (5, 4, True), (512, 100, False), (512, 100, True), (3, 100, False)])
def test_chunks_by_pointers(spark, piece_rows, max_count, split):
    rnd = random.Random(piece_rows)
    sizes = {v: [rnd.choice([0, 1, 5, 30, 200]) for _ in range(rnd.randrange(1, 90))] for v in [*range(5), None]}
    df = spark.createDataFrame([(v, i, n) for v, s in sizes.items() for i, n in enumerate(s)], "k bigint, o bigint, n bigint").repartition(4)
    for joint in (0, 1):
        got = {(r.k, r.o): r.chunk_index for r in greedy_chunks(df, "k", ["o"], {"n": (100, joint)}, max_count, piece_rows=piece_rows, split=split).collect()}
        assert got == {(v, i): c for v, s in sizes.items() for i, c in enumerate(_chunks(s, 100, joint, max_count))}


def test_chunks_of_a_very_long_video(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("o"), (F.col("id") * 7919 % 97).alias("n"))
    want = _chunks([i * 7919 % 97 for i in range(n)], 400, 0, 12)
    got = greedy_chunks(df, "k", ["o"], {"n": (400, 0)}, 12)
    assert got.agg(F.max("chunk_index"), F.sum("chunk_index"), F.count("*")).first() == (want[-1], sum(want), n)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "video_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string")
    assert memory.pack_chunks(empty).count() == 0
    pictures = spark.createDataFrame([], "video_id bigint, event_id bigint, image array<double>")
    assert final_slides.duplicate_targets(spark.createDataFrame([], SLIDE), pictures).count() == 0
    assert chunking.PIECE_ROWS > 1


def test_a_piece_converts_only_its_own_values():
    import pyarrow as pa

    from lectern.operators.speculative import _vectors

    batch = pa.array([[i, i + 1, i + 2] if i % 5 else None for i in range(100)], pa.list_(pa.float32()))
    for part in (batch.slice(21, 4), batch.slice(20, 0), batch):
        got = _vectors(part)
        assert [None if v is None else v.tolist() for v in got] == part.to_pylist()
        assert all(v.base.size <= 3 * len(part) for v in got if v is not None)
