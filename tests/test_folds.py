"""Order-bound folds against plain loops written from the rules."""

from __future__ import annotations

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.operators import glossary, memory, ocr, roles, segments, stacking, timeline
from lectern.operators.scan import OrderedScan


def test_scan_against_a_loop(spark):
    rnd = random.Random(5)
    data = [(rnd.randrange(3), n, rnd.choice([None, *range(9)])) for n in range(400)]
    df = spark.createDataFrame(data, "k bigint, o bigint, v bigint").repartition(5)
    want = []
    for k in range(3):
        part = sorted(r for r in data if r[0] == k)
        seen = []
        for i, (_k, o, v) in enumerate(part):
            known = [x for x in seen if x is not None]
            later = [x[2] for x in part[i + 1:] if x[2] is not None]
            upto = known + ([v] if v is not None else [])
            want.append((k, o, i + 1, sum(upto) if upto else None, max(known) if known else None, known[-1] if known else None,
                         upto[-1] if upto else None, later[0] if later else None, seen[-1] if seen else None,
                         part[i + 1][2] if i + 1 < len(part) else None, sum(x[2] for x in part if x[2] is not None)))
            seen.append(v)
    for split in (False, True):
        got = (
            OrderedScan(df, ["k"], ["o"]).row_number("n").running_sum("s", "v").max_before("mb", "v").last_before("lb", "v")
            .last_value("l", "v").next_value("nx", "v").lag("lag", "v").lead("lead", "v").total("t", "v").apply(split)
            .select("k", "o", "n", "s", "mb", "lb", "l", "nx", "lag", "lead", "t").collect()
        )
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_max_plus_scan_against_a_loop(spark):
    rnd = random.Random(6)
    data = [(rnd.choice([0, 1, None]), n, rnd.randrange(0, 9), rnd.choice([None, *range(0, 900, 40)])) for n in range(300)]
    df = spark.createDataFrame(data, "k bigint, o bigint, a bigint, b bigint").repartition(5)
    want = []
    for k in (0, 1, None):
        x = 0
        for _k, o, a, b in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            before, x = x, max(x + a, b if b is not None else 0)
            want.append((o, before, x))
    for split in (False, True):
        scan = OrderedScan(df, ["k"], ["o"]).max_plus("x", F.col("a"), F.col("b")).max_plus_before("before", F.col("a"), F.col("b")).row_number("n")
        got = scan.apply(split)
        assert set(got.columns) == {"k", "o", "a", "b", "x", "before", "n"}
        assert sorted((r.o, r.before, r.x) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_pack(spark, seed):
    rnd = random.Random(seed)
    rows = [(v, i, i * 10, i * 10 + 5, "x" * rnd.randrange(1, 400)) for v in range(4) for i in range(1, rnd.randrange(2, 60))]
    df = spark.createDataFrame(rows, "video_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string")
    got = {(r.video_id, r.segment_id): r.chunk_index for r in memory.pack_chunks(df, 5, 600).collect()}
    for v in range(4):
        chunk, count, chars = 1, 0, 0
        for _v, i, _s, _e, text in sorted(r for r in rows if r[0] == v):
            if count and (count >= 5 or chars + len(text) > 600):
                chunk, count, chars = chunk + 1, 0, 0
            count, chars = count + 1, chars + len(text)
            assert got[(v, i)] == chunk


def test_speech_packing_counts_bytes_and_flags_oversize(spark):
    rows = [(1, 1, 0, 1, "ä" * 150, ""), (1, 2, 1, 2, "b" * 10, ""), (1, 3, 2, 900_000, "c" * 500, "")]
    df = spark.createDataFrame(rows, "video_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string, translated_text string")
    out = {r.segment_id: r for r in memory.pack_speech_chunks(df, 100, max_text=305).collect()}
    assert [out[i].chunk_index for i in (1, 2, 3)] == [1, 2, 3]
    assert [out[i].oversize for i in (1, 2, 3)] == [False, False, True]
    whole = memory.pack_speech_chunks(df.where("segment_id < 3"), 100).collect()
    assert {(r.chunk_index, r.mode) for r in whole} == {(1, "single_request")}
    with pytest.raises(ValueError):
        memory.speech_byte_budget(5000)


def test_stitch(spark):
    rnd = random.Random(3)
    rows = []
    for v in range(5):
        for c in range(6):
            for r in range(rnd.randrange(1, 5)):
                rows.append((v, c, r, c * 2000, 2750, rnd.choice([0, 9000]), rnd.choice([0, 0, 500, 1200, 2600, 3000]), "some words here " * rnd.randrange(1, 4)))
    df = spark.createDataFrame(rows, "video_id bigint, chunk_no bigint, result_no bigint, chunk_start_ms bigint, chunk_ms bigint, duration_ms bigint, end_offset_ms bigint, text string")
    got = sorted(map(tuple, segments.stitch_overlaps(df).collect()))
    want = []
    for v in range(5):
        accepted, n = 0, 0
        for c in range(6):
            mine = sorted(r for r in rows if r[0] == v and r[1] == c)
            prev = 0
            for k, (_v, _c, _r, cs, ms, dur, end, text) in enumerate(mine):
                text = " ".join(text.split())
                start = prev
                if end <= start + 1:
                    words, chars = len(text.split()), len(text)
                    est = round(max(200.0, min(12000.0, max(words * 1000 / 2.8, chars * 1000 / 16.0, 350.0))))
                    end = min(max(start + 150, ms - 150 * (len(mine) - k - 1)), start + est)
                end = min(ms, max(end, start + 1))
                prev = max(prev, end)
                a, b = cs + start, cs + end
                if b <= accepted + 50:
                    continue
                a = max(a, accepted)
                if dur:
                    a, b = min(a, dur), min(b, dur)
                if b - a <= 1:
                    continue
                accepted, n = max(accepted, b), n + 1
                want.append((v, n, a, b, b - a, text))
    assert got == sorted(want)


def _median(v):
    v = sorted(v)
    m = len(v) // 2
    return float(v[m]) if len(v) % 2 else (v[m - 1] + v[m]) / 2.0


def test_implicit_lists(spark):
    rnd = random.Random(11)
    units = []
    for s in range(12):
        for u in range(1, rnd.randrange(2, 14)):
            units.append((s, u, rnd.choice([100, 110, 300]), 150 + rnd.randrange(0, 500), rnd.choice([120, 200, 300]), rnd.randrange(18, 40),
                          rnd.randrange(1, 11), rnd.randrange(1, 4), rnd.choice(["body", "caption", "title"])))
    df = spark.createDataFrame(units, "slide_id bigint, unit_id bigint, x bigint, y bigint, w bigint, h bigint, words bigint, line_count bigint, role string")
    df = df.withColumns({"rel_width": F.col("w") / 1280, "rel_top": F.col("y") / 720, "image_h": F.lit(720).cast("bigint")})
    got = {(r.slide_id, r.unit_id): (r.cluster_no, r.is_list) for r in roles.implicit_lists(df).collect()}
    for s in range(12):
        groups = []
        for u in sorted((u for u in units if u[0] == s and u[8] != "title"), key=lambda u: (u[3], u[2], u[1])):
            best, into = None, None
            for g in groups:
                x, y, w, h = u[2:6]
                mx, mh, mw = (_median([m[i] for m in g]) for i in (2, 5, 4))
                gap, ratio = y - (g[-1][3] + g[-1][5]), w / max(1.0, mw)
                if not 1 <= u[6] <= 9 or u[7] > 3 or w / 1280 > 0.55 or y / 720 < 0.2:
                    continue
                if abs(x - mx) > max(24.0, mh * 0.95) or y < g[-1][3] or not 0.55 <= ratio <= 1.7:
                    continue
                if gap < -max(6, round(min(mh, h) * 0.35)) or gap > max(72, round(max(mh, h) * 2.3)):
                    continue
                if y - min(m[3] for m in g) > max(220, round(720 * 0.45)):
                    continue
                score = abs(x - mx) + max(0, gap) * 0.22 + abs(ratio - 1.0) * 12.0
                if best is None or score < best:
                    best, into = score, g
            if into is None:
                groups.append([u])
            else:
                into.append(u)
        for no, g in enumerate(groups, start=1):
            is_list = len(g) >= 2 and sum(1 for m in g if m[6] <= 7 and m[4] / 1280 <= 0.42) >= 2
            for m in g:
                assert got[(s, m[1])] == (no, is_list)


def test_group_fragments_uses_markers_and_gaps(spark):
    rows = [
        (1, 1, 1, "•", 40, 100, 10, 20), (1, 2, 1, "first point", 60, 100, 200, 20), (1, 3, 1, "goes on", 60, 124, 180, 20),
        (1, 4, 2, "far below", 60, 400, 200, 20), (1, 5, 2, "–", 40, 440, 10, 20), (1, 6, 2, "second point", 60, 440, 210, 20),
    ]
    df = spark.createDataFrame(rows, "slide_id bigint, fragment_id bigint, block_id bigint, text_norm string, x bigint, y bigint, w bigint, h bigint")
    full = df.withColumns({"text_raw": F.col("text_norm"), "event_id": F.lit(1).cast("bigint"), "line_id": F.col("fragment_id")})
    units = {r.unit_id: r for r in ocr.build_units(full).collect()}
    assert [units[i].source_text for i in (1, 2, 3)] == ["first point goes on", "far below", "second point"]
    assert [units[i].list_marker_fragment_id for i in (1, 2, 3)] == [1, 0, 5]
    assert (units[1].x, units[1].y, units[1].w, units[1].h) == (60, 100, 200, 44)


def test_match_phrases(spark):
    rnd = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    words, slides, cands = {}, [], []
    for v in range(6):
        words[v] = [rnd.choice(vocabulary) for _ in range(60)]
        for s in range(1, 6):
            a = (s - 1) * 10
            said = list(words[v][a:a + 6])
            if s % 2 == 0:
                said[2] = "gamna"
            if s == 5:
                said = ["nothing", "like", "that"]
            slides.append((v, s, " ".join(said), ""))
            cands += [(v, s, i, words[v][i], i * 100, i * 100 + 80) for i in range(max(0, a - 8), min(60, a + 16))]
    sdf = spark.createDataFrame(slides, "video_id bigint, slide_index bigint, text string, translated_text string")
    cdf = spark.createDataFrame(cands, "video_id bigint, slide_index bigint, word_idx bigint, normalized string, start_ms bigint, end_ms bigint")
    got = {(r.video_id, r.slide_index): (r.start_word_index, r.end_word_index, r.exact) for r in timeline.match_phrases(sdf, cdf).collect()}
    for v in range(6):
        low = 0
        for _v, s, text, _t in sorted(x for x in slides if x[0] == v):
            want, mine = text.split(), sorted(c for c in cands if c[:2] == (v, s))
            norm, found, exact = [c[3] for c in mine], None, True
            for i in range(len(norm) - len(want) + 1):
                if mine[i][2] >= low and norm[i:i + len(want)] == want:
                    found = (i, i + len(want) - 1)
                    break
            if found is None:
                best, exact = None, False
                for i in range(len(norm)):
                    if mine[i][2] < low:
                        continue
                    for e in range(i + 1, min(len(norm), i + max(2, len(want) + 4)) + 1):
                        score = SequenceMatcher(None, " ".join(norm[i:e]), text).ratio()
                        if best is None or score > best[0]:
                            best = (score, i, e - 1)
                if best and best[0] >= 0.78:
                    found = best[1:]
            if found is None:
                assert got[(v, s)] == (None, None, None)
            else:
                low = mine[found[1]][2] + 1
                assert got[(v, s)] == (mine[found[0]][2], mine[found[1]][2], exact)


def test_long_phrases_need_few_full_comparisons(monkeypatch):
    calls, rnd = [], random.Random(4)
    full = SequenceMatcher.find_longest_match
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    words = [rnd.choice(vocabulary) for _ in range(120)]
    words[70] = "quartz"
    changed = [w.replace("e", "o") for w in words[30:90]]
    close = [*words[30:60], "other", *words[61:90]]
    found = []
    for wanted in (changed, close):
        best = (0.0, None)
        for at in range(len(words)):
            for end in range(at, min(len(words), at + len(wanted) + 4)):
                score = SequenceMatcher(None, " ".join(words[at:end + 1]), " ".join(wanted)).ratio()
                if score > best[0] and score >= 0.78:
                    best = (score, (at, end))
        found.append(best[1])
    assert found[0] is None and found[1] is not None
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda *a, **k: calls.append(1) or full(*a, **k))
    got = [timeline._Phrases(0.78).fuzzy(words, list(range(len(words))), wanted) for wanted in (changed, close)]
    assert got == found
    assert len(calls) < 200


TERMS = [(1, "the", "*", "der", "0"), (2, "of the", "", "des", "0"), (3, "C++", "*", "CPP", "1"), (4, "Über", "de", "Ueber", "0")]
TEXTS = ["The end of the road, of THEm all", "c++ and C++ und über überall", "nothing here", ""]


def _protected(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    terms = spark.createDataFrame(TERMS, "pos bigint, source_text string, target_language string, target_text string, case_sensitive string")
    return rows, memory.select_termbase(terms, "de")


def test_protect_and_restore(spark):
    rows, terms = _protected(spark)
    out = memory.protect_terms(rows, "t", terms)
    restored, lost = memory.restore_terms(F.col("protected.text"), F.col("protected.keys"), F.col("protected.targets"))
    got = {r.t: r for r in out.select("t", "protected", "termbase_hits", restored.alias("r"), lost.alias("lost")).collect()}
    ordered = sorted((t for t in TERMS), key=lambda t: (-len(t[1]), t[0]))
    for text in TEXTS:
        working, n, back = text, 0, {}
        for _p, src, _l, target, case in ordered:
            pattern = (r"(?<!\w)" if src[0].isalnum() else "") + re.escape(src) + (r"(?!\w)" if src[-1].isalnum() else "")

            def swap(_m, target=target):
                nonlocal n
                n += 1
                back[f"__TERM_{n:04d}__"] = target
                return f"__TERM_{n:04d}__"

            working = re.sub(pattern, swap, working, flags=0 if case == "1" else re.IGNORECASE)
        assert got[text].protected.text == working and got[text].termbase_hits == n and not got[text].lost
        for k, v in back.items():
            working = working.replace(k, v)
        assert got[text].r == working
    assert got[TEXTS[0]].r == "der end des road, of THEm all"


def test_protect_with_a_large_termbase(spark):
    """25,000 terms, some with an edge that is no letter, an underscore or no word at all."""
    rows = spark.createDataFrame([("der er. a_b w17 w18 w17",), ("xa_b er.x ->",), (None,), ("w24999 \\E",)], "t string")
    many = spark.range(25_000).select(
        F.col("id").alias("pos"), F.concat(F.lit("w"), "id").alias("source_text"), F.lit("*").alias("target_language"),
        F.concat(F.lit("t"), "id").alias("target_text"), F.lit("0").alias("case_sensitive"))
    odd = spark.createDataFrame(
        [(30_001, "er.", "*", "ER", "0"), (30_002, "a_b", "*", "AB", "0"), (30_003, "->", "*", "ARROW", "0"), (30_004, "\\E", "*", "SLASH", "0"),
         (30_005, "w17 w18", "*", "pair", "0")], many.schema)
    out = memory.protect_terms(rows, "t", memory.select_termbase(many.union(odd), "de"))
    got = {r.t: r.protected for r in out.collect()}
    assert got["der er. a_b w17 w18 w17"].text == "der __TERM_0003__ __TERM_0004__ __TERM_0001__ __TERM_0002__"
    assert got["der er. a_b w17 w18 w17"].targets == ["pair", "t17", "ER", "AB"]
    assert got["xa_b er.x ->"].targets == ["ER", "ARROW"] and got["xa_b er.x ->"].text == "xa_b __TERM_0001__x __TERM_0002__"
    assert got[None].text == "" and got[None].keys == []
    assert got["w24999 \\E"].text == "__TERM_0001__ __TERM_0002__" and got["w24999 \\E"].targets == ["t24999", "SLASH"]


def test_few_terms_go_to_the_texts(spark):
    """No text is shuffled for a short termbase, and both ways give the same."""
    _rows, terms = _protected(spark)
    texts = [*TEXTS, None, "the C++ " * 300]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    sent, joined = memory.protect_terms(rows, "t", terms), memory.protect_terms(rows, "t", terms, few_terms=0)
    got = {r.i: (r.protected, r.termbase_hits) for r in sent.collect()}
    assert got == {r.i: (r.protected, r.termbase_hits) for r in joined.collect()}
    assert got[5][1] == 600 and got[5][0].keys[-1] == "__TERM_0600__" and got[5][0].targets == ["der"] * 300 + ["CPP"] * 300
    assert "hashpartitioning" not in sent._jdf.queryExecution().toString()


def test_lost_placeholder_is_reported(spark):
    row = spark.createDataFrame([("a __TERM_0001__", ["__TERM_0001__", "__TERM_0002__"], ["x", "y"])], "t string, k array<string>, v array<string>")
    restored, lost = memory.restore_terms(F.col("t"), F.col("k"), F.col("v"))
    assert row.select(restored, lost).first()[:] == ("a x", True)


def test_repeats_within_a_batch(spark):
    """The second occurrence hits only when the first was in an earlier chunk."""
    rows = [(1, i, i * 10, i * 10 + 5, t) for i, t in enumerate(["same", "same", "other", "same"], start=1)]
    s = spark.createDataFrame(rows, "video_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string")
    none = spark.createDataFrame([], "source_text_norm string, target_language string, target_text string")
    model = spark.createDataFrame([("same", "de", "gleich"), ("other", "de", "anders")], "protected_text string, target_language string, translated_text string")
    _rows, terms = _protected(spark)
    out = memory.translate_with_memory(s, none, terms, model, "de", max_count=2).orderBy("segment_id").collect()
    assert [r.translation_status for r in out] == ["translated", "translated", "translated", "tm_exact"]
    assert out[3].translated_text == "gleich"


def test_stacked_groups(spark):
    rnd = random.Random(4)
    units = [(s, u, rnd.choice([100, 112, 130, 300]), rnd.randrange(0, 600), rnd.choice([80, 120, 300]), rnd.randrange(14, 40))
             for s in range(15) for u in range(1, rnd.randrange(3, 25))]
    df = spark.createDataFrame(units, "slide_id bigint, unit_id bigint, x bigint, y bigint, w bigint, h bigint")
    got = {(r.slide_id, r.unit_id): (r.group_no, r.group_size) for r in glossary.stacked_groups(df).collect()}
    want = {}
    for s in range(15):
        groups = []
        for u in sorted((u for u in units if u[0] == s), key=lambda u: (u[3], u[2], u[1])):
            x, y, w, h = u[2:]
            options = []
            for no, g in enumerate(groups):
                mx, mh, mw = (max(least, round(_median([m[i] for m in g]))) for i, least in ((2, -9999), (5, 1), (4, 1)))
                tall, down, lap = max(mh, h), y - g[-1][3], y - g[-1][3] - g[-1][5]
                if (abs(x - mx) <= max(18, round(tall * 0.9)) and 0 <= down <= max(34, round(tall * 3.5)) and lap >= -max(6, round(min(mh, h) * 0.35))
                        and 0.45 <= w / mw <= 2.4):
                    options.append((abs(x - mx) + max(0, down - round(tall * 2.2)), no))
            if options:
                groups[min(options)[1]].append(u)
            else:
                groups.append([u])
        want.update({(s, m[1]): (no, len(g)) for no, g in enumerate(groups, start=1) if len(g) >= 2 for m in g})
    assert got == want


@pytest.mark.parametrize("rule", [stacking.LIST_RULE, stacking.ENTRY_RULE])
def test_a_slide_of_very_many_lines(rule):
    rnd = random.Random(2)
    sweep, begun = stacking.StackSweep(rule), time.monotonic()
    numbers = [sweep.place(rnd.randrange(0, 4000), y // 20, 100, rnd.randrange(14, 30), 720, 30) for y in range(100_000)]
    assert len(numbers) == 100_000 and time.monotonic() - begun < 60
