"""License scan: ordered signature rules behind a keyword prefilter.

All of it is one projection over the rows: no shuffle, no Python. A text that
has none of the gate's strings only has its words counted. Otherwise its words
are joined into one normalised text; a rule runs only if one of the words it needs
is in the text; a detection inside another one of the same or a better priority
is suppressed, and of equal intervals the first rule's stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.license_rules import CONFIDENCE, GATE, compiled, rules
from lectern.llm.spans import comma_joined, constant_table, finished, match_spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: what stands between words, in text of any case
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: phrases that are always reported
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
RULE = "name:string,label:string,priority:int,keyword:string,needs:array<string>,pattern:string,rank:int"
DETECTION = "array<struct<start:bigint,tail:bigint,priority:int,rank:int,end:bigint,label:string,name:string>>"


def _words_in(piece: Column) -> Column:
    return (F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2


def _places(norm: Column, phrase: str, label: str) -> Column:
    return F.transform(
        match_spans(norm, F.lit(compiled(phrase)), _words_in),
        lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(label).alias("label")),
    )


def _detections(norm: Column, words: Column) -> Column:
    def of_rule(r: Column) -> Column:
        return F.transform(
            match_spans(norm, r["pattern"], _words_in),
            lambda h: F.struct(
                h["start"].alias("start"), (-h["end"]).alias("tail"), r["priority"].alias("priority"),
                r["rank"].alias("rank"), h["end"].alias("end"), r["label"].alias("label"), r["name"].alias("name"),
            ),
        )

    table = rules()
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in table for k in r["needs"]})])
    gated = F.transform(F.array(F.array_intersect(words, keywords)), lambda seen: F.filter(
        constant_table(table, RULE), lambda r: F.arrays_overlap(seen, r["needs"]) & F.rlike(norm, r["pattern"])))
    present = F.when(norm.isNotNull(), F.get(gated, F.lit(0)))
    return F.sort_array(F.flatten(F.transform(present, of_rule)))


def _kept(detections: Column) -> Column:
    """One pass over detections by (start, longest first, priority, rule): an earlier one that
    reaches as far contains the current one, so the furthest end of each priority is enough."""
    reach = F.array(*[F.lit(-1).cast("bigint") for _ in CONFIDENCE])
    start = F.struct(reach.alias("reach"), F.array().cast(DETECTION).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.array_max(F.slice(acc["reach"], F.lit(1), d["priority"] + 1)) >= d["end"]
        further = F.transform(acc["reach"], lambda v, i: F.when(i == d["priority"], F.greatest(v, d["end"])).otherwise(v))
        return F.struct(
            further.alias("reach"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"),
        )

    return F.aggregate(detections, start, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct ``licenses`` to every row: n_words, base places, detections, labels, score.

    Words are maximal runs of letters, digits and non-ASCII characters after
    A-Z are lowered; spans are in words. A null or empty text has no words, no
    places, empty labels and score 0; a text of any length is read whole. Of
    equal detections the first rule's stays. Repeated rows are scanned each by
    itself, an empty table stays empty. Other columns stay as they are, whatever
    their names, but one named ``licenses`` is replaced.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    lowered = F.translate(given, UPPER, LOWER)
    words = F.array_remove(F.split(lowered, BETWEEN), "")
    gated = F.when(F.col(text).rlike(GATE), words)
    stage = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.size(F.array_remove(F.split(given, BETWEEN), "")).cast("bigint").alias("n_words"), gated.alias("words"),
    ).withColumn("norm", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    base = F.flatten(F.array(*[_places(F.col("norm"), phrase, label) for phrase, label in BASE]))
    found = stage.select("row", "n_words", base.alias("base"), _detections(F.col("norm"), F.col("words")).alias("found"))
    kept = found.select("row", "n_words", "base", _kept(F.col("found")).alias("kept"))
    sure = F.transform("kept", lambda d: F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), d["priority"] + 1))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(F.col("base.label"), F.col("kept.label")))
    result = F.struct(
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        comma_joined(base_labels).alias("base_labels"), comma_joined(labels).alias("labels"),
        F.greatest(F.coalesce(F.array_max(sure), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["name"].alias("rule"))).alias("detections"),
    )
    return finished(kept, docs.columns, result, "licenses")


def oracle_sql() -> str:
    """The query's rows by DuckDB: every rule on every text, containment as an anti join."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    table = ",\n".join(
        f"({r['rank']},{q(r['label'])},{r['priority']},{q(r['pattern'])})" for r in rules()
    )
    phrases = ", ".join(f"({q(label)}, {q(compiled(p))})" for p, label in BASE)
    confidence = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(CONFIDENCE))

    def hits(source: str, extra: str) -> str:
        return f"""SELECT doc_id, {extra},
            CAST(list_sum(list_transform(gaps[1:k], lambda s: length(s) - length(replace(s, ' ', '')))) / 2
               + coalesce(list_sum(list_transform(hits[1:k-1], lambda s: length(s) - length(replace(s, ' ', '')))), 0) / 2 AS BIGINT) AS s,
            CAST((length(hits[k]) - length(replace(hits[k], ' ', ''))) / 2 AS BIGINT) AS n
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k
                FROM (SELECT *, regexp_extract_all(norm, pattern) AS hits, string_split_regex(norm, pattern) AS gaps FROM {source}))"""

    return f"""
WITH rules(rank, label, priority, pattern) AS (VALUES {table}),
phrases(label, pattern) AS (VALUES {phrases}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
norms AS (SELECT doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM texts),
places AS (SELECT * FROM ({hits("(SELECT * FROM norms, phrases WHERE regexp_matches(norm, pattern))", "label")})),
found AS (SELECT doc_id, label, priority, rank, s, s + n AS e
          FROM ({hits("(SELECT g.doc_id, g.norm, r.* FROM norms g JOIN rules r ON regexp_matches(g.norm, r.pattern))", "label, priority, rank")})),
kept AS (SELECT * FROM found d WHERE NOT EXISTS (
          SELECT 1 FROM found o WHERE o.doc_id = d.doc_id AND o.priority <= d.priority AND o.s <= d.s AND o.e >= d.e
            AND (o.s < d.s OR o.e > d.e OR o.priority < d.priority OR o.rank < d.rank))),
bases AS (SELECT doc_id, count(*) AS n, min(s) AS a, max(s) AS z, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM places GROUP BY doc_id),
tops AS (SELECT doc_id, max(CASE priority {confidence} END) AS c FROM kept GROUP BY doc_id),
marks AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
          FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM kept) GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n_words AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, b.a AS first_word, b.z AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels,
  CAST(greatest(coalesce(k.c, 0.0), CASE WHEN b.n > 0 THEN 0.9 ELSE 0.0 END) AS DOUBLE) AS score
FROM norms t LEFT JOIN bases b USING (doc_id) LEFT JOIN tops k USING (doc_id) LEFT JOIN marks m USING (doc_id)
"""
