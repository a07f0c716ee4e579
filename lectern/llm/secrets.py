"""Secret scan with multipart credential linking.

Certain findings are reported wherever they stand. Weaker parts (names of
accounts, tokens that only look random, endpoints) are reported only when their
counterparts lie close by: all parts of a text are laid out in order, and two
sweeps join each part with the nearest identifier, secret and endpoint before
and behind it. That is an interval join in time linear in the parts; no pairs
are formed. Everything is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.spans import comma_joined, finished, match_spans


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


KEY = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
ASSIGN = KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ACCOUNT = "(?:" + "|".join(_any_case(w) for w in ("client_?id", "user_?name", "user", "login", "account")) + ")"
WEAK_ID = ACCOUNT + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,64}"""
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\x22\x27<>]{3,}|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|io|dev|internal|local)(?::[0-9]{2,5})?"

#: kinds in the order that settles equal starts, with the role of each
KINDS = ["assign", "access", "hex", "endpoint", "weak_id", "weak_secret"]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "endpoint": "endpoint", "weak_id": "id", "weak_secret": "secret"}
#: what must be near a weak part
NEEDS = {"endpoint": ("id", "secret"), "weak_id": ("secret",), "weak_secret": ("id", "endpoint")}
PART = "array<struct<start:bigint,rank:int,end:bigint>>"
FAR = 1 << 40


def _parts(text: Column, kind: str, pattern: str, keep=None) -> Column:
    spans = match_spans(text, F.lit(pattern))
    if keep is not None:
        spans = F.filter(spans, lambda h: keep(h["hit"]))
    return F.transform(
        spans, lambda h: F.struct(h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), h["end"].alias("end"))
    )


def _looks_random(hit: Column) -> Column:
    return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")


def _role_is(rank: Column, role: str) -> Column:
    return rank.isin([i for i, k in enumerate(KINDS) if ROLES[k] == role])


def _sweep(parts: Column, forward: bool) -> Column:
    """Distance of every part to the nearest part of each role on one side, in the order of ``parts``."""
    far = F.lit(-FAR if forward else FAR).cast("bigint")
    names = ["id", "secret", "endpoint"]
    start = F.struct(
        *[far.alias(n) for n in names], F.array().cast("array<struct<id:bigint,secret:bigint,endpoint:bigint>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        gap = (lambda n: x["start"] - acc[n]) if forward else (lambda n: acc[n] - x["end"])
        edge = F.greatest if forward else F.least
        own = x["end"] if forward else x["start"]
        return F.struct(
            *[F.when(_role_is(x["rank"], n), edge(acc[n], own)).otherwise(acc[n]).alias(n) for n in names],
            F.concat(acc["out"], F.array(F.struct(*[gap(n).alias(n) for n in names]))).alias("out"),
        )

    out = F.aggregate(parts if forward else F.reverse(parts), start, step, lambda acc: acc["out"])
    return out if forward else F.reverse(out)


def _apart(spans: Column, others: Column) -> Column:
    """Those spans that overlap none of the others, which are certain findings and few."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return comma_joined(F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ))


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """Adds a struct ``secrets``: counts of the certain kinds, ``base`` and all ``spans``, and both as text.

    Spans are in code points, end exclusive. Two parts belong to one scope
    when at most ``scope`` code points lie between them. A weak part that
    overlaps a certain finding is dropped; of parts with equal starts the first
    kind comes first. A null or empty text has no spans, a text of any length is
    scanned whole, and so is a secret of any length. Repeated rows are scanned
    each by itself, an empty table stays empty; other columns stay as they are,
    but one named ``secrets`` is replaced.
    """
    given = F.col(text)
    gate = given.contains("AKIA") | given.rlike(HEX) | given.rlike(ASSIGN) | given.rlike(WEAK_SECRET)
    stage = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(gate, given).alias("t"),
    )
    t = F.col("t")
    value_long = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    empty = F.array().cast(PART)
    found = stage.select(
        "row", "t",
        *[F.coalesce(c, empty).alias(n) for n, c in (
            ("assign", _parts(t, "assign", ASSIGN, value_long)), ("access", _parts(t, "access", ACCESS)),
            ("hex", _parts(t, "hex", HEX)), ("weak_secret", _parts(t, "weak_secret", WEAK_SECRET, _looks_random)),
        )],
    )
    some = F.size("assign") + F.size("access") + F.size("hex") + F.size("weak_secret") > 0
    linked = found.select(
        "row", "assign", "access", "hex", "weak_secret",
        F.coalesce(F.when(some, _parts(t, "endpoint", ENDPOINT)), empty).alias("endpoint"),
        F.coalesce(F.when(some, _parts(t, "weak_id", WEAK_ID)), empty).alias("weak_id"),
        F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
    )
    weak = _apart(F.concat("endpoint", "weak_id", "weak_secret"), F.col("base"))
    laid = linked.select("row", "assign", "access", "hex", "base", F.sort_array(F.concat(F.col("base"), weak)).alias("parts"))
    swept = laid.select("*", _sweep(F.col("parts"), True).alias("before"), _sweep(F.col("parts"), False).alias("behind"))

    def reported(x: Column) -> Column:
        near = lambda role: (x["before"][role] <= scope) | (x["behind"][role] <= scope)
        weak_ok = F.lit(False)
        for kind, roles in NEEDS.items():
            both = [near(r) for r in roles]
            ok = both[0]
            for b in both[1:]:
                ok = (ok & b) if kind == "endpoint" else (ok | b)
            weak_ok = weak_ok | ((x["part"]["rank"] == KINDS.index(kind)) & ok)
        return (x["part"]["rank"] < 3) | weak_ok

    zipped = F.arrays_zip(F.col("parts").alias("part"), "before", "behind")
    spans = F.transform(F.filter(zipped, reported), lambda x: x["part"])
    final = swept.select("row", "assign", "access", "hex", "base", spans.alias("spans"))
    count = lambda c: F.size(c).cast("bigint")
    result = F.struct(
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("listed"), "base", "spans",
    )
    return finished(final, docs.columns, result, "secrets")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every reported span replaced by ``mask``; overlapping spans share one mask.

    Null stays null, and a text without spans stays as it is.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        more = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(more, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def oracle_sql(scope: int = 200) -> str:
    """The query's rows by DuckDB: spans by list functions, links by EXISTS within the scope."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def part(kind: str, pattern: str, keep: str = "true") -> str:
        return f"""SELECT doc_id, {KINDS.index(kind)} AS r, s, s + length(hit) AS e FROM (
          SELECT doc_id, hits[k] AS hit, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (
            SELECT doc_id, regexp_extract_all(text, {q(pattern)}) AS hits, string_split_regex(text, {q(pattern)}) AS gaps FROM documents)))
          WHERE {keep}"""

    role = "CASE r " + " ".join(f"WHEN {i} THEN '{ROLES[k]}'" for i, k in enumerate(KINDS)) + " END"
    kind = "CASE r " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    random = "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')"

    def near(r: str) -> str:
        return f"""EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.role = '{r}' AND (o.s, o.r, o.e) <> (p.s, p.r, p.e)
          AND o.s - p.e <= {scope} AND p.s - o.e <= {scope})"""

    return f"""
WITH base AS ({part("assign", ASSIGN, f"length(regexp_extract(hit, {q(ASSIGN)}, 2)) >= 8")} UNION ALL {part("access", ACCESS)} UNION ALL {part("hex", HEX)}),
weak_all AS ({part("endpoint", ENDPOINT)} UNION ALL {part("weak_id", WEAK_ID)} UNION ALL {part("weak_secret", WEAK_SECRET, random)}),
weak AS (SELECT * FROM weak_all w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT *, {role} AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
spans AS (SELECT * FROM parts p WHERE r < 3 OR (r = 3 AND {near("id")} AND {near("secret")}) OR (r = 4 AND {near("secret")})
          OR (r = 5 AND ({near("id")} OR {near("endpoint")}))),
b AS (SELECT doc_id, string_agg({kind} || ':' || s || ':' || e, ',' ORDER BY s, r) AS t,
      count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS c, count(*) FILTER (r = 2) AS h FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg({kind} || ':' || s || ':' || e, ',' ORDER BY s, r) AS t FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.c, 0) AS n_access, coalesce(b.h, 0) AS n_hex,
  sha256(coalesce(b.t, '')) AS base_sha256, coalesce(a.t, '') AS spans
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
