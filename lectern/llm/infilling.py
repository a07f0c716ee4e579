"""Fill-in-the-middle transformation of texts, cut by a sparse exception index.

Cuts are drawn in code points but strings are bytes. For each Arrow batch only
the multi-byte characters are recorded, as their code-point position and the
bytes they have in excess; a binary search in that list turns a cut into a byte
offset, and between exceptions the two are the same arithmetic. The worker gets
the texts' bytes and returns four numbers a row. Slices, outputs and digests
are column functions. One projection, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100: from here on plain; of the others, below here suffix first
PLAIN_FROM, SPM_BELOW = 90, 20
CUTS = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,prefix_bytes:bigint,middle_bytes:bigint>"


class ExceptionIndex:
    """The multi-byte characters of some texts that lie in a row in one buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        leads = np.flatnonzero(data >= 0xC0)
        lead = data[leads]
        excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        #: bytes in excess before the k-th exception, and after all of them
        self.excess = np.concatenate([np.zeros(1, np.int64), excess])
        #: code point of each exception, counted from the start of the buffer
        self.points = leads - self.excess[:-1]
        self.offsets = offsets
        #: code points before each text
        self.starts = offsets - self.excess[np.searchsorted(leads, offsets)]

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def byte_cuts(self, chars: np.ndarray) -> np.ndarray:
        """Bytes of the first ``chars`` code points of each text."""
        at = self.starts[:-1] + chars
        return at + self.excess[np.searchsorted(self.points, at)] - self.offsets[:-1]


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls, not copied."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cut_points(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Cuts of each text in code points and bytes, from two draws that are taken modulo the length plus one."""
    index = ExceptionIndex(*string_parts(texts))
    n = index.lengths()
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    start, end = index.byte_cuts(low), index.byte_cuts(high)
    return pa.StructArray.from_arrays(
        [pa.array(v) for v in (n, low, high - low, start, end - start)],
        ["n", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"],
    )


def _cuts():
    @F.arrow_udf(CUTS)
    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        if not len(texts):
            return cut_points(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return cut_points(texts, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))

    return cuts


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits from sha256(seed:key); a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _bytes(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text.cast("binary"), (start + 1).cast("int"), length.cast("int")).cast("string")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", result: str = "infill") -> DataFrame:
    """Adds a struct ``result``: n, form, prefix_chars, middle_chars, output.

    ``form`` is plain, psm or spm; the first two counts are in code points,
    null for plain. A null text counts as empty, an empty text is plain, and so
    is one that holds a marker, since it could not be restored. A text is one
    value of any length; rows with equal keys are cut by the same draws, null
    keys like an empty key. Other columns stay as they are; one named
    ``result`` is replaced. An empty table gives an empty one.
    """
    given = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stage = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), given.alias("t"), F.array(*draws(F.col(f"`{key}`"))).alias("h")
    )
    h = lambda k: F.get(F.col("h"), F.lit(k))
    cut = stage.withColumn("cut", _cuts()(F.col("t"), h(0), h(1)))
    t = F.col("t")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | marked | (h(2) % 100 >= PLAIN_FROM), "plain").when(h(3) % 100 < SPM_BELOW, "spm").otherwise("psm")
    formed = cut.withColumn("form", form)
    start, middle = F.col("cut.prefix_bytes"), F.col("cut.middle_bytes")
    before, between = _bytes(t, F.lit(0), start), _bytes(t, start, middle)
    behind = _bytes(t, start + middle, F.octet_length(t))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), behind, F.lit(MIDDLE), between))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), behind, F.lit(PREFIX), before, F.lit(MIDDLE), between))
        .otherwise(t)
    )
    shown = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c)
    made = F.struct(F.col("cut.n").alias("n"), "form", shown("prefix_chars"), shown("middle_chars"), output.alias("output"))
    return formed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != result], made.alias(result))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its markers alone.

    Each marker stands once, as the text holds none and no marker begins
    inside another. Null in either gives null.
    """
    inside = F.substring(output, 4, 2147483647)
    part = lambda c, mark, k: F.get(F.split(c, mark, 2), F.lit(k))
    head, tail = part(inside, MIDDLE, 0), part(inside, MIDDLE, 1)
    psm = F.concat(part(head, SUFFIX, 0), tail, part(head, SUFFIX, 1))
    spm = F.concat(part(head, PREFIX, 1), tail, part(head, PREFIX, 0))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)


def oracle_sql() -> str:
    def drawn(k: int) -> str:
        return f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, {", ".join(drawn(k) for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
       WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, z - a) AS mid, substr(t, z + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                   WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
