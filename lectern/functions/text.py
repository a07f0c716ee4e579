"""Text helpers as column expressions.

Unicode compatibility forms have no Spark built-in, so they are vectorized
UDFs; only strings with non-ASCII characters are sent to them.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# Characters counted as a list marker when they stand alone.
LIST_MARKERS = [
    "•", "●", "◦", "▪", "■", "▸", "▹", "►", "‣", "∙",
    "·", "○", "◯", "◆", "◇", "*", "-", "–", "—",
]

# White space, and typographic characters and what they are read as.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SMART_CHARS = "‘’‚‛“”„‟′″ "
PLAIN_CHARS = "''''\"\"\"\"'\" "

_NON_ASCII = r"[^\x00-\x7F]"


def _map_text(fn):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))

    return run


def _fold_token(value: str) -> str:
    text = unicodedata.normalize("NFKD", value).lower()
    return "".join(c for c in text if not unicodedata.combining(c) and c != "_").strip()


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return _map_text(lambda v: unicodedata.normalize("NFKC", v))(s)


@pandas_udf(StringType())
def _token_fold(s: pd.Series) -> pd.Series:
    return _map_text(_fold_token)(s)


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)],
        dtype="float64",
    )


def _only_non_ascii(udf, text: Column, plain: Column) -> Column:
    return F.coalesce(udf(F.when(text.rlike(_NON_ASCII), text)), plain)


def collapse(text: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def nfkc(text: Column) -> Column:
    return _only_non_ascii(_nfkc, text, text)


def norm_tm(text: Column) -> Column:
    """Key of a translation-memory text."""
    return collapse(nfkc(F.coalesce(text, F.lit(""))))


def norm_slide(text: Column) -> Column:
    """Key of a slide text: as above, with plain quotes."""
    return collapse(F.translate(nfkc(F.coalesce(text, F.lit(""))), SMART_CHARS, PLAIN_CHARS))


def norm_token(text: Column) -> Column:
    """One word folded for matching: no accents, case or underscores."""
    plain = F.trim(F.regexp_replace(F.lower(text), "_+", ""))
    return _only_non_ascii(_token_fold, text, plain)


def tokens(text: Column) -> Column:
    """Folded words of a text, in order.

    The folding is done on the whole text with words already separated by
    blanks, so the array costs one vectorized call per text.
    """
    words = F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)")), " ")
    return F.filter(F.split(norm_token(words), " "), lambda t: t != "")


def norm_compare(text: Column) -> Column:
    lowered = F.lower(nfkc(collapse(F.coalesce(text, F.lit("")))))
    return collapse(F.regexp_replace(lowered, r"(?U)[^\w\s]", ""))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts; 0 when either is empty."""
    return _ratio(norm_compare(a), norm_compare(b))


def token_count(text: Column) -> Column:
    return F.regexp_count(nfkc(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+")).cast("bigint")


def word_count(text: Column) -> Column:
    # the text is named once, so that it is normalized once; one without words gives one empty part
    return F.size(F.filter(F.split(norm_slide(text), " "), lambda w: w != "")).cast("bigint")


def blank_word_count(text: Column) -> Column:
    """Words of an already normalized text."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("bigint")


def alnum_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")


def has_alnum(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def is_translatable(text: Column) -> Column:
    return has_alnum(F.coalesce(norm_slide(text), F.lit("")))


@cache
def _marker_forms() -> tuple[str, list[str]]:
    """Characters that are nothing but white space as a slide text, and those that are a list marker."""
    smart = str.maketrans(SMART_CHARS, PLAIN_CHARS)
    whole = {chr(c): unicodedata.normalize("NFKC", chr(c)).translate(smart).strip(SPACES) for c in range(0x110000) if not 0xD800 <= c < 0xE000}
    return "".join(c for c, t in whole.items() if t == ""), [c for c, t in whole.items() if t in LIST_MARKERS]


def is_list_marker(text: Column) -> Column:
    """Whether the key of a slide text is a list marker; no compatibility form makes a marker of several other characters."""
    blanks, markers = _marker_forms()
    return F.coalesce(F.btrim(text, F.lit(blanks)).isin(markers), F.lit(False))


def short_text(text: Column, limit: int = 48) -> Column:
    compact = collapse(F.coalesce(text, F.lit("")))
    cut = F.concat(F.substring(compact, 1, max(4, limit - 1)), F.lit("…"))
    return F.when(F.length(compact) <= limit, compact).otherwise(cut)


def punctuation_bonus_pct(text: Column) -> Column:
    """Extra weight of a sentence end, in hundredths of a word."""
    end = F.substring(F.trim(text), -1, 1)
    return (
        F.when(end.isin(".", "!", "?"), F.lit(60))
        .when(end.isin(",", ";", ":"), F.lit(25))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def speech_text(translated: Column, text: Column) -> Column:
    """Translated text, else the source text, else null."""
    return F.coalesce(
        F.nullif(F.trim(translated), F.lit("")), F.nullif(F.trim(text), F.lit(""))
    )


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")


def split_units(text: Column) -> Column:
    """Sentences and the whitespace between them, as an array that joins back to the text.

    A separator is a run of newlines, or whitespace after ``.``, ``!`` or ``?``.
    """
    mark = "\u0001"
    fenced = F.regexp_replace(text, r"(?U)(\n+|(?<=[.!?])\s+)", f"{mark}$1{mark}")
    return F.filter(F.split(fenced, mark), lambda p: p != "")


def is_separator(part: Column) -> Column:
    return collapse(part) == ""


def parse_ids(text: Column) -> Column:
    """``3;1,x,3`` -> ``[1, 3]``: bad parts are skipped."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ";"), ";")
    ids = F.transform(parts, lambda p: F.trim(p).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.array_compact(ids)))


def lang_slug(label: Column) -> Column:
    slug = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", F.lit("translated")).otherwise(slug)


def run_label(run_id: Column) -> Column:
    """``2024-03-09_14-05-00`` -> ``09-Mar-2024, 14:05``; other ids stay as they are."""
    text = F.trim(F.coalesce(run_id, F.lit("")))
    pattern = r"^(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})(-\d{2})?$"
    part = [F.regexp_extract(text, pattern, n) for n in range(6)]
    first = F.try_to_timestamp(F.concat(F.lit("2000-"), part[2], F.lit("-01")), F.lit("yyyy-MM-dd"))
    month = F.coalesce(F.date_format(first, "MMM"), part[2])
    label = F.concat(part[3], F.lit("-"), month, F.lit("-"), part[1], F.lit(", "),
                     part[4], F.lit(":"), part[5])
    return F.when(part[0] != "", label).when(text == "", F.lit("-")).otherwise(text)


# Speech codes whose translation code is not the part before the dash.
SPECIAL_TRANSLATE_CODES = {"cmn-CN": "zh-CN", "cmn-tw": "zh-TW"}


def translate_code(speech_code: Column) -> Column:
    code = F.trim(F.coalesce(speech_code, F.lit("")))
    out = F.lower(F.trim(F.split_part(code, F.lit("-"), F.lit(1))))
    for special, target in SPECIAL_TRANSLATE_CODES.items():
        out = F.when(code == special, F.lit(target)).otherwise(out)
    return out


def event_id_from_name(name: Column) -> Column:
    """``slide_003_event_017_f000120`` -> 17."""
    found = F.regexp_extract(name, r"(?:^|_)event_(\d+)(?:_|$)", 1)
    return F.nullif(found, F.lit("")).cast("bigint")


def slide_index_from_name(name: Column) -> Column:
    found = F.regexp_extract(name, r"slide_(\d+)", 1)
    return F.nullif(found, F.lit("")).cast("bigint")


def numbered(prefix: str, n: Column) -> Column:
    """``event_007``: at least three digits."""
    return F.format_string(f"{prefix}%03d", n)
