"""Text, array and number expressions. Every function maps Columns to a Column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.config import TITLE_SUFFIXES

# Every code point that counts as white space when text is stripped or collapsed.
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_SPACE_RUN = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
STRONG_SEPARATORS = "[、，,；;|]+"
SLASHES = "[/／]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE_RUN, " "))


def clean_optional(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _not_empty(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def clean_list(c: Column, collapse: bool = True) -> Column:
    """Clean every item, drop NULL and blank ones, keep the first occurrence of each in order."""
    cleaned = F.transform(c, collapse_ws if collapse else strip)
    return F.array_distinct(F.filter(F.coalesce(cleaned, F.array().cast("array<string>")), _not_empty))


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def truncate(c: Column, n: int) -> Column:
    """Cut to n code points, then strip the right end; shorter text is only stripped."""
    return rstrip(F.substring(strip(c), 1, n))


def labelled(label: str, c: Column) -> Column:
    """``label：value`` or NULL, so that ``concat_ws`` leaves the part out."""
    return F.concat(F.lit(label + "："), F.nullif(c, F.lit("")))


def labelled_list(label: str, c: Column) -> Column:
    """``label：`` and the items joined, or NULL for an empty list; the items themselves are not empty."""
    return F.concat(F.lit(label + "："), F.nullif(F.array_join(c, "；"), F.lit("")))


def split_clean(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), collapse_ws), _not_empty)


def slash_guard(parts: Column, suffixes: tuple[str, ...] = TITLE_SUFFIXES) -> Column:
    """True when there are several parts and each of them ends like a complete position name."""
    ending = "(" + "|".join(suffixes) + ")$"
    return (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(ending))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def strip_fence(c: Column) -> Column:
    """Remove one leading Markdown fence (with or without ``json``) and one trailing fence."""
    opened = F.regexp_replace(strip(c), r"^```(?:json)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def optional_int(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("int")


def optional_int_invalid(c: Column) -> Column:
    return c.isNotNull() & optional_int(c).isNull()


def retry_after(c: Column) -> Column:
    d = strip(c).try_cast("double")
    return F.when(is_finite(d) & (d >= 0), d)


def http_retryable(status: Column) -> Column:
    return status.isin(408, 409, 429) | (status >= 500)


def backoff(retry: Column, hint: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    """Doubling delay up to the cap; a longer wait demanded by the server wins."""
    delay = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), retry))
    return F.greatest(delay, F.coalesce(hint.cast("double"), F.lit(0.0)))


def source_name(c: Column) -> Column:
    """Short name of a match source; NULL for one that is not known."""
    return F.when(c.isin("exact", "semantic", "manual_search"), c)


def is_json(c: Column) -> Column:
    """True for text that is exactly one JSON value.

    Spark's parser stops after the first value. Text that continues is told apart by putting it into
    a list of one and into an object: whatever follows the value breaks at least one of the two.
    """
    listed = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.coalesce(listed, F.lit(False)) & wrapped.isNotNull()
