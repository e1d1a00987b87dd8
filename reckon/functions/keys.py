"""Normalisers of codes, texts, numbers, revisions and dates, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once: a lambda's argument is never expanded into its body."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def code(c: Column) -> Column:
    """Join key: no white space, upper case; blank is null."""
    out = F.upper(F.regexp_replace(c, r"[\s\u00a0]+", ""))
    return F.when(out != "", out)


def text(c: Column) -> Column:
    """Single blanks, none at the ends; a carriage-return mark goes. Blank and words for nothing are null."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, "_x000D_", ""), r"[\s\u00a0]+", " "))
    return F.when(~F.lower(out).isin("", "none", "null", "nan"), out)


#: Sign, digits before and behind the point, without zeros at either end.
_DIGITS = r"^[+]?(-?)0*(\d*?)(?:\.(\d*?)0*)?$"


def number(c: Column) -> Column:
    """A number's canonical text with all its digits: no exponent, no trailing zeros, no negative zero. Other text stays."""
    own = text(c)
    plain = F.regexp_replace(F.replace(own, F.lit(" "), F.lit("")), ",", ".")
    sign, whole, rest = (F.regexp_extract(plain, _DIGITS, i) for i in (1, 2, 3))
    zero = (whole == "") & (rest == "")
    canonical = F.concat(F.when(zero, "").otherwise(sign), F.when(whole == "", "0").otherwise(whole), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    return F.when(own.isin("-", "—"), None).when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), canonical).otherwise(own)


def tags(c: Column) -> Column:
    """Tags of a text parted by commas, semicolons or line breaks: cleaned, sorted, repeated ones kept."""
    return F.array_sort(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;\n\r]+"), text), lambda x: x.isNotNull()))


def packing_part(c: Column) -> Column:
    """A part of a packing key: no white space, lower case, whole doubles without their point; null is empty."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\s\u00a0]+", ""), r"^(-?\d+)\.0$", "$1"))


def path_key(c: Column) -> Column:
    """A path in lower case with forward slashes, single ones, none at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"), "/$", ""))


def coefficient(c: Column) -> Column:
    """A conversion coefficient: a number or ``a/b``, a question mark and anything else null. What is within 0.005 of 1/n
    (n from 2 to 100) is 1/n."""
    compact = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "^=", ""), r"\s+", ""), ",", ".")
    ratio = F.split(compact, "/")
    bottom = F.get(ratio, F.lit(1)).try_cast("double")
    value = F.when(F.size(ratio) == 1, compact.try_cast("double")).when((F.size(ratio) == 2) & (bottom != 0), F.get(ratio, F.lit(0)).try_cast("double") / bottom)
    n = F.floor(F.try_divide(F.lit(1.0), value) + 0.5)
    near = (value > 0) & (value < 1) & (n >= 2) & (n <= 100) & (F.abs(value - F.try_divide(F.lit(1.0), n)) <= 0.005)
    return F.when(near, F.try_divide(F.lit(1.0), n)).otherwise(value)


def quantity(c: Column) -> Column:
    """Exact decimal; a comma is a point and blanks part thousands. Text that isn't a number is null."""
    return F.expr("try_cast(null as decimal(38,6))") if c is None else F.regexp_replace(F.regexp_replace(c, r"[\s\u00a0]+", ""), ",", ".").try_cast("decimal(38,6)")


def unit(c: Column) -> Column:
    """A unit without trailing dots; its case stays."""
    out = F.regexp_replace(F.trim(c), r"\.+$", "")
    return F.when(out != "", out)


def revision_rank(revision: Column, appendix: Column | None = None) -> Column:
    """Comparable triple: V, then S, then numbers; a missing revision, and any other text, is lowest. Then the appendix, a
    missing one before 0, and the raw text decide."""
    raw = F.upper(F.trim(revision))
    rank = F.when(raw == "V", -2).when(raw == "S", -1).when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).otherwise(-3)
    digits = F.when(F.trim(appendix).rlike("^[0-9]+$"), F.trim(appendix).try_cast("int")) if appendix is not None else F.lit(None).cast("int")
    return F.struct(F.coalesce(rank, F.lit(-3)).alias("rev"), F.coalesce(digits, F.lit(-1)).alias("app"), F.coalesce(raw, F.lit("")).alias("raw"))


def day(c: Column) -> Column:
    """``d.M.yyyy`` text as a date; anything else is null."""
    return F.try_to_date(F.trim(c), "d.M.yyyy")


def fingerprint(*columns: Column) -> Column:
    """Identity of a row that survives reloads."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
