"""Column functions that the bundled transforms share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_upper(c: Column) -> Column:
    """a-z as A-Z; other letters stay."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def utf8_error(raw: Column) -> Column:
    return F.when(~F.is_valid_utf8(raw.cast("string")), F.lit("invalid utf-8 sequence"))


def parse_i32(c: Column) -> Column:
    """A 32-bit integer: sign and ASCII digits only, no white space; else null."""
    return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("int"))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


#: What is a number: decimal digits, a point, an exponent; or infinity or not-a-number by name.
F64 = r"\A[+-]?((?i:inf|infinity|nan)|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\z"


def parse_f64(c: Column) -> Column:
    """A double of a text without white space; else null."""
    sign = F.regexp_extract(c, r"\A([+-]?)", 1)
    name = F.lower(F.regexp_replace(c, r"\A[+-]", ""))
    special = F.when(name == "nan", F.lit(float("nan"))).when(name.isin("inf", "infinity"), F.when(sign == "-", float("-inf")).otherwise(float("inf")))
    return F.when(c.rlike(F64), F.coalesce(special, c.try_cast("double")))


def i32_error(c: Column) -> Column:
    """Why ``parse_i32`` gives null."""
    c = F.coalesce(c, F.lit(""))
    wide = c.rlike(r"\A[+-]?[0-9]+\z")
    return (
        F.when(parse_i32(c).isNotNull(), F.lit(None).cast("string"))
        .when(c == "", "cannot parse integer from empty string")
        .when(wide & c.startswith("-"), "number too small to fit in target type")
        .when(wide, "number too large to fit in target type")
        .otherwise("invalid digit found in string")
    )


def _utc(ms: Column) -> Column:
    """A time that the session's zone shows as UTC does."""
    return F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())


def utc_text(ms: Column) -> Column:
    """``2024-01-01 00:00:00 UTC``, with milliseconds if there are any; ``unknown`` without a time."""
    t = _utc(ms)
    return F.when(ms.isNull(), "unknown").otherwise(F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.when(F.pmod(ms, F.lit(1000)) != 0, F.date_format(t, ".SSS")).otherwise(""), F.lit(" UTC")))


def rfc3339(ms: Column) -> Column:
    """``2024-01-01T00:00:00.000Z``; ``NA`` without a time."""
    return F.when(ms.isNull(), "NA").otherwise(F.date_format(_utc(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def looks_binary(raw: Column) -> Column:
    """A NUL byte among the first 1024, or bytes that are no UTF-8; an approximation of content sniffing."""
    head = F.substring(raw, 1, 1024)
    return (F.length(F.replace(F.hex(head), F.lit("00"), F.lit(""))) % 2 != 0) | (F.instr(head.cast("string"), "\x00") > 0) | ~F.is_valid_utf8(raw.cast("string"))


def pretty_hex(raw: Column) -> Column:
    """Hex dump: two digits a byte, a space between bytes."""
    return F.trim(F.regexp_replace(F.lower(F.hex(raw)), "(..)", "$1 "))


#: Three, two and four decimal digits of any script.
SSN = r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"


def mask_ssn(c: Column) -> Column:
    return F.regexp_replace(c, SSN, "***-**-****")
