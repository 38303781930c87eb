"""Names, labels and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORBIDDEN = r'<>:"/\|?*'


def or_misc(c: Column) -> Column:
    """Trimmed; a null or blank becomes misc."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("misc"))


def spaced(c: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def category(c: Column) -> Column:
    return F.upper(spaced(c))


def unicode_category(c: Column) -> Column:
    """As category(), with byte-order marks dropped, Unicode blanks as blanks and Unicode dashes as hyphens."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "﻿", ""), "[  -   　]", " "), "[‐-―−]", "-")
    return category(plain)


def header(c: Column) -> Column:
    return F.lower(spaced(c))


def key(c: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def unicode_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def base_key(c: Column) -> Column:
    """key() without the digits at its end."""
    return F.regexp_replace(key(c), "[0-9]+$", "")


def safe_chars(c: Column) -> Column:
    """Each character that a file name may not have becomes an underscore; a blank name is Unnamed."""
    return F.coalesce(F.nullif(F.trim(F.translate(c, FORBIDDEN, "_" * len(FORBIDDEN))), F.lit("")), F.lit("Unnamed"))


def safe_runs(c: Column) -> Column:
    """Each run of such characters becomes one underscore."""
    return F.regexp_replace(c, r'[<>:"/\\|?*]+', "_")


def without_index(c: Column) -> Column:
    """Without a trailing index of two underscores and two digits or more."""
    return F.regexp_replace(c, r"__[0-9]{2,}$", "")


def comparable(c: Column) -> Column:
    return F.lower(F.replace(safe_runs(without_index(c)), F.lit(" "), F.lit("_")))


def token(c: Column, keep_underscores: bool = True) -> Column:
    out = F.lower(F.translate(c, FORBIDDEN + " ", "_" * (len(FORBIDDEN) + 1)))
    return out if keep_underscores else F.replace(out, F.lit("_"), F.lit(""))


def handle(c: Column) -> Column:
    """The hexadecimal handle in a name: after an H, else at the end; four digits or more, in upper case; else null."""
    marked = F.nullif(F.regexp_extract(c, "(?i)H([0-9A-F]{4,})", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(c, "(?i)([0-9A-F]{4,})$", 1), F.lit(""))
    return F.upper(F.coalesce(marked, last))


def handle_number(c: Column) -> Column:
    """A handle as a number; what isn't hexadecimal sorts last."""
    ok = c.rlike("^[0-9A-Fa-f]{1,15}$")
    return F.when(ok, F.conv(c, 16, 10).cast("bigint")).otherwise(F.lit((1 << 63) - 1))


def handle_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "^H", "")


def contains_either(a: Column, b: Column) -> Column:
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))


def prefix_either(a: Column, b: Column, least: int = 8) -> Column:
    """One is a prefix of the other, and both have `least` characters or more."""
    return (F.length(a) >= least) & (F.length(b) >= least) & (F.startswith(a, b) | F.startswith(b, a))


def name_similarity(a: Column, b: Column) -> Column:
    """100 for equality and 50 for containment, ignoring case, and the number of distinct common characters, over 200."""
    x, y = F.lower(a), F.lower(b)
    common = F.size(F.array_intersect(F.split(x, ""), F.split(y, "")))
    points = F.when(x == y, F.lit(100)).otherwise(F.lit(0)) + F.when(contains_either(a, b), F.lit(50)).otherwise(F.lit(0)) + common
    return F.least(F.greatest(points / F.lit(200.0), F.lit(0.0)), F.lit(1.0))


def first_line(c: Column) -> Column:
    return F.trim(F.split(c, "\n")[0])


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def shortened(c: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(c, r"[\r\n]+", " "), 1, most)


def file_name(c: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(c, r"[^0-9A-Za-z_]+", "_"), 1, most)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def image_formula(url: Column, mode: int | None = None, height: int | None = None, width: int | None = None) -> Column:
    """A cell's picture by its address; with a mode, and in modes 3 and 4 with the height and width too."""
    more = "" if mode is None else f",{mode}"
    if mode in (3, 4) and height is not None and width is not None:
        more += f",{height},{width}"
    return F.concat(F.lit('=IMAGE("'), url, F.lit('"' + more + ")"))


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def as_base64(content: Column) -> Column:
    """Binary content as text on one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def run_id() -> Column:
    """An r, the session's local time to the minute and six hexadecimal digits; another one for each row."""
    return F.concat(F.date_format(F.current_timestamp(), "'r'yyyyMMdd-HHmm"), F.lit("-"), F.substring(F.uuid(), 1, 6))
