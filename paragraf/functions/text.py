"""String expressions: white space as Unicode has it, node tokens, path parts, first non-blank values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: For str.strip: the same characters in Python.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use has it. For costly values in nested conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column | str) -> Column:
    """Trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def non_blank(c: Column | str) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def first_non_blank(*values: Column | str) -> Column:
    """The first value that isn't blank, trimmed, else the empty string."""
    return F.coalesce(*[non_blank(v) for v in values], F.lit(""))


def node_token(c: Column | str) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def path_part(c: Column | str) -> Column:
    """Safe as part of a file name: others than letters, digits, . _ - become _; blank becomes unknown."""
    safe = F.regexp_replace(F.regexp_replace(trimmed(c), "[^a-zA-Z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(safe == "", "unknown").otherwise(F.coalesce(safe, F.lit("unknown")))


def cut_bytes(c: Column | str, limit: int) -> Column:
    """At most limit bytes of UTF-8, not splitting a character, trimmed if anything was cut."""
    raw = F.encode(c, "UTF-8")
    cut = F.regexp_replace(F.decode(F.substring(raw, 1, limit), "UTF-8"), "\\x{FFFD}+$", "")
    return F.when(F.octet_length(c) <= limit, c).otherwise(trimmed(cut))


def distinct_by(values: Column, key) -> Column:
    """The array's first value for each key, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def split_list(c: Column | str) -> Column:
    """The non-blank parts between commas, semicolons and bars, once each, letter case aside."""
    parts = F.filter(F.transform(F.split(c, "[,;|]"), lambda x: trimmed(x)), lambda x: x != "")
    return distinct_by(parts, lambda x: F.lower(x))


def known(c: Column | str, values: tuple[str, ...]) -> Column:
    """Lower-cased and trimmed if among values, else unknown."""
    low = F.lower(trimmed(c))
    return F.when(low.isin(*values), low).otherwise("unknown")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
