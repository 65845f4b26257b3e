"""Previews as column expressions: plain truncation, or a snippet with the match in brackets. Lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trigrove.functions.pattern import Pattern

CUT = "…"
PREFERRED = ("text.title", "text.body", "title", "body")


def truncated(value: Column, most: int = 180) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit(CUT))).otherwise(value)


def bracketed(value: Column, start: Column, size: Column, most: int = 180) -> Column:
    """The match at ``start`` (from 1) of ``size`` characters in brackets, with as much context on
    either side as fits ``most``; at most ``most`` + 4 characters before the final ellipsis."""
    context = F.floor(F.greatest(F.lit(0), F.lit(most) - (size + 2)) / 2).cast("int")
    lo = F.greatest(F.lit(1), start - context)
    hi = F.least(F.length(value), start + size - 1 + context)
    text = F.concat(
        F.when(lo > 1, F.lit(CUT)).otherwise(F.lit("")),
        F.substr(value, lo, start - lo),
        F.lit("["),
        F.substr(value, start, size),
        F.lit("]"),
        F.substr(value, start + size, hi - start - size + 1),
        F.when(hi < F.length(value), F.lit(CUT)).otherwise(F.lit("")),
    )
    return F.when(F.length(text) > most + 4, F.concat(F.substring(text, 1, most + 4), F.lit(CUT))).otherwise(text)


def literal_preview(value: Column, needle: str, most: int = 180) -> Column:
    """Brackets around the needle, else around its longest prefix of three characters or more that occurs, else truncated."""
    if len(needle) < 3:
        return truncated(value, most)
    # the longest prefix that occurs, found by one expression whatever the needle's length
    size = F.array_max(F.filter(F.sequence(F.lit(3), F.lit(len(needle))), lambda n: F.contains(value, F.substr(F.lit(needle), F.lit(1), n))))
    size = F.when(value.contains(needle), F.lit(len(needle))).otherwise(size)
    found = F.substr(F.lit(needle), F.lit(1), size)
    return F.when(size.isNotNull(), bracketed(value, F.position(found, value), size, most)).otherwise(truncated(value, most))


def span_preview(value: Column, pattern: Pattern, most: int = 180) -> Column:
    """Brackets around the leftmost match; stars are greedy, so *x* covers the whole value."""
    found = F.regexp_extract(value, pattern.regex, 0)
    return F.when(F.length(found) > 0, bracketed(value, F.instr(value, found), F.length(found), most)).otherwise(truncated(value, most))


def preview(value: Column, pattern: Pattern, mode: str = "literal", most: int = 180) -> Column:
    if mode == "plain":
        return truncated(value, most)
    if mode == "literal":
        return literal_preview(value, pattern.needle, most)
    if mode == "span":
        return span_preview(value, pattern, most)
    raise ValueError(f"mode is literal, span or plain, not {mode!r}")


def label_field(fields: Column, wanted: str | None = None, preferred: tuple[str, ...] = PREFERRED) -> Column:
    """The field that a preview is of: the wanted one, else the first preferred one that is not empty, else the first by path."""
    order = ([wanted] if wanted else []) + list(preferred)
    choices = [F.when(F.coalesce(fields[p], F.lit("")) != "", F.lit(p)) for p in order]
    return F.coalesce(*choices, F.array_min(F.map_keys(fields)))
