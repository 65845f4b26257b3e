"""Wildcard patterns, compiled when the query is planned.

``*`` stands for any characters, ``?`` for one; there is no escape for either. A pattern
may match anywhere in a value. It is normalized like the documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trigrove.functions.text import normalize, trigrams


class PatternTooWeak(ValueError):
    """No literal run of at least three characters: every document would be a candidate."""


@dataclass(frozen=True)
class Pattern:
    text: str
    runs: tuple[str, ...]
    grams: tuple[str, ...]

    @property
    def linear_regex(self) -> str:
        """For Java: whether the pattern occurs. Parts between stars are found one after the other, each at its
        first place; groups are atomic, so a value is read once whatever it holds."""
        parts = [p for p in self.text.split("*") if p]
        body = ["(?>.*?" + "".join("." if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c) for c in p) + ")" for p in parts]
        return r"(?s)\A" + "".join(body)

    @property
    def regex(self) -> str:
        """For Java: matches over line ends and in any case."""
        return "(?siu)" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.^$|()[]{}+-&#~" else c) for c in self.text)

    @property
    def needle(self) -> str:
        """The longest literal run by bytes, the first of equals."""
        return max(self.runs, key=lambda r: len(r.encode()), default="")

    def matches(self, value: Column) -> Column:
        """Whether a normalized value matches. Literal runs are looked for first, since that costs least."""
        guards = [value.contains(r) for r in dict.fromkeys(self.runs)]
        if "?" in self.text or len(self.runs) != 1:
            guards.append(value.rlike(self.linear_regex))
        return reduce(lambda a, b: a & b, guards)

    def candidate(self, value: Column, mode: str = "and") -> Column:
        """Whether a normalized value holds all (and), any (or) or none (not) of the required trigrams."""
        parts = [value.contains(g) for g in self.grams]
        if not parts:
            return F.lit(True)
        if mode == "and":
            return reduce(lambda a, b: a & b, parts)
        any_of = reduce(lambda a, b: a | b, parts)
        if mode == "or":
            return any_of
        if mode == "not":
            return ~any_of
        raise ValueError(f"mode is and, or or not, not {mode!r}")


def compile_pattern(wildcard: str, allow_weak: bool = False) -> Pattern:
    """Raises PatternTooWeak without a literal run of three characters, unless weak patterns are allowed (a full scan)."""
    text = normalize(wildcard)
    runs = tuple(r for r in re.split(r"[*?]+", text) if r)
    grams = tuple(dict.fromkeys(g for r in runs for g in trigrams(r)))
    if not grams and not allow_weak:
        raise PatternTooWeak(f"{wildcard!r} has no literal run of three characters")
    return Pattern(text, runs, grams)
