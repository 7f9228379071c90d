"""Compatibility decomposition without marks, then case folding, as JVM expressions.

The tables are made from ``unicodedata`` by rule: characters that become one character or
none go by ``translate``, Hangul syllables by arithmetic, and the others, which become
several, by a map that is looked at only where a text holds one of them."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where Hangul syllables and their parts begin, and how many of each there are.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_LEADS, N_VOWELS, N_TAILS = 19, 21, 28
SEPARATOR = "\x01"


def folded(text: str) -> str:
    """The same of one text, in Python."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold()


@cache
def tables() -> tuple[str, str, str, tuple[str, ...], tuple[str, ...]]:
    """Characters that become one, what they become, those that vanish, those that become several, and what."""
    one, to, gone, several, parts = [], [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or SYLLABLES <= code < SYLLABLES + N_LEADS * N_VOWELS * N_TAILS:
            continue
        c = chr(code)
        if (f := folded(c)) == c:
            continue
        if len(f) == 1:
            one.append(c)
            to.append(f)
        elif f:
            several.append(c)
            parts.append(f)
        else:
            gone.append(c)
    return "".join(one), "".join(to), "".join(gone), tuple(several), tuple(parts)


@cache
def _ranges(characters: tuple[str, ...]) -> str:
    """A character class of a sorted list."""
    out, begin, last = [], None, None
    for code in [*map(ord, characters), None]:
        if begin is not None and code != last + 1:
            out.append(rf"\x{{{begin:x}}}-\x{{{last:x}}}")
            begin = None
        begin, last = (code if begin is None else begin), code
    return "".join(out)


def _jamo(c: Column) -> Column:
    """The parts of a Hangul syllable."""
    names = lambda first, n: F.split(F.lit(SEPARATOR.join(chr(first + i) for i in range(n))), SEPARATOR)
    at = F.ascii(c) - SYLLABLES
    lead, vowel, tail = F.floor(at / (N_VOWELS * N_TAILS)), F.floor(at % (N_VOWELS * N_TAILS) / N_TAILS), at % N_TAILS
    pick = lambda array, i: F.get(array, i.cast("int"))
    last = F.when(tail == 0, "").otherwise(pick(names(TAILS, N_TAILS), tail))
    return F.concat(pick(names(LEADS, N_LEADS), lead), pick(names(VOWELS, N_VOWELS), vowel), last)


def fold(text: Column) -> Column:
    """A text without compatibility forms, marks and case; ASCII texts are lower-cased alone."""
    one, to, gone, several, parts = tables()
    syllables = rf"\x{{{SYLLABLES:x}}}-\x{{{SYLLABLES + N_LEADS * N_VOWELS * N_TAILS - 1:x}}}"
    known = F.map_from_arrays(F.split(F.lit(SEPARATOR.join(several)), SEPARATOR), F.split(F.lit(SEPARATOR.join(parts)), SEPARATOR))
    # what becomes several goes first: its parts are folded already
    apart = lambda c: F.when(c.rlike(f"[{syllables}]"), _jamo(c)).when(c.rlike(f"[{_ranges(several)}]"), F.element_at(known, c)).otherwise(c)
    split = F.when(text.rlike(f"[{syllables}{_ranges(several)}]"), F.array_join(F.transform(F.split(text, ""), apart), "")).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(split, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + one + gone, "abcdefghijklmnopqrstuvwxyz" + to)).otherwise(F.lower(text))
