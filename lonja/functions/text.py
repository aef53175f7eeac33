"""Text normalisers as native column expressions; three differ on purpose and must not be merged."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """By rule from the Unicode data: characters whose compatibility decomposition leaves one ASCII character (two strings
    side by side), and those that leave several (ligatures, numerals, squared units)."""
    src, dst, many = [], [], {}
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3 or 0x4E00 <= code <= 0x9FFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(code))
            dst.append(plain)
        elif len(plain) > 1 and plain.isalnum() and (0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06 or 0x3371 <= code <= 0x33FF or code in (0xC6, 0x132, 0x133, 0x1C4, 0x2116, 0x2121, 0x2122)):
            many[chr(code)] = plain
    return "".join(src), "".join(dst), many


def _wide_table() -> tuple[str, str]:
    """Full-width forms to ASCII, then the invisible characters, which translate() drops as they have no partner."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　   "
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + "    "
    gone = "­​‌‍⁠﻿‎‏"
    return wide + gone, plain


#: Where the characters lie that decompose into several; ranges keep the pattern short.
_SPREADING = "[\u00c6\u0132\u0133\u01c4\u2116\u2121\u2122\u2160-\u217f\u3371-\u33ff\ufb00-\ufb06]"
LATIN, PLAIN, MANY = _decomposed()
WIDE, NARROW = _wide_table()


def fold_wide(c: Column) -> Column:
    """Full-width forms and odd spaces to ASCII, invisible characters dropped."""
    return F.translate(c, WIDE, NARROW)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without what is not ASCII in it; other characters stay. Texts that hold a character
    which decomposes into several take the longer way, plain ASCII none."""
    many = F.create_map(*[F.lit(x) for kv in MANY.items() for x in kv])
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(many[x], x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(F.when(c.rlike(_SPREADING), spread).otherwise(c), LATIN, PLAIN)).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Accents folded, what is still not ASCII deleted, lower case, runs of others to `_`; null or empty gives `na`."""
    t = F.regexp_replace(strip_accents(c), r"[^\x00-\x7F]", "")
    t = F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.when(t != "", t), F.lit("na"))


def normal_word(s: str) -> str:
    """normalize_text of one text on the driver."""
    plain = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "_", plain).strip("_") or "na"


def normalize_official(c: Column) -> Column:
    """Official-register form: accents dropped, case folded, tokens joined by one space, `320 d` joined to `320d`."""
    t = F.lower(strip_accents(c))
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.regexp_replace(t, r"\b(\d+)\s+([a-z])\b", "$1$2")


def normalize_body(c: Column) -> Column:
    """Body-type form: only hyphen and slash become blanks, other characters stay."""
    t = F.lower(F.trim(strip_accents(F.coalesce(c, F.lit("")))))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[-/]", " "), r"\s+", " "))


def contains_tokens(haystack: Column, needle: Column) -> Column:
    """Whole-token containment of a normalised needle, which may have several tokens."""
    bar = F.lit("_")
    return F.position(F.concat(bar, needle, bar), F.concat(bar, haystack, bar)) > 0
