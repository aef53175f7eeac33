"""Reading vehicle descriptions: litres, power, drive words, gearbox, trim and model name out of free text."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field

from lonja.llm.canon_text import canonical
from lonja.llm.canonical_values import osa as _osa

# Public words for automatic and manual gearboxes, folded.
AUTOMATIC = {"aut", "aut.", "auto", "automatico", "automatica", "automatik", "automatic", "dct", "cvt", "7g", "dsg", "7-gang-dct", "automatikgetriebe"}
MANUAL = {"manual", "man.", "man", "schaltgetriebe", "handschaltung"}
#: The same words meet the same names again and again.
osa = functools.lru_cache(200_000)(_osa)
ROMAN = {"i", "ii", "iii", "iv", "v", "vi", "vii"}

_LITRE = re.compile(r"(\d[.,]\d)l?")
_CC = re.compile(r"(\d{3,4})cc(?:m)?")
_POWER = re.compile(r"(\d{2,3})(cv|ps|kw|hp)")
_SPLIT_UNIT = re.compile(r"\b(\d{2,4}) (cv|ps|kw|hp|ccm|cc)\b")
_SPLIT_GEARS = re.compile(r"\b([4-8]) (vel|velocidades|gang)\b")
_GEARS = re.compile(r"[4-8]-?(?:vel|velocidades|gang)\.?")
_DUAL = re.compile(r"\b(\d{2,3})(kw|ps|cv)\s*[/(]\s*(\d{2,3})(kw|ps|cv)\)?")
FACTOR = {"kw": 1.0, "cv": 0.735499, "ps": 0.735499, "hp": 0.735499}


class _Fold(dict):
    """Code point -> folded text, filled as characters occur: lower case, no accents, common letters spelt out."""

    SPELT = {"ß": "ss", "ø": "o", "æ": "ae", "ł": "l"}

    def __missing__(self, code: int) -> str:
        low = chr(code).lower()
        plain = self.SPELT.get(low) or "".join(ch for ch in unicodedata.normalize("NFKD", low) if not unicodedata.combining(ch))
        self[code] = plain
        return plain


_FOLD = _Fold()


def fold(text: str) -> str:
    """Consistent form, lower case, without accents."""
    return text.lower() if text.isascii() and text.isprintable() else canonical(text).translate(_FOLD)


def tokens(text: str | None) -> list[str]:
    """Folded words; a figure and its unit are one word, both halves of a double power figure are words of their own."""
    t = _SPLIT_GEARS.sub(r"\1\2", _SPLIT_UNIT.sub(r"\1\2", fold(text or "")))
    t = _DUAL.sub(r"\1\2 \3\4 ", t)
    return [w for w in (x.strip("|,;:()[]*!?¡®★/\"'") for x in re.split(r"[\s|,;]+(?!\d)|\s*[|/*]\s+|\s+", t)) if w]


@dataclass
class Lexicon:
    """Words learned from a structured column: drive words and trims; models by brand."""

    drive: dict[str, str] = field(default_factory=dict)
    trims: tuple[str, ...] = ()
    models: dict[str, list[str]] = field(default_factory=dict)
    seen: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}


@dataclass
class Reading:
    litres: float | None = None
    cc: int | None = None
    kw: float | None = None
    drive: str | None = None
    trim: str | None = None
    trim_sim: float = 0.0
    gear: str | None = None
    rest: list[str] = field(default_factory=list)


_letters = functools.lru_cache(100_000)(frozenset)


def may_lie_within(a: str, b: str, edits: int) -> bool:
    """Whether two words may be so many edits apart: each edit changes at most one letter on each side."""
    return abs(len(a) - len(b)) <= edits and len(_letters(a) ^ _letters(b)) <= 2 * edits


def trim_likeness(word: str, trim: str) -> float:
    """1 for the trim itself; .95 for its start with a full stop; else 1 less the share of edits, 0 beyond two."""
    if word == trim:
        return 1.0
    if word.endswith(".") and len(word) >= 4 and trim.startswith(word[:-1]):
        return 0.95
    w = word.strip(".")
    if abs(len(w) - len(trim)) > 2 or len(w) < 4:
        return 0.0
    most = 2 if len(trim) >= 7 else 1
    if not may_lie_within(w, trim, most):
        return 0.0
    d = osa(w, trim)
    return 1 - d / len(trim) if d <= most else 0.0


def classify(w: str, lex: Lexicon) -> tuple:
    """What one word is: (kind, value) with the likeness for a trim. Kept by word in the lexicon's cache."""
    if (hit := lex.seen.get(w)) is not None:
        return hit
    if m := _LITRE.fullmatch(w):
        out = ("litres", float(m[1].replace(",", ".")))
    elif m := _CC.fullmatch(w):
        out = ("cc", int(m[1]))
    elif m := _POWER.fullmatch(w):
        out = ("kw", int(m[1]) * FACTOR[m[2]])
    elif w in lex.drive:
        out = ("drive", w)
    elif w in AUTOMATIC:
        out = ("gear", "automatic")
    elif w in MANUAL or _GEARS.fullmatch(w):
        out = ("gear", "manual")
    else:
        s, t = max(((trim_likeness(w, t), t) for t in lex.trims), default=(0.0, None))
        near = [d for d in lex.drive if len(d) >= 4 and may_lie_within(w, d, 1) and osa(w, d) == 1] if s < 0.7 and len(w) >= 5 else []
        out = ("trim", t, s) if s >= 0.7 else ("near", near[0]) if near else ("rest", w)
    if len(lex.seen) > 50_000:
        lex.seen.clear()
    lex.seen[w] = out
    return out


def read(text: str | None, lex: Lexicon) -> Reading:
    """Each word is read once, as the first of: displacement, power, drive word, gearbox word, trim, misspelt drive word;
    others are the rest. The first word of a kind counts, for trims the likest."""
    r = Reading()
    for w in tokens(text):
        kind, value, *sim = classify(w, lex)
        if kind == "trim":
            if sim[0] > r.trim_sim:
                if r.trim:
                    r.rest.append(r.trim)
                r.trim, r.trim_sim = value, sim[0]
            else:
                r.rest.append(w)
        elif kind == "near":
            if r.drive is None:
                r.drive = value
            else:
                r.rest.append(w)
        elif kind == "rest":
            r.rest.append(w)
        elif getattr(r, kind) is None:
            setattr(r, kind, value)
    return r


def model_likeness(rest: list[str], model: str) -> float:
    """How well a model name stands in the words of a text: the mean likeness of its words, the first weighing double;
    less a fifth if a numeral follows that the name does not have."""
    name = model.split()
    sims, at = [], -1
    for k, part in enumerate(name):
        best, where = 0.0, -1
        for i, w in enumerate(rest):
            if w == part:
                best, where = 1.0, i
                break
            if k == 0 and len(part) >= 4 and abs(len(w) - len(part)) <= 2:
                most = 2 if len(part) >= 6 else 1
                d = osa(w, part) if may_lie_within(w, part, most) else most + 1
                s = 1 - d / len(part) if d <= most else 0.0
                if s > best:
                    best, where = s, i
        sims += [best] * (2 if k == 0 else 1)
        at = max(at, where)
    score = sum(sims) / len(sims)
    extra = rest[at + 1] if 0 <= at < len(rest) - 1 else ""
    if (extra in ROMAN or (extra.isdigit() and len(extra) == 1)) and extra not in name:
        score *= 0.8
    return score
