"""Visually identical text with different characters: one consistent form.

A longest-match transducer over grapheme clusters, compiled into one table. Its keys are single characters (compatibility
forms, widths, spaces, hyphens, invisible characters) and sequences (a letter with its marks in every order, half-width
letters with sound marks, jamo, look-alike letters with marks), each in a context: none, or the script that the word
settles. Invisible characters loop within a key, so `e`, zero-width joiner, acute is one match. A mark that does not stand
next to its letter is matched over the marks between, as UTS #10 S2.1 matches discontiguous sequences. The table is checked
for conflicts: one output a key, and no output that the transducer changes again.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter, side by side.
LOOKALIKES = {
    "Cyrillic": ("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһԛԝѵ", "ABEKMHOPCTYXIJSaeopcyxijsdhqwv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυϳ", "ABEZHIKMNOPTYXaikvopuj"),
    "Armenian": ("ՕՍօսհո", "OUouhn"),
}
# Hyphens that look like the plain one.
HYPHENS = "‐‑‒⁃−﹣－˗"
_KEPT_CONTROLS = "\t\n\r"


def _invisible(ch: str) -> bool:
    code = ord(ch)
    return unicodedata.category(ch) in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def _one(ch: str) -> str:
    """Output of a single character by the layers in order: spaces, invisible, hyphens, compatibility; closed under itself."""
    if ch in _KEPT_CONTROLS or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    if _invisible(ch):
        return ""
    if ch in HYPHENS:
        return "-"
    out = unicodedata.normalize("NFKC", ch)
    return out if out == ch else "".join(_one(x) for x in out)


class ConflictError(ValueError):
    pass


class Transducer:
    """Trie over code points, one root a context; the longest key that matches at a place gives the output. A context falls
    back on the keys without one, which its root holds too. Characters of `loops` may stand anywhere within a key."""

    def __init__(self, pairs: dict[str, str], contexts: dict[str, dict[str, str]] | None = None, loops: frozenset = frozenset()):
        self.loops, self.roots = loops, {}
        for context, own in {"": {}, **(contexts or {})}.items():
            merged = {**pairs, **own}
            root = self.roots[context] = {}
            for key, out in merged.items():
                node = root
                for ch in key:
                    node = node.setdefault(ch, {})
                node[""] = out
        for context, own in {"": pairs, **(contexts or {})}.items():
            for key, out in own.items():
                if self.apply(out, context) != out:
                    raise ConflictError(f"the output of {key!r} holds a key")

    def match(self, text: str, i: int, root: dict) -> tuple[int, str] | None:
        node, found = root, None
        while i < len(text):
            step = node.get(text[i])
            if step is None:
                if node is root or text[i] not in self.loops:
                    break
                i += 1
                continue
            node, i = step, i + 1
            if "" in node:
                found = (i, node[""])
        return found

    def apply(self, text: str, context: str = "") -> str:
        root, out, i = self.roots[context], "", 0
        while i < len(text):
            if _is_mark(text[i]):
                hit = (i, "")
            else:
                hit = self.match(text, i, root) or (i + 1, text[i])
            piece, i = hit[1], hit[0]
            if i < len(text) and (piece or hit[0] < len(text)) and (_is_mark(text[i]) or (piece and text[i] in self.loops)):
                piece, i = self._marks(piece, text, i, root)
            # a syllable may be made of two outputs
            if out and piece and (joined := self._key(root, out[-1] + piece[0])) is not None and not _is_mark(piece[0]):
                out, piece = out[:-1] + joined, piece[1:]
            out += piece
        return out

    def _key(self, root: dict, pair: str) -> str | None:
        return root.get(pair[0], {}).get(pair[1], {}).get("")

    def _marks(self, piece: str, text: str, i: int, root: dict) -> tuple[str, int]:
        """The marks that follow, in canonical order, joined to the letter one after another where a key says so; a mark is
        blocked by one before it that was left over and has the same class (UTS #10 S2.1.1 to S2.1.3)."""
        marks = []
        while i < len(text) and (_is_mark(text[i]) or text[i] in self.loops):
            one = root.get(text[i], {}).get("", text[i])
            marks += [c for x in one for c in unicodedata.normalize("NFD", x)]
            i += 1
        if not piece:
            return "".join(sorted(marks, key=unicodedata.combining)), i
        # the letter comes apart as well, for a mark may belong below one that it already holds
        at = len(piece) - 1
        while at and _is_mark(piece[at]):
            at -= 1
        letter = unicodedata.normalize("NFD", piece[at:])
        if any(unicodedata.combining(m) == 0 for m in letter[1:]):  # a syllable, which takes no mark in
            letter = piece[at:]
        marks = sorted([*letter[1:], *marks], key=unicodedata.combining)
        own = letter = letter[0]
        rest, last = [], 0
        for m in marks:
            joined = self._key(root, letter + m) if unicodedata.combining(m) > last or not rest else None
            if joined is not None and len(joined) == 1:
                letter = joined
            else:
                rest.append(m)
                last = unicodedata.combining(m)
        if letter == own:
            letter = root.get(own, {}).get("", own)
        return piece[:at] + letter + "".join(rest), i


@functools.lru_cache(4_000)
def _is_mark(ch: str) -> bool:
    return unicodedata.combining((_one(ch) or " ")[0]) != 0


def _put(keys: dict[str, str], key: str, out: str) -> None:
    if keys.setdefault(key, out) != out:
        raise ConflictError(f"two outputs for {key!r}")


def _sequences() -> dict[str, str]:
    """Multi-character keys by rule: each composed character from its full and partial decompositions, and a plain letter
    with each half-width sound mark."""
    out: dict[str, str] = {}
    for code in range(0xC0, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pair = "".join(chr(int(x, 16)) for x in parts.split())
            full = unicodedata.normalize("NFD", ch)
            for key in {pair, full, *(full[0] + "".join(p) for p in itertools.permutations(full[1:]) if unicodedata.normalize("NFC", full[0] + "".join(p)) == ch)}:
                _put(out, key, _one(ch))
    for code in range(0xFF66, 0xFF9E):
        for mark in "\uff9e\uff9f":
            both = unicodedata.normalize("NFKC", chr(code) + mark)
            if len(both) == 1:
                _put(out, chr(code) + mark, both)
    # jamo: a syllable of two or three, by the rule of the standard
    for lead in range(19):
        for vowel in range(21):
            two = chr(0xAC00 + (lead * 21 + vowel) * 28)
            _put(out, chr(0x1100 + lead) + chr(0x1161 + vowel), two)
            for tail in range(1, 28):
                three, last = chr(ord(two) + tail), chr(0x11A7 + tail)
                _put(out, two + last, three)
                _put(out, chr(0x1100 + lead) + chr(0x1161 + vowel) + last, three)
    return out


def _lookalike_keys(source: dict[str, str], sequences: dict[str, str], single: dict[str, str]) -> dict[str, str]:
    """Keys of one context: look-alike letters of other scripts, alone and with the marks their partner takes. A composed
    letter whose base is a look-alike is one, too, and so is a compatibility form of one."""
    out = dict(source)
    for ch, plain in single.items():
        if any(x in source for x in plain):
            _put(out, ch, "".join(source.get(x, x) for x in plain))
    for key, ch in sequences.items():
        if len(key) >= 2 and key[0].isascii():
            for a, b in source.items():
                if b == key[0]:
                    _put(out, a + key[1:], ch)
    for key, ch in sequences.items():
        if key[0] in source and len(key) == 2:
            whole = unicodedata.normalize("NFC", source[key[0]] + key[1:])
            # a letter that its partner's script does not have with this mark is no look-alike
            _put(out, key, whole if len(whole) == 1 else ch)
            if len(whole) == 1:
                _put(out, ch, whole)
    return out


@functools.cache
def transducer() -> Transducer:
    pairs = {}
    for code in range(0, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0x20 <= code < 0x7F:
            continue
        ch = chr(code)
        out = _one(ch)
        if out != ch:
            pairs[ch] = out
    loops = frozenset(c for c, out in pairs.items() if not out)
    seq = _sequences()
    single = {s: dict(zip(*t)) for s, t in LOOKALIKES.items()}
    to_latin = {a: b for t in single.values() for a, b in t.items()}
    contexts = {"Latin": _lookalike_keys(to_latin, seq, pairs)}
    for s, t in single.items():
        back: dict[str, str] = {}
        for a, b in t.items():
            back.setdefault(b, a)
        contexts[s] = _lookalike_keys(back, seq, pairs)
    return Transducer({**seq, **pairs}, contexts, loops)


# what may stand within a cluster beside its letters and marks: invisible characters, of which some part clusters otherwise
_INNER = r"\p{M}\p{Cf}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u115f\u1160\u3164\uffa0\uff9e\uff9f"
_FRACTIONS = r"\xbc-\xbe\u2150-\u215f\u2189"  # their output parts a word
_WORD = regex.compile(rf"(?![\uff9e\uff9f{_FRACTIONS}])[\p{{L}}\p{{N}}](?:(?![{_FRACTIONS}])[\p{{L}}\p{{N}}{_INNER}])*")
_CLUSTER = regex.compile(rf"\X[{_INNER}\u1161-\u1175\u11a8-\u11c2]*")
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", *LOOKALIKES)}


@functools.lru_cache(20_000)
def _script(ch: str) -> tuple[str, bool]:
    """Script of the letter in a character's output, marks aside, and whether only that script can be meant."""
    out = unicodedata.normalize("NFD", _one(ch))[:1]
    s = next((s for s, p in _SCRIPT.items() if out and p.match(out)), "")
    if s == "Latin":
        return s, not any(out in t[1] for t in LOOKALIKES.values())
    return (s, out not in LOOKALIKES[s][0]) if s else (s, False)


@functools.lru_cache(20_000)
def _context(w: str) -> str:
    """The script that the letters of a word settle where they are of several; none else. Letters that no other script can
    stand for settle it; else the larger number, Latin first."""
    count, firm = Counter(), Counter()
    for ch in w:
        s, own = _script(ch)
        if s:
            count[s] += 1
            firm[s] += own
    if len(count) < 2:
        return ""
    other = max((s for s in count if s != "Latin"), key=lambda s: (firm[s], count[s]))
    if "Latin" not in count:
        return ""
    return "Latin" if firm["Latin"] >= firm[other] and (firm["Latin"] or not firm[other]) else other


@functools.lru_cache(20_000)
def _run(clusters: str, context: str) -> str:
    return transducer().apply(clusters, context)


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; None stays None, an empty text stays empty. One pass: every cluster goes through the
    table once, in the context of its word."""
    if text is None:
        return None
    if not _suspect().search(text):
        return text
    out, at = [], 0
    for m in _WORD.finditer(text):
        out += _clusters(text[at : m.start()], "")
        w = m[0]
        out += [w] if w.isascii() else _clusters(w, _context(w) if len(w) <= 200 else _context.__wrapped__(w))
        at = m.end()
    out += _clusters(text[at:], "")
    return "".join(out)


def _clusters(part: str, context: str) -> list[str]:
    inert = lambda c: c.isascii() and c.isprintable() and context in ("", "Latin")
    return [part] if inert(part) else [c if inert(c) else _run(c, context) for c in _CLUSTER.findall(part)]


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore").astype(object).where(s.notna(), None)


@functools.cache
def _inert_ranges() -> list[tuple[int, int]]:
    """Ranges, by rule, of what can never change: printable ASCII, Latin letters and symbols that map to themselves."""
    keep = [*range(0x20, 0x7F), *(c for c in (*range(0xA1, 0x250), *range(0x2600, 0x2700)) if _one(chr(c)) == chr(c) and unicodedata.category(chr(c))[0] in "LSP")]
    out: list[list[int]] = []
    for c in keep:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [tuple(r) for r in out]


@functools.cache
def _inert_class() -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _inert_ranges())


@functools.cache
def _suspect():
    return re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _inert_ranges()) + "]")


def suspicious(c: Column) -> Column:
    """Whether a text holds anything but inert characters; only those go to Python."""
    return c.rlike(f"[^{_inert_class()}]")


def consistent(c: Column) -> Column:
    """The consistent form as a column: the transducer runs on suspicious texts only."""
    return F.coalesce(canonical_udf(F.when(suspicious(c), c)), c)


def consistent_fields(df: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    """key, field, form, changed for each non-null field. Nulls give no row; empty texts stay empty and unchanged; repeated
    rows come out as often as they went in; texts of any length are processed whole."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    long = df.select(key, F.inline(cells)).where(F.col("v").isNotNull())
    return long.withColumn("form", consistent(F.col("v"))).select(key, "field", "form", (F.col("form") != F.col("v")).alias("changed"))


def changed_fields(df: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    """key, field of the texts that differ from their consistent form; inert texts are settled in the JVM."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    long = df.select(key, F.inline(cells)).where(suspicious(F.col("v")))
    return long.where(canonical_udf("v") != F.col("v")).select(key, "field")
