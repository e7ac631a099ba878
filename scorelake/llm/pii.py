"""Personal data in texts: plain identifiers, and disguised ones found on a normalised text.

Transducers rewrite a text step by step (look-alike characters and invisible ones, spelled digits,
at and dot disguises) and keep, for every rewritten piece, the source characters it came from.
Identifiers found in the normalised text are mapped back to spans of the source. A span that
contains no rewritten piece says nothing new and is left to the plain search, whose spans always
stay; an added span may contain a plain span of its kind but not overlap one otherwise.

Null and empty texts have no spans. Texts are searched whole, row by row; repeated rows, extra
columns and empty tables need no special care. All scans are linear in the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import apart, sha256, table
from scorelake.llm.registry import register

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain identifiers; each kind on its own, leftmost, no overlaps."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, done := m.end()))
        # Without a match, what is left of this sign can't be part of a later local part anyway.
        at, done = text.find("@", max(at + 1, done)), max(done, at + 1)
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other scripts that look like a Latin letter or digit (fixed values).
LOOKS = dict(zip("аеорсухіјѕԁһӏкмтвнАЕОРСУХІЈЅКМТВНαονρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                 "aeopcyxijsdhlkmtbhAEOPCYXIJSKMTBHaovpiktuABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—−"
SPACES = "  -  　"
#: Ranges whose compatibility form or decimal value is plain ASCII: full width, mathematical, enclosed,
#: super- and subscript signs, and decimal digits of other scripts.
STRANGE = re.compile(
    "[" + "".join(LOOKS) + INVISIBLE + DASHES + SPACES +
    "²³¹٠-٩۰-۹०-९․⁰-ₜ①-⓿﹒﹫！-～。"
    "\U0001d400-\U0001d7ff]")


def _look(m: re.Match) -> str:
    c = m[0]
    if c in LOOKS:
        return LOOKS[c]
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c == "。":
        return "."
    d = unicodedata.decimal(c, None)
    s = str(d) if d is not None else unicodedata.normalize("NFKC", c)
    return s if s.isascii() else c


_DIGITS = {
    "zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_D = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_GAP = r"(?:[ \t]*[,-][ \t]*|[ \t\n]+)"
#: Two or more spelled digits in a row, perhaps doubled ("double seven").
SPELLED = re.compile(rf"(?i)\b(?:(?:double|triple)[ \t-]+)?{_D}(?:{_GAP}(?:(?:double|triple)[ \t-]+)?{_D})+\b")
#: A single one beside a digit, a written-out plus, or a dot between numbers.
BESIDE = re.compile(rf"(?i)(?<=[0-9])[ \t]*-?[ \t]*\b{_D}\b(?=[ \t-]*[0-9])")
#: A single spelled part of an address, between dots.
BETWEEN = re.compile(rf"(?i)\b{_D}\b(?=[ \t]*(?:\.|[\[({{]?\b(?:dot|punkt|punto|point)\b))|(?<=dot )\b{_D}\b")
PLUS = re.compile(r"(?i)\bplus[ \t]+(?=[0-9])")
GAPS = re.compile(r"(?<=[0-9])[ \t]*(?:[ \t]{2,}|,[ \t]*|[_/·][ \t]*|[ \t]+-[ \t]+)(?=[0-9])")

_AT = r"(?:at|arroba|arobase|a t)"
_DOT = r"(?:dot|punkt|punto|point|d o t)"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DOT_SIGN = rf"(?:[ \t]*{_OPEN}[ \t]*(?:{_DOT}|\.)[ \t]*{_SHUT}[ \t]*|[ \t]+{_DOT}[ \t]+|[ \t]*[_-]{_DOT}[_-][ \t]*)"
AT_MARKED = re.compile(rf"(?i)(?<=[a-z0-9_])[ \t]*(?:{_OPEN}[ \t]*(?:{_AT}|@)[ \t]*{_SHUT}|[_-]{_AT}[_-])[ \t]*(?=[a-z0-9])")
#: The bare word counts only before a domain that is disguised too: "see me at example.com" is prose.
AT_WORD = re.compile(rf"(?i)(?<=[a-z0-9_])[ \t]+{_AT}[ \t]+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*{_DOT_SIGN}[a-z0-9])")
AT_LOOSE = re.compile(r"(?<=[A-Za-z0-9_])(?:[ \t]+@[ \t]*|[ \t]*@[ \t]+)(?=[A-Za-z0-9-]+[ \t]*(?:\.|[\[({]|[ \t]dot))")
DOT_SIGN = re.compile(rf"(?i)(?<=[a-z0-9]){_DOT_SIGN}(?=[a-z0-9])")
DOT_LOOSE = re.compile(r"(?<=[A-Za-z0-9])[ \t]+\.[ \t]*(?=[a-z0-9])")

_HINTS = (
    # AT_MARKED, DOT_SIGN, and AT_WORD and BETWEEN, which need a disguised dot.
    rf"{_OPEN}[ \t]*(?:{_AT}|{_DOT}|@|\.)[ \t]*{_SHUT}", rf"[_-](?:{_AT}|{_DOT})[_-]", rf"[ \t]{_DOT}[ \t]",
    # SPELLED; BESIDE.
    rf"\b{_D}(?:{_GAP}(?:(?:double|triple)[ \t-]+)?{_D}|[ \t-]+[0-9])",
    # PLUS.
    r"plus[ \t]+[0-9]")
#: For ASCII texts in lower case, and for others.
HINTS = [re.compile(h) for h in _HINTS], [re.compile(f"(?i){h}") for h in _HINTS]


def suspicious(text: str) -> bool:
    """Cheap tests. Each rewriting pattern and each view implies one of them, so a text that passes none holds no disguise."""
    ascii_ = text.isascii()
    if not ascii_ and (STRANGE.search(text) or "·" in text):  # the dot: GAPS
        return True
    if "@" in text and re.search(r"[ \t][@.]|@[ \t]", text):  # AT_LOOSE; the view of DOT_LOOSE
        return True
    low = text.lower() if ascii_ else text
    return any(h.search(low) for h in HINTS[not ascii_])


def _low(text: str) -> str:
    """Lower case, as the patterns see it: they take these for an s and an i too."""
    return text.translate({0x17F: "s", 0x130: "i", 0x131: "i"}).lower()


def _spelled(m: re.Match) -> str:
    out, times = [], 1
    for w in re.findall(r"\w+", _low(m[0])):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out.append(_DIGITS[w] * times)
            times = 1
    return "".join(out)


def _digit(m: re.Match) -> str:
    return _DIGITS[re.search(r"\w+", _low(m[0]))[0]]


class Mapped:
    """A rewritten text. Piece k starts at ``at[k]`` and came from source ``lo[k]:hi[k]``;
    an untouched piece has as many characters as its source."""

    def __init__(self, text: str):
        self.text, self.at, self.lo, self.hi, self.new = text, [0], [0], [len(text)], [False]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a part of the text, and whether any of it was rewritten."""
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        lo = self.lo[a] if self.new[a] else self.lo[a] + start - self.at[a]
        hi = self.hi[b] if self.new[b] else self.lo[b] + end - self.at[b]
        return lo, hi, any(self.new[a:b + 1])

    def sub(self, pattern: re.Pattern, to) -> None:
        """Rewrite every match by ``to`` (a text, or a function of the match)."""
        parts, at, lo, hi, new, size, last = [], [], [], [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            k = bisect_right(self.at, a) - 1
            while a < b:
                stop = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                at.append(size)
                new.append(self.new[k])
                lo.append(self.lo[k] if self.new[k] else self.lo[k] + a - self.at[k])
                hi.append(self.hi[k] if self.new[k] else self.lo[k] + stop - self.at[k])
                parts.append(self.text[a:stop])
                size += stop - a
                a, k = stop, k + 1

        touched = False
        for m in pattern.finditer(self.text):
            with_ = to if isinstance(to, str) else to(m)
            if with_ == m[0]:
                continue
            touched = True
            keep(last, m.start())
            a, b, _ = self.source(m.start(), m.end())
            last = m.end()
            if with_:
                at.append(size)
                lo.append(a)
                hi.append(b)
                new.append(True)
                parts.append(with_)
                size += len(with_)
            elif at:  # a removed piece belongs to the one before it only if that goes on after it
                at.append(size)
                lo.append(a)
                hi.append(b)
                new.append(True)
        if touched:
            keep(last, len(self.text))
            self.text, self.at, self.lo, self.hi, self.new = "".join(parts), at, lo, hi, new


def normalise(text: str) -> Mapped:
    out = Mapped(text)
    out.sub(STRANGE, _look)
    out.sub(SPELLED, _spelled)
    out.sub(BESIDE, _digit)
    out.sub(AT_MARKED, "@")
    out.sub(AT_WORD, "@")
    out.sub(AT_LOOSE, "@")
    if re.search(r"(?i)[0-9]" + _DOT_SIGN, out.text):
        out.sub(BETWEEN, _digit)
    out.sub(DOT_SIGN, ".")
    out.sub(PLUS, "+")
    return out


def _believable(kind: int, found: str) -> bool:
    """Stricter than the plain search, as a rewritten text offers more chances."""
    if kind == 0:
        last = found.rsplit(".", 1)[1]
        return 2 <= len(last) <= 24 and last.isalpha()
    return True


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not suspicious(text):
        return []
    seen, out = normalise(text), []
    views = [seen]
    if re.search(r"@[^ \n]*[ \t]+\.", seen.text):
        loose = normalise(text)
        loose.sub(DOT_LOOSE, ".")
        views.append(loose)
    if GAPS.search(seen.text):
        spaced = normalise(text)
        spaced.sub(GAPS, " ")
        # A change of the gaps alone is no disguise; it must come with rewritten digits.
        views.append(spaced)
    plain_at = {(k, a, b) for a, k, b in base}
    for n, view in enumerate(views):
        for start, kind, end in plain(view.text):
            lo, hi, new = view.source(start, end)
            if not new or (kind, lo, hi) in plain_at or not _believable(kind, view.text[start:end]):
                continue
            if n and view is not views[0] and kind in (2, 3) and not _touched(text[lo:hi]):
                continue
            if any(k == kind and a < hi and lo < b and not (lo <= a and b <= hi) for a, k, b in base + out):
                continue
            if (lo, kind, hi) not in out and not any(k == kind and lo < b and a < hi for a, k, b in out):
                out.append((lo, kind, hi))
    return out


def _touched(source: str) -> bool:
    """Whether a source span holds letters or strange signs, not just digits and gaps."""
    return bool(re.search(r"[^\W\d_]", source)) or not source.isascii()


def spans(text: str | None) -> tuple[list, list]:
    """Plain spans, and all spans, each (start, kind, end) in order."""
    if not text:
        return [], []
    base = plain(text)
    return base, sorted(base + disguised(text, base))


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def mask(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with every span (overlapping ones joined) replaced by the kind's tag."""
    if not found:
        return text
    out, last = [], 0
    for a, k, b in sorted(found, key=lambda s: (s[0], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long, masked string"


def find(docs: DataFrame, text: str = "text", with_masked: bool = False) -> DataFrame:
    """``docs`` with counts and lists of spans, and the masked text if asked for."""
    added = [f.strip().split(" ") for f in FOUND.split(",")][:None if with_masked else -1]
    kept = [c for c in docs.columns if c not in {n for n, _ in added}]

    def run(batches):
        for batch in batches:
            cols = {n: [] for n, _ in added}
            for t in batch.column(text):
                t = t.as_py()
                base, every = spans(t)
                for k, n in enumerate(KINDS):
                    cols[f"n_{n}"].append(sum(s[1] == k for s in base))
                cols["base"].append(listed(base))
                cols["spans"].append(listed(every))
                cols["n_added"].append(len(every) - len(base))
                if with_masked:
                    cols["masked"].append(mask(t, every))
            rows = batch.select([n for n in kept if n != text or with_keep])
            for n, kind in added:
                rows = rows.append_column(n, pa.array(cols[n], pa.int64() if kind == "long" else pa.string()))
            yield rows
    with_keep = not with_masked
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = [n for n in kept if n != text or with_keep]
    return docs.select(*[F.col(f"`{n}`") for n in kept]).mapInArrow(
        run, ", ".join([f"`{n}` {types[n]}" for n in out] + [f"{n} {k}" for n, k in added]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@apart("doc_id", "text", "n_chars")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by tags; ``n_chars`` follows the new text."""
    found = find(docs, with_masked=True)
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


register("op1_pii", op1)
