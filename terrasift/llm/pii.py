"""Personal data in texts: email and IP addresses, card and phone numbers, plain or disguised.

Plain ones are found in the text as it is. Then three transducers rewrite the text one after the other, each keeping where
its output comes from: characters that look like ASCII ones (and invisible ones, which go), numbers spelled in words or with
letters for digits, and the disguises of ``@`` and ``.``. The same detectors read what comes out, and what they find there
is mapped back to characters of the source. A disguise is rewritten only where what stands beside it fits, so that ``at``,
``dot`` and ``one`` stay words elsewhere.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.store import small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = {c: None for c in map(ord, "+ ().-")}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def detect(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of plain identifiers: leftmost matches that don't overlap, those that fail their test left out.

    Every character is read a bounded number of times, however long a run of digits or letters is.
    """
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, end)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(_NO_DIGIT)
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_NO_DIGIT)) <= 15]
    return found


class Rewrite:
    """A transducer's output over a text: edits (start, end, new), in order and apart, and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, size, shift = [], 0, 0, 0
        self.ends, self.regions = [], []
        for start, end, new in edits:
            parts += [text[at:start], new]
            size += start - at + len(new)
            shift += end - start - len(new)
            self.ends.append(size)
            self.regions.append((size - len(new), start, end, shift))
            at = end
        self.text = "".join(parts) + text[at:]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Where output [start, end) comes from: a region that it reaches into counts as a whole."""
        return self._back(start)[0], self._back(end - 1)[1]

    def _back(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.ends, at)
        if k < len(self.ends) and at >= self.regions[k][0]:
            return self.regions[k][1:3]
        shift = self.regions[k - 1][3] if k else 0
        return at + shift, at + shift + 1

    def touches(self, start: int, end: int) -> bool:
        """Whether the output in [start, end) has been edited; a deletion at its ends doesn't count."""
        k = bisect_right(self.ends, start)
        return k < len(self.ends) and self.regions[k][0] < end


#: Letters of other scripts that look like ASCII ones.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "·": ".", "•": ".",
}


@cache
def _characters() -> dict[int, str]:
    """Characters to the ASCII character that they stand for: by compatibility (wide, mathematical, raised forms), decimal
    digits of any script, look-alikes."""
    table = {}
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " <= plain <= "~":
            table[code] = plain
        elif unicodedata.category(c) == "Nd":
            table[code] = str(unicodedata.decimal(c))
    return table | {ord(k): v for k, v in _LOOK_ALIKE.items()}


#: Format characters (soft hyphens, joiners, marks of direction), blank fillers and variation selectors.
_INVISIBLE = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cf") + "\u115f\u1160\u17b4\u17b5\u3164\ufe00-\ufe0f]+")


def plain_characters(text: str) -> Rewrite | None:
    """First transducer: one ASCII character for each that looks like it, nothing for invisible ones."""
    if text.isascii():
        return None
    table = _characters()
    odd = {ord(c) for c in set(text) if ord(c) in table}
    gone = _INVISIBLE.search(text) is not None
    if not odd and not gone:
        return None
    chars = re.compile("[" + "".join(map(re.escape, map(chr, odd))) + "]") if odd else None
    edits = [(m.start(), m.end(), table[ord(m[0])]) for m in chars.finditer(text)] if chars else []
    if gone:
        edits = sorted([*edits, *((*m.span(), "") for m in _INVISIBLE.finditer(text))])
    return Rewrite(text, edits)


#: Names of the digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Names of the dot and of the at sign.
DOTS, ATS = ("dot", "punkt", "point", "punto"), ("at", "arobase", "arroba", "klammeraffe")
_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}
_OPEN, _CLOSE = r"[\[({<][ \t]?", r"[ \t]?[\])}>]"
_BOXED_DOT = rf"{_OPEN}(?:\.|{'|'.join(DOTS)}){_CLOSE}"
_NAMED = rf"(?<![^\W\d_])(?:{'|'.join(sorted(DIGITS, key=len, reverse=True))})(?![^\W\d_])"
_TOKEN = re.compile(
    rf"(?P<word>{_NAMED})|(?P<number>(?<![^\W_])[OoIl|]{{0,3}}[0-9][0-9OoIl|]*+(?![^\W\d_]))|(?P<dot>{_BOXED_DOT}|(?<![^\W\d_])(?:{'|'.join(DOTS)})(?![^\W\d_])|&#46;|&period;)|(?P<plus>\+|(?<![^\W\d_])plus(?![^\W\d_]))",
    re.I,
)
_NAMES, _DOT_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True)), "|".join(DOTS)
#: Of a text in lower case: where none of these stands, no number is disguised. A name of a digit or a plus before another
#: digit or a dot; a digit before a name, a named or boxed dot, or letters for digits; these before a digit.
_NUMBER_HINTS = (
    re.compile(rf"(?:{_NAMES}|plus)(?![^\W\d_])[\s,()/+\[\]{{}}<>.-]{{0,4}}(?:(?:{_NAMES}|{_DOT_NAMES})(?![^\W\d_])|[0-9]|&)"),
    re.compile(rf"[0-9](?:[\s,()/-]{{0,4}}(?:{_NAMES})(?![^\W\d_])|[ \t]{{0,2}}(?:{_BOXED_DOT}|[ \t](?:{_DOT_NAMES})[ \t]|&#46;|&period;)|[ -]?[oil|][0-9oil| -])"),
)


def _hint(text: str) -> bool:
    low = text.lower()
    return _NUMBER_HINTS[1].search(low) is not None or any(not low[m.start() - 1 : m.start()].isalpha() for m in _NUMBER_HINTS[0].finditer(low))


_GAP = re.compile(r"[\s,()/-]{0,3}")
_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}(?:[ \t]{0,2}[._/,:*\t ][ \t]{0,2}[0-9]{4}){3}(?![0-9])")


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    chain: list[tuple[int, int, str, bool, str]] = []

    def flush() -> None:
        # Dots and plus signs count only between or before digits.
        while chain and chain[-1][2] in ".+":
            chain.pop()
        del chain[: next((k for k, c in enumerate(chain) if c[2] != "."), 0)]
        # A lone name beside a number that is whole without it is a word of the text.
        for lone, rest, gap in ((chain[-1:], chain[:-1], chain[-2:]), (chain[:1], chain[1:], chain[:2])):
            if len(chain) > 1 and lone[0][4] == "word" and gap[0 if lone == chain[-1:] else 1][4] == "number" and text[gap[0][1] : gap[1][0]].isspace():
                if sum(len(c[2]) for c in rest if c[2] not in ".+") >= (8 if rest[0][2] == "+" else 16):
                    chain.remove(lone[0])
        if sum(len(c[2]) for c in chain if c[2] not in ".+") > 1 and any(c[3] for c in chain):
            for k, (start, end, new, disguised, _) in enumerate(chain):
                if k and start > (before := chain[k - 1][1]) and (disguised or chain[k - 1][3]):
                    edits.append((before, start, ""))
                if disguised:
                    edits.append((start, end, new))
        chain.clear()

    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            new, disguised = DIGITS[m[0].lower()], True
        elif kind == "number":
            new = "".join(_LETTERS.get(c, c) for c in m[0])
            disguised = new != m[0]
        else:
            new = "." if kind == "dot" else "+"
            disguised = m[0] != new
        if chain and not _GAP.fullmatch(text, chain[-1][1], m.start()):
            # A plain dot between numbers stands in an address.
            if text[chain[-1][1] : m.start()] == "." and chain[-1][2] != "+" and new not in ".+":
                chain.append((m.start() - 1, m.start(), ".", False, "dot"))
            else:
                flush()
        if new == "+" and chain:
            flush()
        chain.append((m.start(), m.end(), new, disguised, kind))
    flush()
    return edits


def plain_numbers(text: str) -> Rewrite | None:
    """Second transducer: digits for their names and for letters that stand between them, dots and plus signs beside digits
    for theirs, and hyphens in four groups of four digits."""
    edits = _spelled(text) if _hint(text) else []
    groups = []
    for m in _GROUPS.finditer(text):
        if any(e[0] < m.end() and e[1] > m.start() for e in edits) or _CARD.fullmatch(m[0]):
            continue
        at = [m.start() + x.start() for x in re.finditer("[0-9]{4}", m[0])]
        groups += [(a + 4, b, "-") for a, b in zip(at, at[1:], strict=False)]
    return Rewrite(text, sorted(edits + groups)) if edits or groups else None


#: Last labels of hosts that are taken for such where `at` or the dots are bare words.
_LAST = frozenset("com org net edu gov mil int info biz name io dev app de fr es uk eu ch nl pl ru cn jp br ca au se dk cz pt mx ar example test invalid local".split())
_BARE = r"[ \t_]{1,2}"
_AT = re.compile(
    rf"(?P<boxed>[ \t]{{0,2}}{_OPEN}(?:@|{'|'.join(ATS)}){_CLOSE}[ \t]{{0,2}}|[ \t]{{0,2}}(?:&#64;|&commat;|%40)[ \t]{{0,2}})|(?P<sign>[ \t]{{0,2}}@[ \t]{{0,2}})|{_BARE}(?P<bare>{'|'.join(ATS)}){_BARE}",
    re.I,
)
_DOT = re.compile(rf"(?P<boxed>[ \t]{{0,2}}{_BOXED_DOT}[ \t]{{0,2}}|&#46;|&period;)|{_BARE}(?P<bare>{'|'.join(DOTS)}){_BARE}|(?P<spaced>[ \t]{{1,2}}\.[ \t]{{1,2}})|(?P<plain>\.)", re.I)
_DOT_BEFORE = re.compile(rf"(?:[ \t]{{0,2}}{_BOXED_DOT}[ \t]{{0,2}}|&#46;|&period;|{_BARE}(?:{'|'.join(DOTS)}){_BARE})\Z", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
#: Dots that go with a bare at: words of one language.
_PAIRS = {"at": ("dot", "punkt"), "arobase": ("dot", "point"), "arroba": ("dot", "punto"), "klammeraffe": ("dot", "punkt")}


#: Of a text in lower case: where none of these stands (nor an @ or an entity), no address is disguised.
_SIGN_HINTS = (
    re.compile(rf"[\[({{<][ \t]?(?:{'|'.join(ATS)})[ \t]?[\])}}>]"),
    re.compile(rf"[ \t_](?:{'|'.join(ATS)})[ \t_]{{1,2}}[a-z0-9-]++(?:[ \t]{{0,2}}[\[({{<&]|[ \t_]{{1,2}}(?:{'|'.join(DOTS)})[ \t_]|\.[a-z0-9])"),
)


def _host(text: str, at: int, words: tuple[str, ...]):
    """The dots of the host that starts at a place: (start, end, kind), and its last label; the label may be a part of a word."""
    m, dots, label = _LABEL.match(text, at), [], ""
    while m:
        label, end = m[0], m.end()
        dot = _DOT.match(text, end)
        if not dot or dot.lastgroup == "bare" and dot["bare"].lower() not in words:
            break
        m = _LABEL.match(text, dot.end())
        if m:
            dots.append((*dot.span(), dot.lastgroup))
    return dots, label


def plain_signs(text: str) -> Rewrite | None:
    """Third transducer: ``@`` and ``.`` for their disguises between the parts of an address."""
    low, edits, done = text.lower(), [], 0
    if not any(x in low for x in ("@", "&#64;", "&commat;", "%40")) and not any(x.search(low) for x in _SIGN_HINTS):
        return None
    before_this = 0
    for m in _AT.finditer(text):
        kind, least, before_this = m.lastgroup, max(done, before_this), m.end()
        start = _local_start(text, m.start(), least)
        if start == m.start():
            continue
        dots, last = _host(text, m.end(), _PAIRS[m["bare"].lower()] if kind == "bare" else DOTS)
        named = any(k in ("bare", "spaced") for *_, k in dots)
        if not dots or kind == "sign" and m[0] == "@" and all(k == "plain" for *_, k in dots):
            continue
        hidden = any(k != "plain" for *_, k in dots)
        if (kind == "bare" or kind == "sign" and named) and last.lower() not in _LAST or kind == "bare" and any(k == "spaced" for *_, k in dots):
            continue
        # A bare `at` before a plain host is one only behind what looks like the name of a mailbox.
        if kind == "bare" and not hidden and not any(c in "0123456789._%+-" for c in text[start : m.start()].strip("._-")):
            continue
        # `name @ host.end`: a sign with space around needs a host of the same care.
        if kind == "sign" and m[0] != "@" and not hidden and last.lower() not in _LAST:
            continue
        before = []
        while (d := _DOT_BEFORE.search(text, max(least, start - 16), start)) and _local_start(text, d.start(), least) < d.start():
            before.append((*d.span(), "."))
            start = _local_start(text, d.start(), least)
        edits += [*reversed(before), (*m.span(), "@"), *((a, b, ".") for a, b, k in dots if k != "plain")]
        done = dots[-1][1]
    return Rewrite(text, [e for e in edits if text[e[0] : e[1]] != e[2]]) if edits else None


TRANSDUCERS = (plain_characters, plain_numbers, plain_signs)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain, disguised) identifiers of a text: (place in KINDS, start, end), in code points, sorted."""
    plain, tape, now = sorted(detect(text)), [], text
    for transducer in TRANSDUCERS:
        if (made := transducer(now)) is not None:
            tape.append(made)
            now = made.text
    more = set()
    for kind, start, end in detect(now) if tape else ():
        edited = False
        for made in reversed(tape):
            edited |= made.touches(start, end)
            start, end = made.back(start, end)
        if edited:
            more.add((kind, start, end))
    # What lies inside a plain one of its kind adds nothing.
    inside = lambda x, k: k > 0 and plain[k - 1][0] == x[0] and x[2] <= plain[k - 1][2]
    return plain, sorted(x for x in more if not inside(x, bisect_right(plain, (x[0], x[1], float("inf")))))


SPAN = "struct<kind: string, start: bigint, end: bigint, disguised: boolean>"


def find_pii(documents: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """documents with a further column `name`: an array of spans (kind, start, end, disguised) by kind as in KINDS, then start.

    Places count code points, end exclusive; disguised spans may overlap plain ones, of which none is dropped. Null and
    empty texts have none; texts of any length are read whole, repeated rows alike. All columns stay as they are, whatever
    their names (one named like the further one is replaced); an empty table gives an empty one. Rows stay where they are: nothing is shuffled.
    """
    small_batches(documents)
    kept = [c for c in documents.columns if c != name]
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept))
    rows = documents.select(others.alias("row"), F.col(f"`{text}`").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))

    def scan(batches):
        for batch in batches:
            spans = []
            for t in batch.column(1):
                plain, more = find(t.as_py() or "")
                every = sorted([*((*x, False) for x in plain), *((*x, True) for x in more)])
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "disguised": d} for k, a, b, d in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["row", "found"])

    out = rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, found array<{SPAN}>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("found").alias(name))


@F.pandas_udf(T.StringType())
def _masked(texts, spans):
    import pandas as pd

    out = []
    for t, own in zip(texts, spans, strict=True):
        parts, at = [], 0
        for s in sorted(own if own is not None else (), key=lambda s: (s["start"], -s["end"])):
            if s["end"] > at:
                parts += [t[at : s["start"]], f"<{s['kind'].upper()}>"] if s["start"] >= at else []
                at = s["end"]
        out.append(None if t is None else "".join(parts) + t[at:])
    return pd.Series(out, dtype=object)


def mask_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with every identifier, plain or disguised, replaced by its kind, as in ``<EMAIL>``; spans that overlap are one."""
    name = "pii"
    while name in documents.columns:
        name += "_"
    found = find_pii(documents, text, name)
    masked = _masked(F.col(f"`{text}`"), F.col(f"`{name}`")).alias(text)
    return found.select(*(masked if c == text else F.col(f"`{c}`") for c in documents.columns))
