"""Personal data, also in disguise: plain detectors on the text, then on a normalised copy whose every character knows the source span it stands for.

Three transducers make the copy: look-alike letters and digits become ASCII and invisible characters go; 'at' and 'dot', bracketed or spelled out,
become '@' and '.'; runs of spelled digits become digits. What the detectors find in the copy is mapped back and added to the plain finds.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import others, spare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never starts inside digits, so none are read twice
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern local@domain finds them from the left: the local part runs back from each '@' with a fitting domain, at most to the last find."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost, non-overlapping matches of each kind; those that fail the kind's test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ո": "n", "ս": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "–": "-", "−": "-", "․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@", "＋": "+", "\u00a0": " ", "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# The ten digits as words.
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _table() -> dict[str, str]:
    """Look-alikes, and by rule decimal digits of any script and the letters whose compatibility form is one ASCII letter or digit."""
    table = dict.fromkeys(INVISIBLE, "")
    for code in [*range(0x80, 0x3000), *range(0xA000, 0xAC00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif kind in ("Ll", "Lu"):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                table[c] = plain
    return table | LOOKALIKES


HOMOGLYPHS = _table()
_GLYPHS = frozenset(HOMOGLYPHS)

_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_BRACKETED = re.compile(rf"(?i)(?<=[A-Z0-9._%+-])(?:{_OPEN}(?:(?P<at>at|@|arroba|arobase)|(?P<dot>dot|\.|punto|point|punkt)){_CLOSE})(?=[A-Z0-9])")
_WORDY = re.compile(r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+(?:[ \t]++dot[ \t]++[A-Z0-9_%+-]++){0,16}(?:[ \t]+(?:at|arroba|arobase|@)[ \t]+|@)[A-Z0-9-]+(?:(?:[ \t]+(?:dot|punto|point|punkt)[ \t]+|\.)[A-Z0-9-]+)+")
_PLAIN_HOST = re.compile(r"((?<![ \t])[ \t]++at[ \t]++)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)
_JOINT = re.compile(r"(?i)(?<![ \t])[ \t]++(?:(at|arroba|arobase|@)|dot|punto|point|punkt)[ \t]+")
# Words that follow a real 'at', so no host.
NO_HOST = {"the", "a", "an", "this", "that", "these", "those", "his", "her", "its", "their", "our", "my", "your", "each", "every", "any", "some", "one", "least", "most", "first", "last", "all"}
_DOT_WORD = re.compile(r"(?i)[ \t](?:dot|punto|point|punkt)[ \t]")
_SPELLED = re.compile(r"(?i)\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b")
_TOKEN = re.compile(r"(?i)\b(?:(zero|one|two|three|four|five|six|seven|eight|nine)|(plus)|(dot|point))\b|([0-9])|([+.])")
#: So many spelled digits make a run worth reading.
MIN_SPELLED = 4


class Aligned:
    """A text whose i-th character stands for source characters starts[i] up to ends[i]."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint, ordered ranges; each new character stands for the whole of what its range stood for."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a]), int(self.ends[b - 1])


def fold_glyphs(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, HOMOGLYPHS[c]) for i, c in enumerate(text) if c in _GLYPHS]


def fold_joints(text: str) -> list[tuple[int, int, str]]:
    """Edits for bracketed 'at' and 'dot', and for spelled ones within 'name at host dot domain'. A joint alone, as in 'look at it', is left."""
    edits = {m.span(): "@" if m["at"] else "." for m in _BRACKETED.finditer(text)}
    return [(a, b, c) for (a, b), c in sorted(edits.items())]


def fold_words(text: str, copy: Aligned | None = None) -> list[tuple[int, int, str]]:
    """Edits for matches with a dot that is spelled out, or was in brackets (`copy` knows)."""
    edits = []
    boxed = np.flatnonzero(copy.ends - copy.starts > 1) if copy is not None else ()
    if not len(boxed) and not _DOT_WORD.search(text):
        return edits
    for m in _WORDY.finditer(text):
        joints = [(m.start() + j.start(), m.start() + j.end(), "@" if j[1] else ".") for j in _JOINT.finditer(m[0])]
        if all(c == "@" for *_, c in joints) and not any(m.start() <= i < m.end() and text[i] == "." for i in boxed):
            continue
        if "@" in m[0] or any(c == "@" and text[b : m.end()].split(None, 1)[0].lower() not in NO_HOST for _, b, c in joints):
            edits += joints
    return edits


def fold_named_at(text: str) -> list[tuple[int, int, str]]:
    """Edits for a spelled 'at' before a host with real dots, if the name before it is no plain word, but has a digit, '_' or an inner '.'."""
    edits = []
    for m in _PLAIN_HOST.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if any(c.isdigit() or c in "._" for c in text[start : m.start()].strip(".%+-")):
            edits.append((m.start(), m.end(1), "@"))
    return edits


def fold_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits for runs with at least MIN_SPELLED spelled digits: words become digits, '+' and '.', and what stands between goes."""
    edits, run, spelled = [], [], 0
    if sum(1 for _ in islice(_SPELLED.finditer(text), MIN_SPELLED)) < MIN_SPELLED:
        return edits

    def close() -> None:
        nonlocal run, spelled
        while run and run[-1][2] in ".+":
            run.pop()
        if spelled >= MIN_SPELLED:
            for i, (a, b, new) in enumerate(run):
                if i and run[i - 1][1] < a:
                    edits.append((run[i - 1][1], a, ""))
                if text[a:b] != new:
                    edits.append((a, b, new))
        run, spelled = [], 0

    for m in _TOKEN.finditer(text):
        gap = text[run[-1][1] : m.start()] if run else ""
        if len(gap) > 3 or gap.strip(" \t,()-–"):
            close()
        word = m[1] or m[2] or m[3]
        new = DIGIT_WORDS[word.lower()] if m[1] else "+" if m[2] else "." if m[3] else m[0]
        if new == "+" and run:
            close()
        if new == "." and not run:
            continue
        run.append((m.start(), m.end(), new))
        spelled += bool(m[1])
    close()
    return edits


def normalise(text: str) -> Aligned | None:
    """The normalised copy, or None if no transducer has anything to do."""
    copy, touched = Aligned(text) if not text.isascii() and not _GLYPHS.isdisjoint(text) else None, False
    if copy is not None:
        copy.edit(fold_glyphs(text))
        touched = True
    now = copy.text if copy is not None else text
    for fold in (fold_joints, fold_words, fold_named_at, fold_digits):
        if edits := fold(now, copy) if fold is fold_words else fold(now):
            copy = copy or Aligned(text)
            copy.edit(edits)
            now, touched = copy.text, True
    return copy if touched else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain finds, finds that normalising adds), each by kind as in KINDS, then by start. An added span never overlaps a plain one of its kind."""
    if not text:
        return [], []
    base = detect(text)
    added: list[Span] = []
    copy = normalise(text)
    if copy is not None:
        for kind, spans in detect(copy.text).items():
            for a, b in spans:
                s, e = copy.source(a, b)
                if all(e <= x or s >= y for x, y in base[kind]):
                    added.append((kind, s, e))
    return [(k, a, b) for k in KINDS for a, b in base[k]], added


def render(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each group of overlapping spans replaced by '<KIND>' of the one that starts first (ties: the longest)."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


ADDED = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], *[T.StructField(k, T.StringType()) for k in ("base_spans", "spans", "redacted")]])


def find_pii(df: DataFrame, text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """Adds counts of the plain finds, `base_spans`, `spans` (plain and added, as kind:start:end in code points) and `redacted` (null unless asked for and changed).

    Null and empty texts have no spans. Whole texts are read; no shuffle. Columns of these names are replaced."""
    out = df.select(*others(df, ADDED.names), F.col(text_col).cast("string").alias(spare(df, "_text")))
    schema = T.StructType([*out.schema[:-1], *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                base, added = find(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, render(base), render([*base, *added]), redact(text, [*base, *added]) if with_redacted and (base or added) else None))
            types = (*[pa.int64()] * 4, *[pa.string()] * 3)
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *ADDED.names])

    return out.mapInArrow(run, schema)


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data replaced by its kind, as '<EMAIL>'; other texts stay as they are. A column n_chars, if any, follows the text."""
    columns = list(df.columns)
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), F.col(text_col).alias("_t"))
    new = spare(df, "_new")
    seen = find_pii(held, "_t", with_redacted=True).select("_all.*", F.col("redacted").alias(new))
    out = {text_col: F.coalesce(new, text_col)}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(df.schema["n_chars"].dataType))
    return seen.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in columns])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
