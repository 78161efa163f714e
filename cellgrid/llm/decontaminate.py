"""Benchmark decontamination: a generalised suffix automaton over the words of the test items; texts are streamed through it.

The automaton holds every run of words of every item. While a text is read, it keeps the longest run that ends at the present word and occurs in an
item. Once that run has WINDOW words, the last WINDOW words are a window of an item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import others, spare

WINDOW = 10
#: Most characters of items in one broadcast automaton; larger benchmarks are dealt to several, and texts are read once for each.
MAX_ITEM_CHARS = 1_000_000

#: Bytes to word bytes: letters lower-cased, digits and everything beyond ASCII kept, the rest blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; a null text has none."""
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised over items. Steps are kept in one dictionary keyed by state * vocabulary + word."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        items = [(k, w) for k, w in items if w]
        self.window = window
        self.word_id: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.word_id.setdefault(w, len(self.word_id))
        self.size = len(self.word_id) + 1
        self.length, self.link, steps = [0], [-1], [{}]
        marks: dict[int, set] = {}
        whole: dict[int, set] = {}
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.word_id[w], steps)
                marks.setdefault(last, set()).add(item)
            if len(words) < window:
                whole.setdefault(last, set()).add(item)
        self._settle(items, steps, marks, whole)

    def _extend(self, last: int, c: int, steps: list[dict]) -> int:
        length, link = self.length, self.link
        if c in steps[last]:
            q = steps[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c, steps)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        steps.append({})
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p != -1:
            q = steps[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c, steps)
        return new

    def _clone(self, p: int, q: int, c: int, steps: list[dict]) -> int:
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        steps.append(dict(steps[q]))
        while p != -1 and steps[p].get(c) == q:
            steps[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _settle(self, items: list, steps: list[dict], marks: dict, whole: dict) -> None:
        """Occurrences rise along the links, longest states first. Then each item is read again, as clones made later may stand for its whole."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if s in marks:
                marks.setdefault(self.link[s], set()).update(marks[s])
        self.items_of = {s: frozenset(marks[s]) for s in order if s in marks and self.length[self.link[s]] < self.window <= self.length[s]}
        self.short: dict[int, tuple[int, frozenset]] = {}
        ends: dict[int, set] = {}
        for item, words in items:
            if len(words) < self.window:
                s = 0
                for w in words:
                    s = steps[s][self.word_id[w]]
                ends.setdefault(s, set()).add((len(words), item))
        # the states whose runs end in a whole short item: all below its state
        below: dict[int, frozenset] = {}
        for s in reversed(order):
            below[s] = below.get(self.link[s], frozenset()) | frozenset(ends.get(s, ()))
        self.short = {s: v for s, v in below.items() if v}
        self.step = {s * self.size + c: t for s, x in enumerate(steps) for c, t in x.items()}
        # of each state the ancestor, or itself, that stands for its last window
        self.top = list(range(len(self.length)))
        for s in reversed(order):
            if self.length[self.link[s]] >= self.window:
                self.top[s] = self.top[self.link[s]]

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans (first word, one past the last) and the items whose windows occur."""
        get, step, size, link, length, window, short, top = self.word_id.get, self.step.get, self.size, self.link, self.length, self.window, self.short, self.top
        state = run = 0
        spans: list[tuple[int, int]] = []
        found: set = set()
        met: set = set()
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = run = 0
                continue
            to = step(state * size + c)
            if to is None:
                while to is None:  # the root has a step for each known word
                    state = link[state]
                    to = step(state * size + c)
                run = length[state]
            run += 1
            state = to
            if run >= window:
                met.add(top[state])
                spans.append((i + 1 - window, i + 1))
            if short and state in short:
                for n, item in short[state]:
                    if n <= run:
                        found.add(item)
                        spans.append((i + 1 - n, i + 1))
        for s in met:
            found |= self.items_of[s]
        if len(spans) > 1:
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    if b > merged[-1][1]:
                        merged[-1] = (merged[-1][0], b)
                else:
                    merged.append((a, b))
            spans = merged
        return spans, found


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_chars: int) -> list:
    """Broadcast automata over shards of at most about max_chars characters (a longer single item is a shard of its own), built on the driver one shard at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // max_chars))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    out = []
    for k in range(shards):
        rows = dealt.where(F.col("shard") == k).collect() if shards > 1 else items.collect()
        pairs = sorted((r["item"], words_of(r["text"].encode())) for r in rows)
        out.append(spark.sparkContext.broadcast(SuffixAutomaton(pairs, window)))
    return out


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_chars: int = MAX_ITEM_CHARS, cut_from: int | None = None) -> DataFrame:
    """Adds to each row `n_words`, `n_hit`, `spans` (word positions, merged, one past the end), `items` (ids as strings, sorted) and `cleaned`.

    cleaned: the text without spans of cut_from words or more; null where cut_from is None or there is nothing to cut. Null texts have no words.
    Items without words, and null items or ids, match nothing. Columns of these names are replaced. No shuffle."""
    automata = _automata(benchmark, item_id, item_text, window, max_chars)
    added = T.StructType.fromDDL("n_words long, n_hit long, spans array<array<int>>, items array<string>, cleaned string")
    out = df.select(*others(df, added.names), F.col(text_col).cast("binary").alias(spare(df, "_text")))
    schema = T.StructType([*out.schema[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [a.value for a in automata]
        for batch in batches:
            counts, hits, spans, items, cleaned = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                words = words_of(text)
                got, found = machines[0].read(words)
                for more in machines[1:]:
                    extra, also = more.read(words)
                    got, found = merge([*got, *extra]), found | also
                counts.append(len(words))
                hits.append(sum(b - a for a, b in got))
                spans.append([list(x) for x in got])
                items.append(sorted(found))
                cut = cut_from is not None and any(b - a >= cut_from for a, b in got)
                cleaned.append(cut_spans(text.decode(errors="replace"), got, cut_from) if cut else None)
            types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.string())
            arrays = [pa.array(x, t) for x, t in zip((counts, hits, spans, items, cleaned), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *added.names])

    return out.mapInArrow(run, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut_spans(text: str, spans: list[list[int]], min_words: int) -> str:
    """The text without the hit spans of at least min_words words; a blank joins what stood around a span."""
    cut = [(a, b) for a, b in spans if b - a >= min_words]
    if not cut:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in cut:
        out.append(text[at : places[a][0]].rstrip())
        at = places[b - 1][1]
    out.append(text[at:].lstrip())
    return " ".join(x for x in out if x)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, min_span: int = WINDOW, max_coverage: float = 0.5, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without benchmark passages: hit spans of min_span words or more are cut out, and rows of which more than max_coverage is hit are removed.

    A span shorter than min_span stems from a whole short item; it is cut as well when it is all of that item, that is always unless min_span > window.
    Other rows are returned as they are, null texts included. A column n_chars, if any, follows the text."""
    columns, new = list(df.columns), spare(df, "_cleaned")
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), F.col(text_col).alias("_t"))
    seen = contamination(held, benchmark, "_t", item_id, item_text, window, cut_from=1 if min_span <= window else min_span)
    kept = seen.where(F.col("n_hit") <= F.col("n_words") * max_coverage).select("_all.*", F.col("cleaned").alias(new))
    out = {text_col: F.coalesce(new, text_col)}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(df.schema["n_chars"].dataType))
    return kept.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in columns])
