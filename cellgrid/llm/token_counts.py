"""Token counts that follow edits: a segment tree of pre-tokens for each document, of which an edit re-encodes only what it may have changed.

A byte-pair vocabulary splits a text into pre-tokens by a pattern and encodes each on its own, so counts add up over pre-tokens. Leaves of the tree
hold runs of pre-tokens, nodes the sums of characters and tokens below. An edit starts re-reading one pre-token before the one that holds the last
character other than white space ahead of it, as no earlier match looked so far, and stops at the first old boundary behind the edit that is a
boundary again, as matches depend only on what follows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import others, spare

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64_000_000
#: Pre-tokens in a leaf; a leaf that has grown over four times that makes the tree be built anew.
LEAF = 64
#: Characters in a piece of a text, and characters beyond a pre-token that the pattern may look at.
PIECE, LOOK = 16_384, 64
CACHE = 200_000

Edit = tuple[int, int, str]


class Encoder:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = _Counts(self.encoding)

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens."""
        pieces = self.pattern.findall(text)
        if len(self.known) > CACHE:
            self.known.clear()
        return list(map(len, pieces)), list(map(self.known.__getitem__, pieces))


class _Counts(dict):
    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encode(piece))
        return n


class SegmentTree:
    """Leaves 0..n-1 at nodes size..size+n-1; node i is the sum of 2i and 2i+1."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.build(lengths, tokens)

    def build(self, lengths: list[int], tokens: list[int]) -> None:
        cuts = range(0, max(1, len(lengths)), LEAF)
        self.lengths = [lengths[i : i + LEAF] for i in cuts]
        self.tokens = [tokens[i : i + LEAF] for i in cuts]
        self.size = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.sums = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(self.lengths)] = [sum(x) for x in self.lengths]
        self.sums[self.size : self.size + len(self.tokens)] = [sum(x) for x in self.tokens]
        level = self.size
        while level > 1:
            for a in (self.chars, self.sums):
                a[level // 2 : level] = a[level : 2 * level : 2] + a[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character, and its first character; the last leaf for the end of the text."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        leaf = min(node - self.size, len(self.lengths) - 1)
        while leaf and not self.lengths[leaf]:
            leaf -= 1
        return leaf, self.start_of(leaf)

    def start_of(self, leaf: int) -> int:
        node, start = leaf + self.size, 0
        while node > 1:
            if node % 2:
                start += int(self.chars[node - 1])
            node //= 2
        return start

    def update(self, leaf: int) -> None:
        node = leaf + self.size
        self.chars[node], self.sums[node] = sum(self.lengths[leaf]), sum(self.tokens[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def piece_at(self, position: int) -> tuple[int, int, int]:
        """Leaf, place in it and first character of the pre-token that holds the character."""
        leaf, start = self.leaf_at(position)
        for i, n in enumerate(self.lengths[leaf]):
            if start + n > position:
                return leaf, i, start
            start += n
        return leaf, max(0, len(self.lengths[leaf]) - 1), start - (self.lengths[leaf][-1] if self.lengths[leaf] else 0)

    def before(self, leaf: int, place: int, start: int) -> tuple[int, int, int]:
        """The pre-token before one; the first has itself."""
        if place:
            return leaf, place - 1, start - self.lengths[leaf][place - 1]
        for k in range(leaf - 1, -1, -1):
            if self.lengths[k]:
                return k, len(self.lengths[k]) - 1, start - self.lengths[k][-1]
        return leaf, 0, start

    def walk(self, leaf: int, place: int, start: int) -> Iterator[tuple[int, int, int]]:
        for k in range(leaf, len(self.lengths)):
            for i in range(place if k == leaf else 0, len(self.lengths[k])):
                yield k, i, start
                start += self.lengths[k][i]
        yield len(self.lengths), 0, start


class Pieces:
    """A text in pieces of about PIECE characters, so that an edit copies a piece, not the text."""

    def __init__(self, text: str):
        self.parts = [text[i : i + PIECE] for i in range(0, max(1, len(text)), PIECE)]
        self.ends = np.cumsum([len(p) for p in self.parts])

    def __len__(self) -> int:
        return int(self.ends[-1])

    def __str__(self) -> str:
        return "".join(self.parts)

    def at(self, position: int) -> tuple[int, int]:
        """The piece that holds the character (the last one for the end), and its first character."""
        i = min(int(np.searchsorted(self.ends, position, side="right")), len(self.parts) - 1)
        return i, int(self.ends[i]) - len(self.parts[i])

    def cut(self, start: int, end: int) -> str:
        i, first = self.at(start)
        j, _ = self.at(end)
        return "".join(self.parts[i : j + 1])[start - first : end - first]

    def replace(self, start: int, end: int, new: str) -> None:
        i, first = self.at(start)
        j, last = self.at(end)
        whole = self.parts[i][: start - first] + new + self.parts[j][end - last :]
        small = len(whole) <= 2 * PIECE
        self.parts[i : j + 1] = [whole] if small else [whole[k : k + PIECE] for k in range(0, len(whole), PIECE)]
        if small and i == j:
            self.ends[i:] += len(new) - (end - start)
        else:
            self.ends = np.cumsum([len(p) for p in self.parts])


class CountedText:
    """A text with its tree. `encoded`: pre-tokens encoded since it was made, the first reading aside."""

    def __init__(self, text: str, encoder: Encoder):
        self.pieces, self.encoder, self.encoded = Pieces(text), encoder, 0
        self.tree = SegmentTree(*encoder.split(text))

    @property
    def text(self) -> str:
        return str(self.pieces)

    @property
    def tokens(self) -> int:
        return self.tree.total

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start up to end of the present text. The pattern may look up to LOOK characters beyond a pre-token."""
        text, tree = self.pieces, self.tree
        if not 0 <= start <= end <= len(text):
            raise ValueError(f"edit {start}:{end} of a text of {len(text)} characters")
        seen = start
        while seen:
            before = text.cut(max(0, seen - 256), seen)
            stripped = len(before.rstrip())
            seen -= len(before) - stripped
            if stripped:
                break
        text.replace(start, end, new)
        leaf, place, at = tree.before(*tree.piece_at(seen - 1)) if seen else (0, 0, 0)
        shift, safe = len(new) - (end - start), start + len(new)
        old = tree.walk(leaf, place, at)
        bound = next(old)
        lengths, tokens, stop, room, done = [], [], at, safe - at + 4 * LOOK, False
        while not done and stop < len(text):
            base, limit = stop, min(len(text), stop + room)
            for m in self.encoder.pattern.finditer(text.cut(base, limit)):
                if m.end() + LOOK > limit - base and limit < len(text):
                    break  # what follows might change it: read on from here
                first = base + m.start()
                if first >= safe:
                    while bound[2] + shift < first and bound[0] < len(tree.lengths):
                        bound = next(old)
                    if bound[2] + shift == first and bound[2] >= end:
                        done = True
                        break
                lengths.append(len(m[0]))
                tokens.append(self.encoder.known[m[0]])
                stop = base + m.end()
            room = 4 * LOOK if stop > base else 2 * room
        if not done:
            while bound[0] < len(tree.lengths):
                bound = next(old)
        self.encoded += len(lengths)
        self._splice(leaf, place, bound[0], bound[1], lengths, tokens)

    def _splice(self, leaf: int, place: int, to_leaf: int, to_place: int, lengths: list[int], tokens: list[int]) -> None:
        """Puts the new pre-tokens for those from (leaf, place) up to (to_leaf, to_place)."""
        tree = self.tree
        for side, new in ((tree.lengths, lengths), (tree.tokens, tokens)):
            if to_leaf == leaf:
                side[leaf][place:to_place] = new
            else:
                side[leaf][place:] = new
                for k in range(leaf + 1, min(to_leaf, len(side))):
                    side[k] = []
                if to_leaf < len(side):
                    side[to_leaf] = side[to_leaf][to_place:]
        if len(tree.lengths[leaf]) > 4 * LEAF:
            tree.build([x for part in tree.lengths for x in part], [x for part in tree.tokens for x in part])
        else:
            for k in range(leaf, min(to_leaf, len(tree.lengths) - 1) + 1):
                tree.update(k)


def _vocabulary(path: str) -> bytes:
    data = Path(path).read_bytes()  # a file of the driver's; workers get its bytes
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {len(data)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    return data


def token_counts(df: DataFrame, text_col: str = "text", edits: str | Callable[[str], list[Edit]] | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Adds n_tokens and, after the edits, n_tokens_edited, n_edits, n_reencoded (pre-tokens encoded for them) and edited (null if there are none).

    edits: a column of array<struct<start, end, text>>, or a function of the text that returns such triples; each applies to the text as it then is.
    Null and empty texts have 0 tokens; edits of a null text, and null edits, are none. Whole texts are read. No shuffle; the vocabulary is broadcast (its size is checked)."""
    held = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    added = ["n_tokens", "n_tokens_edited", "n_edits", "n_reencoded", "edited"]
    script = F.col(edits) if isinstance(edits, str) else F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    out = df.select(*others(df, added), F.col(text_col).cast("string").alias(spare(df, "_text")), script.alias(spare(df, "_edits")))
    schema = T.StructType([*out.schema[:-2], *[T.StructField(c, T.LongType()) for c in added[:4]], T.StructField("edited", T.StringType())])
    derive = edits if callable(edits) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, pattern)
        for batch in batches:
            rows = []
            for text, given in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py() or ""
                script = derive(text) if derive and text else [tuple(e.values()) for e in given.as_py() or () if e] if text else []
                counted = CountedText(text, encoder)
                before = counted.tokens
                for edit in script:
                    counted.edit(*edit)
                rows.append((before, counted.tokens, len(script), counted.encoded, counted.text if script else None))
            arrays = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], names=[*batch.schema.names[:-2], *added])

    return out.mapInArrow(run, schema)


def redaction_edits(text: str) -> list[Edit]:
    """Edits that put '<KIND>' for each piece of plain personal data, the last first, so that earlier places stay valid. Of overlapping finds the first stays."""
    from cellgrid.llm.pii import detect

    spans, last = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in detect(text).items() for a, b in found):
        if a >= last:
            spans.append((a, b, f"<{kind.upper()}>"))
            last = b
    return spans[::-1]
