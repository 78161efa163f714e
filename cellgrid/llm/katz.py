"""Katz backoff over n-grams of any order: Good-Turing discounted counts, exactly normalised backoff weights, evaluated by backing off token by token.

    P(w | h) = d(c) c(h, w) / c(h)            if c = c(h, w) > 0
             = alpha(h) P(w | h')             else, h' being h without its first word; P(w | h') if h was never seen
    P(w)     = d(c) c(w) / N                  if c = c(w) > 0
             = the mass the discounts leave   else (one class of unknown words)

alpha(h) is the mass that h's discounts leave, divided by one minus the sum of P(w | h') over all w seen after h. A context whose discounts leave nothing
(no successor rare enough) is treated as if it had been seen once more. Before a text's first word stand as many start marks as the order needs. Each order
has its own discounts.

Counts are far too many for a broadcast, and token rows too many for a row-wise join. Texts are read in blocks of about BLOCK_BYTES. A block asks the
vocabulary, partitioned by a hash of the word, for its distinct words, and then, order by order, the table of the n-grams, partitioned by a hash of the
context, for its distinct n-grams whose context was seen; questions, model and answers are sorted, delta-coded and compressed columns. Contexts with a
1 / HOT_SHARE share of all tokens are spread by the whole n-gram instead, and their few sums are added up over the partitions. An n-gram is packed two
word numbers a row of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import materialise, shuffle_partitions

#: Counts above this are not discounted.
CUT = 5
BLOCK_BYTES = 8_000_000
HOT_SHARE = 64
#: A bucket of the vocabulary or of the bigrams answers for about so many blocks' worth of text, or less: buckets grow in number, not in size.
BUCKET_BLOCKS = 8
END = b"\n"
_START, _UNKNOWN = (1 << 32) - 1, (1 << 32) - 2
#: Answers about words; those about n-grams of order n have the kind n - 1.
_WORDS = 0


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return text.lower().split() if text else []


def squeeze(values: np.ndarray) -> bytes:
    """Eight byte planes of the values, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstd.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[0..CUT] from the numbers n[1..CUT+1] of types seen so often; where Good-Turing gives no ratio between 0 and 1, (r - 1/2) / r."""
    d = np.ones(CUT + 1)
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else -1.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


@dataclass
class Unigrams:
    """n: how many types have each count up to CUT + 1; total: tokens; types: with a count over 0; ends: texts."""

    n: np.ndarray
    total: int
    types: int
    ends: int
    d: np.ndarray = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.d = discounts(self.n)
        r = np.arange(1, CUT + 1)
        self.unknown = float((self.n[1 : CUT + 1] * r * (1 - self.d[1:])).sum()) / self.total if self.total else 1.0
        self.plain = self.unknown <= 0
        if self.plain:
            self.unknown = 1 / (self.total + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(float)
        if self.plain:
            return np.where(c > 0, c / (self.total + 1), self.unknown)
        return np.where(c > 0, self.d[np.minimum(counts, CUT + 1).astype(np.int64) % (CUT + 1)] * c / max(self.total, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts.astype(float) + 0.1) / (self.total + 0.1 * (self.types + 1)))


# d has entries 0..CUT; counts over CUT meet d[0] = 1 by the modulus above, as min(c, CUT + 1) % (CUT + 1) is 0 for them


def _block_rows():
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, train, held, sizes, tokens, vocabulary, room = [], [], [], [], [], {END: 0}, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(tokens).astype(np.int64)
            ends = np.cumsum(sizes)
            known = np.repeat(np.array(train, bool), sizes)
            counts = np.bincount(flat[known], minlength=len(vocabulary))
            order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = np.array(list(vocabulary), object)[order]
            row = [(part << 32) | seq, zstd.ZstdCompressor(level=3).compress(b" ".join(w if w != END else b"" for w in words)), squeeze(counts[order]), squeeze(rank[flat]), squeeze(ends), bytes(train), bytes(held)]
            types = (pa.int64(), *[pa.binary()] * 6)
            return pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(row, types, strict=True)], pa.array([ids], pa.list_(pa.int64()))], names=["block", "words", "counts", "tokens", "ends", "train", "held", "ids"])

        for batch in batches:
            for doc, text, learn, out in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = words_of(text)
                tokens.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
                tokens.append(np.zeros(1, np.int32))
                ids.append(doc)
                train.append(bool(learn))
                held.append(bool(out))
                sizes.append(len(words) + 1)
                room += len(text or b"")
                if room >= BLOCK_BYTES or len(ids) >= 100_000:
                    yield block()
                    ids, train, held, sizes, tokens, vocabulary, room, seq = [], [], [], [], [], {END: 0}, 0, seq + 1
        if ids:
            yield block()

    return rows


BLOCK = "block long, words binary, counts binary, tokens binary, ends binary, train binary, held binary, ids array<long>"


def _words(data: bytes) -> list[bytes]:
    return [w or END for w in zstd.ZstdDecompressor().decompress(data).split(b" ")]


def _by_bucket(buckets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket starts in it."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(count + 1))


def _word_buckets(words: list[bytes], count: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(count)).astype(np.int64)


ASK = "bucket int, block long, a binary, b binary, c binary"
REPLY = "block long, kind int, bucket int, a binary, b binary, c binary, stats array<long>"


def _batch(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_ASK_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_REPLY_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_ASK_NAMES, _REPLY_NAMES = ["bucket", "block", "a", "b", "c"], ["block", "kind", "bucket", "a", "b", "c", "stats"]


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstd.ZstdCompressor(level=1).compress
        for batch in batches:
            for block, data, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = _words(data), stretch(counts)
                order, starts = _by_bucket(_word_buckets(words, buckets), buckets)
                rows = []
                for b in np.flatnonzero(np.diff(starts)):
                    own = order[starts[b] : starts[b + 1]]
                    rows.append((int(b), block, pack(b" ".join(words[i] if words[i] != END else b"" for i in own)), squeeze(counts[own]), None))
                yield _batch(_ASK_NAMES, _ASK_TYPES, rows)

    return run


def _count_words(buckets: int):
    """All questions of a bucket of words: totals, and numbers by falling count. stats: types by count 1..CUT+1, tokens, types, ends."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_words(x) for x in table["a"].to_pylist()]
        counts = np.concatenate([stretch(x) for x in table["b"].to_pylist()]).astype(np.int64)
        coded = pa.array([w for x in asked for w in x], pa.binary()).dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        totals = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(totals, index, counts)
        rank = np.empty(len(totals), np.int64)
        rank[np.lexsort((np.array(coded.dictionary.to_pylist(), object), -totals))] = np.arange(len(totals))
        bucket = table["bucket"][0].as_py()
        numbers = rank * buckets + bucket
        if len(numbers) and numbers.max() >= _UNKNOWN:
            raise OverflowError("more than 2^32 distinct words")
        at = coded.dictionary.index(pa.scalar(END, pa.binary())).as_py()
        small = np.bincount(np.minimum(totals, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        stats = [*small.tolist(), int(totals.sum()), int((totals > 0).sum()), int(totals[at]) if at >= 0 else 0]
        rows, start = [], 0
        for block, words in zip(table["block"].to_pylist(), asked, strict=True):
            own = index[start : start + len(words)]
            rows.append((block, _WORDS, bucket, squeeze(numbers[own]), squeeze(totals[own]), None, [] if rows else stats))
            start += len(words)
        return pa.Table.from_batches([_batch(_REPLY_NAMES, _REPLY_TYPES, rows)])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hash(rows: np.ndarray) -> np.ndarray:
    out = _mix(rows[0])
    for row in rows[1:]:
        out = _mix(out ^ row)
    return out


def _pack(numbers: list[np.ndarray]) -> np.ndarray:
    """Word numbers, one array for each place of the n-gram, as rows of two numbers; an odd last one has a row to itself."""
    return np.stack([numbers[i] << np.uint64(32) | numbers[i + 1] if i + 1 < len(numbers) else numbers[i] for i in range(0, len(numbers), 2)])


def _contexts(keys: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams without their last word."""
    return keys[:-1] if order % 2 else np.concatenate([keys[:-1], keys[-1:] >> np.uint64(32)])


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted packed n-grams; the first row as differences."""
    return squeeze(np.concatenate([np.diff(keys[0], prepend=np.uint64(0)), *keys[1:]]))


def _stretch_keys(data: bytes, order: int) -> np.ndarray:
    keys = stretch(data).reshape((order + 1) // 2, -1)
    return np.vstack([np.cumsum(keys[:1], axis=1, dtype=np.uint64), keys[1:]])


def _starts(rows: np.ndarray) -> np.ndarray:
    """Whether each column of sorted rows differs from the one before."""
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    return new


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct columns in order, the first place of each, and the place of each column among them."""
    by = np.lexsort(keys[::-1])
    ordered = keys[:, by]
    new = _starts(ordered)
    where = np.empty(len(by), np.int64)
    where[by] = np.cumsum(new) - 1
    return ordered[:, new], by[new], where


def _gram_buckets(keys: np.ndarray, order: int, hot: np.ndarray, buckets: int) -> np.ndarray:
    context = _hash(_contexts(keys, order))
    return (np.where(np.isin(context, hot), _hash(keys), context) % np.uint64(buckets)).astype(np.int64)


def _hot_contexts(least: int, order: int):
    """Hashes of the words (order 1) or n-grams that were counted `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = stretch(a)[None] if order == 1 else _stretch_keys(a, order)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hash(keys[:, stretch(b) >= least])).view(np.int64))], names=["id"])

    return run


def left_over(rare: np.ndarray, d: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The share of a context's mass that its discounts free; one part of total + 1 if they free none."""
    free = (rare * np.arange(1, CUT + 1) * (1 - d[1:])).sum(axis=-1)
    return np.where(free > 0, free / np.maximum(total, 1), 1 / (total + 1.0))


@dataclass
class _Level:
    """One order's discounts, the hashes of its hot contexts, and the sums of those: contexts (packed), numbers of rare successors, sums of lower P."""

    order: int
    d: np.ndarray
    hot: np.ndarray
    contexts: np.ndarray
    rare: np.ndarray
    sums: np.ndarray

    def seen(self, count: np.ndarray, dry: np.ndarray, total: np.ndarray) -> np.ndarray:
        """P of n-grams that were seen."""
        return np.where(dry, count / (total + 1), self.d[np.minimum(count, CUT + 1) % (CUT + 1)] * count / np.maximum(total, 1))


@dataclass
class _Model:
    """What a task needs: unigrams and the finished levels, lowest first."""

    buckets: int
    unigrams: Unigrams
    levels: list[_Level]


class _Block:
    """A block's tokens after the answers of some orders. Of each token: p, the probability by the highest of these orders, and of the n-gram of that
    order that ends there, count (in training), total (its context's count) and dry (its context's discounts free nothing)."""

    def __init__(self, row: dict, replies: list[dict], model: _Model) -> None:
        words = _words(row["words"])
        order, starts = _by_bucket(_word_buckets(words, model.buckets), model.buckets)
        number, count = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        for r in replies:
            if r["kind"] == _WORDS:
                own = order[starts[r["bucket"]] : starts[r["bucket"] + 1]]
                number[own], count[own] = stretch(r["a"]), stretch(r["b"]).astype(np.int64)
        number[count == 0] = _UNKNOWN
        tokens, self.ends = stretch(row["tokens"]).astype(np.int64), stretch(row["ends"]).astype(np.int64)
        self.begin = np.r_[0, self.ends[:-1]]
        self.trained = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), np.diff(np.r_[0, self.ends]))
        self.model, self.number, self.word_count = model, number[tokens], count[tokens]
        self.count, self.p = self.word_count, model.unigrams.p(self.word_count)
        self.total = self.dry = np.zeros(len(tokens), np.int64)
        for level in model.levels:
            self.climb(level, [r for r in replies if r["kind"] == level.order - 1])

    def before(self, values: np.ndarray, first: int) -> np.ndarray:
        """The value of the token before; `first` at the beginning of a text."""
        out = np.r_[values[:1], values[:-1]]
        out[self.begin] = first
        return out

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams whose context was seen, a token of each, each token's place among them (-1: none) and its context's count."""
        total = self.before(self.count, self.model.unigrams.ends)
        numbers = [self.number]
        for _ in range(order - 1):
            numbers.insert(0, self.before(numbers[0], _START))
        asked = np.flatnonzero(total > 0)
        keys, first, where = _distinct(_pack(numbers)[:, asked])
        place = np.full(len(total), -1, np.int64)
        place[asked] = where
        return keys, asked[first], place, total

    def climb(self, level: _Level, replies: list[dict]) -> None:
        keys, token, place, totals = self.grams(level.order)
        order, starts = _by_bucket(_gram_buckets(keys, level.order, level.hot, self.model.buckets), self.model.buckets)
        count, dry = np.zeros(len(token), np.int64), np.zeros(len(token), bool)
        rare, sums = np.zeros((len(token), CUT), np.int64), np.zeros(len(token))
        contexts = _contexts(keys, level.order)
        for r in replies:
            own = order[starts[r["bucket"]] : starts[r["bucket"] + 1]]
            got = stretch(r["a"]).astype(np.int64)
            count[own], dry[own] = got >> 1, (got & 1).astype(bool)
            unseen = own[count[own] == 0]
            if len(unseen):
                at = np.cumsum(_starts(contexts[:, unseen])) - 1
                rare[unseen] = stretch(r["b"]).astype(np.int64).reshape(-1, CUT)[at]
                sums[unseen] = np.frombuffer(r["c"], float)[at]
        hot = np.flatnonzero(np.isin(_hash(contexts), level.hot))
        for i in range(len(level.sums)):
            own = hot[(contexts[:, hot] == level.contexts[:, i : i + 1]).all(axis=0)]
            rare[own], sums[own], dry[own] = level.rare[i], level.sums[i], level.rare[i].sum() == 0
        total = totals[token].astype(float)
        p = np.where(count > 0, level.seen(count, dry, total), left_over(rare, level.d, total) / (1 - sums) * self.p[token])
        has = place >= 0
        self.p, self.total = self.p.copy(), totals
        self.p[has] = p[place[has]]
        self.count, self.dry = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        self.count[has], self.dry[has] = count[place[has]], dry[place[has]]


def _ask_grams(order: int, model: _Model, hot: np.ndarray):
    """Questions a, b, c: n-grams, counts in the block's training texts, and what the probability of the lower order is made of."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        x = _Block(block.to_pylist()[0], replies.to_pylist(), model)
        keys, token, place, _ = x.grams(order)
        in_train = np.bincount(place[x.trained & (place >= 0)], minlength=len(token))
        lower = x.count[token][None] if order == 2 else np.stack([x.count[token] * 2 + x.dry[token], x.total[token]])
        by, starts = _by_bucket(_gram_buckets(keys, order, hot, model.buckets), model.buckets)
        rows = []
        for b in np.flatnonzero(np.diff(starts)):
            own = by[starts[b] : starts[b + 1]]
            rows.append((int(b), block["block"][0].as_py(), _squeeze_keys(keys[:, own]), squeeze(in_train[own]), squeeze(lower[:, own].ravel())))
        return pa.Table.from_batches([_batch(_ASK_NAMES, _ASK_TYPES, rows)])

    return run


def _lower_p(order: int, model: _Model, lower: np.ndarray) -> np.ndarray:
    """The lower order's P of the last words of n-grams that were seen, and whose shorter n-grams therefore were."""
    if order == 2:
        return model.unigrams.p(lower[0])
    return model.levels[-1].seen(lower[0] >> 1, (lower[0] & 1).astype(bool), lower[1].astype(float))


def _context_sums(new: np.ndarray, totals: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted n-grams whose contexts begin where `new` is true: how many successors were seen 1..CUT times, and the sum of p over all seen successors."""
    starts = np.flatnonzero(new)
    rare = np.stack([np.add.reduceat((totals == r).astype(np.int64), starts) for r in range(1, CUT + 1)], axis=1)
    return rare, np.add.reduceat(np.where(totals > 0, p, 0.0), starts)


def _count_grams(order: int, model: _Model, hot: np.ndarray):
    """All questions of a bucket of n-grams. An answer's `a` has the counts, doubled, plus one where the context's discounts leave nothing; b and c have,
    for each context with an unseen n-gram, its numbers of rare successors and the bits of its sum of lower P. The bucket's rows of block -1 are its part
    of the model (keys, counts), those of block -2 the sums of hot contexts."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_stretch_keys(x, order) for x in table["a"].to_pylist()]
        keys, first, index = _distinct(np.concatenate(asked, axis=1))
        counts = np.concatenate([stretch(x) for x in table["b"].to_pylist()]).astype(np.int64)
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, index, counts)
        lower = np.concatenate([stretch(x).reshape(-1, k.shape[1]) for x, k in zip(table["c"].to_pylist(), asked, strict=True)], axis=1)[:, first].astype(np.int64)
        contexts = _contexts(keys, order)
        new = _starts(contexts)
        rare, sums = _context_sums(new, totals, _lower_p(order, model, lower))
        own = contexts[:, new]
        is_hot = np.isin(_hash(own), hot)
        dry = (rare.sum(axis=1) == 0) & ~is_hot
        bucket, kind = table["bucket"][0].as_py(), order - 1
        seen = totals > 0
        small = np.bincount(np.minimum(totals[seen], CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        rows = [(-1, kind, bucket, _squeeze_keys(keys[:, seen]), squeeze(totals[seen]), None, small.tolist())]
        if is_hot.any():
            rows.append((-2, kind, bucket, squeeze(own[:, is_hot].ravel()), squeeze(rare[is_hot].ravel()), sums[is_hot].tobytes(), []))
        place = np.cumsum(new) - 1
        answer = totals * 2 + dry[place]
        start = 0
        for block, ask in zip(table["block"].to_pylist(), asked, strict=True):
            mine = index[start : start + ask.shape[1]]
            start += ask.shape[1]
            unseen = np.unique(place[mine[totals[mine] == 0]])
            rows.append((block, kind, bucket, squeeze(answer[mine]), squeeze(rare[unseen].ravel()), sums[unseen].tobytes(), []))
        return pa.Table.from_batches([_batch(_REPLY_NAMES, _REPLY_TYPES, rows)])

    return run


def _score(model: _Model):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        x = _Block(row, replies.to_pylist(), model)
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(np.frombuffer(row["held"], np.uint8).astype(bool)),
                "n_tokens": pa.array(np.diff(np.r_[0, x.ends])),
                "n_known": pa.array(np.add.reduceat((x.word_count > 0).astype(np.int64), x.begin)),
                "train_tokens": pa.array(np.full(len(x.begin), model.unigrams.total, np.int64)),
                "base_score": pa.array(np.add.reduceat(model.unigrams.base(x.word_count), x.begin)),
                "score": pa.array(np.add.reduceat(np.log10(x.p), x.begin)),
            }
        )

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_stats(replies: DataFrame) -> np.ndarray:
    rows = replies.where(F.size("stats") > 0).select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(max([CUT + 4, *[r["pos"] + 1 for r in rows]]), np.int64)
    for r in rows:
        out[r["pos"]] = r["n"]
    return out


def _level(order: int, hot: np.ndarray, grams: DataFrame) -> _Level:
    """What all tasks need of a counted order."""
    width = order // 2  # rows of a packed context
    sums: dict[tuple, list] = {}
    for r in grams.where("block = -2").select("a", "b", "c").toLocalIterator():  # at most HOT_SHARE + 1 contexts a partition
        rare, p = stretch(r["b"]).astype(np.int64).reshape(-1, CUT), np.frombuffer(r["c"], float)
        for i, context in enumerate(zip(*stretch(r["a"]).reshape(width, -1).tolist(), strict=True)):
            old = sums.setdefault(context, [np.zeros(CUT, np.int64), 0.0])
            old[0], old[1] = old[0] + rare[i], old[1] + p[i]
    found = sorted(sums)
    contexts = np.array(found, np.uint64).reshape(-1, width).T
    rare = np.array([sums[c][0] for c in found], np.int64).reshape(-1, CUT)
    return _Level(order, discounts(np.r_[0, _sum_stats(grams)[: CUT + 1]]), hot, contexts, rare, np.array([sums[c][1] for c in found]))


def katz_scores(df: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> tuple[DataFrame, DataFrame]:
    """(scores, model). scores: for every row doc_id, held_out, n_tokens (one end included), n_known (seen in training), train_tokens, base_score (add-0.1
    unigrams) and score, both log10. model: the tables of the n-grams, one row an order and partition, with sorted keys (word numbers, two in 64 bits; first
    row of keys as differences) and counts.

    train, held_out: conditions; a null one is false. order: words of the longest n-gram, 2 or more. Null texts are empty, that is, one end. Repeated rows
    count and are scored each. Without any training row every word is unknown. An empty input gives no rows."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    docs = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), F.coalesce(train, F.lit(False)), F.coalesce(held_out, F.lit(False)))
    blocks = materialise(docs.mapInArrow(_block_rows(), BLOCK), "blocks")
    buckets = max(shuffle_partitions(df.sparkSession), -(-blocks.count() // BUCKET_BLOCKS))
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask_words(buckets), ASK)
    words = materialise(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count_words(buckets), REPLY), "word-answers")
    stats = _sum_stats(words)
    unigrams = Unigrams(np.r_[0, stats[: CUT + 1]], int(stats[CUT + 1]), int(stats[CUT + 2]), int(stats[CUT + 3]))
    least = max(1, -(-unigrams.total // HOT_SHARE))
    model, answers, last, tables = _Model(buckets, unigrams, []), words, words, []
    for n in range(2, order + 1):
        counted = last if n == 2 else last.where("block = -1")
        found = counted.select("a", "b").mapInArrow(_hot_contexts(least, n - 1), "id long").distinct().collect()  # at most HOT_SHARE
        start = _hash(_pack([np.full(1, _START, np.uint64)] * (n - 1)))
        hot = np.unique(np.r_[start, np.array([r["id"] for r in found], np.int64).view(np.uint64)])
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_grams(n, model, hot), ASK)
        last = materialise(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count_grams(n, model, hot), REPLY), f"answers-{n}")
        model = replace(model, levels=[*model.levels, _level(n, hot, last)])
        answers = answers.union(last.where("block >= 0"))
        tables.append(last.where("block = -1").select(F.lit(n).alias("order"), F.col("bucket").alias("partition"), F.col("a").alias("keys"), F.col("b").alias("counts")))
    scores = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model), SCORED)
    return scores, reduce(DataFrame.union, tables)
