"""Near-duplicates beyond a few bits: SimHash signatures of 256 bits over distinct five-word shingles, linked where they differ in so few bits as texts
of a given Jaccard similarity do.

Texts of similarity J have shingle vectors at a cosine of about 2J / (1 + J), and each bit differs with probability angle / pi. Candidates come from
tables keyed by random bits: more bits for more texts, and as many tables as make a pair at the similarity meet with probability
RECALL. Within a bucket the bit planes of all signatures are added up by carry-save counters, a block of words at a time, and lanes that are beyond
the radius are abandoned. Buckets larger than HOT_BUCKET are dealt into groups.
What hangs together so far is compared exactly by its shingles.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import materialise, remove, shuffle_partitions
from cellgrid.llm.components import connected_components
from cellgrid.llm.simhash import HOT_BUCKET, MAX_BROADCAST_BUCKETS, SMALL_BUCKET, majority, planes_of, simhash_components

WORDS, SHINGLE, SIMILARITY, RECALL = 4, 5, 0.8, 0.98
#: Bits beyond the expected distance at the similarity, in standard deviations of the binomial.
MARGIN = 3.5
#: Texts of so many shingles or fewer are also looked up by their shingles, as majorities of few hashes stray further than the binomial says.
SHORT = 40
BITS = 64 * WORDS
#: Rows of a bucket that are compared with all its others first, and rows of a large bucket that go to each of its groups.
PIVOTS, SHARED = 64, 64
#: Texts to be compared are picked by a broadcast of at most so many rows of numbers; more are picked by a shuffle.
MAX_BROADCAST_NODES = 1_000_000
# fixed values: odd multipliers that derive four words from one hash
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; one for a shorter text, none without words."""
    words = text.lower().split() if text else []
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def signature_of(hashes: np.ndarray) -> np.ndarray:
    """Bit k is set if it is set in over half of the distinct shingles' hashes; a text without words has none set."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    out = []
    for m in _MIX:
        x = (hashes ^ (hashes >> np.uint64(32))) * m
        out.append(majority((x ^ (x >> np.uint64(29))) * m))
    return np.array(out, np.uint64)


def signature(text: bytes | None) -> np.ndarray:
    return signature_of(shingle_hashes(text))


def bit_share(similarity: float) -> float:
    """Share of differing bits of two texts at the similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float) -> int:
    p = bit_share(similarity)
    return round(BITS * p + MARGIN * math.sqrt(BITS * p * (1 - p)))


def tables_of(rows: int, similarity: float, recall: float = RECALL) -> list[list[int]]:
    """The bits of each table, and tables until a pair at the similarity meets in one with the recall.

    A bucket has about 256 of unrelated texts, beyond 2^24 of them; below, tables of 16 bits are no dearer."""
    k = max(16, min(40, math.ceil(math.log2(max(rows, 2))) - 8))
    meet = (1 - bit_share(similarity)) ** k
    rng = random.Random(97)
    return [sorted(rng.sample(range(BITS), k)) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - meet)))]


class Counter:
    """Counts of up to 63 in each lane, as six bit planes and an overflow."""

    def __init__(self, shape):
        self.planes = [np.zeros(shape, np.uint64) for _ in range(6)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for plane in self.planes:
            carry = plane & x
            plane ^= x
            x = carry
        self.over |= x

    def above(self, radius: int) -> np.ndarray:
        more, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for k in range(5, -1, -1):
            if radius >> k & 1:
                equal &= self.planes[k]
            else:
                more |= equal & self.planes[k]
                equal &= ~self.planes[k]
        return self.over | more

    def keep(self, live: np.ndarray) -> None:
        self.planes, self.over = [p[..., live] for p in self.planes], self.over[..., live]


def near_rows(planes: list[np.ndarray], queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query (row of WORDS words) the lanes within the radius, as words of bits. Words of lanes that are all beyond it are abandoned after each 64 bits."""
    lanes = planes[0].shape[1]
    alive = np.arange(lanes)
    count = Counter((len(queries), lanes))
    for w in range(WORDS):
        here = planes[w][:, alive]
        for k in range(64):
            flip = np.where((queries[:, w] >> np.uint64(k)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            count.add(here[k] ^ flip[:, None])
        live = ~(count.above(radius) == ~np.uint64(0)).all(axis=0)
        if not live.all():
            alive = alive[live]
            count.keep(live)
    out = np.zeros((len(queries), lanes), np.uint64)
    out[:, alive] = ~count.above(radius)
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows are within the radius: one lane a pair, dropped once it is beyond."""
    at, differs = np.arange(len(a)), a ^ b
    distance = np.zeros(len(a), np.int64)
    for w in range(WORDS):
        count = Counter(-(-max(len(at), 1) // 64))
        for plane in planes_of(differs[at, w]):
            count.add(plane)
        own = sum((np.unpackbits(p.view(np.uint8), bitorder="little")[: len(at)].astype(np.int64) << k for k, p in enumerate(count.planes)), np.zeros(len(at), np.int64))
        own += 64 * np.unpackbits(count.over.view(np.uint8), bitorder="little")[: len(at)].astype(np.int64)
        distance[at] += own
        at = at[distance[at] <= radius]
        if not len(at):
            break
    out = np.zeros(len(a), bool)
    out[at] = True
    return out


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a, b) at distance d join the components of all of them, and the rows' new labels. Labels are row numbers; the lowest of a component stays.
    Each component's pair is the one with the lowest component it meets, of those the nearest."""
    chosen, left = [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        x, y = label[a[left]], label[b[left]]
        left = left[x != y]
        if not len(left):
            return np.concatenate(chosen), label
        x, y = label[a[left]], label[b[left]]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((d[left], low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        chosen.append(left[first])
        to = np.arange(len(label))
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def first_of(values: np.ndarray) -> np.ndarray:
    """For each row the first row of equal value."""
    _, first, of = np.unique(values, return_index=True, return_inverse=True)
    return first[of]


def close_pairs(planes: list[np.ndarray], sigs: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (asked row, any row) within the radius, a block of asked rows at a time."""
    step = max(16, min(1024, (1 << 14) // planes[0].shape[1]))
    for i in range(0, len(asked), step):
        chunk = asked[i : i + step]
        hit = np.unpackbits(near_rows(planes, sigs[chunk], radius).view(np.uint8).reshape(len(chunk), -1), axis=1, bitorder="little")[:, : len(sigs)]
        a, b = np.nonzero(hit)
        yield chunk[a], b


def distance(sigs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sigs[a] ^ sigs[b]).sum(axis=1).astype(np.int64)


def bucket_tree(sigs: np.ndarray, c: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the components of one bucket, where rows of one label count as joined: first the pairs of PIVOTS rows, then those of all rows outside the largest component,
    as of two rows that are still apart one lies outside it."""
    planes = [planes_of(np.ascontiguousarray(sigs[:, w])) for w in range(WORDS)]
    label, left, right = first_of(c), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    asked = np.arange(min(PIVOTS, len(sigs)))
    for turn in range(2):
        for a, b in close_pairs(planes, sigs, asked, radius):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            chosen, label = spanning(label, a, b, distance(sigs, a, b))
            left.append(a[chosen])
            right.append(b[chosen])
        if not turn:
            outside = label != np.bincount(label).argmax()
            outside[asked] = False
            asked = np.flatnonzero(outside)
    return np.concatenate(left), np.concatenate(right)


def small_pairs(start: np.ndarray, size: np.ndarray, c: np.ndarray, sigs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius, of different labels, of many small buckets at once: one lane a pair of places p and p + gap."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, SMALL_BUCKET):
        start, size = start[size > gap], size[size > gap]
        if not len(start):
            break
        count = size - gap
        first = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = first[c[first] != c[first + gap]]
        for i in range(0, len(first), 1 << 15):
            a = first[i : i + (1 << 15)]
            near = a[near_pairs(sigs[a], sigs[a + gap], radius)]
            left.append(near)
            right.append(near + gap)
    return np.concatenate(left), np.concatenate(right)


def equal_sets(sets: list[np.ndarray], c: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that join the components of the rows whose shingle sets, none empty, have the Jaccard similarity, compared exactly; rows of one label `c` count as joined.
    A search by breadth: each row reached is compared with the rows not reached yet."""
    size = np.array([len(x) for x in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    place = np.argsort(c, kind="stable")
    bounds = np.flatnonzero(np.r_[True, c[place][1:] != c[place][:-1], True])
    label = np.empty(len(sets), np.int64)
    label[place] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    members = lambda i: place[bounds[label[i]] : bounds[label[i] + 1]]
    found, todo, own = [], np.ones(len(sets), bool), np.zeros(len(ids), np.int32)
    left = np.arange(len(sets))
    shingles, begins = flat, start
    for first in range(len(sets)):
        if not todo[first]:
            continue
        front = members(first).tolist()
        todo[front] = False
        while front:
            if todo[left].sum() * 2 <= len(left):
                left = left[todo[left]]
                if not len(left):
                    return found
                shingles = np.concatenate([flat[start[k] : start[k] + size[k]] for k in left])
                begins = np.cumsum(size[left]) - size[left]
            i = front.pop()
            at = flat[start[i] : start[i] + size[i]]
            own[at] = 1
            common = np.add.reduceat(own[shingles], begins)
            own[at] = 0
            for k in left[(common >= (size[left] + size[i] - common) * similarity) & todo[left]].tolist():
                found.append((i, k))
                if todo[k]:
                    more = members(k)
                    front += more[todo[more]].tolist()
                    todo[more] = False
    return found


def _prefixes(similarity: float):
    """Rows (node, c, s) under each of the smallest shingles' hashes: two sets of the similarity share one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, c, sets = (batch.column(i).to_pylist() for i in range(3))
            key, at = [], []
            for i, x in enumerate(sets):
                prefix = x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]
                key += prefix
                at += [i] * len(prefix)
            for i in range(0, len(at), 1 << 14):
                take = pa.array(at[i : i + (1 << 14)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(take), np.int32)), pa.array(key[i : i + (1 << 14)], pa.int64()), *(x.take(take) for x in batch.columns)], names=["t", "key", "node", "c", "s"]
                )

    return run


def _short_edges(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, c, sets = None, [], []

        def close() -> pa.RecordBatch:
            pairs = equal_sets(sets, np.array(c), similarity) if len(set(c)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([c[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for *key, label, s in zip(*columns, batch.column(6), strict=True):
                if key != last:
                    yield close()
                    last, c, sets = key, [], []
                c.append(label)
                sets.append(s.values.to_numpy())
        yield close()

    return run


def short_links(short: DataFrame, similarity: float = SIMILARITY, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) of the groups `c` that join all texts (`node`, `c`, sorted shingles `s`, none empty) of the similarity."""
    keyed = short.select("node", "c", "s").mapInArrow(_prefixes(similarity), "t int, key long, node long, c long, s array<long>")
    hot = materialise(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket), "hot-shingles")
    edges = _dealt(keyed, hot, hot.count(), hot_bucket).mapInArrow(_short_edges(similarity), "a long, b long")
    return materialise(edges.distinct(), "short-links")


def _keys(tables: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.stack([batch.column(2 + w).to_numpy() for w in range(WORDS)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(sigs).view(np.uint8), bitorder="little").reshape(len(sigs), BITS)
            for t, chosen in enumerate(tables):
                key = bits[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(len(chosen), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), *batch.columns], names=["t", "key", "node", "c", "s0", "s1", "s2", "s3"])

    return run


def _in_buckets(columns: int, links):
    """Runs links on whole buckets, many at a time, of rows that come sorted by their first four columns; `columns` of numbers, then lists if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists, room = [], [], 0

        def take(at: int | None) -> pa.RecordBatch:
            nonlocal held, lists, room
            rows, sets = np.concatenate(held), lists
            at = len(rows) if at is None else at
            held, lists = [rows[at:]], sets[at:]
            room = len(rows) - at + sum(map(len, lists)) // 64
            x, y = links(rows[:at], sets[:at])
            return pa.RecordBatch.from_arrays([pa.array(rows[x, 5]), pa.array(rows[y, 5])], names=["a", "b"])

        for batch in batches:
            part = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(columns)], axis=1)
            held.append(part)
            if batch.num_columns > columns:
                new = [x.values.to_numpy() for x in batch.column(columns)]
                lists += new
                room += sum(map(len, new)) // 64
            room += len(part)
            if room < 1 << 16:
                continue
            held = [np.concatenate(held)]
            cut = np.flatnonzero((held[0][1:, :4] != held[0][:-1, :4]).any(axis=1))
            if len(cut):
                yield take(cut[-1] + 1)
        if held:
            yield take(None)

    return run


def _starts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(rows)])


def _near_edges(radius: int):
    """Pairs of groups that join the components of each bucket's rows within the radius."""

    def links(rows: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        c, sigs = rows[:, 5], np.ascontiguousarray(rows[:, 6:]).view(np.uint64)
        start, sizes = _starts(rows)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, n in zip(start[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
            if (c[s : s + n] != c[s]).any():
                x, y = bucket_tree(sigs[s : s + n], c[s : s + n], radius)
                left.append(s + x)
                right.append(s + y)
        few = (sizes > 1) & (sizes <= SMALL_BUCKET)
        x, y = small_pairs(start[few], sizes[few], c, sigs, radius)
        if len(x):
            bucket, (_, own) = np.repeat(np.arange(len(start)), sizes), np.unique(c, return_inverse=True)
            chosen, _ = spanning(first_of(bucket * (own.max() + 1) + own), x, y, distance(sigs, x, y))
            left.append(x[chosen])
            right.append(y[chosen])
        return np.concatenate(left), np.concatenate(right)

    return _in_buckets(6 + WORDS, links)


def _equal_edges(similarity: float):
    """Pairs of groups that join the components of each bucket's texts of the similarity."""

    def links(rows: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros((0, 2), np.int64)]
        for s, n in zip(*_starts(rows), strict=True):
            if n > 1 and (rows[s : s + n, 5] != rows[s, 5]).any():
                found.append(s + np.array(equal_sets(sets[s : s + n], rows[s : s + n, 5], similarity), np.int64).reshape(-1, 2))
        return tuple(np.concatenate(found).T)

    return _in_buckets(6, links)


_KEYED = "t int, key long, node long, c long, s0 long, s1 long, s2 long, s3 long"


def _sent(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y", "node")


def _few(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _part(parts: Column, seed: int = 11) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), parts).cast("int")


def _dealt(keyed: DataFrame, hot: DataFrame, found: int, hot_bucket: int) -> DataFrame:
    """The rows by bucket (t, key, x, y); those of a bucket of over hot_bucket rows are dealt into groups, by pairs of groups."""
    rest = [c for c in keyed.columns if c not in ("t", "key")]
    x, y = F.lit(0), F.lit(0)
    if found:
        grouped = hot.select("t", "key", F.ceil(F.col("n") / hot_bucket).cast("int").alias("g"))
        keyed = keyed.join(_few(grouped, found, MAX_BROADCAST_BUCKETS), ["t", "key"], "left")
        own = _part(F.col("g"))
        pairs = F.when(F.col("g") > 1, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y"))))
        keyed = keyed.withColumn("p", F.explode(F.coalesce(pairs, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))))
        x, y = F.col("p.x"), F.col("p.y")
    return _sent(keyed.select("t", "key", x.alias("x"), y.alias("y"), *rest))


def _first_rows(keyed: DataFrame, hot: DataFrame, found: int, hot_bucket: int) -> DataFrame:
    """The rows by bucket. Those of a bucket of over hot_bucket rows are dealt into groups, and about SHARED of them go to every group, so that the groups' trees meet."""
    rest, groups = [x for x in keyed.columns if x not in ("t", "key", "w")], F.array(F.lit(0))
    if found:
        marks = hot.select("t", "key", F.ceil(F.col("n") / hot_bucket).cast("int").alias("g"), F.greatest(F.lit(1), F.floor(F.col("n") / SHARED)).cast("int").alias("every"))
        keyed = keyed.join(_few(marks, found, MAX_BROADCAST_BUCKETS), ["t", "key"], "left")
        dealt = F.when(_part(F.col("every"), 13) == 0, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(_part(F.col("g"))))
        groups = F.when(F.col("g") > 1, dealt).otherwise(groups)
    return _sent(keyed.withColumn("x", F.explode(groups)).select("t", "key", "x", F.lit(0).alias("y"), *rest))


def _further_rows(keyed: DataFrame, hot: DataFrame, found: int, hot_bucket: int) -> DataFrame:
    """The rows of the hot buckets, for the pairs that their groups have left apart. As of two rows of different labels one has not the commonest label, all rows are dealt into
    groups, those of other labels into groups of their own, and each of the ones meets each of the others. A bucket of one label is left out."""
    rest = [x for x in keyed.columns if x not in ("t", "key", "w")]
    keyed = keyed.join(_few(hot.select("t", "key"), found, MAX_BROADCAST_BUCKETS), ["t", "key"], "left_semi")
    each = keyed.groupBy("t", "key", "c").agg(F.sum("w").alias("n"))
    commonest = each.groupBy("t", "key").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"))
    sizes = commonest.select("t", "key", F.col("most.c").alias("label"), *[F.ceil(n / hot_bucket).cast("int").alias(x) for n, x in ((F.col("n"), "g"), (F.col("n") - F.col("most.n"), "h"))])
    marks = materialise(sizes.where("h > 0"), "hot-labels")
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    all_rows = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: place(_part(F.col("g")), y))
    others = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: place(x, _part(F.col("h"), 17)))
    dealt = F.when(F.col("c") == F.col("label"), all_rows).otherwise(F.array_distinct(F.concat(all_rows, others)))
    return _sent(keyed.join(_few(marks, found, MAX_BROADCAST_BUCKETS), ["t", "key"]).withColumn("p", F.explode(dealt)).select("t", "key", "p.x", "p.y", *rest))


def joined(rows_of, nodes: DataFrame, kernel, hot_bucket: int, name: str) -> DataFrame:
    """Links (a, b) of the groups `c` that join all that the kernel finds in the buckets of rows_of(nodes) (`t`, `key`, `w`, `node`, `c`, ...; w: what a row weighs).

    Buckets that weigh over hot_bucket are done in two passes: groups of their rows, then the rows outside the largest group so far against all. So a large group of near copies
    costs its rows once or twice, not the square of them; only rows that stay apart from it meet all others."""
    keyed = rows_of(nodes)
    hot = materialise(keyed.groupBy("t", "key").agg(F.sum("w").alias("n")).where(F.col("n") > hot_bucket), f"hot-{name}")
    found = hot.count()
    links = materialise(_first_rows(keyed, hot, found, hot_bucket).mapInArrow(kernel, "a long, b long").distinct(), name)
    if found:
        labels = connected_components(links, "a", "b").withColumnRenamed("node", "c")
        again = nodes.join(labels, "c", "left").withColumn("c", F.coalesce("label", "c")).select(*nodes.columns)
        links = links.union(materialise(_further_rows(rows_of(again), hot, found, hot_bucket).mapInArrow(kernel, "a long, b long").distinct(), f"further-{name}"))
    return links


def similar_links(signed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) of groups `c` of the nodes (`node`, `c`, `s0`..`s3`; `texts` has `node`, `text`).

    First the buckets' rows are joined by the radius alone, down to trees. Then the texts of each component of those are compared exactly, by their shingles: the components of the
    links are those of all pairs of the similarity within such a component, so of all pairs that meet in a table within the radius. No pairs of texts are written or shuffled."""
    tables = tables_of(signed.count(), similarity)
    keyed = lambda nodes: nodes.select("node", "c", "s0", "s1", "s2", "s3").mapInArrow(_keys(tables), _KEYED).withColumn("w", F.lit(1))
    near = connected_components(joined(keyed, signed, _near_edges(radius_of(similarity)), hot_bucket, "near-groups"), "a", "b")
    members = signed.select("node", "c").join(near.select(F.col("node").alias("c"), F.col("label").alias("key")), "c")
    members = materialise(members, "similar-texts")
    held = texts.select("node", "text").join(_few(members, members.count(), MAX_BROADCAST_NODES), "node").select("key", "node", "c", "text")  # so the texts are not shuffled, up to that many
    held = materialise(held.mapInArrow(_sets, "t int, key long, node long, c long, w int, s array<long>"), "shingle-sets")
    links = joined(lambda nodes: nodes.select("t", "key", "node", "c", "w", "s"), held, _equal_edges(similarity), hot_bucket, "similar-groups")
    for used in (near, members):
        remove(used)
    return links


def shingle_set(text: bytes | None) -> list[int]:
    return shingle_hashes(text).view(np.int64).tolist()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, node, c, w, s) with the shingles' hashes; a row weighs one, and one more for each 1024 shingles. Texts without words have no row."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            some = batch.slice(i, 1000)
            sets = [shingle_hashes(t.as_py()).view(np.int64) for t in some.column(3)]
            at = pa.array([k for k, s in enumerate(sets) if len(s)], pa.int32())
            sets = [s for s in sets if len(s)]
            zero, weight = np.zeros(len(sets), np.int32), np.array([1 + len(s) // 1024 for s in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(zero), *[some.column(k).take(at) for k in range(3)], pa.array(weight), pa.array(sets, pa.list_(pa.int64()))], names=["t", "key", "node", "c", "w", "s"])


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """The rows of df, unchanged, of which one stays for each group of near-duplicates: texts whose fingerprints of three-word shingles differ in at most 3 bits,
    or that the signatures find and that have the Jaccard similarity of five-word shingles; groups are the components of both kinds of links.

    The smallest id stays (then the first row as written; rows without an id only where none of the group has one). Texts of equal
    shingles are searched for once, every other text by itself, whatever its fingerprint is linked to. Null and blank texts are one group. An empty input gives none."""
    columns = list(df.columns)
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), F.col(id_col).alias(id_col), F.col(text_col).alias("_t"))
    rows, best = simhash_components(held, id_col, "_t", keep=["_all"])
    texts = rows.select(F.col("_row").alias("node"), F.col(f"_all.`{text_col}`").cast("binary").alias("text"), "_fp")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py()) for t in batch.column(1)]
            sigs = np.array([signature_of(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            same = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(x)) for x in (*same.T, *sigs.T)]
            short = pa.array([s.view(np.int64) if 0 < len(s) <= SHORT else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, short], names=["node", "_fp", "k0", "k1", "s0", "s1", "s2", "s3", "s"])

    words = ["s0", "s1", "s2", "s3"]
    seen = materialise(texts.mapInArrow(sign, "node long, _fp long, k0 long, k1 long, s0 long, s1 long, s2 long, s3 long, s array<long>"), "signed-texts")
    distinct = seen.groupBy("k0", "k1", "_fp").agg(F.min("node").alias("node"), *[F.first(x).alias(x) for x in words])
    # a group of the fingerprints is named by the row that would stay of it
    distinct = materialise(distinct.join(best.select("_fp", F.col("first_row").alias("c")), "_fp"), "distinct-texts")
    equal = distinct.groupBy("k0", "k1").agg(F.min("node").alias("node"), F.min("c").alias("c"), F.max("c").alias("_high"), *[F.first(x).alias(x) for x in words])
    equal = materialise(equal, "signatures")
    signed = equal.select("node", "c", *words)
    joined = distinct.select("k0", "k1", F.col("c").alias("b")).join(equal.where("c < _high").select("k0", "k1", F.col("c").alias("a")), ["k0", "k1"]).where("a < b").select("a", "b")
    short = short_links(seen.where("s is not null").select("node", "s").join(signed.select("node", "c"), "node"), similarity, hot_bucket)
    links = similar_links(signed, texts, similarity, hot_bucket).union(joined).union(short)
    labels = connected_components(links, "a", "b")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))
    groups = best.select(F.col("first_row").alias("node"), F.col("component_id").alias("id")).distinct()
    chosen = groups.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(order).alias("first"))
    stays = materialise(chosen.select(F.col("first.node").alias("_row")), "staying-rows")
    for used in (seen, short, distinct, equal, labels, best):
        remove(used)
    return rows.join(stays.hint("merge"), "_row", "left_semi").select("_all.*")  # the same plan at every size: most rows stay
