"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by bit-sliced comparison.

Candidates come from the pigeonhole rule. Of BLOCKS parts of the 64 bits, radius differing bits touch at most radius parts, so two linked
fingerprints agree on BLOCKS - radius parts; each choice of those is a table of buckets. Within a bucket, bit plane k holds bit k of 64
fingerprints a machine word, a carry-save counter of two planes and an overflow plane adds up the differing bits of all of them at once, and words
whose fingerprints have all overflowed are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import materialise, remove, shuffle_partitions, spare
from cellgrid.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Parts of the fingerprint; RADIUS + 2 gives ten tables with keys of 24 to 26 bits.
BLOCKS = 5
#: Buckets of more distinct fingerprints are dealt into groups of about this many, and each pair of groups becomes a task's work.
HOT_BUCKET = 2048
#: Buckets up to this size are compared lane by lane, many buckets together.
SMALL_BUCKET = 24
#: More hot buckets than this are joined by a shuffle, not broadcast.
MAX_BROADCAST_BUCKETS = 20_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits of one text: bit k is set if it is set in over half of the shingles' XXH64. Null and blank texts give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes. Bytes of 0 and 1 add up eight to a word, at most 255 rows at a time, so none overflows."""
    n = len(hashes)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).view(np.uint64).reshape(n, 8)
    sums = np.add.reduceat(bits, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `_fp`, the fingerprint as a signed long."""
    keep = list(df.columns) if keep is None else keep
    out = df.select(*[F.col(f"`{c}`") for c in keep if c.lower() != "_fp"], F.lit(0).cast("long").alias("_fp"), F.col(text_col).cast("binary").alias(spare(df, "_text")))
    schema = T.StructType(out.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x) for x in batch.column(batch.num_columns - 1).to_pylist()), np.uint64, batch.num_rows)
            columns = batch.columns[:-2]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got.view(np.int64))], names=batch.schema.names[:-1])

    return out.mapInArrow(run, schema)


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of each table's key, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    found = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows, one a bit; lane i is bit i of the row, packed 64 lanes a word and padded with zero lanes."""
    lanes = -(-max(len(fps), 1) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(lanes, 64)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_lanes(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query a row of words; lane bits are set where the lane's fingerprint is within the radius (1 to 3) of the query."""
    words = planes.shape[1]
    alive = np.arange(words)
    flip = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    ones = np.zeros((len(queries), words), np.uint64)
    twos, over = ones.copy(), ones.copy()
    here = planes
    for k in range(64):
        x = here[k] ^ flip[:, k : k + 1]
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7 and k < 63:
            dead = ((over if radius == 3 else over | _above(ones, twos, radius)) == ~np.uint64(0)).all(axis=0)
            if dead.sum() * 4 > len(alive):
                live = ~dead
                alive, here, ones, twos, over = alive[live], here[:, live], ones[:, live], twos[:, live], over[:, live]
                if not len(alive):
                    break
    near = ~(over | _above(ones, twos, radius))
    out = np.zeros((len(queries), words), np.uint64)
    out[:, alive] = near
    return out


def _above(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    return {3: np.zeros_like(ones), 2: ones & twos, 1: twos, 0: ones | twos}[radius]


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning star of each component within one bucket: a search by breadth whose steps compare a block of queries with all lanes at once."""
    n, planes, found = len(fps), planes_of(fps), []
    todo = np.ones(planes.shape[1] * 64, bool)
    todo[n:] = False
    for start in range(n):
        if not todo[start]:
            continue
        todo[start] = False
        front, members = np.array([start]), []
        while len(front):
            chunk, front = front[:128], front[128:]
            hit = np.bitwise_or.reduce(near_lanes(planes, fps[chunk], radius), axis=0)
            new = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little").view(bool) & todo)
            todo[new] = False
            members.extend(new.tolist())
            front = np.concatenate([front, new])
        found.extend((start, m) for m in members)
    return found


def lane_links(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) are within the radius: the same counter, with one lane a pair."""
    near = near_lanes(planes_of(a ^ b), np.zeros(1, np.uint64), radius)[0]
    return np.unpackbits(near.view(np.uint8), bitorder="little").view(bool)[: len(a)]


def _link_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            key, fp = np.concatenate([rest_key, key]), np.concatenate([rest_fp, fp])
            if not len(fp):
                continue
            last = len(fp) - 1
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            cut = start[-1]
            rest_key, rest_fp = key[cut:], fp[cut:]
            if cut <= last:
                yield _edges(start[:-1], fp[:cut], radius)
        yield _edges(np.zeros(min(1, len(rest_fp)), np.int64), rest_fp, radius)

    return run


def _edges(start: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    sizes = np.diff(np.r_[start, len(fp)])
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for s, n in zip(start[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        own = fp[s : s + n]
        if links := bucket_links(own, radius):
            pair = np.array(links)
            left.append(own[pair[:, 0]])
            right.append(own[pair[:, 1]])
    small = (sizes > 1) & (sizes <= SMALL_BUCKET)
    begin, size = start[small], sizes[small]
    for gap in range(1, SMALL_BUCKET):  # every pair of a small bucket: places p and p + gap
        begin, size = begin[size > gap], size[size > gap]
        if not len(begin):
            break
        count = size - gap
        first = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for i in range(0, len(first), 1 << 16):
            a = fp[first[i : i + (1 << 16)]]
            b = fp[first[i : i + (1 << 16)] + gap]
            near = lane_links(a, b, radius)
            left.append(a[near])
            right.append(b[near])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) that join exactly the components of the graph of all fingerprints (`_fp`, distinct) within the radius.

    A bucket of more than hot_bucket fingerprints is dealt into groups by hash; every pair of groups is compared in a bucket of its own."""
    spark = distinct.sparkSession
    keys = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("_fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius=radius))])
    rows = distinct.select("_fp", F.explode(keys).alias("k")).select("_fp", "k.t", "k.key")
    hot = materialise(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket).select("t", "key", F.ceil(F.col("n") / hot_bucket).cast("int").alias("g")), "hot-buckets")
    found = hot.count()
    if found:
        rows = rows.join(F.broadcast(hot) if found <= MAX_BROADCAST_BUCKETS else hot, ["t", "key"], "left")
        own = F.pmod(F.xxhash64("_fp", F.lit(11)), F.col("g")).cast("int")
        pairs = F.when(F.col("g") > 1, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y"))))
        rows = rows.withColumn("p", F.explode(F.coalesce(pairs, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))))
        rows = rows.select("t", "key", "p.x", "p.y", "_fp")
    else:
        rows = rows.select("t", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), "_fp")
    dealt = rows.repartition(shuffle_partitions(spark), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return dealt.mapInArrow(_link_rows(radius), "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Fingerprints and near-duplicate components of all rows.

    Returns (rows, best). rows: the kept columns, `_fp` and `_row` (a number of its own for each row, fixed as the table is written).
    best: for each distinct `_fp`, `component_id`, the smallest id of its component, and `first_row`, the `_row` of the document that stays (the
    smallest id, then the smallest `_row`; rows without an id stay only where no row of the component has one).
    Null and blank texts have fingerprint 0 and are linked like others. Repeated rows are members of one component. An empty input gives empty tables."""
    keep = list(dict.fromkeys([id_col, *(keep or [])]))
    rows = materialise(with_fingerprint(df, text_col, keep).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    distinct = materialise(rows.groupBy("_fp").agg(F.min(order).alias("first")), "distinct-fingerprints")
    labels = connected_components(link_fingerprints(distinct.select("_fp"), radius), "a", "b")
    known = distinct.join(labels.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("label", F.coalesce("label", "_fp"))
    known = materialise(known, "labelled-fingerprints")
    smallest = known.groupBy("label").agg(F.min("first").alias("best"))
    best = materialise(known.select("_fp", "label").join(smallest, "label").select("_fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("first_row")), "components-of-fingerprints")
    for used in (distinct, labels, known):
        remove(used)
    return rows, best


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document: id, fingerprint (16 hexadecimal digits), component_id and `stays` (the one document of its component that is kept)."""
    rows, best = simhash_components(df, id_col, text_col, radius=radius)
    return rows.join(best, "_fp").select(F.col(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("_row") == F.col("first_row")).alias("stays"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of df, unchanged, of which one a component stays."""
    columns = list(df.columns)
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), F.col(id_col).alias(id_col), F.col(text_col).alias("_t"))
    rows, best = simhash_components(held, id_col, "_t", keep=["_all"], radius=radius)
    return rows.join(best.select(F.col("first_row").alias("_row")).distinct(), "_row", "left_semi").select("_all.*")
