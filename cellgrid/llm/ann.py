"""Nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are extended to equal norm (by sqrt(M^2 - |x|^2), M the largest norm), which turns the largest inner product into the least Euclidean distance.
Each of TABLES tables hashes with k functions floor((a.x + b) / w), a Gaussian. A query looks into its own bucket and then into buckets whose hashes
differ by one step in some functions, in the order of estimated success: the squared distance of the query to the borders it would have to cross,
of which the expected order over all queries gives one list of perturbations, filled in by each query's own sorted distances. The candidates of all
tables are merged and reranked by their exact inner products.

k, w and the number of probes are fitted on a bounded sample; every row is indexed. Equal vectors are held once with their smallest ids, as no more
than top + 1 of them can be in one answer. Buckets are dealt to groups of about GROUP_ROWS rows, larger ones split by hash, and a query goes once to each
group that holds any of its probes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import materialise

TOP, TABLES = 20, 8
#: The index is fitted on about so many vectors, of which QUERIES serve as queries.
SAMPLE, QUERIES = 8192, 160
#: Share of the sample's nearest neighbours that the fitted probes must reach.
TARGET = 0.95
MAX_PROBES = 2048
GROUP_ROWS, BUCKET_ROWS = 32_768, 48
#: Queries of a group are answered so many at a time, and queries that found too few neighbours so many in a pass over all rows.
CHUNK, PASS = 128, 4096
#: Queries that meet a group's rows in one task, and passes over all rows in one job.
TASK_QUERIES, JOB_PASSES = 32_768, 8


def perturbations(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of places among the 2k sorted border distances, cheapest first by their expected squares. Places i and 2k-1-i belong to one function's two borders and exclude each other."""
    z = [0.0] * (2 * k)
    for j in range(1, k + 1):
        z[j - 1] = j * (j + 1) / (4 * (k + 1) * (k + 2))
        z[2 * k - j] = 1 - j / (k + 1) + z[j - 1]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < most:
        cost, places = heapq.heappop(heap)
        if all(2 * k - 1 - p not in places for p in places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*places, last + 1)))
    return out


@dataclass(frozen=True)
class Hashing:
    """a: tables x k x (dim + 1); b: tables x k; sets: the perturbations as a matrix of places, padded with 2k."""

    a: np.ndarray
    b: np.ndarray
    width: float
    sets: np.ndarray
    largest: float

    def extend(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.column_stack([x / norm[:, None], np.zeros(len(x))])
        x = x / self.largest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))])

    def places(self, extended: np.ndarray) -> np.ndarray:
        """rows x tables x k: position in units of the width."""
        return np.einsum("nd,tkd->ntk", extended, self.a, optimize=True) / self.width + self.b

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One long for the k hashes (last axis)."""
        mixed = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
        for i in range(cells.shape[-1]):
            mixed = (mixed ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64)

    def row_keys(self, x: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.places(self.extend(x, False))))

    def probe_cells(self, x: np.ndarray) -> np.ndarray:
        """queries x tables x probes x k cells, the likeliest first."""
        at = self.places(self.extend(x, True))
        cell = np.floor(at)
        left = at - cell
        k = cell.shape[-1]
        cost = np.concatenate([left, 1 - left], axis=-1)
        order = np.argsort(cost, axis=-1, kind="stable")
        step = np.concatenate([np.where(order < k, -1, 1), np.zeros((*order.shape[:-1], 1), np.int64)], axis=-1)
        which = np.concatenate([order % k, np.zeros((*order.shape[:-1], 1), np.int64)], axis=-1)
        cells = np.repeat(cell[:, :, None, :], len(self.sets), axis=2)
        n, t = cell.shape[:2]
        rows = np.arange(n)[:, None, None], np.arange(t)[None, :, None], np.arange(len(self.sets))[None, None, :]
        for column in self.sets.T:
            np.add.at(cells, (*rows, which[:, :, column]), step[:, :, column])
        return cells


def _sets(k: int, probes: int) -> np.ndarray:
    found = perturbations(k, probes)
    most = max(len(s) for s in found)
    return np.array([[*s, *[2 * k] * (most - len(s))] for s in found], np.int64).reshape(len(found), most)


def fit(sample: np.ndarray, rows: int, largest: float, top: int = TOP, tables: int = TABLES, target: float = TARGET, seed: int = 5) -> Hashing:
    """Chooses k by the number of rows (about BUCKET_ROWS a bucket) and then the number of probes: the fewest that reach the target share of what are,
    in the sample, the nearest top * sample / rows neighbours (at least one). If MAX_PROBES are too few, k falls and buckets grow."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    every = max(1, len(sample) // QUERIES)
    asks = sample[::every][:QUERIES]
    near = max(1, round(top * len(sample) / max(rows, 1)))
    scores = asks @ sample.T
    scores[np.arange(len(asks)), np.arange(0, len(asks) * every, every)] = -np.inf
    near = min(near, max(1, len(sample) - 1))
    best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    k = max(1, int(np.ceil(np.log2(max(2, rows / BUCKET_ROWS)) / 1.3)))
    while True:
        a, b = rng.standard_normal((tables, k, dim + 1)), rng.random((tables, k))
        probe = Hashing(a, b, 1.0, np.zeros((1, 0), np.int64), largest)
        width = 2 * float(np.median(probe.places(probe.extend(sample, False)).std(axis=0))) or 1.0
        full = Hashing(a, b, width, _sets(k, min(MAX_PROBES, 3**k)), largest)
        keys = full.row_keys(sample)
        ranks = []
        for i in range(len(asks)):
            cells = full.keys(full.probe_cells(asks[i : i + 1]))[0]
            hit = [np.isin(cells[t], keys[best[i], t]) for t in range(tables)]
            for j in best[i]:
                ranks.append(min(int(np.argmax(cells[t] == keys[j, t])) if hit[t].any() and (cells[t] == keys[j, t]).any() else 1 << 30 for t in range(tables)))
        need = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1
        if need <= len(full.sets):
            return Hashing(a, b, width, full.sets[:need], largest)
        if k == 1:
            return full
        k -= 1


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of lists of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a finite, non-zero vector of the commonest length (ties: the shortest); repeated rows once."""
    fine = "id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(fine)
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common["n"] if common else 0)).distinct()


def _best(scores: np.ndarray, top: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores among which each row's `top` largest are: all that reach the top-th largest of every eighth column, less the rounding of a product."""
    width = scores.shape[1]
    part = scores[:, ::8] if width > 16 * top else scores
    if part.shape[1] <= top:
        floor = np.full(len(scores), -np.inf)
    else:
        floor = np.partition(part, part.shape[1] - top, axis=1)[:, part.shape[1] - top]
    return np.nonzero((scores >= floor[:, None] - slack) & (scores > -np.inf))


def _rounding(a: np.ndarray, b: np.ndarray) -> float:
    """How far two ways to add up one inner product can differ."""
    norm = lambda x: float(np.sqrt((x * x).sum(axis=1).max(initial=0)))
    return 4 * a.shape[1] * np.finfo(float).eps * norm(a) * norm(b)


def _ranked(ask_ids: np.ndarray, asks: np.ndarray, q: np.ndarray, r: np.ndarray, us: np.ndarray, lows: np.ndarray, xs: np.ndarray, top: int) -> list[np.ndarray]:
    """The candidates (q, r) with exact scores; for each query the `top` best, ties by the smallest id."""
    score = np.einsum("ij,ij->i", asks[q], xs[r])
    order = np.lexsort((us[r], lows[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < top
    return [ask_ids[q[keep]], us[r[keep]], lows[r[keep]], score[keep]]


FOUND = "ask long, u long, low long, score double"


def _found(parts: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    return pa.table([pa.array(c) for c in columns], names=["ask", "u", "low", "score"])


def _search(top: int):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return _found([])
        keys = rows["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, us, lows, xs = keys[order], rows["u"].to_numpy()[order], rows["low"].to_numpy()[order], matrix(rows["vec"])[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends, buckets = np.r_[starts[1:], len(keys)], keys[starts]
        ids, vecs = asks["ask"].to_numpy(), matrix(asks["vec"])
        probes = asks["keys"].combine_chunks()
        offsets, flat = probes.offsets.to_numpy(), probes.values.to_numpy()
        parts = []
        for a in range(0, len(ids), CHUNK):
            b = min(a + CHUNK, len(ids))
            wanted = flat[offsets[a] : offsets[b]]
            who = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
            hit = buckets[at] == wanted
            at, who = at[hit], who[hit]
            by = np.argsort(at, kind="stable")
            at, who = at[by], who[by]
            scores = np.full((b - a, len(keys)), -np.inf)
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
                s, e, q = starts[at[i]], ends[at[i]], who[i:j]
                scores[q, s:e] = vecs[a:b][q] @ xs[s:e].T
            q, r = _best(scores, top, _rounding(vecs[a:b], xs))
            parts.append(_ranked(ids[a:b], vecs[a:b], q, r, us, lows, xs, top))
        return _found(parts)

    return run


def _index(hashing, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = hashing.value.row_keys(matrix(batch.column(2)))
            for t in range(keys.shape[1]):
                g = t * groups + (keys[:, t].view(np.uint64) >> np.uint64(7)) % np.uint64(groups)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(keys[:, t]), *batch.columns], names=["g", "key", "u", "low", "vec"])

    return run


def _probe(hashing, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                keys = hashing.value.keys(hashing.value.probe_cells(matrix(batch.column(1))))
                n, tables, _ = keys.shape
                g = (keys.view(np.uint64) >> np.uint64(7)) % np.uint64(groups) + (np.arange(tables, dtype=np.uint64) * np.uint64(groups))[None, :, None]
                row = np.broadcast_to(np.arange(n)[:, None, None], keys.shape).ravel()
                flat, g = keys.ravel(), g.ravel().astype(np.int64)
                order = np.lexsort((g, row))
                row, flat, g = row[order], flat[order], g[order]
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(flat)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(g[cut]), batch.column(0).take(pa.array(row[cut])), batch.column(1).take(pa.array(row[cut])), lists], names=["g", "ask", "vec", "keys"])

    return run


def _scan(block, top: int):
    """All rows against one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = block.value
        for batch in batches:
            us, lows, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for a in range(0, len(ids) if len(us) else 0, CHUNK):
                q, r = _best(vecs[a : a + CHUNK] @ xs.T, top, _rounding(vecs[a : a + CHUNK], xs))
                yield _found([_ranked(ids[a : a + CHUNK], vecs[a : a + CHUNK], q, r, us, lows, xs, top)]).to_batches()[0]

    return run


def _top(found: DataFrame, n: int) -> DataFrame:
    """The n best candidates of each query. One found in several tables has the same rank each time, so each task passes on its n best before the shuffle."""
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "low", "u")
    return found.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= n).drop("_n").dropDuplicates(["ask", "u"])


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = TOP, tables: int = TABLES, sample_rows: int = SAMPLE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, id, score) for every row whose id is divisible by `every`: its `top` nearest found among all rows of another id, by inner product.

    Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part, nor do rows without an id; repeated
    rows count once. Equal scores rank by the smaller id. A query that found too few neighbours is compared with all rows, so every query gets `top` rows
    or all there are. An empty input gives no rows."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    smallest = Window.partitionBy("vec").orderBy("id")
    held = rows.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= top + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = materialise(held.select(F.monotonically_increasing_id().alias("u"), F.col("ids")[0].alias("low"), "vec", "ids"), "vectors")
    asks = materialise(rows.where(F.pmod("id", F.lit(every)) == 0), "queries")
    distinct_asks = materialise(asks.select("vec").distinct().select(F.monotonically_increasing_id().alias("ask"), "vec"), "query-vectors")
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.expr("aggregate(vec, 0D, (a, x) -> a + double(x) * double(x))"))).alias("m")).first()
    if not about["n"]:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    share = int(min(1.0, sample_rows / about["n"]) * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64("u", F.lit(17)), F.lit(1 << 30)) < share).select("vec").toArrow()  # about sample_rows rows
    sample = matrix(sample["vec"]) if sample.num_rows else matrix(vectors.limit(1).select("vec").toArrow()["vec"])
    hashing = spark.sparkContext.broadcast(fit(sample, about["n"], about["m"], top, tables))
    groups = max(1, -(-about["n"] // group_rows))
    kind = vectors.schema["vec"].dataType.simpleString()
    index = vectors.select("u", "low", "vec").mapInArrow(_index(hashing, groups), f"g long, key long, u long, low long, vec {kind}")
    probes = distinct_asks.mapInArrow(_probe(hashing, groups), f"g long, ask long, vec {kind}, keys array<long>")
    hot = materialise(index.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * group_rows).select("g", F.ceil(F.col("n") / group_rows).alias("parts")), "hot-groups")
    if hot.limit(1).count():
        index = index.join(hot, "g", "left").withColumn("c", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")), F.lit(0).cast("long")))
        probes = probes.join(hot, "g", "left").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long")))))
    else:
        index, probes = index.withColumn("c", F.lit(0).cast("long")), probes.withColumn("c", F.lit(0).cast("long"))
    parts = -(-max(1, distinct_asks.count()) // TASK_QUERIES)
    index = index.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("g", "c", "p", "key", "u", "low", "vec")
    probes = probes.withColumn("p", F.pmod(F.xxhash64("ask", F.lit(23)), F.lit(parts)).cast("int")).select("g", "c", "p", "ask", "vec", "keys")
    found = index.groupBy("g", "c", "p").cogroup(probes.groupBy("g", "c", "p")).applyInArrow(_search(top + 1), FOUND)
    found = materialise(_top(found, top + 1), "found")
    enough = min(top + 1, about["n"])
    short = materialise(distinct_asks.join(found.groupBy("ask").count().where(F.col("count") >= enough), "ask", "left_anti"), "short-queries")
    missing = short.count()
    blocks = -(-missing // PASS)
    for k in range(blocks):
        part = short.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == k).toArrow()
        if part.num_rows:
            block = spark.sparkContext.broadcast((part["ask"].to_numpy(), matrix(part["vec"])))
            found = found.union(vectors.select("u", "low", "vec").mapInArrow(_scan(block, top + 1), FOUND))
            if k % JOB_PASSES == JOB_PASSES - 1:
                found = materialise(_top(found, top + 1), "found")
    if missing:
        found = _top(found, top + 1)
    who = asks.join(distinct_asks, "vec").select(F.col("id").alias("query_id"), "ask")
    each = found.join(vectors.select("u", "ids"), "u").select("ask", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = who.join(each, "ask").where("id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
