"""What the operators of this package share: scratch tables, text columns and deterministic samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/cellgrid-scratch-{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df once as a shared table and reads it back: lineage ends there, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cellgrid_path = path
    return back


def remove(df: DataFrame) -> None:
    """Deletes the table behind a materialised frame that nothing reads any more."""
    if path := getattr(df, "_cellgrid_path", None):
        delete_path(df.sparkSession, path)


@contextmanager
def scratch_of_a_step(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables that are made within it, whether it succeeds or fails. Frames that read them are void afterwards."""
    made = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        for path in made[before:]:
            delete_path(spark, path)
        del made[before:]


def cleanup(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Frames that read them are void afterwards."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column | str, folds: int) -> Column:
    """crc32 of the value as text, modulo folds; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % folds


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Steps of the order of a sample for each doubling of it.
LEVELS_A_DOUBLING = 32


def part_of(text: Column, chars: int, by: list[str], seed: int = 5) -> Column:
    """The text, or `chars` characters of a longer one from a place that a hash chooses. For samples only: what is scored is read whole."""
    spare_chars = F.length(text) - chars
    return F.when(spare_chars <= 0, text).otherwise(F.substring(text, F.pmod(F.xxhash64(*by, F.lit(seed)), F.greatest(spare_chars, F.lit(0)) + 1).cast("int") + 1, F.lit(chars)))


def thin(df: DataFrame, by: list[str], weight: Column, limit: int, strata: str | None = None, seed: int = 7) -> DataFrame:
    """A deterministic sample of about `limit` units of weight in each stratum (all rows where there are fewer): rows in the order of a hash until the limit is reached, so no
    stratum with rows is left empty.

    The order is cut at one of LEVELS_A_DOUBLING steps for each doubling, so a sample is about a fiftieth over the limit, or by the weight of the rows of its last step. Only the weights
    of the steps, at most 62 * LEVELS_A_DOUBLING a stratum, reach the driver. Rows of equal `by` are taken together. Null strata and null or negative weights are none."""
    hashed = F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit((1 << 62) - 1)) + 1
    level = F.floor(F.log2(hashed.cast("double")) * LEVELS_A_DOUBLING).cast("int")
    stratum = F.col(strata) if strata else F.lit(0)
    steps = df.where(stratum.isNotNull()).groupBy(stratum.alias("_s"), level.alias("_l")).agg(F.coalesce(F.sum(F.greatest(weight, F.lit(0))), F.lit(0)).alias("_w")).collect()
    sums: dict = {}
    keep = F.lit(False)
    for row in sorted(steps, key=lambda r: r["_l"]):
        before, last = sums.get(row["_s"], (0, None))
        if before < limit or last is None:
            sums[row["_s"]] = (before + row["_w"], row["_l"])
    for value, (_, last) in sums.items():
        keep = keep | ((stratum == F.lit(value)) & (level <= last))
    return df.where(keep)


def others(df: DataFrame, added: list[str]) -> list[Column]:
    """The columns of df beside those to be added; Spark's names ignore case."""
    taken = {c.lower() for c in added}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def spare(df: DataFrame, name: str) -> str:
    """The name, with underscores until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
