"""Cells of the reference set: k-means in integer arithmetic, and a median-split tree. Both give (members, cells)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import DIMS
from .shared import scoped, written

#: Rows whose tie is settled by sorting their ids in one group.
TIE_BLOCK = 4096
_MEMBER = "cell long, idx long, v array<int>, fraud int"
_TREE = 1 << 62


def seeds(refs: DataFrame, n_cells: int) -> DataFrame:
    """(cell, idx, v): the vectors at idx 0, s, 2s ... with s = n div n_cells; idx is dense from 0."""
    n = refs.count()
    if n < n_cells or n_cells < 1:
        raise ValueError("as many references as cells are needed")
    step = n // n_cells
    return refs.where((F.col("idx") % step == 0) & (F.col("idx") < step * n_cells)).select((F.col("idx") / step).cast("long").alias("cell"), "idx", "v")


def _nearest_cell(centroids: np.ndarray) -> Callable:
    c = centroids.astype(np.float64)
    norm = (c**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                cell = np.concatenate([(norm - 2 * (x @ c.T)).argmin(axis=1) for x in np.array_split(v, -(-len(v) // 2048))])  # the first of equals
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *(batch[k] for k in ("idx", "v", "fraud"))], names=["cell", "idx", "v", "fraud"])

    return run


def assigned(refs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """members: each reference with its nearest centroid, of equal ones the lowest. Row-local."""
    return refs.select("idx", "v", F.col("fraud").cast("int").alias("fraud")).mapInArrow(_nearest_cell(centroids), _MEMBER)


def means(members: DataFrame) -> DataFrame:
    """(cell, v): the mean of each cell, truncated toward zero; aggregated map-side."""
    sums = members.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(DIMS)])
    return sums.select("cell", F.array(*[F.expr(f"cast(s{i} div n as int)") for i in range(DIMS)]).alias("v"))


def kmeans(refs: DataFrame, n_cells: int, iterations: int) -> DataFrame:
    """members after so many assignments, with an update between two of them; an empty cell keeps its centroid.

    The driver holds the centroids alone: n_cells vectors.
    """
    if iterations < 1:
        raise ValueError("at least one iteration")
    centroids = np.array([r["v"] for r in seeds(refs, n_cells).orderBy("cell").collect()], np.int64)
    for _ in range(iterations - 1):
        for r in means(assigned(refs, centroids)).collect():
            centroids[r["cell"]] = r["v"]
    return assigned(refs, centroids)


def boxes(members: DataFrame) -> DataFrame:
    """(cell, n, blocks, bmin, bmax)"""
    aggs = [f(F.col("v")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)]
    boxed = members.groupBy("cell").agg(F.count("*").alias("n"), *aggs)
    lo, hi = (F.array(*[F.col(f"{name}{i}") for i in range(DIMS)]) for name in ("lo", "hi"))
    return boxed.select("cell", "n", F.ceil(F.col("n") / 8.0).cast("long").alias("blocks"), lo.alias("bmin"), hi.alias("bmax"))


def split_dims(boxed: DataFrame) -> DataFrame:
    """boxed with the widest dimension (of equal ones the lowest) and its spread."""
    spread = F.transform(F.arrays_zip("bmin", "bmax"), lambda b: b["bmax"] - b["bmin"])
    widest = boxed.withColumn("spread", F.array_max(spread))
    return widest.withColumn("dim", (F.array_position(spread, F.col("spread")) - 1).cast("int"))


def _pivots(members: DataFrame, splits: DataFrame) -> DataFrame:
    """(cell, dim, px, pi): value and idx of the last member that goes left, n div 2 of them by (value, idx).

    Found from counts by value, then by block of idx, so no cell is sorted as a whole.
    """
    rows = members.join(splits.select("cell", "dim", F.expr("n div 2").alias("half")), "cell").select("cell", "idx", "dim", "half", F.element_at("v", F.col("dim") + 1).alias("x"))

    def reached(counts: DataFrame, by: str, need: str) -> DataFrame:
        upto = F.sum("c").over(Window.partitionBy("cell").orderBy(by))
        at = counts.withColumn("upto", upto).where(f"upto >= {need} and upto - c < {need}")
        return at.withColumn("rest", F.expr(f"{need} - (upto - c)"))

    by_value = rows.groupBy("cell", "dim", "half", "x").agg(F.count("*").alias("c"))
    value = reached(by_value, "x", "half").select("cell", F.col("x").alias("px"), F.col("rest").alias("r1"))
    ties = rows.join(value, "cell").where("x = px").withColumn("block", F.expr(f"idx div {TIE_BLOCK}"))
    by_block = ties.groupBy("cell", "dim", "px", "r1", "block").agg(F.count("*").alias("c"))
    block = reached(by_block, "block", "r1").select("cell", F.col("block").alias("pb"), F.col("rest").alias("r2"))
    last = ties.join(block, "cell").where("block = pb").groupBy("cell", "dim", "px", "r2").agg(F.array_sort(F.collect_list("idx")).alias("ids"))  # at most TIE_BLOCK ids
    return last.select("cell", "dim", "px", F.element_at("ids", F.col("r2").cast("int")).alias("pi"))


@scoped
def kd_tree(refs: DataFrame, leaf_max: int, most_levels: int = 60) -> DataFrame:
    """members of the tree's leaves. The root is cell 1, the halves of cell c are 2c and 2c + 1.

    One level a round: a cell with more than leaf_max members and a spread is split at the median of its widest
    dimension. Each level is written, so a lost executor costs one level at most. Each split halves a cell, so
    most_levels is more than any table needs.
    """
    members = written(refs.select(F.lit(1).cast("long").alias("cell"), "idx", "v", F.col("fraud").cast("int").alias("fraud")), "kd")
    for _ in range(most_levels + 1):
        splits = written(split_dims(boxes(members)).where(f"n > {leaf_max} and spread > 0").select("cell", "n", "dim"), "splits")
        if splits.isEmpty():
            return members
        pivots = written(_pivots(members, splits), "pivots")
        x = F.element_at("v", F.col("dim") + 1)
        left = (x < F.col("px")) | ((x == F.col("px")) & (F.col("idx") <= F.col("pi")))
        cell = F.when(F.col("dim").isNull(), F.col("cell")).when(left, F.col("cell") * 2).otherwise(F.col("cell") * 2 + 1)
        members = written(members.join(pivots, "cell", "left").select(cell.alias("cell"), "idx", "v", "fraud"), "kd")
    raise ValueError(f"cells of more than {leaf_max} members are left after {most_levels} levels")


VERSION = 1


def save(members: DataFrame, path: str, kind: str) -> None:
    """An index as Parquet: members sorted by cell (row groups prune by it), cells, and what it is."""
    spark = members.sparkSession
    members.repartitionByRange("cell").sortWithinPartitions("cell", "idx").write.mode("overwrite").parquet(f"{path}/members")
    boxes(spark.read.parquet(f"{path}/members")).write.mode("overwrite").parquet(f"{path}/cells")
    spark.range(1).select(F.lit(kind).alias("kind"), F.lit(VERSION).alias("version"), F.lit(DIMS).alias("dims")).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, cells) of a saved index; another version or dimension is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION or meta["dims"] != DIMS:
        raise ValueError(f"an index of version {meta['version']} with {meta['dims']} dimensions")
    return spark.read.schema(_MEMBER).parquet(f"{path}/members"), spark.read.parquet(f"{path}/cells")


@scoped
def build_index(spark: SparkSession, refs_path: str, out: str, n_cells: int = 2048, iterations: int = 12) -> None:
    """From a JSON reference file to a saved k-means index."""
    from ..sources.references import load_references

    refs = written(load_references(spark, refs_path), "references")
    save(kmeans(refs, n_cells, iterations), out, "kmeans")
