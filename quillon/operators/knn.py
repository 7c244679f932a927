"""Exact nearest neighbours, vote, decision and response.

Neighbours are ordered by (distance, idx), so ties are settled the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import distance
from .blocks import ASKED, BLOCK, FOUND, Boxes, Planes, celled, packed, searched, sent_home, unpacked
from .shared import scoped, written

K, DENY_FROM = 5, 3
#: Queries that are searched at once, most references in a block, and query blocks that a task holds against a block.
QUERY_BLOCK, REF_BLOCK, TASK_BLOCKS = 8192, 32768, 16
#: Few references are dealt into BLOCKS blocks, but for blocks of less than SMALL_BLOCK.
BLOCKS, SMALL_BLOCK = 64, 2048
#: References that the cuts are made from: in all, and for each cell.
SAMPLE, CELL_SAMPLE = 200_000, 256
MOST_TASKS = 4096
_NEAREST = "qid long, idx long, dist long, fraud int"


def pairs(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Every query with every reference and their distance, in generated code. For a stated, small query set."""
    q = queries.select("qid", F.col("v").alias("q"))
    return refs.crossJoin(q).select("qid", "idx", distance("q", "v").alias("dist"), "fraud")


def first_k(scored: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of each query with their rank; the partial limit below the shuffle keeps k per task."""
    by = Window.partitionBy("qid").orderBy("dist", "idx")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def blocked(members: DataFrame, size: int) -> tuple[DataFrame, Boxes]:
    """members (cell, idx, v, fraud), those of a cell in one task or in neighbouring ones, as blocks, and the boxes of all blocks."""
    rows = members.select("cell", "idx", "v", "fraud").mapInArrow(packed(size), BLOCK)
    blocks = written(rows, "blocks")
    return blocks, Boxes(blocks.select("block", "lo", "hi", "first").orderBy("block").collect())


def _met(asked: DataFrame, blocks: DataFrame, k: int, boxes: Boxes | None) -> DataFrame:
    """FOUND of the queries asked, each in the block that it names. A block that very many ask is searched by several tasks."""
    most = QUERY_BLOCK * TASK_BLOCKS
    parts = written(asked.groupBy("block").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts")), "parts")
    n = parts.agg(F.sum("parts")).first()[0] or 1
    empty = F.lit(None).cast("binary")
    part = F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part")
    q = asked.join(parts, "block").select("block", part, F.lit(1).alias("kind"), F.col("qid").alias("a"), F.col("q").alias("b"), F.col("dist").alias("c"), F.col("idx").alias("d"))
    r = blocks.join(parts, "block").select("block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("kind"), F.col("idx").alias("a"), F.col("v").alias("b"), F.col("fraud").alias("c"), F.col("starts").alias("d"))
    rows = r.union(q).repartition(min(n, MOST_TASKS), "block", "part").sortWithinPartitions("block", "part", "kind")
    return written(rows.mapInArrow(searched(k, QUERY_BLOCK, boxes), FOUND), "found")


def over_blocks(queries: DataFrame, blocks: DataFrame, boxes: Boxes, k: int) -> DataFrame:
    """(qid, rank, idx, dist, fraud) of the k nearest rows in blocks, exactly, in two rounds: the nearest block of each
    query, then those that may hold nearer rows. The driver holds the boxes alone."""
    if not len(boxes.block):  # no references
        return queries.sparkSession.createDataFrame([], "qid long, rank int, idx long, dist long, fraud int")
    asked = written(queries.select("qid", "v").mapInArrow(sent_home(boxes, QUERY_BLOCK * TASK_BLOCKS), ASKED), "asked")
    first = _met(asked, blocks, k, boxes)
    found = first.where("block is null")
    if len(boxes.block) > 1:
        found = found.union(_met(first.where("block is not null").drop("fraud"), blocks, k, None))
    near = found.select("qid", "idx", "dist", "fraud").mapInArrow(unpacked, _NEAREST)
    return first_k(near, k).select("qid", "rank", "idx", "dist", "fraud")


@scoped
def nearest(queries: DataFrame, refs: DataFrame, k: int = K) -> DataFrame:
    """(qid, rank, idx, dist, fraud) of the k nearest references of each query, exactly.

    A tree of cuts, made from SAMPLE references at most, deals all references into cells of nearby rows, which become
    blocks of REF_BLOCK or so. The sample only decides where to cut: each row is in a block, and a block is left out
    only for queries whose k-th distance so far is below its box's. Blocks and queries are shuffled, packed; a task
    returns at most k rows for a query and block.
    """
    n = refs.count()
    size = min(REF_BLOCK, max(SMALL_BLOCK, -(-n // BLOCKS)))
    n_cells = max(1, -(-n // size))
    rows, want = refs.select("idx", "v", F.col("fraud").cast("int").alias("fraud")), min(SAMPLE, CELL_SAMPLE * n_cells)
    if n_cells > 1:
        drawn = rows.select("idx", "v").where(F.pmod(F.xxhash64("idx"), F.lit(n)) < want).toArrow()
        v = drawn["v"].combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, -1)
        planes = Planes(v, drawn["idx"].to_numpy(), n_cells)
        members = rows.mapInArrow(celled(planes), "cell long, idx long, v array<int>, fraud int").repartition(n_cells, "cell")
    else:
        members = rows.withColumn("cell", F.lit(0).cast("long")).repartition(1)
    return over_blocks(queries, *blocked(members, REF_BLOCK), k)


@scoped
def within(queries: DataFrame, members: DataFrame, k: int = K) -> DataFrame:
    """nearest() over members of cells (cell, idx, v, fraud): blocks are cells, parts of a large one or several small ones."""
    n = members.count()
    dealt = members.repartitionByRange(max(1, -(-n // (2 * REF_BLOCK))), "cell", "idx")
    return over_blocks(queries, *blocked(dealt, REF_BLOCK), k)


def threshold(neighbours: DataFrame, k: int = K) -> DataFrame:
    """(qid, tau): the k-th distance, null with fewer than k neighbours."""
    return neighbours.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("dist")).alias("tau"))


def vote(neighbours: DataFrame) -> DataFrame:
    """(qid, fraud_count, n_neighbors), over real neighbours only."""
    return neighbours.groupBy("qid").agg(F.sum("fraud").cast("int").alias("fraud_count"), F.count("*").cast("int").alias("n_neighbors"))


def decision(fraud_count: Column) -> tuple[Column, Column]:
    """(approved, fraud_score)."""
    return fraud_count < DENY_FROM, fraud_count / F.lit(float(K))


def decided(votes: DataFrame) -> DataFrame:
    approved, score = decision(F.col("fraud_count"))
    return votes.select("qid", "fraud_count", approved.alias("approved"), score.alias("fraud_score"))


def response(approved: Column, score: Column) -> Column:
    return F.to_json(F.struct(approved.alias("approved"), score.alias("fraud_score")))


def safe(requests: DataFrame, votes: DataFrame) -> DataFrame:
    """Every request's decision: one that could not be read is approved with score 0."""
    joined = requests.select("qid", "parse_ok").join(votes.select("qid", "fraud_count"), "qid", "left")
    approved, score = decision(F.coalesce("fraud_count", F.lit(0)))
    return joined.select("qid", "parse_ok", approved.alias("approved"), score.alias("fraud_score"))
