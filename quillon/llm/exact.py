"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Each step drops the rows that are alone in their group, so that the next and dearer one reads only the rest: whole
texts are hashed for surviving groups alone. The survivors of a step travel as a filter of fixed size (Members), not
as a list, so no text is shuffled to find out whether it needs another look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Members, scoped, written

#: Characters in the prefix.
PREFIX = 256


def _text() -> Column:
    return F.coalesce(F.col("row.text").cast("string"), F.lit(""))


def _shared(rows: DataFrame, *by: str) -> Members:
    """The keys that two rows or more have."""
    return Members(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), *by)


@scoped
def exact_dedup(docs: DataFrame, columns: list[str] | None = None, every_digest: bool = False) -> DataFrame:
    """Each row as struct row (its columns, or those named), with keep_id, group_size, kept, and digest.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id stays (a null
    one is below all others; of equal ids exactly one row stays), keep_id is its doc_id. digest is the text's SHA-256
    where the refinement had to compute it, else null, but for every_digest. A very long text is hashed whole. Empty tables give no rows; clashing columns live in row.
    """
    columns = columns or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = rows.withColumn("size", F.octet_length(_text()).cast("long"))
    same_size = _shared(sized.select("size"), "size")
    sized = same_size.marked(sized, "again", F.col("size"))
    headed = sized.withColumn("head", F.when(F.col("again"), F.xxhash64(F.substring(_text(), 1, PREFIX))))
    same_head = _shared(headed.where("again").select("size", "head"), "size", "head")
    headed = same_head.marked(headed, "suspect", F.col("size"), F.col("head"))
    short = F.struct(*[F.col(f"row.`{c}`") for c in columns]).alias("row")
    doc_id = F.col("row.doc_id").cast("long").alias("doc_id")
    open_rows = headed.where("suspect and again").select(doc_id, short, "size", "head", F.sha2(_text().cast("binary"), 256).alias("digest"))
    open_rows = written(open_rows.withColumn("uid", F.monotonically_increasing_id()), "suspects")
    best = F.max(F.struct("doc_id", "uid")).alias("best")
    groups = open_rows.groupBy("size", "head", "digest").agg(best, F.count("*").alias("group_size"))
    groups = written(groups.where("group_size > 1"), "groups")
    joined = open_rows.join(groups, ["size", "head", "digest"], "left")
    alone = F.col("best").isNull()
    found = joined.select("row", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                          F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                          (alone | (F.col("best.uid") == F.col("uid"))).alias("kept"), "digest")
    single = headed.where("not (suspect and again)").select(short, doc_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), (F.sha2(_text().cast("binary"), 256) if every_digest else F.lit(None).cast("string")).alias("digest"))
    return found.union(single)


def exact_filter(docs: DataFrame) -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns."""
    return exact_dedup(docs).where("kept").select("row.*")


def exact_query(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row."""
    done = exact_dedup(docs.select("doc_id", "text"), ["doc_id"], every_digest=True)
    return done.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
