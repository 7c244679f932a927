"""What the operators share: written tables in the shared folder, and a membership filter sized by its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import release, scope, scoped, settings, shared_folder, written  # noqa: F401

_PAGE = 32_768  # bits in one bitmap of bitmap_construct_agg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch of a step that is written at once. Bytes are bounded by spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_ROWS = 500


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow. Batches have at most the session's number of rows and bytes; run goes through them row by row."""
    return df.mapInArrow(run, schema)


def written_in_batches(df: DataFrame, name: str) -> DataFrame:
    """written(), with BATCH_ROWS rows in an Arrow batch for as long as the writing lasts."""
    with settings(df.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch=str(BATCH_ROWS)):
        return written(df, name)


class Members:
    """A filter over hashes of keys: no false negatives, few false positives. Rows that it rules out need no join.

    A key's hash names a page and a bit in it by each of SHIFTS; with BITS_A_KEY bits for a key that lets through
    about one in a hundred of the other rows, at every input size. Up to MOST_BITS it is broadcast, as bitmaps of 4 KB.
    Beyond that the hashes stay a table, and marked() joins with it, so nothing that is broadcast grows without a bound.
    """

    BITS_A_KEY = 16
    MOST_BITS = 1 << 28
    #: Where in the hash the bits' places begin, 15 bits each; the 19 lowest bits name the page.
    SHIFTS = (49, 34, 19)

    def __init__(self, keys: DataFrame, *by: str):
        hashed = written(keys.select(F.xxhash64(*by).alias("key")), "keys")
        self.n_pages = max(1, -(-self.BITS_A_KEY * hashed.count() // _PAGE))
        self.keys = hashed if self.n_pages * _PAGE > self.MOST_BITS else None
        if self.keys is None:
            places = F.array(*(F.expr(self._place("key", s)) for s in self.SHIFTS))
            slots = hashed.select(F.expr(self._page("key")).alias("page"), F.explode(places).alias("slot"))
            made = slots.groupBy("page").agg(F.expr("bitmap_construct_agg(cast(slot as long))").alias("bits"))
            half = "cast(conv(hex(substring(bits, cast(8 * i + {} as int), 4)), 16, 10) as long)"
            words = f"transform(sequence(0, {_PAGE // 64 - 1}), i -> shiftleft({half.format(1)}, 32) | {half.format(5)})"
            self.pages = written(made.select("page", F.expr(words).alias("words")), "members")

    def _page(self, key: str) -> str:
        return f"cast(({key} & {(1 << min(self.SHIFTS)) - 1}) % {self.n_pages} as int)"

    def _place(self, key: str, shift: int) -> str:
        return f"cast(shiftrightunsigned({key}, {shift}) & {_PAGE - 1} as int)"

    def marked(self, rows: DataFrame, flag: str, *keys: Column) -> DataFrame:
        """rows with a boolean column flag: false where the keys are certainly not among the filter's."""
        own, key, page, words = rows.columns, f"__slot_{flag}", f"__page_{flag}", f"__words_{flag}"
        rows = rows.withColumn(key, F.xxhash64(*keys))
        if self.keys is not None:
            there = self.keys.select(F.col("key").alias(page)).distinct()
            joined = rows.join(there, F.col(key) == F.col(page), "left")
            return joined.select(*own, F.col(page).isNotNull().alias(flag))
        pages = self.pages.select(F.col("page").alias(page), F.col("words").alias(words))
        joined = rows.join(F.broadcast(pages), F.expr(self._page(key)) == F.col(page), "left")

        def bit(place: str) -> str:
            # Bit s of a bitmap is bit s % 8 of byte s / 8; a word has eight bytes, the first one highest.
            at = f"56 - 8 * cast({place} % 64 div 8 as int) + {place} % 8"
            return f"getbit(get({words}, cast({place} div 64 as int)), {at}) = 1"

        held = " and ".join(bit(self._place(key, s)) for s in self.SHIFTS)
        return joined.select(*own, F.expr(f"coalesce({held}, false)").alias(flag))

    def maybe(self, rows: DataFrame, *keys: Column, other: tuple[Column, ...] | None = None) -> DataFrame:
        """The rows that may be members, by keys or by other, ahead of an exact join; all rows where the filter is too
        large to broadcast."""
        if self.keys is not None:
            return rows
        found = self.marked(rows, "__maybe", *keys)
        if other:
            found = self.marked(found, "__other", *other)
        return found.where("__maybe or __other" if other else "__maybe").select(*rows.columns)


#: Links that a task of connected() writes: few links get few files.
LINKS_A_TASK = 500_000


@scoped
def connected(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, component) for each node that has a link; component is the smallest node.

    Alternating large and small stars; each round is two aggregates and two joins, and its links are written to the
    shared folder, in as many files as their number asks for. No neighbourhood is collected: a node with very many
    links is aggregated map-side, and the join back is one that adaptive execution can split.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    def put(df: DataFrame, name: str) -> DataFrame:
        return written(df.coalesce(-(-after[0] // LINKS_A_TASK)), name)

    now = written(oriented(links), "links")
    before, after = None, state(now)
    while after[0] and before != after:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = put(oriented(large), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = least.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = put(oriented(small), "links")
        before, after = after, state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    every = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    return put(every, "components") if after[0] else written(every, "components")
