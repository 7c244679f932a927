"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text becomes a digest of its shingle set and 51 buckets of 10 bins. Texts with one set form a class, and only
   one of them goes on, so a group of copies costs one aggregated row.
2. In each bucket all members are paired with one centre: the member whose buckets are the fullest, which is the one
   that most others were derived from. A bucket of n gives n - 1 pairs.
3. Pairs are confirmed on the whole sets, and components are built from the links.
4. Where a bucket without its centre still holds several components, each member outside its largest one is held
   against all members of other components: in blocks of at most BLOCK shingles or so, whose sets meet in one task
   and which give links only, never pairs. So every two members of a bucket are either known to be connected or have
   been compared on whole sets: star-shaped candidates lose no link that the buckets hold.

Two texts at the threshold share a bucket with a chance of 1 - (1 - 0.85**10)**51, that is all but 14 in a million;
at a similarity of 0.5 it is 5 percent, at a third 1 in a thousand, so texts that share a passage seldom meet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import Members, connected, in_batches, scoped, written, written_in_batches

PERCENT = 85
#: Shingles of a bucket's members that one task holds at once; larger buckets are dealt to several tasks.
BLOCK = 1 << 20
_SET = pa.schema([("node", pa.int64()), ("set", pa.binary())])
_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, kernels.by_text(kernels.signature, _SIGNATURE, ["doc_id"]), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar enough; only the texts of such rows are shuffled.

    a is the centre: b's text joins first, so that a centre's text is not carried through a shuffle once for each pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = Members(ends, "id").marked(texts, "wanted", F.col("id")).where("wanted").select("id", "text")
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    both = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    return in_batches(both.select("a", "b", "a_text", "b_text"), kernels.linked(percent), "a long, b long")


@scoped
def near_links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) for each representative that is linked with another. reps: (node, n, bands).

    A node with several texts has a row for each; their sizes become the bounds least and most of its sizes.
    """
    placed = reps.select("node", "n", F.explode("bands").alias("bucket"))
    shared = written(placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    met = Members(shared, "bucket").marked(placed, "met", F.col("bucket")).where("met").drop("met")
    sizes = (F.min("n").alias("least"), F.max("n").alias("most"))
    placed = written(met.join(shared, "bucket").groupBy("bucket", "node").agg(F.max("members").alias("members"), *sizes), "placed")
    scores = placed.groupBy("node").agg(F.sum("members").alias("score"), F.min("least").alias("least"), F.max("most").alias("most"))
    scores = written(scores, "scores")
    # Buckets with the same members have the same centre and the same pairs: one of them stays. A node is in a bucket
    # once, else it would cancel out.
    prints = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"p{i}") for i in (1, 2)]
    alike = placed.groupBy("bucket").agg(F.count("*").alias("members"), *prints).where("members > 1")
    alike = alike.groupBy("p1", "p2", "members").agg(F.min("bucket").alias("bucket"))
    placed = placed.join(alike.select("bucket"), "bucket").select("bucket", "node")
    placed = written(placed.join(scores, "node"), "different")
    fits = f"100 * least(most, a_most) >= {percent} * greatest(least, a_least)"  # else the sizes alone rule a link out
    centres = placed.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"), "least", "most")).alias("c"))
    centres = centres.select("bucket", (-F.col("c.minus")).alias("a"), F.col("c.least").alias("a_least"), F.col("c.most").alias("a_most"))
    centres = written(centres, "centres")
    stars = placed.join(centres, "bucket").where(f"node <> a and {fits}").select("a", F.col("node").alias("b")).distinct()
    tested = written(stars, "stars")
    links = written_in_batches(_confirmed(docs, tested, percent), "links")
    found = connected(links)

    label = F.coalesce("component", "node").alias("label")
    others = placed.join(centres, "bucket").where("node <> a")  # the centre has been compared with all of them
    now = written(others.join(found, "node", "left").select("bucket", "node", F.col("most").alias("n"), label), "others")
    parts = written(now.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("size")), "labels").groupBy("bucket")
    parts = parts.agg(F.max(F.struct("c", "label", "size")).alias("top"), F.sum("c").alias("all"), F.sum("size").alias("size")).where("all > top.c")
    blocks = (F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("size", "rows"), ("rest", "columns")))
    parts = written(parts.withColumn("rest", F.expr("size - top.size")).select("bucket", F.col("top.label").alias("top"), *blocks), "open")
    now = now.join(parts, "bucket").withColumn("deal", F.xxhash64("node", "bucket"))
    # Bit 1 of role: a member; bit 2: one that is held against the members of its block.
    member = "transform(sequence(0, columns - 1), y -> struct(cast(pmod(deal, rows) as int) as x, y, 1 as role))"
    stray = "transform(sequence(0, rows - 1), x -> struct(x, cast(pmod(deal, columns) as int) as y, 2 as role))"
    whole = "array(struct(0 as x, 0 as y, if(label = top, 1, 3) as role))"
    cells = F.expr(f"case when rows = 1 and columns = 1 then {whole} when label = top then {member} else concat({member}, {stray}) end")
    now = written(now.select("bucket", "node", "label", F.explode(cells).alias("cell")).select("bucket", "node", "label", "cell.*"), "blocks")
    ids = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    ids = Members(now.select("node").distinct(), "node").marked(ids, "wanted", F.col("node")).where("wanted").select("node", "text")
    sets = in_batches(ids, kernels.by_text(lambda b: (kernels.shingles(b).tobytes(),), _SET, ["node"]), "node long, set binary").where("length(set) > 0")
    more = now.join(sets, "node").groupBy("bucket", "x", "y").applyInArrow(kernels.strangers(percent), "a long, b long")
    more = written_in_batches(more, "links")
    return found if more.isEmpty() else connected(links.union(more))


@scoped
def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    A text without words, and a row without a doc_id, is linked with nothing: its component_id is its doc_id, kept is
    true. Rows that share a doc_id are one document, in one component. A very long text is used whole. An empty table
    gives no rows; other columns are not read.
    """
    signed = written_in_batches(signatures(docs), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    classes = written(classes, "classes")
    reps = usable.join(classes.withColumn("doc_id", F.col("node")), ["d1", "d2", "doc_id"])
    reps = reps.dropDuplicates(["d1", "d2", "doc_id"])  # a row may repeat
    reps = written(reps.select("node", F.col("n_shingles").alias("n"), "bands"), "representatives")
    found = near_links(docs, reps, percent)
    named = classes.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(linked, F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


@scoped
def near_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns; only rows that may go are shuffled."""
    lost = written(near_dedup(docs).where("not kept").select(F.col("doc_id").alias("lost")).distinct(), "lost")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = Members(lost, "lost").marked(rows, "suspect", F.col("row.doc_id").cast("long"))
    kept = rows.where("suspect").join(lost, F.col("row.doc_id") == F.col("lost"), "left_anti")
    return rows.where("not suspect").select("row.*").union(kept.select("row.*"))
