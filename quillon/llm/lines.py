"""Line dedup: an exact set-similarity join by parts of token sets, over built-in expressions.

A line's tokens are its distinct words in lower case, as 64-bit hashes. The corpus is cut into words once: one written
table holds each line's tokens, and all later steps read that.

Lines with equal tokens form a class, which is judged by its earliest line. Two sets that are similar enough differ in
d tokens at most, which their sizes tell: of d + 1 parts, cut by ranges of the hash, one is the same in both. A line is
filed under a hash of each of its parts, of some ten tokens each, so that lines meet which have ten tokens in common and
seldom by chance, and what is filed grows with the input. A line files its parts for each number of parts that a larger
partner may ask for: mostly one or two. Only parts that two lines have are filed: the others are ruled out by a filter
before anything is shuffled.

A line also carries 64 bits, each of which says whether an odd number of its tokens fall there: no two sets differ in
fewer tokens than in bits. Pairs whose sizes and bits allow it are verified on whole token sets.

Lines that share a passage may have a part in common with very many others. Those in a part of more than MANY lines
are held against each other by their rarest tokens instead: two similar lines share one of these (prefix filter), with
enough tokens left after it (positional filter). How rare a token is among them comes from counts in SLOTS slots, so that
what is gathered has a fixed size; any one order of all tokens makes the filters exact.

A line asks for its earliest similar line only. So it is held against the earliest line of each part or token first;
what it matches there bounds the rest, and only lines before that bound are candidates still, within lines of a similar
size. Variants of one line that match the earliest of them so make one pair each and not all pairs.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Members, release, scoped, written

PERCENT = 90
SLOTS = 1 << 18
#: The writer's option for tokens, whose dictionary would take more time than all else that is written.
PLAIN = {"parquet.enable.dictionary#tokens.list.element": "false"}
#: Lines of a part beyond which they are joined by their rarest tokens, and of a token beyond which by ranges of size.
MANY = 1000
#: Tokens of a line up to which its parts' ends are looked up one by one, which takes the square of its size.
LOOKED_UP = 1000
_SPACE = "\t\x0b\x0c\r"
_AT = "struct(doc_id, line_no, uid)"
#: What tells rows apart, besides doc_id: two hashes of the text.
_ROW = ["text_h1", "text_h2"]


def _row_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(_ROW[0]), F.xxhash64(F.lit(1), text).alias(_ROW[1])]


def _lines(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, *_ROW, line_no, k1, k2, tokens): the lines with a word; k1 and k2 are two hashes of their token set."""
    text = F.col("text").cast("string")
    odd = text.contains(_SPACE[0])
    for c in _SPACE[1:]:
        odd = odd | text.contains(c)
    plain = F.lower(F.when(odd, F.translate(text, _SPACE, " " * len(_SPACE))).otherwise(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_keys(text), plain.alias("plain"))
    split = rows.select("doc_id", *_ROW, F.posexplode(F.split("plain", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    words = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))  # an empty one beside each doubled space
    tokens = F.sort_array(F.array_distinct(F.array_remove(words, F.xxhash64(F.lit("")))))
    hashed = split.select("doc_id", *_ROW, "line_no", tokens.alias("tokens"))
    keys = (F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(1), "tokens").alias("k2"))
    return hashed.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *_ROW, "line_no", *keys, "tokens")


def _ranks(lines: DataFrame) -> Column:
    """For each slot the binary logarithm of its tokens in the corpus: one literal array."""
    slots = lines.select(F.explode("tokens").alias("t")).select(F.expr(f"t & {SLOTS - 1}").alias("slot"))
    counts = slots.groupBy("slot").agg(F.count("*").alias("n"))
    ranks = [0] * SLOTS
    for r in counts.collect():  # SLOTS rows at most
        ranks[r["slot"]] = min(r["n"].bit_length(), 62)
    return F.from_json(F.lit(json.dumps(ranks, separators=(",", ":"))), "array<long>")


_BITS = "aggregate(tokens, 0L, (x, t) -> x ^ shiftleft(1L, cast(t & 63 as int)))"


def _least(percent: int) -> int:
    """Tokens of the smallest line that may have a similar one with other tokens."""
    return -(-percent // (100 - percent))


def _parts(sized: DataFrame, percent: int) -> DataFrame:
    """sized (at, n, bits, tokens) with a row and a hash, token, for each part of tokens, for each number of parts in which
    a similar line may meet it; without tokens.

    Two lines of at most m tokens differ in d = 2 m (100 - percent) / (100 + percent) tokens at most, so that d + 1
    parts of the larger one's count, or more, have one in common. The smaller one files all counts up to the size that
    percent allows; they are rounded up to 2, 3, 4, 6, 8, 12 and so on, so that most lines file one. Where one token may
    differ, three parts are made and each is left out once, as halves of a small line hold few tokens.

    What goes through all tokens is compiled code, outside of lambdas, but for the ends of a very long line's parts.
    """
    asked = f"sequence(2L * n * {100 - percent} div {100 + percent} + 1, 2L * (100 * n div {percent}) * {100 - percent} div {100 + percent} + 1)"
    step = "shiftleft(1L, greatest(cast(floor(log2(q)) as int) - 1, 0))"
    counts = f"filter(array_distinct(transform({asked}, q -> (q + {step} - 1) div {step} * {step})), q -> q > 1)"
    rows = sized.select("*", F.expr(f"explode({counts})").alias("q")).select("*", F.expr("if(q = 2, 3L, q)").alias("p"))

    def start(i: str) -> str:
        """Part i of p begins at the hashes whose upper half, counted from the lowest, is i / p of 2**32."""
        return f"shiftleft(({i} * 4294967296 + p - 1) div p - 2147483648, 32)"

    merged = f"sort_array(concat(tokens, transform(sequence(1L, p - 1), i -> {start('i')})))"
    is_start = f"exists(array(shiftright((shiftright(y, 32) + 2147483648) * p, 32)), j -> exists(array(j, j + 1), i -> i between 1 and p - 1 and y = {start('i')}))"
    passed = f"transform(filter(transform(merged, (y, at) -> if({is_start}, at, -1)), at -> at >= 0), (at, i) -> at - i)"
    rows = rows.withColumn("merged", F.expr(merged)).withColumn("ends", F.expr(f"if(n <= {LOOKED_UP}, null, {passed})"))
    rows = rows.select("*", F.expr("explode(sequence(1L, p))").alias("i"))

    def end(i: str) -> str:
        return f"if(n <= {LOOKED_UP}, cast(array_position(merged, {start(i)}) - {i} as int), ends[cast({i} as int) - 1])"

    rows = rows.withColumn("e", F.expr(f"if(i = 1, 0, {end('(i - 1)')})")).withColumn("f", F.expr(f"if(i = p, n, {end('i')})"))
    part = F.expr("if(q = 2, xxhash64(q, i, slice(tokens, 1, e), slice(tokens, f + 1, n - f)), xxhash64(q, i, slice(tokens, e + 1, f - e)))")
    return rows.select("at", "n", "bits", part.alias("token"))


@scoped
def _filed(lines: DataFrame, copies: Members, firsts: Members, percent: int) -> tuple[DataFrame, DataFrame]:
    """(at, n, power, bits, pos, token) for each part, token, of a class's first line that another one's has; and (token, c)
    of those parts, with the number of lines that have them."""
    sized = lines.select(F.expr(_AT).alias("at"), "k1", F.size("tokens").alias("n"), "tokens").where(f"n >= {_least(percent)}")
    reps = firsts.marked(copies.marked(sized, "many", F.col("k1")), "first", F.col("at.uid")).where("first or not many")
    parts = written(_parts(reps.select("at", "n", F.expr(_BITS).alias("bits"), "tokens"), percent), "parts")
    shared = written(parts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    release(lines.sparkSession)
    filed = Members(shared, "token").maybe(parts, F.col("token"))
    return written(filed.select("at", "n", F.lit(0).alias("power"), "bits", F.lit(0).alias("pos"), "token"), "filed"), shared


def _prefixes(lines: DataFrame, percent: int) -> DataFrame:
    """(at, n, power, bits, prefix): the rarest tokens of each line.

    With n - ceil(percent n / 100) + 1 of its rarest tokens, a line shares one with each similar line. The power of
    100 / percent that n reaches differs by one at most between similar lines.
    """
    ranks = _ranks(lines)
    sized = lines.select(F.expr(_AT).alias("at"), F.size("tokens").alias("n"), "tokens")
    ranked = F.sort_array(F.transform("tokens", lambda t: F.shiftleft(F.get(ranks, t.bitwiseAND(SLOTS - 1)), 57).bitwiseOR(F.shiftrightunsigned(t, 7))))
    power = F.expr(f"cast(floor({0.999 / math.log(100 / percent)!r} * ln(n)) as int)").alias("power")
    return sized.select("at", "n", power, F.expr(_BITS).alias("bits"), F.slice(ranked, F.lit(1), F.expr(f"n - ({percent} * n + 99) div 100 + 1").cast("int")).alias("prefix"))


@scoped
def _filed_by_token(lines: DataFrame, percent: int) -> DataFrame:
    """(at, n, power, bits, pos, token) for each of the rarest tokens of lines that another one of a similar size has:
    under (token, power) or (token, power + 1) two such lines meet."""
    reps = written(_prefixes(lines, percent), "prefixes")
    places = reps.select("power", F.explode("prefix").alias("token")).select("token", F.explode(F.expr("array(power, power + 1)")).alias("power"))
    shared = Members(places.groupBy("token", "power").agg(F.count("*").alias("c")).where("c > 1"), "token", "power")
    release(lines.sparkSession)
    filed = reps.select("at", "n", "power", "bits", F.posexplode("prefix").alias("pos", "token"))
    return written(shared.maybe(filed, F.col("token"), F.col("power"), other=(F.col("token"), F.col("power") + 1)), "filed")


@scoped
def _index(filed: DataFrame) -> DataFrame:
    """(token, c, head, at, n, power, pos, bits): each line of a token, or part, but the earliest, head; c counts them all."""
    heads = filed.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("at", "n", "pos", "bits")).alias("head")).where("c > 1")
    heads = written(heads, "heads")
    release(filed.sparkSession)
    return written(filed.join(heads, "token").where("at.uid <> head.at.uid"), "index")


@scoped
def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(uid, match): for each line the earliest of its partners in pairs (uid, other) that is similar enough."""
    pairs = written(pairs.distinct(), "pairs")
    release(lines.sparkSession)
    ends = Members(pairs.select(F.explode(F.array("uid", "other.uid")).alias("uid")).distinct(), "uid")
    sets = written(ends.maybe(lines.select("uid", "tokens"), F.col("uid")), "sets")
    both = pairs.join(sets.withColumnRenamed("tokens", "a"), "uid")
    both = both.join(sets.select(F.col("uid").alias("partner"), F.col("tokens").alias("b")), F.col("other.uid") == F.col("partner"))
    common = F.size(F.array_intersect("a", "b")).alias("c")
    near = both.select(pairs["uid"], "other", common, (F.size("a") + F.size("b")).alias("s")).where(f"100 * c >= {percent} * (s - c)")
    return written(near.groupBy("uid").agg(F.min("other").alias("match")), "matches")


def _fits(percent: int, y: str) -> Column:
    """Length and positional filter of a filed line (n, pos, bits) against another one, y, and the one on bits."""
    need = f"({percent} * (n + {y}.n) + {99 + percent}) div {100 + percent}"
    close = f"100 * least(n, {y}.n) >= {percent} * greatest(n, {y}.n)"
    return F.expr(f"{close} and 1 + least(n - pos - 1, {y}.n - {y}.pos - 1) >= {need} and bit_count(bits ^ {y}.bits) <= n + {y}.n - 2 * ({need})")


@scoped
def _matches(lines: DataFrame, copies: Members, firsts: Members, percent: int) -> DataFrame:
    """(uid, match): for the first line of each class its earliest similar line with other tokens, if there is one."""
    filed, shared = _filed(lines, copies, firsts, percent)
    release(lines.sparkSession)
    crowded = written(shared.where(f"c > {MANY}").select("token"), "crowded")
    if crowded.isEmpty():
        return _earliest(filed, lines, percent)
    best = _earliest(filed.join(crowded, "token", "left_anti"), lines, percent)
    uids = written(filed.join(crowded, "token", "left_semi").select(F.col("at.uid").alias("uid")).distinct(), "crowd")
    crowd = written(Members(uids, "uid").maybe(lines.select("uid", "doc_id", "line_no", "tokens"), F.col("uid")).join(uids, "uid", "left_semi"), "crowd")
    more = _earliest(_filed_by_token(crowd, percent), crowd, percent)
    return written(best.union(more).groupBy("uid").agg(F.min("match").alias("match")), "best")


@scoped
def _earliest(filed: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(uid, match): for each line filed the earliest similar one among those that share a token, or part, with it."""
    index = _index(filed)
    release(lines.sparkSession)
    stars = index.where(_fits(percent, "head")).select("at.uid", F.col("head.at").alias("other"))
    best = _verified(stars, lines, percent)
    # Then, in tokens with more lines whose earliest one comes before the best match so far, against those that would
    # be a better one. A token of many lines is cut by their size.
    later = index.where("c > 2").withColumn("power", F.expr(f"if(c > {MANY}, power, 0)"))
    powers = F.expr(f"if(c > {MANY}, array(power - 1, power, power + 1), array(power))")
    left = later.withColumn("uid", F.col("at.uid")).join(best, "uid", "left").withColumn("bound", F.coalesce("match", "at")).where("head.at < bound")
    left = left.select("uid", "n", "pos", "bits", "token", "bound", F.explode(powers).alias("power"))
    others = later.select("token", "power", F.struct("at", "n", "pos", "bits").alias("y"))
    rest = left.join(others, ["token", "power"]).where((F.col("y.at") < F.col("bound")) & _fits(percent, "y"))
    more = _verified(rest.select("uid", F.col("y.at").alias("other")), lines, percent)
    return written(best.union(more).groupBy("uid").agg(F.min("match").alias("match")), "best")


@scoped
def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line_no, kept, match_doc, match_line, *_ROW) for each line with a word, line_no from 0.

    A line is removed if an earlier one, by (doc_id, line_no), has the same words or a Jaccard similarity of percent
    or more; match_doc and match_line name the earliest such line. A null doc_id comes before all others; of rows that
    share a doc_id one comes first. The columns of _ROW tell such rows apart for without_lines. Null and empty texts
    have no lines; a very long text or line is used whole; an empty table gives no rows; other columns are not read.
    """
    lines = written(_lines(docs), "lines", **PLAIN)
    copies = Members(lines.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1"), "k1")
    own = lines.select("uid", "doc_id", "line_no", "k1", "k2")
    several = copies.maybe(own, F.col("k1")).groupBy("k1", "k2").agg(F.min(F.expr(_AT)).alias("first"))
    classes = written(several, "classes")
    firsts = Members(classes.select("first.uid"), "uid")
    best = _matches(lines, copies, firsts, percent)
    # Only lines of a class with copies, or with a match, take part in a join.
    verdicts = classes.join(best, F.col("first.uid") == F.col("uid"), "left").select("k1", "k2", "first", "match")
    verdicts = written(verdicts, "verdicts")
    rows = lines.select("uid", "doc_id", "line_no", *_ROW, "k1", "k2")
    rows = Members(best, "uid").marked(copies.marked(rows, "many", F.col("k1")), "near", F.col("uid"))
    kept = [F.col("m").isNull().alias("kept"), F.col("m.doc_id").alias("match_doc"), F.col("m.line_no").alias("match_line")]
    out = lambda found, m: found.select("doc_id", "line_no", m.alias("m"), *_ROW).select("doc_id", "line_no", *kept, *_ROW)
    at = F.expr(_AT)
    earlier = F.when(F.col("match") < at, F.col("match"))
    same = F.when(F.col("first.uid") != F.col("uid"), F.col("first"))
    found = F.when(earlier.isNull() | (same < earlier), F.coalesce(same, earlier)).otherwise(earlier)
    in_class = out(rows.where("many").join(verdicts, ["k1", "k2"]), found)
    matched = out(rows.where("near and not many").join(best, "uid", "left"), F.col("match"))
    alone = rows.where("not near and not many").select("doc_id", "line_no", F.lit(True).alias("kept"), F.lit(None).cast("long").alias("match_doc"), F.lit(None).cast("int").alias("match_line"), *_ROW)
    return alone.union(matched).union(in_class)


@scoped
def without_lines(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of text. verdicts: line_dedup's, for the same docs.

    Lines are taken out by row: by doc_id, null too, and the text's hashes. A line that equal rows hold at one place
    is kept for the first of them at most, so one such row keeps what any keeps; which one is free, as their texts are
    equal. Rows that keep all lines are not shuffled.
    """
    keys = ["doc_id", *_ROW]
    places = lambda kept: F.collect_set(F.when(F.col("kept") == F.lit(kept), F.col("line_no")))
    lost = verdicts.groupBy(*keys).agg(places(False).alias("lost"), places(True).alias("held")).where("size(lost) > 0")
    lost = written(lost.select(*keys, "lost", F.array_intersect("lost", "held").alias("once")), "lost")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = [F.col("row.doc_id").cast("long").alias("own_id"), *(c.alias(f"own_{n}") for c, n in zip(_row_keys(F.col("row.text").cast("string")), _ROW, strict=True))]
    rows = Members(lost, *keys).marked(rows.select("row", *own), "hit", F.col("own_id"), *(F.col(f"own_{n}") for n in _ROW))
    same = F.col("own_id").eqNullSafe(F.col("doc_id"))
    for n in _ROW:
        same &= F.col(f"own_{n}") == F.col(n)
    hit = rows.where("hit").select("row", *(c for c in rows.columns if c.startswith("own_"))).join(lost, same, "left")
    hit = written(hit.withColumn("id", F.monotonically_increasing_id()), "hit")
    firsts = hit.where("size(once) > 0").groupBy(*keys).agg(F.min("id").alias("id")).select("id")
    out = F.when(F.col("is_first").isNotNull(), F.array_except("lost", "once")).otherwise(F.col("lost"))
    changed = hit.join(firsts.withColumn("is_first", F.lit(True)), "id", "left").withColumn("lost", out)
    split = F.split(F.col("row.text"), "\n")
    numbered = F.filter(F.transform(split, lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda x: ~F.array_contains(F.col("lost"), x["i"]))
    text = F.array_join(F.transform(numbered, lambda x: x["line"]), "\n")
    changed = changed.select(F.when(F.col("lost").isNull(), F.col("row")).otherwise(F.col("row").withField("text", text)).alias("row"))
    return rows.where("not hit").select("row.*").union(changed.select("row.*"))
