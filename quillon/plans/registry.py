"""The registered queries and their SQL for a second engine.

Search queries take as queries every row whose id is divisible by 20, against all rows; fraud_score takes every row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import features
from ..operators import cells, evaluate, knn, search
from ..operators.shared import new_path, scoped, settings, written
from ..sources.fixtures import CODES, transactions, vectors
from ..sources.payload import decoded, encoded
from ..sources.references import quantised_references

EVERY, N_CELLS, ITERATIONS, LEAF = 20, 16, 3, 64
FIRST, MOST = 2, 4
#: (first, most) cells of the sweep over N_CELLS cells.
SWEEP = [(1, 2), (1, 4), (2, 4), (2, 8), (4, 8), (4, 12)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = scoped(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- shared SQL -------------------------------------------------------------------------------------------------

_T = f"""
WITH epochs AS (
  SELECT *, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey * 37) % 86400 AS ts FROM orders),
t AS (
  SELECT o_orderkey AS qid, CAST(o_orderstatus = 'F' AS INT) AS fraud, o_totalprice / 45.0::DOUBLE AS amount,
         CAST(o_orderkey % 15 AS DOUBLE) AS installments, ts, CAST(o_custkey % 97 AS DOUBLE) * 25 AS avg_amount,
         CAST(o_custkey % 23 AS DOUBLE) AS tx_24h, s_suppkey, s_acctbal AS merchant_avg,
         {CODES!r}[s_suppkey % 12 + 1] AS mcc,
         o_orderkey % 2 = 0 AS is_online, o_orderkey % 3 = 0 AS card_present,
         CAST((o_orderkey * 7919) % 12000 AS DOUBLE) / 10 AS km_home,
         lag(ts) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS last_ts,
         CAST((o_orderkey * 104729) % 12000 AS DOUBLE) / 10 AS km_last,
         s_suppkey IN (o_custkey % 10, o_custkey * 3 % 10, o_custkey * 7 % 10) AS known
  FROM epochs JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier))"""


def _q(e: str) -> str:
    return f"CAST(greatest(-10000, least(10000, round(({e}) * 10000::DOUBLE))) AS INT)"


def _c(e: str) -> str:
    return f"CASE WHEN {e} < 0 THEN 0::DOUBLE WHEN {e} > 1 THEN 1::DOUBLE ELSE {e} END"


_DIMS = [
    _q(_c("(amount / 10000::DOUBLE)")),
    _q(_c("(installments / 12::DOUBLE)")),
    _q(f"CASE WHEN avg_amount = 0 THEN CASE WHEN amount < 0 THEN 0::DOUBLE ELSE 1::DOUBLE END ELSE {_c('(amount / avg_amount / 10::DOUBLE)')} END"),
    _q("hour(make_timestamp(ts * 1000000)) / 23::DOUBLE"),
    _q("(isodow(make_timestamp(ts * 1000000)) - 1) / 6::DOUBLE"),
    f"CASE WHEN last_ts IS NULL THEN -10000 ELSE {_q(_c('((ts - last_ts) / 60::DOUBLE / 1440::DOUBLE)'))} END",
    f"CASE WHEN last_ts IS NULL THEN -10000 ELSE {_q(_c('(km_last / 1000::DOUBLE)'))} END",
    _q(_c("(km_home / 1000::DOUBLE)")),
    _q(_c("(tx_24h / 20::DOUBLE)")),
    "CASE WHEN is_online THEN 10000 ELSE 0 END",
    "CASE WHEN card_present THEN 10000 ELSE 0 END",
    "CASE WHEN known THEN 0 ELSE 10000 END",
    _q("CASE mcc WHEN '5411' THEN 0.15 WHEN '5812' THEN 0.30 WHEN '5912' THEN 0.20 WHEN '5944' THEN 0.45 WHEN '7801' THEN 0.80 WHEN '7802' THEN 0.75 WHEN '7995' THEN 0.85 WHEN '4511' THEN 0.35 WHEN '5311' THEN 0.25 WHEN '5999' THEN 0.50 ELSE 0.5 END::DOUBLE"),
    _q(_c("(merchant_avg / 10000::DOUBLE)")),
]
_DIST = "list_sum(list_transform(list_zip(q, v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
_TV = _T + f""",
vecs AS MATERIALIZED (SELECT qid AS idx, fraud, [{", ".join(f"CAST({d} AS BIGINT)" for d in _DIMS)}] AS v FROM t)"""
_EV = """
WITH vecs AS MATERIALIZED (
  SELECT vec_id AS idx, CAST(label % 2 AS INT) AS fraud,
         list_transform(embedding[1:14], lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)) AS v
  FROM embeddings)"""
_CUT = f" WHERE idx % {EVERY} = 0"
_PAIRS = f""",
qs AS MATERIALIZED (SELECT idx AS qid, v AS q FROM vecs{_CUT}),
pairs AS (SELECT qid, idx, CAST({_DIST} AS BIGINT) AS dist, fraud FROM qs CROSS JOIN vecs)"""
_TOP = """,
top AS MATERIALIZED (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, idx) AS INT) AS rank FROM pairs) WHERE rank <= 5)"""
_VOTES = """,
votes AS (SELECT qid, CAST(sum(fraud) AS INT) AS fraud_count, CAST(count(*) AS INT) AS n_neighbors FROM top GROUP BY qid)"""
_ENN, _TNN = _EV + _PAIRS + _TOP, _TV + _PAIRS + _TOP
_TNN_ALL = _TV + _PAIRS.replace(_CUT, "") + _TOP


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(transactions(spark, sf_dir))


def _asked(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("idx") % EVERY == 0).select(F.col("idx").alias("qid"), "v")


def _compiled(df: DataFrame, name: str) -> DataFrame:
    """written(). One method for all features has more bytes of code than the JVM compiles, and would be interpreted;
    under this limit Spark makes several of it."""
    with settings(df.sparkSession, spark_sql_codegen_hugeMethodLimit="8000"):
        return written(df, name)


def _tx_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(_tx(spark, sf_dir).select(F.col("qid").alias("idx"), "v", "fraud"), "vectors")


# ---- payloads and features --------------------------------------------------------------------------------------

@query(_T + """
SELECT qid, true AS parse_ok, amount, installments, avg_amount, tx_24h, CAST(s_suppkey AS VARCHAR) AS merchant_id, mcc, merchant_avg,
       is_online, card_present, km_home, last_ts IS NOT NULL AS has_last,
       CASE WHEN last_ts IS NOT NULL THEN km_last END AS last_km FROM t""")
def payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decoded(encoded(transactions(spark, sf_dir)).select("qid", "payload"))
    return read.select("qid", "parse_ok", "amount", "installments", "avg_amount", "tx_24h", "merchant_id", "mcc", "merchant_avg", "is_online", "card_present", "km_home", "has_last", "last_km")


@query(_TNN + _VOTES + """
SELECT qid, qid % 3 <> 0 AS parse_ok, CASE WHEN qid % 3 = 0 THEN true ELSE fraud_count < 3 END AS approved,
       CASE WHEN qid % 3 = 0 THEN 0::DOUBLE ELSE fraud_count / 5::DOUBLE END AS fraud_score FROM votes""")
def payload_safe_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third payload is broken; it is still answered."""
    asked = encoded(transactions(spark, sf_dir).where(F.col("qid") % EVERY == 0))
    broken = F.when(F.col("qid") % 3 == 0, F.regexp_replace("payload", '"merchant":', '"mer":')).otherwise(F.col("payload"))
    read = _compiled(features(decoded(asked.select("qid", broken.alias("payload")))).select("qid", "parse_ok", "v"), "read")
    found = knn.nearest(read.where("parse_ok").select("qid", "v"), _tx_refs(spark, sf_dir))
    return knn.safe(read, knn.vote(found))


@query(_TV + " SELECT idx AS qid, " + ", ".join(f"CAST(v[{i + 1}] AS INT) AS d{i}" for i in range(14)) + " FROM vecs")
def vec_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir).select("qid", *[F.col("v")[i].alias(f"d{i}") for i in range(14)])


def _dims(name: str, dims: tuple[int, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tx(spark, sf_dir).select("qid", *[F.col("v")[i].alias(f"d{i}") for i in dims])

    run.__name__ = name
    query(_TV + " SELECT idx AS qid, " + ", ".join(f"CAST(v[{i + 1}] AS INT) AS d{i}" for i in dims) + " FROM vecs")(run)


_dims("vec_ratio", (2,))
_dims("vec_calendar", (3, 4))
_dims("vec_sentinel", (5, 6))
_dims("vec_unknown_merchant", (11,))
_dims("vec_mcc_lookup", (12,))


@query("""SELECT vec_id AS idx, list_transform(embedding[1:14], lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS INT)) AS v,
       CAST(label % 2 AS INT) AS fraud FROM embeddings""")
def refs_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.transform(F.slice("embedding", 1, 14), lambda x: x.cast("double"))
    label = F.when(F.col("label") % 2 == 1, "fraud").otherwise("legit")
    return quantised_references(e.select(F.col("vec_id").alias("idx"), vector.alias("vector"), label.alias("label")))


# ---- neighbours -------------------------------------------------------------------------------------------------

@query(_EV + _PAIRS + " SELECT qid, idx, dist FROM pairs")
def knn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = vectors(spark, sf_dir)
    return knn.pairs(_asked(refs), refs).select("qid", "idx", "dist")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = vectors(spark, sf_dir)
    return knn.nearest(_asked(refs), refs)


@query(_ENN + " SELECT qid, rank, idx, dist, fraud FROM top")
def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir)


@query(_ENN + " SELECT qid, max(dist) AS tau FROM top GROUP BY qid")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.threshold(_neighbours(spark, sf_dir))


@query(_TNN + " SELECT qid, rank, idx, dist, fraud FROM top")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _tx_refs(spark, sf_dir)
    return knn.nearest(_asked(refs), refs)


@query(_ENN + _VOTES + " SELECT * FROM votes")
def fraud_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.vote(_neighbours(spark, sf_dir))


@query(_TNN_ALL + _VOTES + " SELECT qid, fraud_count, fraud_count < 3 AS approved, fraud_count / 5::DOUBLE AS fraud_score FROM votes")
def fraud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is scored, against all orders."""
    refs = _tx_refs(spark, sf_dir)
    return knn.decided(knn.vote(knn.nearest(refs.select(F.col("idx").alias("qid"), "v"), refs)))


@query(_ENN + _VOTES + """ SELECT qid, '{"approved":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":'
  || ['0.0', '0.2', '0.4', '0.6', '0.8', '1.0'][fraud_count + 1] || '}' AS response FROM votes""")
def score_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = knn.decided(knn.vote(_neighbours(spark, sf_dir)))
    return done.select("qid", knn.response(F.col("approved"), F.col("fraud_score")).alias("response"))


# ---- cells ------------------------------------------------------------------------------------------------------

_DIST_C = "list_sum(list_transform(list_zip(c, v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
_SEED = f""",
size AS (SELECT count(*) // {N_CELLS} AS step FROM vecs),
c0 AS MATERIALIZED (SELECT idx // step AS cell, idx, v AS c FROM vecs, size WHERE idx % step = 0 AND idx // step < {N_CELLS})"""


def _assign(i: int) -> str:
    return f""",
a{i} AS MATERIALIZED (
  SELECT idx, any_value(v) AS v, any_value(fraud) AS fraud, min_by(cell, struct_pack(d := d, cell := cell)) AS cell
  FROM (SELECT vecs.idx AS idx, v, fraud, cell, {_DIST_C} AS d FROM vecs CROSS JOIN c{i}) GROUP BY idx)"""


def _update(i: int) -> str:
    # // of integers truncates toward zero, as div does
    return f""",
m{i} AS (SELECT cell, [{", ".join(f"CAST(CAST(sum(v[{d}]) AS BIGINT) // count(*) AS BIGINT)" for d in range(1, 15))}] AS c FROM a{i} GROUP BY cell),
c{i + 1} AS MATERIALIZED (SELECT cell, coalesce(m.c, p.c) AS c FROM c{i} p LEFT JOIN m{i} m USING (cell))"""


_KM = _EV + _SEED + _assign(0) + _update(0) + _assign(1) + _update(1) + _assign(2)
_BOX = f""",
members AS (SELECT cell, idx, v, fraud FROM a{ITERATIONS - 1}),
boxes AS MATERIALIZED (
  SELECT cell, count(*) AS n, [{", ".join(f"min(v[{d}])" for d in range(1, 15))}] AS bmin, [{", ".join(f"max(v[{d}])" for d in range(1, 15))}] AS bmax
  FROM members GROUP BY cell)"""
_ORDER = f""",
qs AS MATERIALIZED (SELECT idx AS qid, v AS q FROM vecs WHERE idx % {EVERY} = 0),
bounds AS (
  SELECT qid, cell, q, CAST(list_sum(list_transform(list_zip(q, bmin, bmax), lambda p: greatest(p[2] - p[1], p[1] - p[3], 0) * greatest(p[2] - p[1], p[1] - p[3], 0))) AS BIGINT) AS lb
  FROM qs CROSS JOIN boxes),
probes AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY lb, cell) AS INT) AS place FROM bounds)"""


def _limited(most: int) -> str:
    return f""",
pairs AS (SELECT qid, idx, CAST({_DIST} AS BIGINT) AS dist, fraud FROM probes JOIN members USING (cell) WHERE place <= {most})"""


def _adaptive(first: int, most: int, tag: str = "") -> str:
    return f""",
cand{tag} AS MATERIALIZED (SELECT qid, place, idx, CAST({_DIST} AS BIGINT) AS dist, fraud FROM probes JOIN members USING (cell) WHERE place <= {most}),
pref{tag} AS (
  SELECT * FROM (SELECT qid, p, dist, fraud, row_number() OVER (PARTITION BY qid, p ORDER BY dist, idx) AS r
                 FROM cand{tag}, range(1, {most} + 1) g(p) WHERE place <= p) WHERE r <= 5),
state{tag} AS (SELECT qid, p, max(dist) AS tau, CAST(sum(fraud) AS INT) AS fraud_count, count(*) AS n FROM pref{tag} GROUP BY qid, p),
judged{tag} AS (
  SELECT s.*, nx.lb AS next_lb FROM state{tag} s LEFT JOIN probes nx ON nx.qid = s.qid AND nx.place = s.p + 1),
adapt{tag} AS (
  SELECT qid, CAST(min(p) AS INT) AS probes, arg_min(fraud_count, p) AS fraud_count FROM judged{tag}
  WHERE next_lb IS NULL OR p = {most} OR (n >= 5 AND next_lb >= tau) OR (n >= 5 AND p >= {first} AND fraud_count IN (0, 5)) GROUP BY qid)"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(vectors(spark, sf_dir), "vectors")


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, members) of the k-means index."""
    refs = _refs(spark, sf_dir)
    return _asked(refs), written(cells.kmeans(refs, N_CELLS, ITERATIONS), "members")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, members, cells) of the k-means index."""
    q, members = _members(spark, sf_dir)
    return q, members, written(cells.boxes(members), "cells")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs = _refs(spark, sf_dir)
    members = cells.kd_tree(refs, LEAF)
    return _asked(refs), members, written(cells.boxes(members), "cells")


@query(_EV + _SEED + " SELECT cell, idx, c AS v FROM c0")
def kmeans_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.seeds(vectors(spark, sf_dir), N_CELLS)


def _first_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    start = np.array([r["v"] for r in cells.seeds(refs, N_CELLS).orderBy("cell").collect()])
    return cells.assigned(refs, start)


@query(_EV + _SEED + _assign(0) + " SELECT idx, cell FROM a0")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_members(spark, sf_dir).select("idx", "cell")


@query(_EV + _SEED + _assign(0) + _update(0) + " SELECT cell, c AS v FROM m0")
def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.means(_first_members(spark, sf_dir))


@query(_KM + " SELECT idx, cell FROM a2")
def kmeans_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.kmeans(_refs(spark, sf_dir), N_CELLS, ITERATIONS).select("idx", "cell")


@query(_KM + _BOX + " SELECT cell, bmin, bmax FROM boxes")
def cell_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[2].select("cell", "bmin", "bmax")


@query(_KM + _BOX + " SELECT cell, n, CAST((n + 7) // 8 AS BIGINT) AS blocks FROM boxes")
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[2].select("cell", "n", "blocks")


@query(_KM + _BOX + _ORDER + " SELECT qid, cell, lb FROM bounds")
def cell_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, c = _index(spark, sf_dir)
    return search.lower_bounds(q, c).select("qid", "cell", "lb")


@query(_KM + _BOX + _ORDER + " SELECT qid, cell, place FROM probes")
def cell_probe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, c = _index(spark, sf_dir)
    return search.probe_order(search.lower_bounds(q, c)).select("qid", "cell", "place")


@query(_ENN + " SELECT qid, rank, idx, dist, fraud FROM top")
def ivf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(*_index(spark, sf_dir))


@query(_KM + _BOX + _ORDER + _limited(2) + _TOP + """
SELECT CAST(sum(n) AS BIGINT) AS read, (SELECT count(*) FROM qs) * (SELECT count(*) FROM vecs) AS every
FROM probes JOIN boxes USING (cell) JOIN (SELECT qid, CASE WHEN count(*) >= 5 THEN max(dist) END AS tau FROM top GROUP BY qid) USING (qid)
WHERE tau IS NULL OR lb <= tau""")
def ivf_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pruning(*_index(spark, sf_dir))


@query(_KM + _BOX + _ORDER + _limited(MOST) + _TOP + " SELECT qid, rank, idx, dist, fraud FROM top")
def ivf_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.budget(*_index(spark, sf_dir), MOST)


@query(_KM + _BOX + _ORDER + _adaptive(FIRST, MOST) + " SELECT * FROM adapt")
def ivf_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.adaptive(*_index(spark, sf_dir), FIRST, MOST)


@query(_KM + _BOX + _ORDER + _adaptive(16, 64) + " SELECT qid, fraud_count FROM adapt")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed search with the budgets that are served: 16 cells at first, 64 at most."""
    return search.ivf_search(*_index(spark, sf_dir), mode="adaptive")


@query(_ENN + " SELECT qid, rank, idx, dist, fraud FROM top")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, members = _members(spark, sf_dir)  # save() makes the cells
    path = new_path(spark, "index")
    cells.save(members, path, "kmeans")
    return written(search.exact(q, *cells.load(spark, path)), "found")


# The tree: each level takes the widest dimension and the median by (value, idx), to a depth that all levels reach.
_KD0 = ",\nk0 AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS cell, idx, v, fraud FROM vecs)"
_SPREADS = ", ".join(f"max(v[{d}]) - min(v[{d}])" for d in range(1, 15))


def _level(i: int) -> str:
    return f""",
s{i} AS MATERIALIZED (
  SELECT cell, n, list_max(sp) AS spread, list_position(sp, list_max(sp)) AS dim
  FROM (SELECT cell, count(*) AS n, [{_SPREADS}] AS sp FROM k{i} GROUP BY cell)),
k{i + 1} AS MATERIALIZED (
  SELECT CASE WHEN n > {LEAF} AND spread > 0 THEN cell * 2 + CAST(r > n // 2 AS BIGINT) ELSE cell END AS cell, idx, v, fraud
  FROM (SELECT k.*, s.n, s.spread, row_number() OVER (PARTITION BY k.cell ORDER BY k.v[s.dim], k.idx) AS r FROM k{i} k JOIN s{i} s ON k.cell = s.cell))"""


_LEVELS = 12
_KD = _EV + _KD0 + "".join(_level(i) for i in range(_LEVELS))
_KBOX = _BOX.replace(f"FROM a{ITERATIONS - 1}", f"FROM k{_LEVELS}")


@query(_EV + _KD0 + _level(0) + " SELECT cell, n, CAST(spread AS INT) AS spread, CAST(dim - 1 AS INT) AS dim FROM s0")
def kd_split_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = vectors(spark, sf_dir).withColumn("cell", F.lit(1).cast("long"))
    return cells.split_dims(cells.boxes(root)).select("cell", "n", "spread", "dim")


@query(_KD + f" SELECT idx, cell FROM k{_LEVELS}")
def kd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[1].select("idx", "cell")


@query(_ENN + " SELECT qid, rank, idx, dist, fraud FROM top")
def kd_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(*_tree(spark, sf_dir))


@query(_ENN + " SELECT qid, rank, idx, dist, fraud FROM top")
def kd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, members, _ = _tree(spark, sf_dir)
    path = new_path(spark, "index")
    cells.save(members, path, "kd")
    return written(search.exact(q, *cells.load(spark, path)), "found")


@query(_KD + _KBOX + _ORDER + _limited(MOST) + _TOP + " SELECT qid, rank, idx, dist, fraud FROM top")
def kd_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.budget(*_tree(spark, sf_dir), MOST)


# ---- evaluation: the expectation is the query's own label ---------------------------------------------------------

_RESULTS = _VOTES + """,
results AS (SELECT qid, fraud_count < 3 AS approved, f.fraud = 0 AS expected_approved, CASE WHEN f.fraud = 0 THEN 0.4 ELSE 0.6 END AS expected_score
            FROM votes JOIN vecs f ON f.idx = qid)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    done = knn.decided(knn.vote(knn.nearest(_asked(refs), refs)))
    truth = refs.select(F.col("idx").alias("qid"), (F.col("fraud") == 0).alias("expected_approved"), F.when(F.col("fraud") == 0, 0.4).otherwise(0.6).alias("expected_score"))
    return done.join(truth, "qid").withColumn("parse_ok", F.lit(True))


def _partly_read(results: DataFrame) -> DataFrame:
    """Every third request could not be read: it is approved, and counts as a mismatch."""
    ok = F.col("qid") % 3 != 0
    return results.withColumns({"parse_ok": ok, "approved": F.col("approved") | ~ok})


@query(_ENN + _RESULTS + """ SELECT count(*) AS total, count(*) FILTER (WHERE qid % 3 = 0 OR approved <> expected_approved) AS mismatches,
  count(*) FILTER (WHERE expected_score = 0.6) AS edges,
  count(*) FILTER (WHERE expected_score = 0.6 AND (qid % 3 = 0 OR approved <> expected_approved)) AS edge_mismatches FROM results""")
def eval_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mismatches(_partly_read(_results(spark, sf_dir)))


@query(_ENN + _RESULTS + """ SELECT qid, approved, expected_approved FROM results WHERE approved <> expected_approved
  ORDER BY qid, approved, expected_approved LIMIT 10""")
def eval_first_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten mismatches by id: a report of the evaluation."""
    wrong = _results(spark, sf_dir).where("approved <> expected_approved").select("qid", "approved", "expected_approved")
    return evaluate.limited(wrong, 10, "qid")


@query(_ENN + _RESULTS + """ SELECT count(*) AS total, count(*) FILTER (WHERE NOT approved AND expected_approved) AS fp,
  count(*) FILTER (WHERE approved AND NOT expected_approved) AS fn,
  count(*) FILTER (WHERE NOT approved AND expected_approved) + 3 * count(*) FILTER (WHERE approved AND NOT expected_approved) AS weighted_error FROM results""")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_results(spark, sf_dir))


@query(_KM + _BOX + _ORDER + f""",
pairs AS (SELECT qid, idx, CAST({_DIST} AS BIGINT) AS dist, fraud FROM qs CROSS JOIN vecs)""" + _TOP + _VOTES + _adaptive(FIRST, MOST) + """
SELECT count(*) AS total, count(*) FILTER (WHERE (v.fraud_count < 3) <> (a.fraud_count < 3)) AS decision_flips,
       count(*) FILTER (WHERE v.fraud_count <> a.fraud_count) AS count_flips FROM votes v JOIN adapt a USING (qid)""")
def eval_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, members, c = _index(spark, sf_dir)
    return evaluate.flips(knn.vote(knn.nearest(q, members)), search.adaptive(q, members, c, FIRST, MOST))


_PCT = """ SELECT CAST(count(*) AS BIGINT) AS total, CAST(max(probes) FILTER (WHERE r = (n - 1) // 2) AS BIGINT) AS p50,
  CAST(max(probes) FILTER (WHERE r = (n - 1) * 9 // 10) AS BIGINT) AS p90, CAST(max(probes) FILTER (WHERE r = (n - 1) * 99 // 100) AS BIGINT) AS p99,
  CAST(max(probes) FILTER (WHERE r = (n - 1) * 999 // 1000) AS BIGINT) AS p999, avg(probes) AS mean, CAST(max(probes) AS BIGINT) AS most
  FROM (SELECT probes, row_number() OVER (ORDER BY probes) - 1 AS r, count(*) OVER () AS n FROM adapt)"""


@query(_KM + _BOX + _ORDER + _adaptive(1, 8) + _PCT)
def probe_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = search.adaptive(*_index(spark, sf_dir), 1, 8).select(F.col("probes").cast("long").alias("probes"))
    return evaluate.percentiles(probes, "probes")


@query(_KM + _BOX + _ORDER + "".join(_adaptive(a, b, str(i)) for i, (a, b) in enumerate(SWEEP)) + " " + " UNION ALL ".join(
    f"SELECT CAST({a} AS INT) AS first, CAST({b} AS INT) AS most, avg(probes) AS mean_probes, CAST(max(probes) AS BIGINT) AS max_probes, CAST(sum(fraud_count) AS BIGINT) AS frauds FROM adapt{i}" for i, (a, b) in enumerate(SWEEP)))
def probe_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    out = None
    states = search.prefix_states(*index, max(most for _, most in SWEEP))  # serve all settings
    for first, most in SWEEP:
        done = search.stopped(states, first, most)
        row = done.agg(F.avg("probes").alias("mean_probes"), F.max("probes").cast("long").alias("max_probes"), F.sum("fraud_count").alias("frauds"))
        row = row.select(F.lit(first).alias("first"), F.lit(most).alias("most"), "mean_probes", "max_probes", "frauds")
        out = row if out is None else out.union(row)
    return out
