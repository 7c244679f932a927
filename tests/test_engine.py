import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.features import features, timestamp
from quillon.operators import blocks, cells, evaluate, knn, search
from quillon.operators.shared import settings
from quillon.plans import registry
from quillon.sources.payload import decoded
from quillon.sources.references import load_references, load_validation
from quillon.report import report
from quillon.streaming.scorer import ready, score_stream, scored

from .oracle import same

SMALL = "/root/testdata/sf0.001"


def payload(**change):
    p = {
        "id": "tx-1",
        "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
        "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
        "last_transaction": None,
    }
    for path, v in change.items():
        at, keys = p, path.split("__")
        for k in keys[:-1]:
            at = at[k]
        if v is KeyError:
            del at[keys[-1]]
        else:
            at[keys[-1]] = v
    return json.dumps(p)


def read(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "qid long, payload string")
    return {r["qid"]: r for r in features(decoded(df)).select("qid", "parse_ok", "v").collect()}


# Payloads and the vectors that they must give.
GOLDEN = [
    (payload(), [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]),
    (payload(transaction={"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"}, customer={"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]}, merchant={"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86}, terminal__km_from_home=952.27), [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55]),
    (payload(transaction={"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"}, customer={"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001", "MERC-001"]}, merchant={"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95}, terminal__km_from_home=13.7090520965, last_transaction={"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774}), [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299]),
]


def test_golden_vectors(spark):
    found = read(spark, *[p for p, _ in GOLDEN])
    for i, (_, v) in enumerate(GOLDEN):
        assert found[i]["parse_ok"] and found[i]["v"] == v


def test_unreadable_payloads(spark):
    bad = ["", "nonsense", payload(transaction=KeyError), payload(customer=KeyError), payload(merchant=KeyError), payload(terminal=KeyError), payload(transaction__amount="41.12"), payload(customer__avg_amount=KeyError), payload(transaction__requested_at="2026-03-11"), payload(transaction__requested_at="2026-13-11T18:45:53Z"), payload(last_transaction={"timestamp": "2026-03-11T14:58:35Z"}), payload(last_transaction={"km_from_current": 1.0}), payload(terminal__is_online=KeyError), payload(merchant__id="x" * 39), None]
    assert not any(r["parse_ok"] for r in read(spark, *bad).values())


def test_readable_payloads(spark):
    found = read(spark, payload(last_transaction=KeyError), payload(customer__known_merchants=KeyError), payload(merchant__mcc="0000"), payload(terminal__is_online=1), payload(customer__avg_amount=0), payload(customer__avg_amount=0, transaction__amount=-1), payload(customer__known_merchants=["MERC-016", None]), payload(customer__known_merchants=[None]))
    assert all(r["parse_ok"] for r in found.values())
    assert found[0]["v"][5:7] == [-10000, -10000]
    assert found[1]["v"][11] == 10000 and found[6]["v"][11] == 0 and found[7]["v"][11] == 10000
    assert found[2]["v"][12] == 5000 and found[3]["v"][9] == 0
    assert found[4]["v"][2] == 10000 and found[5]["v"][2] == 0


def test_weekdays(spark):
    df = spark.createDataFrame([("2026-03-11T00:00:00Z",), ("2026-03-14T00:00:00+05:00",)], "t string")
    assert [r[0] for r in df.select(F.weekday(timestamp(F.col("t")))).collect()] == [2, 5]


def refs_of(spark, first_dims, frauds):
    rows = [(i, [x] + [0] * 13, f) for i, (x, f) in enumerate(zip(first_dims, frauds, strict=True))]
    return spark.createDataFrame(rows, "idx long, v array<int>, fraud int")


def test_ties_go_to_the_lowest_idx(spark):
    refs = refs_of(spark, [10, 10, 20, 30, 50, 10], [0, 1, 1, 1, 1, 1])
    q = spark.createDataFrame([(7, [0] * 14)], "qid long, v array<int>")
    found = knn.nearest(q, refs).orderBy("rank").collect()
    assert [r["idx"] for r in found] == [0, 1, 5, 2, 3]
    assert knn.decided(knn.vote(knn.nearest(q, refs))).first()["approved"] is False


def test_pruning_keeps_ties_of_other_cells(spark):
    members = spark.createDataFrame([(0, i, [10] + [0] * 13, 1) for i in range(1, 6)] + [(1, 0, [-10] + [0] * 13, 0)], "cell long, idx long, v array<int>, fraud int")
    q = spark.createDataFrame([(0, [0] * 14)], "qid long, v array<int>")
    found = search.exact(q, members, cells.boxes(members), first_cells=1).orderBy("rank").collect()
    assert [r["idx"] for r in found] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("spread", [10000, 2])
def test_cells_equal_brute_force(spark, spread):
    rng = np.random.default_rng(12345)
    v = rng.integers(0, spread + 1, (1500, 14)) * (1 if spread > 2 else 100)
    refs = spark.createDataFrame([(i, x.tolist(), int(i % 3 == 0)) for i, x in enumerate(v)], "idx long, v array<int>, fraud int")
    asked = rng.integers(0, spread + 1, (40, 14)) * (1 if spread > 2 else 100)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "qid long, v array<int>")
    order = [np.lexsort((np.arange(1500), ((v - x) ** 2).sum(axis=1)))[:5].tolist() for x in asked]

    def ids(found):
        out = {}
        for r in found.orderBy("qid", "rank").collect():
            out.setdefault(r["qid"], []).append(r["idx"])
        return [out[i] for i in range(len(asked))]

    assert ids(knn.nearest(q, refs)) == order
    for members in (cells.kmeans(refs, 16, 3), cells.kd_tree(refs, 64)):
        assert ids(search.exact(q, members, cells.boxes(members))) == order


def test_tree_halves_cells(spark):
    refs = refs_of(spark, [1] * 100 + [2] * 31, [0] * 131)
    sizes = {r["cell"]: r["n"] for r in cells.boxes(cells.kd_tree(refs, 40)).collect()}
    assert sizes[2] == 65 and sum(sizes.values()) == 131  # one value, no spread: a leaf above the size


def test_few_references_vote_alone(spark):
    q = spark.createDataFrame([(0, [0] * 14)], "qid long, v array<int>")
    r = knn.vote(knn.nearest(q, refs_of(spark, [1, 2], [1, 0]))).first()
    assert (r["fraud_count"], r["n_neighbors"]) == (1, 2)
    assert knn.threshold(knn.nearest(q, refs_of(spark, [1, 2], [1, 0]))).first()["tau"] is None
    assert knn.nearest(q.limit(0), refs_of(spark, [1], [1])).count() == 0
    with pytest.raises(ValueError):
        cells.kmeans(refs_of(spark, [1], [1]), 1, 0)


def test_percentiles_take_elements(spark):
    r = evaluate.percentiles(spark.range(1, 101), "id").first()
    assert (r["p50"], r["p90"], r["p99"], r["most"], r["mean"]) == (50, 90, 99, 100, 50.5)


def test_reference_and_validation_files(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps([{"vector": [0.01] + [0.5] * 13, "label": "legit"}, {"vector": [-1] * 14, "label": "fraud"}]))
    assert [tuple(r) for r in load_references(spark, f"{tmp_path}/refs.json").orderBy("idx").collect()] == [(0, [100] + [5000] * 13, 0), (1, [-10000] * 14, 1)]
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [1.0], "label": "legit"}]))
    with pytest.raises(Exception, match="bad reference"):
        load_references(spark, f"{tmp_path}/bad.json").collect()
    entry = {"request": json.loads(GOLDEN[0][0]), "expected_approved": True, "expected_fraud_score": 0.2}
    for name, body in (("list", [entry, entry]), ("object", {"entries": [entry, entry]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        rows = load_validation(spark, f"{tmp_path}/{name}.json").collect()
        assert [r["expected_fraud_score"] for r in rows] == [0.2, 0.2]
        assert read(spark, rows[0]["payload"])[0]["v"] == GOLDEN[0][1]


def test_references_of_many_splits(spark, tmp_path):
    entries = [{"vector": [i / 1000] + [0.5] * 13, "label": "fraud" if i % 3 else "legit"} for i in range(1000)]
    for name, body in (("line", json.dumps(entries)), ("lines", json.dumps(entries, indent=1)), ("none", "[\n]")):
        (tmp_path / name).write_text(body)
    with settings(spark, spark_sql_files_maxPartitionBytes="5000", spark_sql_files_openCostInBytes="1"):
        for name in ("line", "lines"):
            found = load_references(spark, f"{tmp_path}/{name}").collect()
            assert sorted((r["idx"], r["v"][0], r["fraud"]) for r in found) == [(i, i * 10, int(i % 3 > 0)) for i in range(1000)]
        assert load_references(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_blocks_of_queries_equal_brute_force(spark, monkeypatch, broadcast):
    for name, size in (("QUERY_BLOCK", 7), ("REF_BLOCK", 11), ("TASK_BLOCKS", 2)):
        monkeypatch.setattr(knn, name, size)
    rng = np.random.default_rng(3)
    v, asked = rng.integers(0, 3, (300, 14)), rng.integers(0, 3, (60, 14))
    refs = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "idx long, v array<int>, fraud int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "qid long, v array<int>")
    with settings(spark, spark_sql_autoBroadcastJoinThreshold=broadcast):
        found = sorted((r["qid"], r["rank"], r["idx"]) for r in knn.nearest(q, refs).collect())
    order = [np.lexsort((np.arange(300), ((v - x) ** 2).sum(axis=1)))[:5].tolist() for x in asked]
    assert found == [(i, r + 1, idx) for i, x in enumerate(order) for r, idx in enumerate(x)]


def test_report_of_an_index(spark, tmp_path):
    refs = refs_of(spark, range(0, 10000, 50), [i % 2 for i in range(200)])
    cells.save(cells.kmeans(refs, 8, 2), f"{tmp_path}/index", "kmeans")
    entries = [{"request": json.loads(p), "expected_approved": True, "expected_fraud_score": 0.6} for p, _ in GOLDEN]
    entries.append({"request": {"id": "broken"}, "expected_approved": True, "expected_fraud_score": 0.0})
    (tmp_path / "validation.json").write_text(json.dumps(entries))
    got = report(spark, f"{tmp_path}/index", f"{tmp_path}/validation.json", 1, 4, runs=2)
    found = knn.vote(knn.nearest(spark.createDataFrame([(i, v) for i, (_, v) in enumerate(GOLDEN)], "qid long, v array<int>"), refs))
    assert got["total"] == 4 and got["edges"] == 3 and got["probes"]["total"] == 3 and got["seconds"]["total"] == 2
    assert 0 <= got["pruned_share"] < 1 and got["fp"] + got["fn"] == got["mismatches"] - 1 and found.count() == 3


def test_percentiles_over_ranges(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(0, 40, 3000), rng.integers(0, 10**6, 3000)])
    r = evaluate.percentiles(spark.createDataFrame([(int(x),) for x in values], "x long").repartition(6), "x").first()
    values.sort()
    assert [r[c] for c in ("total", "p50", "p90", "p99", "p999", "most")] == [6000, *(values[5999 * a // b] for a, b in ((1, 2), (9, 10), (99, 100), (999, 1000))), values[-1]]


def test_index_is_built_from_a_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "refs.json").write_text(json.dumps([{"vector": [round(x, 4) for x in rng.random(14).tolist()], "label": "fraud"} for _ in range(200)]))
    cells.build_index(spark, f"{tmp_path}/refs.json", f"{tmp_path}/index", 8, 2)
    members, boxed = cells.load(spark, f"{tmp_path}/index")
    assert members.count() == 200 and boxed.count() <= 8


def test_stream_scores_like_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [p for p, _ in GOLDEN] + ["nonsense", payload(merchant=KeyError)]
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    refs = refs_of(spark, range(0, 10000, 100), [i % 2 for i in range(100)])
    stream = spark.readStream.text(f"{tmp_path}/in")
    query = score_stream(stream, refs, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert not ready(query)  # it has ended
    got = {r["payload"]: r["response"] for r in spark.read.parquet(f"{tmp_path}/out/scores").collect()}
    batch = scored(spark.createDataFrame(list(enumerate(lines)), "qid long, payload string"), refs).collect()
    assert got == {lines[r["qid"]]: r["response"] for r in batch}
    assert got["nonsense"] == '{"approved":true,"fraud_score":0.0}'


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL)


def brute(v, asked):
    idx = np.arange(len(v))
    return [(i, r + 1, int(at)) for i, x in enumerate(asked) for r, at in enumerate(np.lexsort((idx, ((v - x) ** 2).sum(axis=1)))[:5])]


def test_nearest_asks_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "REF_BLOCK", 500)
    rounds, met = [], knn._met
    monkeypatch.setattr(knn, "_met", lambda asked, blocks, *more: rounds.append((asked.agg(F.sum("n")).first()[0], blocks.count())) or met(asked, blocks, *more))
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(0, 10000, (12000, 3)), np.zeros((12000, 11), np.int64)], axis=1)
    asked = v[rng.choice(len(v), 300)]
    refs = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "idx long, v array<int>, fraud int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "qid long, v array<int>")
    assert sorted((r["qid"], r["rank"], r["idx"]) for r in knn.nearest(q, refs).collect()) == brute(v, asked)
    (home, n_blocks), (others, _) = rounds
    assert home == 300 and n_blocks >= 24 and others < 300 * n_blocks / 4
    assert knn.nearest(q, refs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["fraud_score", "payload_safe_default"])
def test_vectors_are_made_once(spark, monkeypatch, name):
    limits, written = [], registry.written
    monkeypatch.setattr(registry, "written", lambda df, at: limits.append((at, spark.conf.get("spark.sql.codegen.hugeMethodLimit"))) or written(df, at))
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().analyzed().toString()
    assert ("vectors", "8000") in limits and (name == "fraud_score" or ("read", "8000") in limits)
    assert "from_json" not in plan and "lag(" not in plan  # the result reads written tables
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") != "8000"


def test_exact_search_joins_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "scanned", None)
    rng = np.random.default_rng(7)
    v = rng.integers(0, 3, (40, 14))[rng.integers(0, 40, 6000)] * 100  # about 150 copies of each
    refs = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "idx long, v array<int>, fraud int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:50])], "qid long, v array<int>")
    members = cells.kmeans(refs, 8, 2)
    found = search.exact(q, members, cells.boxes(members))
    assert sorted((r["qid"], r["rank"], r["idx"]) for r in found.collect()) == brute(v, v[:50])


def test_search_of_a_saved_index_joins_no_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search, "scanned", None)
    v = np.random.default_rng(8).integers(0, 50, (3000, 14)) * 100
    refs = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "idx long, v array<int>, fraud int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[::60])], "qid long, v array<int>")
    cells.save(cells.kmeans(refs, 8, 2), f"{tmp_path}/index", "kmeans")
    found = search.exact(q, *cells.load(spark, f"{tmp_path}/index"))
    assert sorted((r["qid"], r["rank"], r["idx"]) for r in found.collect()) == brute(v, v[::60])


def test_a_saved_index_makes_its_boxes_once(spark, monkeypatch):
    made, boxes = [], cells.boxes
    monkeypatch.setattr(cells, "boxes", lambda members: made.append(members) or boxes(members))
    found = registry.QUERIES["index_roundtrip"](spark, SMALL)
    assert len(made) == 1 and found.count() == 5 * found.select("qid").distinct().count() > 0


def test_every_order_is_scored(spark):
    made = registry.QUERIES["vec_full"](spark, SMALL).orderBy("qid").toPandas()
    fraud = spark.read.parquet(f"{SMALL}/orders.parquet").orderBy("o_orderkey").select((F.col("o_orderstatus") == "F").cast("int")).toPandas().to_numpy()[:, 0]
    v = made[[f"d{i}" for i in range(14)]].to_numpy(np.int64)
    counts = [int(fraud[np.lexsort((made["qid"], ((v - x) ** 2).sum(axis=1)))[:5]].sum()) for x in v]
    found = registry.QUERIES["fraud_score"](spark, SMALL).orderBy("qid").collect()
    assert len(found) == len(fraud) > 20
    assert [(r["qid"], r["fraud_count"], r["approved"], r["fraud_score"]) for r in found] == [(q, n, n < 3, n / 5) for q, n in zip(made["qid"], counts, strict=True)]


@pytest.mark.parametrize("most, kept", [(32767, 2), (32768, 4)])
def test_queries_are_sent_narrow_where_they_fit(most, kept):
    q = np.array([[-32768, 0, 5], [1, most, -7]], np.int32)
    sent = blocks._narrow(q).tobytes()
    assert len(sent) == kept * q.size
    got = blocks._wide(sent, 2, 3)
    assert got.dtype == np.int32 and (got == q).all()


def test_wide_values_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "REF_BLOCK", 500)
    v = np.random.default_rng(9).integers(-50000, 50001, (3000, 14))
    refs = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "idx long, v array<int>, fraud int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[::60])], "qid long, v array<int>")
    assert sorted((r["qid"], r["rank"], r["idx"]) for r in knn.nearest(q, refs).collect()) == brute(v, v[::60])
