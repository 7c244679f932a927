import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, exact, kernels, licenses, lines, near, packing, pieces, quality, queries, sharding, tokencount, urls
from quillon.llm.common import table, written

from ..oracle import same
from . import brute

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, label string, row string, size string, n string"


def odd_docs(spark, rows=None):
    """Nulls in any column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    long_text = " ".join(f"w{i % 997}" for i in range(60_000))
    plain = "the quick brown fox jumps over the lazy dog near the old river bank today\nand again it runs"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, plain), (4, plain), (4, plain), (None, plain), (None, None), (5, long_text), (6, long_text + " end"), (7, "a"), (8, plain.upper()), (9, "é ﬁ 日本 <|endoftext|> ▁x\x00y")] if rows is None else rows
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", 1, "x", "y", "z", "q", "r") for i, t in rows], DOCS)


def empty(spark):
    return odd_docs(spark).limit(0)


ROWWISE = {
    "quality": quality.quality_rules,
    "exact": exact.exact_query,
    "near": near.near_dedup,
    "licenses": licenses.license_scan,
    "pieces": lambda d: pieces.n_best_encoding(d, pieces.default_model()),
    "tokens": lambda d: tokencount.token_counts(d, pieces.default_model()),
    "sharding": sharding.sharded,
}


@pytest.mark.parametrize("name", ROWWISE)
def test_odd_rows_and_empty_tables(spark, name):
    docs = odd_docs(spark)
    found = ROWWISE[name](docs).collect()
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids(found) == ids(docs.collect())
    assert ROWWISE[name](empty(spark)).collect() == []


@pytest.mark.parametrize("keep", [quality.quality_filter, exact.exact_filter, near.near_filter])
def test_filters_return_the_columns(spark, keep):
    docs = odd_docs(spark)
    assert keep(docs).columns == docs.columns
    assert keep(empty(spark)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], TINY)


def test_repeated_words():
    rng = random.Random(3)
    for n in (0, 4, 5, 6, 30, 200):
        w = [rng.choice([b"a", b"b"]) for _ in range(n)]
        windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
        covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 5)}
        assert kernels.repeated(w) == len(covered)


def test_sketch_buckets_and_merging(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 1000, 123_456, 10**12]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.expr(quality.bucket("v")).alias("b")).collect()
    assert all(r["b"] <= r["v"] and (r["v"] - r["b"]) * 32 <= r["v"] for r in got)
    assert all(r["b"] == r["v"] for r in got if r["v"] < 64)


def test_junk_goes_and_clean_stays(spark):
    found = quality.quality_rules(table(spark, SMALL, "documents")).toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    both = found[~found.base_failed].merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.99 and both[both.quality == 0].kept.mean() < 0.1


def test_exact_keeps_the_largest_id_and_one_of_equal_rows(spark):
    found = exact.exact_query(odd_docs(spark)).collect()
    plain = [r for r in found if r["group_size"] == 4]
    assert len(plain) == 4 and {r["keep_id"] for r in plain} == {4} and sum(r["kept"] for r in plain) == 1
    nothing = [r for r in found if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(nothing) == 3 and {r["keep_id"] for r in nothing} == {1}


def test_exact_sees_past_the_prefix(spark):
    head = "x" * 300
    found = exact.exact_query(odd_docs(spark, [(1, head + "a"), (2, head + "b"), (3, head + "a")])).collect()
    assert {r["doc_id"]: r["keep_id"] for r in found} == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("sf", [TINY, SMALL])
def test_near_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute.near([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_dedup(docs).collect()}
    assert got == want


def test_near_links_a_chain_and_a_hub(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]

    def edited(base, at):
        out = list(base)
        for i in at:
            out[i] = f"x{rng.random()}"
        return out

    hub = [" ".join(edited(words, [2 * i])) for i in range(12)] + [" ".join(words)]
    chain, own = [], words[::-1]
    for i in range(8):
        chain.append(" ".join(own))
        own = edited(own, [25 * i % 200])
    rows = list(enumerate(hub + chain + ["a b c d e f g h"]))
    want = brute.near(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_dedup(odd_docs(spark, rows)).collect()}
    assert got == want and got[len(hub)][1] == len(hub) and got[len(rows) - 1][1] == len(rows) - 1


def test_near_equals_brute_force_on_repeated_rows(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        base = [f"r{rng.randrange(5000)}" for _ in range(60)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base[:59] + ["z"]))]
    rows += [(2000 + i, rows[2 * i][1]) for i in range(20)]
    want = brute.near(rows)
    for docs in (odd_docs(spark, rows + rows), odd_docs(spark, rows + rows[::2] + rows[::3])):
        found = near.near_dedup(docs).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want and len(found) == docs.count()


def test_near_links_each_text_of_a_document(spark):
    """Document 1 has a long and a short text of which each is near another document's."""
    long, short = [f"l{i}" for i in range(300)], [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(long)), (1, " ".join(short)), (2, " ".join(long[:299])), (3, " ".join(short[:59])), (4, "a b c d e f")]
    got = {r["doc_id"]: r["component_id"] for r in near.near_dedup(odd_docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_one_permutation_estimates_similarity():
    rng = np.random.default_rng(2)
    for size, extra in ((300, 100), (40, 10), (2000, 200)):
        agree = []
        for _ in range(30):
            x = rng.integers(0, 2**63, size + extra, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x), np.unique(x[:size])
            agree.append((kernels.one_permutation(a) == kernels.one_permutation(b)).mean())
        assert abs(np.mean(agree) - size / (size + extra)) < 0.05


def check_packing(spark, docs, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.harmonic_packing(docs, path, capacity).toPandas()
    totals = rows.groupby("sequence_id").length.sum()
    assert (totals <= capacity).all() and ((totals & (totals - 1)) == 0).all()  # no padding at all
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    for doc_id, own in rows.dropna(subset=["doc_id"]).groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 1], np.uint32)
        for x in own.itertuples():
            assert x.doc_tokens == len(ids) and zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32
        assert own.length.sum() % len(ids) == 0
    return rows


def test_packing(spark):
    check_packing(spark, table(spark, TINY, "documents"))
    check_packing(spark, odd_docs(spark))
    check_packing(spark, odd_docs(spark).where("doc_id < 4"), 8)
    assert packing.harmonic_packing(empty(spark), packing.default_tokenizer()).collect() == []


def test_packing_cuts_little(spark):
    own = packing.harmonic_packing(table(spark, SMALL, "documents").coalesce(1), packing.default_tokenizer()).toPandas()
    docs = own.groupby("doc_id").agg(pieces=("length", "size"), total=("doc_tokens", "first"))
    assert len(own) <= (-(-docs.total // packing.CAPACITY)).sum() + 1.5 * own.sequence_id.nunique()
    assert ((own.length < packing.CAPACITY // packing.LEAST) & (own.length < own.doc_tokens)).sum() <= 30  # at a task's end
    assert not ((own.length == 1) & (own.doc_tokens > 1)).any()
    totals = own.groupby("sequence_id").length.sum()
    assert (totals < packing.CAPACITY).sum() <= 11


def test_bins_take_all_lengths():
    rng = np.random.default_rng(5)
    for capacity, lengths in [(2048, rng.integers(1, 6000, 2000)), (2048, [65] * 3000), (2048, [2049] * 500), (64, [1] * 500), (64, rng.integers(1, 200, 2000)), (4, rng.integers(1, 9, 300)), (2048, [])]:
        bins, texts, got, at = packing.Bins(0, capacity), [], {}, {}
        for i, n in enumerate(lengths):
            texts.append(rng.bytes(4 * int(n)))
            bins.add(i, texts[-1])
            assert len(bins.waiting) <= packing.WAITING
        bins.finish()
        for doc, start, n, crc, total, sequence, offset in bins.taken():
            assert crc == zlib.crc32(texts[doc][4 * start : 4 * (start + n)]) and 4 * total == len(texts[doc])
            assert offset == at.get(sequence, 0)
            at[sequence] = offset + n
            got.setdefault(doc, []).append((start, n))
        for i, n in enumerate(lengths):
            parts = sorted(got[i])
            assert parts[0][0] == 0 and sum(x for _, x in parts) == n and all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))
        assert all(n <= capacity and n & (n - 1) == 0 for n in at.values()) and sum(n < capacity for n in at.values()) <= 11


def test_url_rules(spark):
    cases = [
        (0, None, "", "", None, "allow"), (1, "no scheme", "", "", None, "allow"), (2, "http://NET/", "net", "/", "net/", "block"), (3, "http://a.net", "a.net", "", None, "allow"),
        (4, "http://anet/x", "anet", "/x", None, "allow"), (5, "http://www.Example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"), (6, "http://example.net/En/1", "example.net", "/En/1", "net/", "block"),
        (7, "x://a.org/fr/#y", "a.org", "/fr/", "org/fr/", "allow"), (8, "http://spam-farm.org/fr/a", "spam-farm.org", "/fr/a", "org/fr/", "allow"), (9, "http://spam-farm.example.org/", "spam-farm.example.org", "/", None, "block"),
        (10, "http://x?://b.net/", "x", "", None, "allow"), (11, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (12, "", "", "", None, "allow"), (12, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in cases], "page_id long, url string, host string, rule string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(pages).orderBy("page_id").collect()]
    assert got == [(i, *x) for i, _, *x in cases]
    assert urls.url_filter(pages.limit(0)).collect() == []


def test_pieces_against_all_segmentations():
    v = pieces.Vocabulary(pieces.default_model())
    encoder = pieces.Encoder(pieces.default_model(), 4)

    def every(text):
        if not text:
            return [(0.0, ())]
        out = []
        for start, ids, score in v.ending(text, len(text)):
            out += [(s + score, x + ids) for s, x in every(text[:start])]
        return out

    for text in ("hello", "a b", "the cat\nsat", "é日x", "  x  y", "to be, or"):
        want = sorted((-s for s, _ in every(pieces.prepared(text))))[:4]
        found = encoder.encode(text)
        assert np.allclose([-s for s, _ in found], want[: len(found)]) and len(found) == min(4, len(want))
        ids = [tuple(array("i", x)) for _, x in found]
        assert len(set(ids)) == len(ids) and all(v.decode(x) == text for x in ids)
        trie = tokencount.Trie(v)
        assert sum(trie[t][0] for t in pieces._CHUNK.findall(pieces.prepared(text))) == len(ids[0])


def test_pieces_decode_to_the_text(spark):
    docs = table(spark, TINY, "documents")
    found = written(pieces.n_best_encoding(docs, pieces.default_model()), "encoded")
    assert found.where("not round_trip").count() == 0
    back = pieces.decoded(found.select("doc_id", F.col("ids")[0].alias("ids")), pieces.default_model())
    assert back.join(docs.withColumnRenamed("text", "own"), "doc_id").where("text <> own").count() == 0


def test_license_base_places_and_edits():
    def scan(text):
        n_words, n_base, first, last, base, labels, score, spans = licenses.scan(text.encode(), licenses.PHRASES, licenses.NOTICES)
        return n_words, n_base, first, last, base, labels, score, spans

    assert scan("")[:7] == (0, 0, None, None, "", "", 0.0)
    assert scan("CC-BY, cc by cc.by")[:5] == (6, 3, 0, 4, "cc-by")
    found = scan("x All RIGHTS\n reserved; the General Public  License")
    assert found[:5] == (8, 2, 1, 5, "gpl,reserved") and found[6] == 1.0
    edited = scan("this was Relased under teh MIT License by them")
    assert edited[4] == "" and edited[5] == "mit" and 0.8 < edited[6] < 1 and edited[7][0]["edits"] >= 2
    assert edited[7][0]["first_word"] == 2 and edited[7][0]["end_word"] == 7
    assert scan("plain words without any notice")[5] == ""


@pytest.mark.parametrize("exact_at", [0, 2, 5])
def test_license_notices_in_a_row(exact_at):
    notices = ["released under the mit licence"] * 5
    notices.insert(exact_at, "released under the mit license")
    *_, base, labels, score, spans = licenses.scan(" ".join(notices).encode(), licenses.PHRASES, licenses.NOTICES)
    assert [(x["first_word"], x["end_word"]) for x in spans] == [(5 * i, 5 * i + 5) for i in range(6)]
    assert [x["edits"] for x in spans] == [int(i != exact_at) for i in range(6)]
    assert (base, labels, score) == ("", "mit", 1.0)


def test_shards_are_even_and_few_rows_move(spark):
    docs = table(spark, SMALL, "documents")
    found = sharding.sharded(docs).toPandas()
    counts = found["shard"].value_counts()
    assert len(counts) == 40 and counts.max() - counts.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in found.groupby("shard").slot)
    more = sharding.sharded(docs, 41).toPandas().merge(found, on="doc_id")
    assert (more.shard_x != more.shard_y).mean() < 0.06


def test_shards_with_one_key_in_many_rows(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'t' as text")
    counts = sharding.sharded(rows).toPandas()["shard"].value_counts()
    assert counts.sum() == 9000 and counts.max() - counts.min() <= 1


def brute_lines(rows, percent=90):
    seen, out = [], {}
    for i, text in sorted(rows):
        for j, line in enumerate((text or "").split("\n")):
            words = frozenset(x for x in re.split("[ \t\x0b\x0c\r]+", line.lower()) if x)
            if words:
                out[i, j] = next((at for at, o in seen if 100 * len(words & o) >= percent * len(words | o)), None)
                seen.append(((i, j), words))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(4):
            line = list(rng.choice(pool))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = f"n{rng.randrange(400)}"
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    docs = odd_docs(spark, [*rows, (100, None), (101, ""), (102, "\n \n")])
    found = lines.line_dedup(docs)
    got = {(r["doc_id"], r["line_no"]): None if r["kept"] else (r["match_doc"], r["match_line"]) for r in found.collect()}
    want = brute_lines(rows)
    assert got == want and sum(v is not None for v in want.values()) > 20
    texts = {r["doc_id"]: r["text"] for r in lines.without_lines(docs, found).collect()}
    assert all(texts[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if want.get((i, j)) is None) for i, t in rows)
    assert texts[100] is None and lines.line_dedup(empty(spark)).collect() == []


def test_variants_of_a_line_equal_brute_force(spark):
    """Variants that drift away from the first one: the earliest line of a token is often not similar itself."""
    rng = random.Random(23)
    rows, line = [], [f"v{i}" for i in range(30)]
    for i in range(250):
        if i % 5 == 0:
            line[rng.randrange(30)] = f"d{rng.randrange(60)}"
        own = list(line)
        own[rng.randrange(30)] = f"d{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    found = lines.line_dedup(odd_docs(spark, rows)).collect()
    got = {(r["doc_id"], r["line_no"]): None if r["kept"] else (r["match_doc"], r["match_line"]) for r in found}
    assert got == brute_lines(sorted(rows))
    assert any(m and m[0] > 20 for m in got.values())


@pytest.mark.parametrize(("percent", "many", "looked_up"), [(90, 1000, 1000), (90, 1000, 0), (90, 3, 1000), (80, 1000, 1000), (80, 3, 0)])
def test_lines_by_parts_equal_brute_force(spark, monkeypatch, percent, many, looked_up):
    """Pairs at the threshold and beside it, of all sizes, whose parts are cut in both ways, with crowded parts and without."""
    monkeypatch.setattr(lines, "MANY", many)
    monkeypatch.setattr(lines, "LOOKED_UP", looked_up)
    rng = random.Random(31)
    rows = []
    for n in (*range(3, 48), 90, 91, 171, 190, 330):
        line = [f"w{rng.randrange(2000)}" for _ in range(n)]
        for d in {0, 1, 2, n * (100 - percent) // 100, n * (100 - percent) // 100 + 1, n * (100 - percent) // (100 + percent)}:
            left, put = line[: n - d], [f"x{rng.randrange(10**6)}" for _ in range(d)]
            rows += [" ".join(x) for x in (line, left, line + put, left + put) if x]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    found = lines.line_dedup(odd_docs(spark, rows), percent).collect()
    got = {(r["doc_id"], r["line_no"]): None if r["kept"] else (r["match_doc"], r["match_line"]) for r in found}
    assert got == brute_lines(rows, percent)


def test_lines_seldom_meet_by_chance(spark, monkeypatch):
    """Lines of a few hundred words, each of which very many lines have."""
    met, written = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name, **more: met.append((name, out := written(df, name, **more), out.count())) or out)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(20, 60)))) for i in range(4000)]
    rows += [(4000 + i, rows[i][1] + " more") for i in range(10)]
    found = lines.line_dedup(odd_docs(spark, rows)).collect()
    assert {(r["doc_id"], r["match_doc"]) for r in found if not r["kept"]} == {(4000 + i, i) for i in range(10)}
    assert sum(n for name, _, n in met if name == "index") < 400


def test_lines_take_odd_rows(spark):
    docs = odd_docs(spark)
    found = lines.line_dedup(docs).collect()
    kept = [(r["doc_id"], r["line_no"]) for r in found if r["kept"]]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, 0), (None, 1), (5, 0), (7, 0), (9, 0)]))
    lost = {(r["doc_id"], r["line_no"]): (r["match_doc"], r["match_line"]) for r in found if not r["kept"]}
    assert lost == {(6, 0): (5, 0)} | {(i, j): (None, j) for i in (3, 4, 8) for j in (0, 1)} and len(found) == 14


def test_lines_are_taken_out_by_row(spark):
    """Repeated rows keep one copy of each line, and rows without a doc_id lose their own lines only."""
    rows = [(1, "alpha one\nbeta two"), (1, "alpha one\nbeta two"), (1, "alpha one\nbeta two"), (1, "gamma three\ndelta four"), (2, "alpha one\nepsilon five")]
    rows += [(None, "zeta six\n\neta seven"), (None, "theta eight\nzeta six\nown nine"), (None, "iota ten\nown eleven"), (None, "iota ten\nown eleven"), (None, None), (3, "eta seven")]
    docs = odd_docs(spark, rows)
    out = lines.without_lines(docs, lines.line_dedup(docs))
    assert out.columns == docs.columns
    got = [(r["doc_id"], x) for r in out.collect() for x in (r["text"] or "").split("\n") if x]
    want = [(1, "alpha one"), (1, "beta two"), (1, "gamma three"), (1, "delta four"), (2, "epsilon five")]
    want += [(None, x) for x in ("zeta six", "eta seven", "theta eight", "own nine", "iota ten", "own eleven")]
    assert out.count() == len(rows) and sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("literal", [urls.MOST_LITERAL, 10])
def test_url_rules_equal_brute_force(spark, monkeypatch, literal):
    """Rules with and without tokens, from a literal and from a table."""
    monkeypatch.setattr(urls, "MOST_LITERAL", literal)
    rng = random.Random(4)
    names = [f"w{i}" for i in range(40)]
    rules = [urls.host_rule(f"{rng.choice(names)}.{rng.choice(names)}/{rng.choice(['', rng.choice(names) + '/'])}", rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [urls.word_rule(x, "block") for x in names[:5]] + [urls.Rule("any-q", "q+$", (), "block", rank=1)]
    links = [f"http://{rng.choice(['', 'a.'])}{rng.choice(names)}.{rng.choice(names)}/{rng.choice(names)}/{rng.choice(['', 'qq'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i % 350, u) for i, u in enumerate(links)], "page_id long, url string")

    def want(url):
        at = url[7:]
        fits = [r for r in rules if re.search(r.pattern, at)]
        best = [min((r for r in fits if r.base is b), key=lambda r: (-r.rank, r.name, r.pattern, r.verdict), default=None) for b in (True, False)]
        return (*[r and r.name for r in best], next((r.verdict for r in best if r), "allow"))

    got = [(r["page_id"], r["rule"], r["pattern_rule"], r["verdict"]) for r in urls.url_filter(pages, rules).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i % 350, *want(u))) for i, u in enumerate(links))
    assert any(g[1] for g in got) and any(g[2] == "any-q" for g in got)


def test_filters_are_sized_by_their_keys(spark, monkeypatch):
    """As many rows get through with many keys as with few, and beyond the broadcast bound only members do."""
    for keys in (1000, 400_000):
        held = common.Members(spark.range(0, 2 * keys, 2), "id").marked(spark.range(2 * keys), "held", F.col("id"))
        r = held.agg(F.count_if(F.expr("held and id % 2 = 0")).alias("in"), F.count_if(F.expr("held and id % 2 = 1")).alias("out")).first()
        assert r["in"] == keys and r["out"] < 0.13 * keys
    monkeypatch.setattr(common.Members, "MOST_BITS", 1)
    held = common.Members(spark.range(0, 200, 2), "id").marked(spark.range(200), "held", F.col("id"))
    assert held.where("held").count() == 100 and held.count() == 200
    docs = table(spark, TINY, "documents")
    same(spark, lambda s, d: exact.exact_query(docs), exact.ORACLE_SQL, TINY)


def test_shards_equal_a_plain_ring(spark):
    """Clockwise overflow by arc and rank, with sizes and checksums, against a walk over the ring."""
    docs = table(spark, TINY, "documents")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("k")).collect()}
    ring = sharding.Ring(40)
    room = [len(texts) // 40 + (s < len(texts) % 40) for s in range(40)]
    waiting = {}
    for i, k in sorted(keys.items(), key=lambda x: x[1]):
        at = next((j for j, p in enumerate(ring.at.tolist()) if k <= p), 0)
        waiting.setdefault(at, []).append((at, i))
    order, want = {}, {}
    for at in sorted(waiting):  # slices of the ring count an arc's keys in order of their hash
        order[at] = [i for _, i in waiting[at]]
    queue = [(at, own) for at, own in order.items()]
    while queue:
        onward = []
        for at, own in queue:
            s = int(ring.owner[at])
            for i in own[: room[s]]:
                want[i] = s
            taken = min(len(own), room[s])
            room[s] -= taken
            if own[taken:]:
                onward.append(((at + 1) % len(ring.owner), own[taken:]))
        queue = onward
    for r in sharding.sharded(docs).collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
        assert r["shard"] == want[r["doc_id"]]


def test_tables_of_an_operator_go(spark):
    """What is left in the shared folder is what the result reads."""
    import os

    folder = common.shared_folder(spark).removeprefix("file:") + "/quillon"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = lines.line_dedup(odd_docs(spark))
    left = set(os.listdir(folder)) - before
    read = {f.rsplit("/", 2)[1] for f in found.inputFiles()}
    assert left == read and len(left) < 10
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
