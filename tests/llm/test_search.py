"""Hard negatives, fingerprints and ranked search against brute force."""
import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import block_max_search, consistent_parse, hard_negatives, oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(oracle.all_sql()[name])
    columns = [c[0] for c in res.description]
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(res.fetchall(), key=str) and got


# ---------------------------------------------------------------- hard negatives
def _mined(rows, every, positives=5, negatives=3):
    part = [(k, [math.floor(256 * x) for x in v], y) for k, v, y in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []

    def order(entry):
        return -entry[0], entry[1] is None, entry[1] or 0

    for i, (k, v, y) in enumerate(part):
        if k is None or k % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), n, z == y) for j, (n, w, z) in enumerate(part) if j != i]
        for p, n, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            fit = sorted((s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:negatives]
            out += [(k, n, r + 1, m, p, s) for r, (s, m, _) in enumerate(fit)]
    return sorted(out, key=str)


def _vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        v = rng.normal(size=20) + 3 * (np.arange(20) == i % 4)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), i % 3))
    rows += rows[:40]  # copies, of anchors too
    rows += [(None, rows[3][1], 1), (None, rows[4][1], 2), (600, None, 1), (601, rows[0][1], None), (610, [float("nan")] * 20, 1),
             (620, [0.1, None], 1), (630, [float("inf")], 0), (640, [0.0] * 20, 0), (650, [1.0], 1), (660, [], 2),
             (670, [1000.0] * 20, 0), (680, [-1000.0] * 20, 1), (690, [999.5] * 20, 1)]
    return rows


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    for name in ("id", "number", "rank", "held", "cell", "codes"):
        df = df.withColumn(name, F.lit(1))
    got = hard_negatives.mine(df, anchor=F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _mined(rows, 10)
    assert len(want) > 100 and sorted(map(tuple, got.collect()), key=str) == want
    assert hard_negatives.mine(df.where("false"), anchor=F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df.where("label = 1"), anchor=F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(2)
    rotation = hard_negatives.Rotation(70)
    vectors = np.floor(256 * rng.normal(size=(200, 70)) * rng.integers(0, 40, (200, 1)))
    codes, align, norm = rotation.encode(vectors)
    row = {"ids": np.arange(200), "labels": np.zeros(200, np.int64), "numbers": np.arange(200), "vectors": vectors.astype(np.int64),
           "codes": codes, "align": align, "norms": norm}
    block = hard_negatives.Block({k: v.tobytes() for k, v in row.items()})
    planes = rotation.planes(vectors)
    width = []
    for k in range(20):
        sums = errors = np.zeros(200)
        score = vectors @ vectors[k]
        for level in range(hard_negatives.LEVELS):
            lower, upper, sums, errors = block.intervals(np.arange(200), level, tuple(x[k] for x in planes), sums, errors)
            assert (lower <= score).all() and (score <= upper).all()
            width.append((level, float((upper - lower).mean())))
    means = [np.mean([w for level, w in width if level == at]) for at in range(hard_negatives.LEVELS)]
    assert all(a > 1.3 * b for a, b in zip(means[:-2], means[1:-1]))  # each level narrows them


def test_anchors_meet_codes_together():
    """All anchors of a tile are bounded at once, as one by one, and ranges that overlap are cut as one."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-300, 300, (300, 70))
    rotation = hard_negatives.Rotation(70)
    codes, align, norm = rotation.encode(vectors.astype(float))
    key = np.arange(300)
    row = dict(zip(hard_negatives.PACKED, (key, key, key, vectors, codes, align, norm), strict=True))
    block = hard_negatives.Block({k: v.tobytes() for k, v in row.items()})
    planes = rotation.planes(vectors[:9].astype(float))
    lower, upper = block.bounds(planes)
    for k in range(9):
        sums = errors = np.zeros(300)
        for level in range(hard_negatives.LEVELS):
            low, high, sums, errors = block.intervals(key, level, tuple(x[k] for x in planes), sums, errors)
        assert np.allclose(lower[k], low) and np.allclose(upper[k], high)
        score = vectors @ vectors[k]
        assert (lower[k] <= score).all() and (score <= upper[k]).all()
        ranges = [(score.max() // 8, score.max() // 3), (score.max() // 9, score.max() // 4), (5, 4)]
        left = hard_negatives._survivors(lower[k], upper[k], ranges, 3)
        for low, high in ranges:
            inside = np.flatnonzero((score >= low) & (score <= high))
            assert set(inside[hard_negatives._first(score[inside], inside, 3)]) <= set(left)
        assert len(left) < 300 and len(hard_negatives._survivors(lower[k], upper[k], [(5, 4)], 3)) == 0



# ---------------------------------------------------------------- fingerprints
def _whole_phrases(text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = []
    for level, _, name, place, _ in consistent_parse.parse(data, np.array([0, len(data)])):
        ends = np.append(place[1:], len(data))
        found += [(level, int(n), int(a), int(b)) for n, a, b in zip(name, place, ends)]
    return found


def test_phrases_cover_texts_and_are_named_by_content():
    rng = np.random.default_rng(4)
    names = {}
    for n in (1, 2, 3, 7, 50, 3000):
        for letters in ("a", "ab", "abcdefgh "):
            text = "".join(rng.choice(list(letters), n))
            found = _whole_phrases(text)
            for level in {f[0] for f in found}:
                cut = [f for f in found if f[0] == level]
                assert cut[0][2] == 0 and cut[-1][3] == n and all(a[3] == b[2] for a, b in zip(cut, cut[1:]))
            assert found[-1][2:] == (0, n)  # the last level is the whole text
            for level, name, a, b in found:
                assert names.setdefault((level, name), text[a:b]) == text[a:b]


def test_equal_substrings_have_equal_interiors():
    rng = np.random.default_rng(6)
    middle = "".join(rng.choice(list("abcdefghij klmno"), 4000))
    inside = []
    for before in ("", "x", "some other words ", "zz" * 41):
        text = before + middle + before[::-1]
        inside.append({(level, name, a - len(before)) for level, name, a, b in _whole_phrases(text)
                       if level <= 5 and a >= len(before) + 1200 and b <= len(before) + 2800})
    assert all(x == inside[0] for x in inside) and len(inside[0]) > 900


def test_fingerprints_against_next(spark, edge):
    docs = edge.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "lang", "source"),
                            allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit(1) for c in ("part", "next", "fingerprint", "name")})
    got = consistent_parse.against_next(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(got) == len(rows)
    single = {k: n for k, n in Counter(k for k, _ in rows).items() if n == 1 and k is not None}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    by_id = {r["doc_id"]: r for r in got}
    for (k, text), (other, after) in zip(rows, rows[1:]):
        if k in single and other in single:
            edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
            assert by_id[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert by_id[k]["n_chars"] == len(text)
            assert (by_id[k]["fingerprint"] == by_id[k]["edited_fingerprint"]) == (text == edited)
            if text == after:
                assert by_id[k]["near_next"] == 1
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for r in consistent_parse.fingerprints(docs).collect():
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert all(r["fingerprint"] in prints[r["doc_id"]] for r in got)
    texts = {}
    for k, text in rows:
        if k in single:
            texts.setdefault(by_id[k]["fingerprint"], set()).add(text)
    assert all(len(t) == 1 for t in texts.values())
    real = [r for r in got if (r["doc_id"] or 0) >= 100 and r["n_chars"] >= 200]
    assert np.mean([r["near_edited"] for r in real]) > 0.65 and np.mean([r["near_next"] for r in real]) < 0.15
    assert consistent_parse.against_next(docs.where("false")).count() == 0
    one = consistent_parse.against_next(docs.where("doc_id = 150")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_likeness_follows_the_shared_part(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]

    def text():
        return " ".join(rng.choice(words, 400))

    a, b = [text() for _ in range(60)], [text() for _ in range(60)]
    for share in (0.0, 0.25, 0.5, 0.9):
        mixed = [x[:int(len(x) * share)] + y[int(len(x) * share):] for x, y in zip(a, b)]
        prints = []
        for texts in (a, mixed):
            data = [t.encode() for t in texts]
            prints.append(consistent_parse.sketched(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])))
        assert abs(consistent_parse.likeness(*prints[0], *prints[1]).mean() - share) < 0.12
        packed = consistent_parse.packed(*prints[0]).to_pylist()
        names, slots = consistent_parse.unpacked(packed)
        assert (names == prints[0][0]).all() and (slots == prints[0][1]).all()


def test_phrases_find_shared_passages(spark):
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefghij klmno"), 3000))
    df = spark.createDataFrame([(1, "before " + passage), (2, passage + " after"), (3, None), (4, "")], "doc_id long, text string")
    found = consistent_parse.phrases(df, least=100)
    shared = found.where("level > 0").groupBy("level", "name").agg(F.count_distinct("doc_id").alias("n"), F.max("n_bytes").alias("b")).where("n = 2")
    assert shared.agg(F.sum("b")).first()[0] > 2000
    assert found.where("level = -1").count() == 2


# ---------------------------------------------------------------- ranked search
def _terms(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def _ranked(docs, items, k):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for name, text in items:
        scored = []
        for d, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // max(n_terms, 1)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t, n in Counter(_terms(text)).items() if bag[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(name, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 20])
def test_search_against_brute_force(spark, edge, monkeypatch, k):
    monkeypatch.setattr(block_max_search, "SHARD", 1 << 16)
    monkeypatch.setattr(block_max_search, "BLOCK", 4)
    monkeypatch.setattr(block_max_search, "ITEMS", 9)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text").unionByName(edge.select("doc_id", "text"))
    common = [(1000 + i, "the of and " * (1 + i % 5) + f"word{i % 7}") for i in range(200)]  # ties
    docs = docs.unionByName(spark.createDataFrame(common, "doc_id long, text string")).withColumns({c: F.lit("x") for c in ("item", "score", "key", "shard")})
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    more = [(900, None), (901, ""), (902, "the the THE of"), (902, "the the THE of"), (903, "nowheretobefound"), (904, "word3 word3 Ünïcode 日本語"), (None, "one")]
    items = items.unionByName(spark.createDataFrame(more, "item_id long, text string")).withColumns({c: F.lit(0) for c in ("doc_id", "rank")})
    got = block_max_search.search(block_max_search.build_index(docs), items, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = _ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], k)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_empty_tables(spark, edge):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for docs in (edge.where("false"), edge.where("text IS NULL")):
        assert block_max_search.search(block_max_search.build_index(docs), items).count() == 0
    assert block_max_search.search(block_max_search.build_index(edge), items.where("false")).count() == 0


def test_blocks_are_rejected_before_they_are_unpacked():
    """A rare term decides; of a frequent one only blocks with documents that are seen are unpacked."""
    n = 100_000
    length = np.full(n, 10, np.int64)
    norm = block_max_search._norms(length, n, 10 * n)

    def listed(docs):
        shard = np.asarray(docs, np.int64)
        block = np.arange(0, len(shard), block_max_search.BLOCK)
        heads = np.stack([shard[block], np.ones(len(block), np.int64), np.full(len(block), 10)], axis=1)
        offset = shard - np.repeat(shard[block], np.diff(np.append(block, len(shard))))
        return block_max_search._List(len(shard), 4, offset.astype("u4").tobytes(), np.ones(len(shard), "u4").tobytes(), heads.tobytes(), norm, n, 10 * n)

    rare, common = listed(np.arange(0, 4000, 100)), listed(np.arange(0, n, 2))
    at, score = block_max_search.top_documents([(rare, 9000), (common, 100)], n, 20)
    assert len(at) == 40 and len(set(score.tolist())) == 1
    assert 0 < (~common.packed).sum() <= 20 < len(common.packed)
