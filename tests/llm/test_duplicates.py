import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import bagminhash, suffix_dedup

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- near duplicates
def _bag(text):
    words = (text or "").split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def _classes(texts):
    bags = {i: _bag(t) for i, t in texts.items()}
    holders = defaultdict(set)
    for i, bag in bags.items():
        for s in bag:
            holders[s].add(i)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, bag in bags.items():
        for b in {x for s in bag for x in holders[s] if x > a}:
            shared = sum((bag & bags[b]).values())
            if shared >= 0.8 * (sum(bag.values()) + sum(bags[b].values()) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    by_text = {}
    for i in sorted(texts):  # exact copies, with or without words
        if (texts[i] or "") in by_text:
            x, y = find(i), find(by_text[texts[i] or ""])
            parent[max(x, y)] = min(x, y)
        by_text.setdefault(texts[i] or "", i)
    return {i: find(i) for i in texts}


def test_classes_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    for i in range(40):  # near copies around one text, some of them linked only through others
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            words[k] = f"v{i}x{k}"
        texts[10_000 + i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = bagminhash.near_duplicates(frame).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == _classes(texts)
    kept = {r["doc_id"] for r in bagminhash.keep_one(frame).collect()}
    assert kept == set(_classes(texts).values())


def test_classes_of_loose_variants(spark):
    """Variants that are like few others, none of them a leader of their buckets."""
    rng = np.random.default_rng(5)
    texts = {}
    for i in range(300):
        words = [f"w{k}" for k in range(120)]
        for k in rng.choice(20, 2, replace=False):
            words[6 * k + 2] = f"v{i}x{k}"
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame).collect()}
    assert got == _classes(texts)
    assert 100 < len(set(got.values())) < 200


def test_leaders_stop_when_they_link_few(spark, monkeypatch):
    """A chain that leaders link a few at a time, among variants that share buckets and are not alike: what a round
    of leaders leaves is joined at once, not round by round."""
    texts = {i: " ".join(f"v{i}" if k == i else f"{'x' if k < i else 'w'}{k}" for k in range(60)) for i in range(60)}
    for i in range(100, 250):
        texts[i] = " ".join(f"u{i}x{k}" if k % 19 == i % 19 else f"y{k}" for k in range(120))
    rounds, mixed = [], bagminhash._mixed
    monkeypatch.setattr(bagminhash, "_mixed", lambda *a: rounds.append(1) or mixed(*a))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame).collect()}
    assert got == _classes(texts)
    assert len(rounds) <= 3, rounds


def test_near_duplicate_edges(edge, empty):
    got = bagminhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    classes = defaultdict(set)
    for r in got:
        classes[r["doc_id"]].add(r["class_id"])
    assert classes[5] == classes[6] == {5} and classes[1] == classes[2] == {1}
    assert classes[7] == {7} and classes[None] == {None}
    assert bagminhash.near_duplicates(empty).count() == 0
    assert sorted(bagminhash.keep_one(edge).columns) == sorted(edge.columns)


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    codes.sort()
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    a[:10], b[50:] = 1, 20
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert bagminhash.similarity(codes, a, codes, b) == pytest.approx(want)
    slots = 6000
    row = np.repeat([0, 1], 60)
    best = bagminhash.signatures(row, np.concatenate([codes, codes]), np.concatenate([a, b]), 2, slots)
    assert (best[0] == best[1]).mean() == pytest.approx(want, abs=0.03)


def test_components(spark):
    nodes = spark.range(0, 40).selectExpr("id", "id as class")
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 39)] + [(3, 9), (9, 4), (4, 20)], "a long, b long")
    got = {r["id"]: r["class"] for r in bagminhash.components(nodes, links).collect()}
    assert {i for i, c in got.items() if c == 3} == {3, 4, 9, *range(20, 40)}
    assert all(got[i] == i for i in range(40) if i not in (4, 9) and i < 20)


# ---------------------------------------------------------------- repeated strings
def _removed(rows, match=100):
    seen, out = {}, {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - match + 1):
            if seen.setdefault(data[p:p + match], (key, p)) != (key, p):
                covered[p:p + match] = b"\1" * match
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        out[key] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [suffix_dedup.BUCKET, 400])
def test_repeats_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    letters = list("abcdefgh ")
    passage = "".join(rng.choice(letters, 700))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i in range(120):  # one passage in many texts, with single bytes changed: a hot anchor with many contexts
        part = list(passage)
        for k in rng.integers(0, 700, 3):
            part[k] = rng.choice(letters)
        rows.append((5000 + i, "".join(rng.choice(letters, 50)) + "".join(part) + "é" * int(rng.integers(0, 90))))
    rows += [(9000, "ab" * 300), (9001, "x" * 99), (9002, "x" * 100), (9003, "x" * 101), (9004, "x" * 2000),
             (9005, "é" * 120), (9006, ""), (9007, None), (9008, "abc" * 77 + passage[:150] * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame, sample=4).collect()
    want = _removed(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 50_000


def test_repeat_edges(spark, edge, empty):
    got = suffix_dedup.remove_repeats(edge, with_text=True).collect()
    assert len(got) == edge.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["n_removed"] for r in by[5]] == [27 * 9 - 27]  # all but its first period
    assert {r["kept"] for r in by[6]} == {""} and len(by[6]) == 2
    assert by[7][0]["n_removed"] == by[7][0]["n_bytes"] - len("alpha beta gamma delta ")
    assert [(r["n_bytes"], r["n_removed"]) for r in by[2]] == [(0, 0)]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 5, 300) for _ in range(3)]
    order = suffix_dedup.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys, strict=True))


def test_few_words_alone_in_a_slice(spark):
    for n in range(6):
        text = " ".join("abcdef"[:n])
        row, code, count = bagminhash.shingles(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert len(row) == (n > 0) + (n > 5) and (count == 1).all()
        frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").repartition(2)
        assert {r["class_id"] for r in bagminhash.near_duplicates(frame).collect()} == {1}


def test_keep_one_keeps_every_text(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(30)) for w in "abc")
    near = a.replace("a7 ", "other ")
    rows = [(1, a), (5, a), (5, b), (8, c), (8, c), (9, near), (None, a), (None, None), (10, None), (11, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as digest", "2 as node", "3 as class")
    kept = bagminhash.keep_one(frame, threshold=0.6)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, a), (1, a), (5, b), (8, c), (10, "")]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in bagminhash.near_duplicates(frame, threshold=0.6).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (5, 1), (5, 5), (8, 8), (8, 8), (9, 1), (10, 10), (11, 10)]
