import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quarry.llm import adaptive_rules, bpe_automaton, decontaminate, fasttext, hash_tree, lm_score, queries, toxicity
from quarry.llm.buffers import flat

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- classifiers
def _crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("query, label, modulus, held, least",
                         [("op1_quality", "quality", 3, 1, 0.9), ("op5_toxicity", "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    sf = "/root/testdata/sf0.01"
    rows = queries.queries()[query](spark, sf).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (_crc(r["doc_id"], modulus) == held) and 0 <= r["score"] <= 1 for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in tested]) >= least


def test_sample_has_one_text_a_key(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), *[(2, "c")] * 50, (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = fasttext.labelled_sample(docs, labels, "quality", F.lit(True), 5)
    assert got == (["a", "c", ""], [1, 0, 1])


def test_folded_quality_score_is_the_softmax_of_the_mean():
    model = fasttext.train(["good words here"] * 20 + ["bad### bad### bad###"] * 20, [1] * 20 + [0] * 20)
    texts = ["good words here", "bad### bad### bad###", "", "x"]
    together = model.score(*flat(pa.array(texts)))
    assert together[0] > 0.9 and together[1] < 0.1
    assert np.allclose(together, [model.score(*flat(pa.array([t])))[0] for t in texts])


def test_noisy_or_finds_the_sentence(spark, edge, empty):
    texts = [f"calm words number {i}. more calm words." for i in range(60)]
    texts += [f"calm words number {i}. you awful thing. more calm words." for i in range(60)]
    model = toxicity.train(texts, [0] * 60 + [1] * 60)
    df = spark.createDataFrame([(texts[0],), (texts[-1],)], "text string")
    clean, toxic = toxicity.score_texts(df, model, locate=True).collect()
    assert clean["score"] < 0.3 <= toxic["score"] and not clean["offending"]
    (place,) = toxic["offending"]
    assert texts[-1][place["start"]:place["end"]] == "you awful thing"
    scored = toxicity.score_texts(edge, model, locate=True).collect()
    assert len(scored) == edge.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_texts(empty, model).count() == 0


def test_classifiers_without_labels(edge, empty):
    for module in (fasttext, toxicity):
        for labels, want in (([], 0.5), ([1, 1], 1.0)):
            model = module.train(["a"] * len(labels), labels)
            assert all(abs(r["score"] - want) < 1e-5 for r in module.score_texts(edge, model).collect())
        assert module.score_texts(empty, module.train([], [])).count() == 0


# ---------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def test_tokens_equal_the_library(spark, edge, empty, library):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    encoded = bpe_automaton.encode(df, queries.tokenizer_path())
    for r in bpe_automaton.decode(encoded, queries.tokenizer_path()).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe_automaton.digest(empty, queries.tokenizer_path()).count() == 0


def test_random_text_tokens(library):
    import random
    rnd = random.Random(5)
    tokenizer = bpe_automaton.tokenizer_source(queries.tokenizer_path())()
    texts = ["".join(chr(rnd.choice([rnd.randint(1, 0x250), rnd.randint(32, 126), rnd.randint(0x250, 0x3000)]))
                     for _ in range(40)) for _ in range(300)] + ["a" * 700, "tha" * 500, "ΑΣ ΣΑ İ"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [e.tolist() for e in tokenizer.encode_all(texts)] == want


def test_gadgets_against_plain_merging():
    """Toy rules, all words up to 7 letters: the automaton and the walk accept what merging gives."""
    import itertools
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "aa"), ("ab", "ab"), ("aa", "aa"), ("b", "b"), ("bb", "a")]
    vocabulary = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    automaton = bpe_automaton.TokenAutomaton(vocabulary, merges)
    symbols = bpe_automaton.byte_symbols()
    walker = bpe_automaton.Walker(automaton, symbols, "")
    for n in range(1, 8):
        words = ["".join(w) for w in itertools.product("ab", repeat=n)]
        packed = walker.paths([w.encode() for w in words])
        for word, got in zip(words, packed, strict=True):
            parts = list(word)
            for x, y in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == x and parts[i + 1] == y:
                        parts[i:i + 2] = [x + y]
                    i += 1
            want = [vocabulary[p] for p in parts]
            assert automaton.path(word) == want
            assert np.frombuffer(got, np.int32).tolist() == want


# ---------------------------------------------------------------- language models
def test_cross_entropy_difference(spark, edge, empty):
    docs = spark.createDataFrame([(i, "blue sky over green hills" if i % 2 else "buy now cheap offer") for i in range(40)],
                                 "doc_id long, text string")
    scored = {r["text"]: r for r in lm_score.score_documents(docs, docs.where("doc_id % 2 = 1")).collect()}
    assert scored["blue sky over green hills"]["score"] > 0.1 > 0 > scored["buy now cheap offer"]["score"]
    # by hand: start pair, then four pairs; each word and pair once per target text
    added, size = 0.1, 9  # words of both models
    single = (20 + added) / (100 + added * size)
    assert scored["blue sky over green hills"]["target_loss"] == pytest.approx(-np.log(0.5 + 0.5 * single), rel=1e-5)
    rows = lm_score.score_documents(edge, empty).collect()
    assert len(rows) == edge.count() and all(np.isfinite(r["score"]) for r in rows)
    assert lm_score.score_documents(empty, empty).count() == 0


def test_losses_against_exact_counts(spark, monkeypatch):
    """Thousands of words and pairs, none of which shares its count with another."""
    monkeypatch.setattr(lm_score, "BLOCK", 4000, raising=False)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 6000, rng.integers(0, 60))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.score_documents(frame, frame.where("doc_id % 3 = 0")).collect()}
    assert len(got) == len(texts)
    for column, part in (("target_loss", texts[::3]), ("background_loss", texts)):
        single = Counter(w for t in part for w in t.split())
        seen = single + Counter({None: sum(bool(t.split()) for t in part)})
        pairs = Counter(p for t in part for p in zip([None, *t.split()], t.split()))
        total = sum(single.values()) + 0.1 * len({w for t in texts for w in t.split()})
        for i, text in enumerate(texts):
            losses = [-np.log(0.5 * pairs[a, b] / seen[a] + 0.5 * (single[b] + 0.1) / total if seen[a]
                              else (single[b] + 0.1) / total) for a, b in zip([None, *text.split()], text.split())]
            assert got[i][column] == pytest.approx(np.mean(losses) if losses else 0, rel=1e-9)
            assert got[i]["n_tokens"] == len(losses)


# ---------------------------------------------------------------- rules
def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(repeated))


def test_rule_counts_against_brute_force(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    df = docs.unionByName(edge.select(*docs.columns).where("doc_id is not null").selectExpr("-doc_id as doc_id", *docs.columns[1:]))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = adaptive_rules.judge(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, chars, symbols, dups, repeats = _counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, chars, symbols, dups, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert r["kept"] == (not r["base_failed"] and not r["reasons"])
    assert adaptive_rules.judge(empty).count() == 0
    assert adaptive_rules.judge(edge).count() == edge.count()


def test_thresholds_follow_the_group(spark):
    rows = [(i, " ".join(f"w{i + 100}x{k}" for k in range(80)), "en", "s") for i in range(100)]
    rows.append((100, " ".join(f"w{k + 100}y###" for k in range(80)), "en", "s"))
    rows += [(200 + i, " ".join(f"w{i + 100}y{k}###" for k in range(80)), "en", "markup") for i in range(100)]
    got = {r["doc_id"]: r for r in adaptive_rules.judge(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior=5.0).collect()}
    assert not got[100]["kept"] and "symbols_per_word" in got[100]["reasons"]
    assert all(got[i]["kept"] for i in range(100)) and all(got[200 + i]["kept"] for i in range(100))


@pytest.mark.parametrize("prior", [0.0, 30.0, 200.0])
def test_verdicts_against_exact_quantiles(spark, prior):
    """Groups within the sketch's size: its quantiles are exact."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        words = ["".join(rng.choice(list("abcdef"), max(1, int(rng.normal(5, 1))))) for _ in range(60 + int(rng.integers(40)))]
        for k in range(int(rng.integers(0, 4)) ** 3 if i % 9 == 0 else 0):
            words[k] = "#$%"
        lines = "\n".join(" ".join(words[k:k + 10]) for k in range(0, len(words), 10))
        rows.append((i, lines + ("\n" + " ".join(words[:10])) * (i % 7 == 0), None if i % 50 == 0 else "en" if i % 3 else "de", f"s{i % 4}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in adaptive_rules.judge(df, prior=prior).collect()}
    ratio, group, whole = {}, {}, {}
    for i, text, lang, source in rows:
        n_lines = len([x for x in text.split("\n") if x.strip()])
        parts = {**got[i].asDict(), "n_lines": n_lines}
        if not got[i]["base_failed"]:
            ratio[i] = {r: parts[a] / max(parts[b], 1) for r, (a, b, *_) in adaptive_rules.RATIOS.items()}
            group.setdefault((lang, source), []).append(i)
            whole.setdefault(lang, []).append(i)
    assert len(ratio) > 400

    def quantile(ids, r, q):
        return float(np.quantile([ratio[i][r] for i in ids], q, method="inverted_cdf"))

    kept = set()
    for (lang, _), ids in group.items():
        for i in ids:
            fine = True
            for r, (_, _, tail, reach, both) in adaptive_rules.RATIOS.items():
                low, middle, high = ((len(ids) * quantile(ids, r, q) + prior * quantile(whole[lang], r, q)) / (len(ids) + prior)
                                     for q in (1 - tail, 0.5, tail))
                fine &= ratio[i][r] <= high + reach * (high - middle) + 1e-12
                fine &= not both or ratio[i][r] >= low - reach * (middle - low) - 1e-12
            kept |= {i} if fine else set()
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert 0 < len(ratio) - len(kept) < 100


# ---------------------------------------------------------------- decontamination
def _leaks(text, items, window=10):
    words = decontaminate.normal_words(text)
    hit, found = set(), set()
    for name, item in items:
        seq = decontaminate.normal_words(item)
        n = min(window, len(seq))
        grams = {tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)} if seq else set()
        for i in range(len(words) - n + 1 if seq else 0):
            if tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1 << 20, 400])
def test_leaks_against_brute_force(spark, edge, block_words):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = [(-1, "one"), (-2, "same text twice"), (-3, ""), (-4, None), (-5, "gamma delta alpha")]
    items = items.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    known = [(r[0], r[1]) for r in items.collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        edge.select("doc_id", "text").where("length(text) < 10000 or text is null"))
    found = decontaminate.find_leaks(docs, items, block_words=block_words).collect()
    assert any(r["items"] for r in found)
    for r in found:
        hit = sum(b - a for a, b in zip(r["hit_ranges"][::2], r["hit_ranges"][1::2], strict=True))
        assert (r["n_words"], hit, r["items"]) == _leaks(r["text"], known)


def test_leaks_edges_and_removal(spark, edge, empty):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(edge, items.where("false")).where("size(items) > 0").count() == 0
    docs = spark.createDataFrame([(1, "x y z " * 9 + "A, b c d e f g h i j k! tail"), (2, "a b c d e f g h i j"), (3, "clean")],
                                 "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_leaks(docs, items).collect()}
    assert left == {1: "x y z " * 9 + "! tail", 3: "clean"}


# ---------------------------------------------------------------- sharding
def _tree_rows(df, tree, grown=None):
    return hash_tree.shard_documents(df, tree, grown).collect()


def test_shards(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tree = hash_tree.HashTree.regular(2, 2, 4)
    rows = _tree_rows(docs, tree, tree.with_region((1.0,)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r["grown_shard"] == 16 for r in rows) in range(30, 90)
    got = _tree_rows(edge, tree)
    assert len(got) == edge.count() and _tree_rows(empty, tree) == []
    assert {r["size"] for r in got if r["doc_id"] == 2} == {1}


def test_changed_weight_moves_only_its_subtree(spark):
    keys = spark.range(4000)
    before = hash_tree.HashTree.regular(2, 2, 4)
    region = (((1.0, 1.0, 1.0, 2.0), (1.0,) * 4), before.regions[1])
    after = hash_tree.HashTree(region)
    moved = keys.select(before.place(keys["id"]).alias("a"), after.place(keys["id"]).alias("b")).where("a <> b").collect()
    assert moved and all(r["b"] < 8 for r in moved)  # only into the region that grew
    share = keys.select(after.place(keys["id"]).alias("s")).where("s = 3").count() / 4000
    assert 0.08 < share < 0.16
