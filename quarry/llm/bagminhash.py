"""Near-duplicate classes with BagMinHash signatures.

A text is the multiset of its five-word shingles; two texts are linked at a
weighted Jaccard similarity (sum of minimal over sum of maximal counts) of at
least ``threshold``.

Signature: the weight axis of a shingle is cut at 1, 2, 4, 8, ...; each piece
carries its own Poisson process, seeded by the shingle and the piece, with a
rate equal to the piece's length.  A point has an arrival time, a place on the
(discretised) axis and a signature slot; a shingle of weight w owns the points
up to w.  A slot keeps the earliest arrival of all shingles, so two texts
agree in a slot with a probability equal to their weighted Jaccard similarity.
Points come in order of time, and a process stops once its time is past the
text's latest slot.

Candidates: texts that agree in a whole band of slots.  Exact copies are
grouped first and one of each group goes on.  A bucket of a band never emits
its pairs: each member is compared with one leader, the text of another class
that agrees with the most texts overall, which is the one nearest to the
middle of a group of variants.  While comparisons link a good part of the texts,
classes are joined and the members of buckets with several classes compared with
the leaders that this leaves.  What then still shares a bucket with another class
is joined exactly, by the rarest shingles (``_across``).  Links are verified on
the whole shingle multisets; classes are the connected components, found by
repeated hooking.

Words are runs without white space, as written.  A text of one to four words
has one shingle, all of it; a text without words is linked to nothing but its
exact copies.  A null text counts as empty.  The work is done on distinct
texts: a row's class is that of its text, named by the least key of the rows
with texts of the class, so rows that repeat a key but not the text may be of
different classes of one name.  A row without a key has the class null and
takes no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import append_columns, flat, mix, slices, tidied, words
from .shared import checkpointed, written

SHINGLE = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 64-bit shingle, count) of every distinct shingle of every row, in row order."""
    word, row = words(data, offsets)
    n_rows = len(offsets) - 1
    per_row = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    code = np.zeros(len(word), np.uint64)
    for k in range(size):
        part = np.zeros(len(word), np.uint64)
        part[:max(len(word) - k, 0)] = word[k:]
        inside = np.arange(len(word)) + k < (first + per_row)[row]
        code = np.where(inside, mix(code + part + np.uint64(k + 1)), code)
    starts = np.arange(len(word)) - first[row]
    use = starts <= np.maximum(per_row[row] - size, 0)
    code, row = code[use], row[use]
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], code[at], np.diff(np.concatenate([at, [len(code)]]))


def signatures(row: np.ndarray, code: np.ndarray, count: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """n_rows x slots arrival times; rows without shingles keep infinity."""
    best = np.full(n_rows * slots, np.inf)
    # one process for each piece (0, 1], (1, 2], (2, 4], ... of a shingle's weight that it reaches
    pieces = np.ceil(np.log2(count)).astype(np.int64) + 1 if len(count) else np.zeros(0, np.int64)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    owner = np.repeat(row, pieces)
    low = np.where(piece > 0, 1 << np.maximum(piece - 1, 0), 0)
    length = np.where(piece > 0, low, 1)
    weight = np.repeat(count, pieces)
    seed = mix(np.repeat(code, pieces) + piece.astype(np.uint64) * _GOLDEN)
    time = np.zeros(len(seed))
    while len(seed):
        seed = seed + _GOLDEN
        draw = mix(seed)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / length
        more = mix(draw ^ _GOLDEN)
        slot = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        place = low + ((more >> np.uint64(32)).astype(np.float64) / (1 << 32) * length).astype(np.int64) + 1
        mine = place <= weight
        np.minimum.at(best, owner[mine] * slots + slot[mine], time[mine])
        latest = best.reshape(n_rows, slots).max(axis=1)
        on = time < latest[owner]
        seed, time, owner, low, length, weight = seed[on], time[on], owner[on], low[on], length[on], weight[on]
    return best.reshape(n_rows, slots)


def band_keys(best: np.ndarray, bands: int) -> np.ndarray:
    """n_rows x bands 64-bit keys; equal keys mean equal slots throughout the band."""
    n, slots = best.shape
    bits = best.view(np.uint64).reshape(n, bands, slots // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (n, bands)).copy()
    for k in range(slots // bands):
        key = mix(key + bits[:, :, k])
    return key.view(np.int64)


#: Leaders are tried again while they link more than one in so many of the texts left.
FEW = 10

BANDS = [T.StructField("bands", T.ArrayType(T.LongType()))]


def with_bands(df: DataFrame, *, text_col: str, bands: int, rows: int) -> DataFrame:
    """``df`` with the band keys of the text (none without words)."""
    def run(column: pa.Array, _) -> list[pa.Array]:
        data, offsets = flat(column)
        keys, has = [np.zeros((0, bands), np.int64)], [np.zeros(0, bool)]
        for a, b in slices(offsets):
            found = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            best = signatures(*found, b - a, bands * rows)
            keys.append(band_keys(best, bands))
            has.append(np.isfinite(best[:, 0]))
        keys, has = np.concatenate(keys), np.concatenate(has)
        ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[has].ravel(), pa.int64()))]

    return append_columns(df, text_col, BANDS, run)


def _digest(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def similarity(code_a: np.ndarray, count_a: np.ndarray, code_b: np.ndarray, count_b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted shingle multisets."""
    at = np.searchsorted(code_b, code_a)
    at[at == len(code_b)] = 0
    same = code_b[at] == code_a if len(code_b) else np.zeros(len(code_a), bool)
    shared = int(np.minimum(count_a[same], count_b[at[same]]).sum())
    whole = int(count_a.sum()) + int(count_b.sum()) - shared
    return shared / whole if whole else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (id, text) are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = (pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        for batch in batches:
            (data_a, at_a), (data_b, at_b) = flat(batch.column("text_a")), flat(batch.column("text_b"))
            good = []
            for i, j in slices(at_a + at_b):
                code_a, count_a, cut_a = _bags(data_a, at_a[i:j + 1])
                code_b, count_b, cut_b = _bags(data_b, at_b[i:j + 1])
                good += [similarity(code_a[p:q], count_a[p:q], code_b[r:s], count_b[r:s]) >= threshold
                         for p, q, r, s in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:], strict=True)]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return both.mapInArrow(tidied(run), "a long, b long")


def _bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(shingles, counts, place of each row's first shingle) of a range of rows."""
    row, code, count = shingles(data[offsets[0]:offsets[-1]], offsets - offsets[0])
    return code, count, np.searchsorted(row, np.arange(len(offsets))).tolist()


def components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class) after the links (a, b) have joined the classes of their ends; a joined class has its least name.

    Every round hooks the larger of two linked classes to the smaller and then
    follows the hooks, so that chains shorten by half and more.
    """
    while True:
        left = classes.select(F.col("id").alias("a"), F.col("class").alias("class_a"))
        right = classes.select(F.col("id").alias("b"), F.col("class").alias("class_b"))
        between = links.join(left, "a").join(right, "b").where("class_a <> class_b")
        hooks = written(between.select(F.greatest("class_a", "class_b").alias("class"),
                                            F.least("class_a", "class_b").alias("to"))
                             .groupBy("class").agg(F.min("to").alias("to")))
        if hooks.isEmpty():
            return classes
        while True:  # a hook's target may be hooked itself
            on = hooks.select(F.col("class").alias("to"), F.col("to").alias("further"))
            shorter = written(hooks.join(on, "to", "left").select(
                "class", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            hooks = shorter.select("class", "to")
            if shorter.where("moved").isEmpty():
                break
        classes = written(classes.join(hooks, "class", "left")
                               .select("id", F.coalesce("to", "class").alias("class")))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    bands: int = 24, rows: int = 3) -> DataFrame:
    """(id, class_id): per row its class, the least key of its group.

    At a similarity of 0.8, 24 bands of 3 slots miss a pair with a probability
    of 4e-8; at 0.3 they propose it with one of 0.5.
    """
    keyed, found = _text_classes(df, id_col, text_col, threshold, bands, rows)
    rows_of = keyed.join(found.select("digest", "class_id"), "digest").select(F.col("id").alias(id_col), "class_id")
    nulls = df.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"))
    return rows_of.unionByName(nulls)


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24,
             rows: int = 3) -> DataFrame:
    """``df`` with one row of each near-duplicate class, one with the least key and of
    the texts with that key the least digest; rows without a key stay."""
    _, found = _text_classes(df, id_col, text_col, threshold, bands, rows)
    first = found.groupBy("class").agg(F.min(F.struct("id", "digest")).alias("one"))
    first = first.select(F.col("one.id").alias("__id"), F.col("one.digest").alias("__digest"))
    marked = df.withColumns({"__id": F.col(id_col).cast("long"), "__digest": _digest(F.col(text_col).cast("string"))})
    kept = marked.hint("merge").join(first, ["__id", "__digest"]).dropDuplicates(["__id", "__digest"])
    return kept.select(*df.columns).unionByName(df.where(F.col(id_col).isNull()))


def _text_classes(df: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of the rows with a key, and (digest, id, class, class_id) of their distinct texts:
    the least key of the text, its class and the least key of the class."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.where(F.col("id").isNotNull()).withColumn("digest", _digest(F.col("text")))
    signed = checkpointed(with_bands(docs, text_col="text", bands=bands, rows=rows).select("id", "digest", "bands"))
    # one node for each text: copies, however many, meet in partial aggregates
    texts = written(signed.groupBy("digest").agg(F.min("id").alias("id"), F.min("bands").alias("bands"))
                    .withColumn("node", F.monotonically_increasing_id()))
    buckets = texts.where(F.size("bands") > 0).select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = buckets.join(shared, "bucket")
    # texts that agree with many others make the best leaders of a bucket
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = written(members.select("bucket", "id").join(weight, "id"))
    involved = members.select("id").distinct()
    # ids and pairs grow with the documents: shuffle joins at every size
    of = texts.select("digest", "id", "node").join(involved.withColumnRenamed("id", "node").hint("merge"), "node", "left_semi")
    whole = checkpointed(docs.join(of.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])
                         .select(F.col("node").alias("id"), "text"))

    # first each text against the best of its candidates, then against all that are still of another class
    classes = involved.withColumn("class", F.col("id"))
    pairs = written(_candidates(members, classes).groupBy("b")
                         .agg(F.max(F.struct("weight", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
    links = written(_verified(pairs, whole, threshold))
    tried, many = pairs, True
    while many:
        classes = components(classes, links)
        members = _mixed(members, classes)
        pairs = written(_candidates(members, classes).select("a", "b").distinct()
                             .join(tried, ["a", "b"], "left_anti"))
        links = written(_verified(pairs, whole, threshold))
        tried = written(tried.unionByName(pairs))
        many = FEW * links.count() > members.select("id").distinct().count()
    if not links.isEmpty():
        classes = components(classes, links)
        members = _mixed(members, classes)
    # a leader is one text of another class: what no leader has settled is joined exactly
    if not members.isEmpty():
        pairs = written(_across(members.select("id").distinct(), whole, classes, threshold)
                        .join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                              ["a", "b"], "left_anti"))
        classes = components(classes, written(_verified(pairs, whole, threshold)))
    of_node = (texts.select("digest", "id", "node").join(classes.withColumnRenamed("id", "node"), "node", "left")
               .select("digest", "id", F.coalesce("class", "node").alias("class")))
    least = of_node.groupBy("class").agg(F.min("id").alias("class_id"))
    return signed.select("id", "digest"), written(of_node.join(least, "class"))


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes; the others hold one for good."""
    several = (members.join(classes, "id").groupBy("bucket")
               .agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("bucket"))
    return written(members.join(several, "bucket", "left_semi"))


def _candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, weight): in each bucket of several classes each member b with a
    leader a of another class, the heaviest there is; one row a member and bucket at most."""
    placed = members.join(classes, "id")
    heads = placed.groupBy("bucket", "class").agg(F.max(F.struct("weight", F.col("id").alias("id"))).alias("head"))
    heads = written(heads)
    best = heads.groupBy("bucket").agg(F.max(F.struct("head", "class")).alias("one"), F.count(F.lit(1)).alias("n"))
    best = best.where("n > 1").drop("n")
    other = (heads.join(best, "bucket").where("class <> one.class")
             .groupBy("bucket").agg(F.max("head").alias("two"), F.first("one").alias("one")))
    leader = F.when(F.col("class") == F.col("one.class"), F.col("two")).otherwise(F.col("one.head"))
    return (placed.join(other, "bucket").select(leader.alias("leader"), F.col("id").alias("b"))
            .select(F.col("leader.id").alias("a"), "b", F.col("leader.weight").alias("weight")))


#: 64-bit words of the parity sketch of a shingle multiset.
SKETCH = 4


def _items(texts: DataFrame) -> DataFrame:
    """(id, size, sketch, items) of ``texts`` (id, text): one 64-bit item for each shingle and repeat of it.

    The sketch has the parities of the items' numbers in 64 * SKETCH cells, so
    two sketches differ in no more cells than their multisets differ in items.
    """
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in slices(offsets):
                row, code, count = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                ends = np.cumsum(count)
                nth = np.arange(count.sum()) - np.repeat(ends - count, count)
                item = mix(np.repeat(code, count) + nth.astype(np.uint64) * _GOLDEN)
                row = np.repeat(row, count)
                size = np.bincount(row, minlength=b - a)
                cell = row * (64 * SKETCH) + (mix(item) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH)
                odd = (np.bincount(cell, minlength=(b - a) * 64 * SKETCH) & 1).astype(np.uint8)
                sketch = np.packbits(odd).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * SKETCH, pa.int32()), pa.array(sketch)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                                              pa.array(item.view(np.int64)))],
                    names=["id", "size", "sketch", "items"])

    return texts.select("id", "text").mapInArrow(tidied(run), "id long, size long, sketch array<long>, items array<long>")


def _across(ids: DataFrame, texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: a superset of the pairs of ``ids`` of different classes that are similar enough.

    Prefix filter: with all items in one order, two similar texts share one of
    the first size - ceil(threshold * size) + 1 of each.  The order puts items
    of one class only first, as no pair of classes shares them, then the rare
    ones.  A pair goes on if its sizes, the places of the shared item and the
    sketches leave room for the similarity.
    """
    found = written(_items(texts.join(ids.hint("merge"), "id", "left_semi")).join(classes.hint("merge"), "id"))
    item = found.select("id", "class", F.explode("items").alias("item"))
    held = (item.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.max("class").alias("most"))
            .where("least < most").select("item", "n"))
    ranked = (item.hint("merge").join(held, "item")
              .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked")))
    rest = F.col("size") - F.size("ranked")  # items of one class only
    first = (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1 - rest).cast("int")
    placed = (found.drop("items").hint("merge").join(ranked, "id").where(first > 0)
              .select("id", "class", "size", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)],
                      rest.alias("rest"), F.posexplode(F.slice("ranked", F.lit(1), first)).alias("place", "one"))
              .withColumn("left", F.col("size") - F.col("rest") - F.col("place")).withColumn("item", F.col("one.item"))
              .drop("rest", "place", "one"))
    placed = written(placed)
    a, b = placed.alias("a"), placed.alias("b")
    both = F.col("a.size") + F.col("b.size")
    shared = F.lit(threshold / (1 + threshold)) * both - 1e-6  # items that similar texts share at least
    apart = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(SKETCH)), F.lit(0))
    room = ((F.col("a.item") == F.col("b.item")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.class") != F.col("b.class"))
            & (F.least("a.left", "b.left") >= shared) & (apart <= both - 2 * shared))
    return a.hint("merge").join(b, room).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
