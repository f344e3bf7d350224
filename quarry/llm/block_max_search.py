"""Ranked lexical search by block-max MaxScore over an index in shards.

Index: documents are put into shards of about ``SHARD`` bytes as they are
read.  A shard has one posting list for each of its terms: places of documents
and term frequencies in blocks of ``BLOCK`` postings, as narrow as the list
allows, and beside each block, unpacked, its first document, its greatest
frequency and its shortest document.  From these two a block's greatest score
follows for any collection, so shards need no common statistics and indexes
can be put together.

Search: document frequencies and lengths are summed over the shards, and the
query terms' lists meet the items in one task for each shard and block of
items.  Lists are taken by falling bounds.  While documents not yet seen could
still reach the k-th best score, a list is essential and read whole.  The
others only raise documents that are seen: a document goes if its score, its
block's bound and the bounds of the lists behind fall short, and only blocks
with a document left are unpacked.  The first k of all shards meet in a window
that is cut before the shuffle.

Terms are runs of ASCII letters and digits and of all characters above ASCII,
A-Z lower-cased, known by 64-bit hashes (two terms of a query and a corpus of
a billion terms collide with odds of about one in a million).

Cases: a null or empty text has no terms and is never found; an item without
known terms has no rows; repeated terms of an item count each time; repeated
rows, of documents or items, are rows of their own; equal scores are in the
order of keys, a null key last; a table without terms gives no rows; a very
long text is a shard of its own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import LOWER, flat, range_hash, slices, spans
from .shared import with_package, written

#: Bytes of text and documents in a shard, about; postings in a block; items searched together, about.
SHARD = 1 << 24
SHARD_DOCS = 1 << 16
BLOCK = 128
ITEMS = 256
#: Stands for a null key, last in ties.
NO_KEY = (1 << 63) - 1

_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_low:_high] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key of each term, its row)."""
    start, end, row = spans(_TERM[data], offsets)
    keys = range_hash(LOWER[data])(start, end) if len(start) else np.zeros(0, np.uint64)
    return keys.view(np.int64), row


# ---------------------------------------------------------------- index
INDEX = ("shard long, key long, n long, total long, width int, docs binary, tfs binary, heads binary")


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: consecutive stretches of an array that end at ``ends`` (in elements)."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                                          pa.py_buffer(values.tobytes())])


class _Shard:
    """The documents of a shard as they come."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.ids, self.keys, self.rows = [], [], []
        self.n = 0

    def add(self, ids: np.ndarray, keys: np.ndarray, row: np.ndarray, size: int) -> None:
        self.ids.append(ids)
        self.keys.append(keys)
        self.rows.append((row + self.n).astype(np.int32))
        self.n, self.bytes = self.n + len(ids), self.bytes + size

    def batches(self):
        """One row for the documents (without a key), one for each term."""
        keys, rows = np.concatenate(self.keys), np.concatenate(self.rows)
        length = np.bincount(rows, minlength=self.n).astype(np.int64)
        yield self._batch([None], [int((length > 0).sum())], [int(length.sum())], 8,
                          _cut(np.concatenate(self.ids), np.array([self.n])), _cut(length, np.array([self.n])), _cut(length[:0], np.array([0])))
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")  # documents stay in order
        keys, rows = keys[order], rows[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        at = np.flatnonzero(new_key | np.append(True, rows[1:] != rows[:-1]))
        tf = np.diff(np.append(at, len(keys)))
        keys, doc, new_key = keys[at], rows[at].astype(np.int64), new_key[at]
        first = np.flatnonzero(new_key)
        count = np.diff(np.append(first, len(keys)))
        place = np.arange(len(keys)) - np.repeat(first, count)
        block = np.flatnonzero(place % BLOCK == 0)
        offset = doc - np.repeat(doc[block], np.diff(np.append(block, len(keys))))
        heads = np.stack([doc[block], np.maximum.reduceat(tf, block), np.minimum.reduceat(length[doc], block)], axis=1).astype(np.int64)
        widest = np.maximum.reduceat(np.maximum(offset, tf), first)
        width = np.where(widest < 1 << 8, 1, np.where(widest < 1 << 16, 2, 4))
        n_blocks = -(-count // BLOCK)
        for w in np.unique(width).tolist():
            mine = width == w
            posting, head = np.repeat(mine, count), np.repeat(mine, n_blocks)
            kind = np.dtype(f"u{w}")
            c, total = count[mine], np.add.reduceat(tf, first)[mine]
            docs, tfs = (_cut(x[posting].astype(kind), np.cumsum(c)) for x in (offset, tf))
            batch = self._batch(keys[first[mine]], c, total, w, docs, tfs, _cut(heads[head].ravel(), 3 * np.cumsum(n_blocks[mine])))
            for k in range(0, batch.num_rows, 1 << 14):
                yield batch.slice(k, 1 << 14)

    def _batch(self, keys, n, total, width: int, *binary: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.number] * len(keys)), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.int64()),
                                           pa.array([width] * len(keys), pa.int32()), *binary],
                                          names=["shard", "key", "n", "total", "width", "docs", "tfs", "heads"])


def build_index(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all texts, written to the shared folder."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        shard = _Shard(number)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            data, offsets = flat(batch.column("text"))
            for a, b in slices(offsets):
                keys, row = terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                shard.add(ids[a:b], keys, row, int(offsets[b] - offsets[a]))
                if shard.bytes >= SHARD or shard.n >= SHARD_DOCS:
                    yield from shard.batches()
                    number += 1
                    shard = _Shard(number)
        if shard.n:
            yield from shard.batches()

    with_package(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, INDEX))


# ---------------------------------------------------------------- search in a shard
def _part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to a score, for a weight of one."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def _norms(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + 25 times a document's length over the mean length."""
    if 25 * n_docs * int(length.max(initial=0)) < 1 << 62:
        return 75 + 25 * length * n_docs // n_terms
    return np.array([75 + 25 * int(n) * n_docs // n_terms for n in length], np.int64)


class _List:
    """A posting list; blocks are unpacked when they are asked for."""

    def __init__(self, count: int, width: int, docs: bytes, tfs: bytes, heads: bytes, norm: np.ndarray, n_docs: int, n_terms: int) -> None:
        heads = np.frombuffer(heads, np.int64).reshape(-1, 3)
        self.first, self.count, self.norm = heads[:, 0], count, norm
        self.bound = _part(heads[:, 1], _norms(heads[:, 2], n_docs, n_terms))  # of blocks
        self.offsets, self.tfs = np.frombuffer(docs, f"u{width}"), np.frombuffer(tfs, f"u{width}")
        self.doc, self.part = np.zeros(count, np.int64), np.zeros(count, np.int64)
        self.packed = np.ones(len(heads), bool)

    def unpack(self, blocks: np.ndarray | slice) -> np.ndarray:
        """Places of the postings of the blocks, which then are in ``doc`` and ``part``."""
        blocks = np.arange(len(self.packed))[blocks]
        if not len(blocks):
            return blocks
        new = blocks[self.packed[blocks]]
        if len(new):
            at = self._places(new)
            doc = self.first[at // BLOCK] + self.offsets[at]
            self.doc[at], self.part[at] = doc, _part(self.tfs[at].astype(np.int64), self.norm[doc])
            self.packed[new] = False
        return self._places(blocks)

    def _places(self, blocks: np.ndarray) -> np.ndarray:
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return at[at < self.count]


def top_documents(lists: list[tuple[_List, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents that may be among the first ``k`` of a shard, ties included.

    ``lists``: posting lists with their weights.
    """
    lists = sorted(((x, w, int(x.bound.max()) * w) for x, w in lists), key=lambda entry: -entry[2])
    behind = np.append(np.cumsum([bound for _, _, bound in lists][::-1])[::-1], 0)  # bounds of a list and all after it
    score, least, at = np.zeros(n_docs, np.int64), 0, 0
    while at < len(lists) and behind[at] >= least:  # essential
        found, weight, _ = lists[at]
        found.unpack(slice(None))
        score[found.doc] += weight * found.part
        at += 1
        if at < len(lists):
            least = _kth(score, k)
    seen = np.flatnonzero(score)
    for j in range(at, len(lists)):
        found, weight, _ = lists[j]
        seen = seen[score[seen] + behind[j] >= least]
        block = np.searchsorted(found.first, seen, side="right") - 1
        bound = np.where(block >= 0, found.bound[block] * weight, 0)
        good = score[seen] + bound + behind[j + 1] >= least
        seen, block = seen[good], block[good]
        places = found.unpack(np.unique(block[block >= 0]))
        if len(places):
            docs = found.doc[places]
            hit = np.searchsorted(docs, seen)
            hit[hit == len(docs)] = 0
            same = docs[hit] == seen
            score[seen[same]] += weight * found.part[places[hit[same]]]
        least = max(least, _kth(score[seen], k))
    return seen[score[seen] >= least], score[seen][score[seen] >= least]


def _kth(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


# ---------------------------------------------------------------- search
def _item_terms(items: DataFrame) -> DataFrame:
    """(item, key, times) of the terms of items (item, text)."""
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in slices(offsets):
                keys, row = terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row + a)), pa.array(keys)], names=["item", "key"])

    return items.mapInArrow(run, "item long, key long").groupBy("item", "key").agg(F.count(F.lit(1)).alias("times"))


def search(index: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each item."""
    documents = index.where("key IS NULL")
    n_docs, n_terms = documents.agg(F.sum("n"), F.sum("total")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("name"), F.col(text_col).cast("string").alias("text")))
    blocks = -(-asked.count() // ITEMS) or 1
    uses = (written(_item_terms(asked.select("item", "text"))).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
            .groupBy("block", "key").agg(F.collect_list(F.struct("item", "times")).alias("uses")))  # one for each item of a block
    wanted = uses.select("key").distinct()
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2.0) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = (index.where("key IS NOT NULL").select("key", "n").join(wanted, "key")
               .groupBy("key").agg(F.sum("n").alias("df")).select("key", weight.alias("weight")))
    weighted = written(uses.join(weights, "key"))
    lists = index.where("key IS NOT NULL").join(weighted, "key").select("shard", "block", "weight", "uses", "n", "width", "docs", "tfs", "heads")
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    beside = documents.where("n > 0").select(F.col("shard").alias("of"), F.explode(every).alias("part"), F.col("docs").alias("ids"),
                                             F.col("tfs").alias("lengths"))

    def run(found: pa.Table, shard: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        if shard.num_rows and found.num_rows:
            ids, length = (np.frombuffer(shard.column(c)[0].as_py(), np.int64) for c in ("ids", "lengths"))
            norm = _norms(length, n_docs, n_terms)
            by_item: dict[int, list[tuple[_List, int]]] = {}
            for row in found.select(["weight", "uses", "n", "width", "docs", "tfs", "heads"]).to_pylist():
                postings = _List(row["n"], row["width"], row["docs"], row["tfs"], row["heads"], norm, n_docs, n_terms)
                for use in row["uses"]:
                    by_item.setdefault(use["item"], []).append((postings, row["weight"] * use["times"]))
            for item, lists in by_item.items():
                place, score = top_documents(lists, len(ids), k)
                first = np.lexsort((ids[place], -score))[:k]
                first = first[score[first] > 0]
                out.append(np.stack([np.full(len(first), item), ids[place[first]], score[first]], axis=1))
        return pa.table(list(np.concatenate(out).T), names=["item", "doc_id", "score"])

    found = lists.groupBy("shard", "block").cogroup(beside.groupBy("of", "part")).applyInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (best.join(asked.select("item", "name"), "item")
            .select(F.col("name").alias(id_col), "rank", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")).alias("doc_id"), "score"))
