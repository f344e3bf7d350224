"""Document scores by cross-entropy difference of two n-gram models.

A target and a background model of the same form (interpolated word bigrams)
share one vocabulary, all distinct words of both.  The background counts come
from all documents, the target counts from all target documents.  A document
scores the mean over its words of (background loss - target loss), in nats:
the higher, the more it reads like the target.

Every distinct word and word pair has a count of its own (by 64-bit keys), in
tables that grow with the corpus and that no process holds whole.  Documents
are put into blocks of bounded size, written once in buckets by block, so that
texts are never shuffled.  A block sends its distinct keys, sorted, cut into
ranges and packed, with their counts in target and all documents.  The keys of
a range, from all blocks, are summed in one task and the totals go back in the
block's own order, without the keys.  A key has one entry a block, however
frequent it is.

Words are runs without white space, lower-cased in A-Z; the first word of a
text follows a start mark.

Cases: a null or empty text, or one of white space, has no words, losses 0 and
score 0; without target documents both losses still are finite (the target
model is uniform); repeated rows count each time and each get their row; all
rows of a target key are target documents, a null key never is; an empty table
gives no rows; other columns are passed through unread.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import LOWER, flat, mix, slices, tidied_groups, words
from .shared import shared_folder, written

#: Bytes and rows of a block of documents, about.
BLOCK = 1 << 24
BLOCK_ROWS = 1 << 16
#: Key of the starts of texts; keys of words are odd, those of pairs even.
START = np.uint64(0)


def keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the texts: (row, word key, key of the word before or START, pair key)."""
    code, row = words(LOWER[data], offsets)
    word = code | np.uint64(1)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    context = np.zeros(len(word), np.uint64)
    context[1:] = word[:-1]
    context[first] = START
    pair = mix(context * np.uint64(0x9E3779B97F4A7C15) + word) & ~np.uint64(1)
    return row, word, context, pair


def in_blocks(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``__block`` and ``__row``, its block and place there, written in
    buckets by block: whatever meets the rows by block comes to them."""
    def run(batches):
        block, size, n = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            _, offsets = flat(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in slices(offsets):
                if size >= BLOCK or n >= BLOCK_ROWS:
                    block, size, n = block + 1, 0, 0
                size += int(offsets[b] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(b - a, block)), pa.array(np.arange(n, n + b - a))],
                                                 names=[*batch.schema.names, "__block", "__row"])
                n += b - a

    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("__block", T.LongType()), T.StructField("__row", T.LongType())])
    name = f"lm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.mapInArrow(run, schema).write.bucketBy(buckets, "__block")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


# ---------------------------------------------------------------- packed counts
def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the greatest needs; that number comes first."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(len(values), 8)[:, :width].tobytes()


def _wide(packed: bytes) -> np.ndarray:
    width = packed[0]
    found = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    found[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return found.view("<u8").ravel()


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a key; ranges are in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class _Slice:
    """Some texts of a block: their distinct keys in order, and the places there of each word, of what comes before it and of both."""

    def __init__(self, first: int, end: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.size = first, end - first
        self.row, word, _, pair = keys(data, offsets)
        n = len(word)
        self.key, at = np.unique(np.concatenate([word, pair, np.full(min(n, 1), START)]), return_inverse=True)
        self.word, self.pair = at[:n], at[n:2 * n]
        self.starts = np.append(True, self.row[1:] != self.row[:-1]) if n else np.zeros(0, bool)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = 0  # START is the least key

    def counts(self, use: np.ndarray) -> np.ndarray:
        """How often each key occurs in the rows of ``use``."""
        use = use[self.first:self.first + self.size][self.row]
        found = np.bincount(self.word[use], minlength=len(self.key)) + np.bincount(self.pair[use], minlength=len(self.key))
        found[:1] += int((self.starts & use).sum())
        return found


def _block_keys(column: pa.Array | pa.ChunkedArray) -> tuple[list[_Slice], np.ndarray, list[np.ndarray]]:
    """(slices, sorted distinct keys, places of each slice's keys there) of the texts of a block."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    data, offsets = flat(column)
    parts = [_Slice(a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets)]
    key = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p.key for p in parts]]))
    return parts, key, [np.searchsorted(key, p.key) for p in parts]


def key_counts(blocks: DataFrame, flags: DataFrame, ranges: int, *, text_col: str) -> DataFrame:
    """(range, block, keys, t, b): the distinct keys of a block, and how often they occur in its target rows and all its rows."""
    def run(rows: pa.Table, flagged: pa.Table) -> pa.Table:
        parts, key, places = _block_keys(rows.column(text_col))
        target, every = np.zeros(rows.num_rows, bool), np.ones(rows.num_rows, bool)
        if flagged.num_rows:
            target = np.isin(rows.column("__row").to_numpy(), np.array(flagged.column("target")[0].as_py(), np.int64))
        t, b = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for part, at in zip(parts, places, strict=True):
            t[at] += part.counts(target)
            b[at] += part.counts(every)
        cuts = np.searchsorted(_range_of(key, ranges), np.arange(ranges + 1))
        used = np.flatnonzero(np.diff(cuts))
        block = rows.column("__block")[0].as_py() if rows.num_rows else 0
        spans = [slice(cuts[r], cuts[r + 1]) for r in used]
        return pa.table([pa.array(used), pa.array([block] * len(used), pa.int64()),
                         pa.array([_narrow(np.diff(key[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                         *[pa.array([_narrow(c[s]) for s in spans], pa.binary()) for c in (t, b)]],
                        names=["range", "block", "keys", "t", "b"])

    rows = blocks.select("__block", "__row", text_col)
    return rows.groupBy("__block").cogroup(flags.groupBy("__of")).applyInArrow(
        tidied_groups(run), "range long, block long, keys binary, t binary, b binary")


def totals(counts: DataFrame) -> DataFrame:
    """(block, range, t, b, words, t_words, b_words): totals of a block's keys, in its order; the
    distinct words of a range and their totals are in one of its rows."""
    def run(rows: pa.Table) -> pa.Table:
        own = [np.cumsum(_wide(k)) for k in rows.column("keys").to_pylist()]
        key, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([_wide(x) for x in rows.column(c).to_pylist()]), minlength=len(key)).astype(np.int64)
                for c in ("t", "b")]
        cuts = np.cumsum([0, *map(len, own)])
        word = (key & np.uint64(1)) == 1
        summary = [[int(word.sum())], [int(sums[0][word].sum())], [int(sums[1][word].sum())]]
        return pa.table([rows.column("block"), rows.column("range"),
                         *[pa.array([_narrow(x[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in sums],
                         *[pa.array(x + [0] * (len(own) - 1), pa.int64()) for x in summary]],
                        names=["block", "range", "t", "b", "words", "t_words", "b_words"])

    return written(counts.groupBy("range").applyInArrow(
        tidied_groups(run), "block long, range long, t binary, b binary, words long, t_words long, b_words long"))


@dataclass
class BigramModel:
    """Interpolated bigrams: half the pair's share of its context, half the smoothed share of the word."""

    n_words: float
    vocabulary: float
    weight: float = 0.5
    added: float = 0.1

    def loss(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Loss of words from the counts of the word, of what comes before it and of both together."""
        single = (word + self.added) / (self.n_words + self.added * max(self.vocabulary, 1.0))
        double = pair / np.maximum(context, 1)
        return -np.log(np.where(context > 0, self.weight * double + (1 - self.weight) * single, single))


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("target_loss", T.DoubleType()),
          T.StructField("background_loss", T.DoubleType()), T.StructField("score", T.DoubleType())]


def score_documents(df: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the number of words, both mean losses and their difference; the
    target model learns from the rows whose key is one of ``target``'s."""
    blocks = in_blocks(df, text_col=text_col)
    # keys grow with the documents: shuffle joins of narrow rows at every size
    wanted = target.select(F.col(id_col).alias("__id")).distinct().hint("merge")
    flags = (blocks.select(F.col(id_col).alias("__id"), F.col("__block").alias("__of"), F.col("__row").alias("__at")).join(wanted, "__id")
             .groupBy("__of").agg(F.collect_list("__at").alias("target")))  # at most the rows of a block
    ranges = max(1, blocks.agg(F.count_distinct("__block")).first()[0])
    back = totals(key_counts(blocks, flags, ranges, text_col=text_col))
    n, n_target, n_all = (float(x or 0) for x in back.agg(F.sum("words"), F.sum("t_words"), F.sum("b_words")).first())
    models = (BigramModel(n_target, n), BigramModel(n_all, n))
    made = [f.name for f in FIELDS]
    kept = [f for f in df.schema.fields if f.name not in made]
    out = T.StructType([*kept, *FIELDS])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        parts, _, places = _block_keys(rows.column(text_col))
        order = np.argsort(known.column("range").to_numpy())
        tables = [np.concatenate([np.zeros(0), *[_wide(x) for x in known.column(c).take(pa.array(order)).to_pylist()]]) for c in ("t", "b")]
        n, losses = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
        for part, at in zip(parts, places, strict=True):
            count = np.bincount(part.row, minlength=part.size)
            n.append(count)
            both = []
            for model, table in zip(models, tables, strict=True):
                own = table[at]
                loss = model.loss(own[part.word], own[part.context], own[part.pair])
                both.append(np.bincount(part.row, weights=loss, minlength=part.size) / np.maximum(count, 1))
            losses.append(np.stack(both, axis=1))
        n, losses = np.concatenate(n), np.concatenate(losses)
        return pa.table([*[rows.column(f.name) for f in kept], pa.array(n), pa.array(losses[:, 0]), pa.array(losses[:, 1]),
                         pa.array(losses[:, 1] - losses[:, 0])], names=out.names)

    found = back.select("block", "range", "t", "b")
    return blocks.groupBy("__block").cogroup(found.groupBy("block")).applyInArrow(tidied_groups(run), out)
