"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words and character n-grams,
hashed into one table, and of a token for each repeated word trigram; a linear layer and a softmax give the class.  Training
is numpy stochastic gradient descent (Adagrad steps on small batches) on a
bounded sample of labelled rows.  As the mean and the last layer are linear, a
trained model folds into one number per hashed feature (the difference of the
two logits), so that scoring reads each text once with array lookups.

Case, digits and symbols are kept: they tell junk from prose.  White space
separates words and marks the ends of n-grams.

Cases: a null or empty text, or one of white space, has no features and gets
the score of the bias; without labelled rows of both classes every text scores
the share of label 1 (0.5 without labels); repeated rows each get their own
row; other columns than the key and the text are passed through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import append_columns, flat, mix, range_hash, slices, spans

SCORE = T.StructField("score", T.DoubleType())
#: Longest character n-gram packs into 64 bits with room for its length.
NGRAMS = (3, 4)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends): the texts with one space before, between and after them."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    size = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), size)] = data
    starts = offsets[:-1] + np.arange(1, n + 1)
    return out, starts, starts + size


_MARK = np.zeros(256, bool)
_MARK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ngram_features(buffer: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram length (table rows, whether the window at each byte counts)."""
    space = _MARK[buffer]
    wide = np.where(space, np.uint8(32), buffer).astype(np.uint64)
    out = []
    code, inside = wide, np.zeros(len(buffer), bool)
    for n in range(2, max(NGRAMS) + 1):
        m = len(buffer) - n + 1
        if m <= 0:
            break
        # no space but at the two ends
        inside = inside[:m] | space[n - 2:n - 2 + m] if n > 2 else np.zeros(m, bool)
        code = code[:m] | (wide[n - 1:] << np.uint64(8 * (n - 1)))
        if n in NGRAMS:
            row = ((code + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            out.append((row.astype(np.int64), ~inside))
    return out


def word_features(buffer: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, first byte) of the words, and of one token more for each
    word that ends a word trigram met before in its text."""
    start, end, _ = spans(~_MARK[buffer], np.array([0, len(buffer)]))
    if not len(start):
        return np.zeros(0, np.int64), start
    word = range_hash(buffer)(start, end)
    row = (word >> np.uint64(64 - bits)).astype(np.int64)
    if len(word) < 3:
        return row, start
    text = np.searchsorted(starts, start, side="right")
    code = mix(word[:-2] + mix(word[1:-1] + mix(word[2:] + text[2:].astype(np.uint64))))
    code[text[:-2] != text[2:]] = 0
    _, first = np.unique(code, return_index=True)
    again = np.ones(len(code), bool)
    again[first] = False
    again &= code != 0
    at = start[2:][again]
    return np.concatenate([row, np.zeros(len(at), np.int64)]), np.concatenate([start, at])


@dataclass
class QualityModel:
    """``table``: logit difference per hashed feature; score = sigmoid(mean + bias)."""

    table: np.ndarray
    bias: float
    bits: int

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buffer, starts, ends = spaced(data, offsets)
        total, count = np.zeros(len(starts)), np.zeros(len(starts))
        for row, use in ngram_features(buffer, self.bits):
            # a window that starts at the space before a text belongs to that text
            use[:1] &= len(buffer) > 1
            value = np.concatenate([[0.0], np.cumsum(np.where(use, self.table[row], 0.0))])
            uses = np.concatenate([[0], np.cumsum(use)])
            a, b = np.minimum(starts - 1, len(row)), np.minimum(ends, len(row))
            total += value[b] - value[a]
            count += uses[b] - uses[a]
        row, at = word_features(buffer, starts, self.bits)
        text = np.searchsorted(starts, at, side="right") - 1
        total += np.bincount(text, weights=self.table[row], minlength=len(starts))
        count += np.bincount(text, minlength=len(starts))
        return 1 / (1 + np.exp(-np.clip(np.where(ends > starts, total / np.maximum(count, 1), 0.0) + self.bias, -700, 700)))


def _matrix(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) with weights that sum to 1 per row."""
    data, offsets = flat(pa.array(texts, pa.large_string()))
    buffer, starts, ends = spaced(data, offsets)
    rows, features = [], []
    for row, use in ngram_features(buffer, bits):
        at = np.flatnonzero(use)
        rows.append(np.searchsorted(starts, at + 1, side="right") - 1)
        features.append(row[at])
    row, at = word_features(buffer, starts, bits)
    rows.append(np.searchsorted(starts, at, side="right") - 1)
    features.append(row)
    key, count = np.unique(np.concatenate(rows) << bits | np.concatenate(features), return_counts=True)
    row = key >> bits
    weight = count / np.bincount(row, weights=count, minlength=len(texts))[row]
    return row.astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32), weight.astype(np.float32)


def train(texts: list[str], labels: list[int], *, bits: int = 17, dim: int = 8, epochs: int = 8, batch: int = 32,
          rate: float = 0.2, seed: int = 7) -> QualityModel:
    """Embeddings and softmax layer by stochastic gradient descent, folded to a ``QualityModel``."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        logit = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return QualityModel(np.zeros(1 << bits, np.float32), float(logit), bits)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-0.5 / dim, 0.5 / dim, (1 << bits, dim))
    layer, bias = random.normal(0, 0.5, (dim, 2)), np.zeros(2)
    seen_v, seen_l, seen_b = np.full(1 << bits, 1e-6), np.full(layer.shape, 1e-6), np.full(2, 1e-6)
    order = random.permutation(len(texts))
    batches = [_matrix([texts[i] for i in order[k:k + batch]], bits) for k in range(0, len(texts), batch)]
    wanted = [y[order[k:k + batch]] for k in range(0, len(texts), batch)]
    for _ in range(epochs):
        for b in random.permutation(len(batches)):
            row, feature, weight = batches[b]
            n = len(wanted[b])
            hidden = np.stack([np.bincount(row, weights=weight * vectors[feature, d], minlength=n)
                               for d in range(dim)], axis=1)
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), wanted[b]] -= 1  # gradient of the cross entropy at the logits
            back = p @ layer.T
            used, at = np.unique(feature, return_inverse=True)
            grad = np.stack([np.bincount(at, weights=weight * back[row, d]) for d in range(dim)], axis=1)
            seen_v[used] += (grad ** 2).mean(axis=1)
            vectors[used] -= rate * grad / np.sqrt(seen_v[used])[:, None]
            grad_l, grad_b = hidden.T @ p / n, p.mean(axis=0)
            seen_l += grad_l ** 2
            seen_b += grad_b ** 2
            layer -= rate * grad_l / np.sqrt(seen_l)
            bias -= rate * grad_b / np.sqrt(seen_b)
    difference = layer[:, 1] - layer[:, 0]
    return QualityModel((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]), bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, rows_per_class: int, *,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels of up to ``rows_per_class`` rows of each class, the first by a hash of the key."""
    labelled = labels.where(use & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    picked = None
    for value in (0, 1):
        some = labelled.where(F.col("y") == value).distinct().orderBy(F.xxhash64(id_col), id_col).limit(rows_per_class)
        picked = some if picked is None else picked.unionByName(some)
    # 2 x rows_per_class short rows at most, and as many texts: one for each key, however often it comes
    rows = (docs.select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col, "y")
            .agg(F.min(text_col).alias(text_col)).select(text_col, "y", id_col).collect())
    rows.sort(key=lambda r: (r[2], r[0] or "", r[1]))  # the order of training doesn't depend on the partitions
    return [r[0] or "" for r in rows], [r[1] for r in rows]


def sample_weight(labels: DataFrame, label_col: str, use: Column, sampled: list[int], *, id_col: str = "doc_id") -> float:
    """What a sampled row of label 0 counts beside one of label 1, so that the
    sample stands for all rows of ``use`` (1 where either has one class only)."""
    found = labels.where(use & F.col(id_col).isNotNull()).agg(F.count_if(F.col(label_col) == 0), F.count_if(F.col(label_col) == 1)).first()
    ours = sampled.count(0), sampled.count(1)
    return found[0] / found[1] * ours[1] / ours[0] if all((*found, *ours)) else 1.0


def score_texts(df: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``score``, the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array, _) -> list[pa.Array]:
        model = shared.value
        data, offsets = flat(column)
        parts = [model.score(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets)]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())]

    return append_columns(df, text_col, [SCORE], run)
