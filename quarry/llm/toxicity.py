"""Toxicity by multiple-instance learning.

Only documents carry labels.  A document is a bag of sentences; a sentence
scores sigmoid(bias + sum of its words' weights) and the document the noisy-or
1 - prod(1 - p) of its sentences, so training on document labels finds the
sentences that explain them.  Words are runs of letters, digits and characters
from U+0080, lower-cased in A-Z; a word counts with itself and with its
prefixes of ``PREFIXES`` bytes, all hashed into one table.  A sentence ends at
``. ! ?`` or a line end.  Features of fewer than ``min_docs`` training
documents keep weight 0.

Cases: a null or empty text, or one without words, has no sentence and scores
0 with both classes in the labels; without, every text scores the share of
label 1 (0.5 without labels); repeated rows each get their own row; other
columns are passed through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .buffers import LOWER, append_columns, flat, mix, range_hash, slices, spans

#: Bytes of the word beginnings that count as features, for inflected and compound words.
PREFIXES = (5, 6, 7, 8)

SCORE = T.StructField("score", T.DoubleType())
OFFENDING = T.StructField("offending", T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Bags:
    """Words of the sentences of some texts; sentences without words are left out."""

    feature: np.ndarray   # table row of each word and prefix
    sentence: np.ndarray  # and its sentence
    row: np.ndarray       # per sentence: its text
    start: np.ndarray     # per sentence: bytes of its text from its first word to its last
    end: np.ndarray
    n_rows: int


def bags(data: np.ndarray, offsets: np.ndarray, bits: int) -> Bags:
    start, end, row = spans(_WORD[data], offsets)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Bags(z, z, z, z, z, len(offsets) - 1)
    hashed = range_hash(LOWER[data])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])[start]
    new = np.concatenate([[True], (np.diff(stops) > 0) | (np.diff(row) > 0)])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    base = offsets[row[first]]
    codes, owners = [hashed(start, end)], [sentence]
    for n in PREFIXES:
        longer = end - start > n
        codes.append(mix(hashed(start[longer], start[longer] + n) + np.uint64(n)))
        owners.append(sentence[longer])
    feature = (np.concatenate(codes) >> np.uint64(64 - bits)).astype(np.int64)
    return Bags(feature, np.concatenate(owners), row[first], start[first] - base, end[last] - base, len(offsets) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    bits: int
    share: float | None = None  # the score of everything, where both classes weren't seen

    def sentences(self, found: Bags) -> np.ndarray:
        total = np.bincount(found.sentence, weights=self.weights[found.feature], minlength=len(found.row))
        return _sigmoid(total + self.bias)

    def documents(self, found: Bags) -> np.ndarray:
        if self.share is not None:
            return np.full(found.n_rows, self.share)
        safe = np.log1p(-np.minimum(self.sentences(found), 1 - 1e-12))
        return -np.expm1(np.bincount(found.row, weights=safe, minlength=found.n_rows))


def train(texts: list[str], labels: list[int], *, bits: int = 20, epochs: int = 30, batch: int = 64, rate: float = 0.3,
          decay: float = 5e-4, min_docs: int = 5, clean_weight: float = 1.0, seed: int = 11) -> ToxicityModel:
    """Feature weights by gradient steps on the cross entropy of the noisy-or.

    ``clean_weight`` weighs documents of label 0, for samples that hold fewer
    of them than the rows they stand for (``fasttext.sample_weight``).
    """
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.5
    weights = np.zeros(1 << bits)
    if share in (0.0, 1.0) or not len(y):
        return ToxicityModel(weights.astype(np.float32), 0.0, bits, share)
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    groups = [order[k:k + batch] for k in range(0, len(texts), batch)]
    found = [bags(*flat(pa.array([texts[i] for i in g], pa.large_string())), bits) for g in groups]
    seen_in = sum(np.bincount(np.unique(b.row[b.sentence] << bits | b.feature) & ((1 << bits) - 1),
                              minlength=1 << bits) for b in found)
    trained = seen_in >= min_docs
    step, bias, step_bias = np.full(1 << bits, 1e-4), -5.0, 1e-4
    for _ in range(epochs):
        for b in random.permutation(len(groups)):
            bag, want = found[b], y[groups[b]]
            p = _sigmoid(np.bincount(bag.sentence, weights=weights[bag.feature], minlength=len(bag.row)) + bias)
            safe = np.bincount(bag.row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=bag.n_rows)
            score = np.clip(-np.expm1(safe), 1e-9, 1 - 1e-9)
            # d loss / d sentence sum: p for label 0, -p (1 - score) / score for label 1
            pull = np.where(want == 1, -(1 - score) / score, clean_weight)[bag.row] * p / len(want)
            grad = np.bincount(bag.feature, weights=pull[bag.sentence], minlength=1 << bits)
            used = np.flatnonzero((grad != 0) & trained)
            step[used] += grad[used] ** 2
            move = weights[used] - rate * grad[used] / np.sqrt(step[used])
            # soft threshold: words that explain nothing return to 0
            weights[used] = np.sign(move) * np.maximum(np.abs(move) - rate * decay / np.sqrt(step[used]), 0)
            step_bias += pull.sum() ** 2
            bias -= rate * pull.sum() / np.sqrt(step_bias)
    return ToxicityModel(weights.astype(np.float32), float(bias), bits)


def score_texts(df: DataFrame, model: ToxicityModel, *, text_col: str = "text", locate: bool = False,
                threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` and, with ``locate``, the byte ranges and scores of
    the sentences at or above ``threshold`` in ``offending``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array, _) -> list[pa.Array]:
        model = shared.value
        data, offsets = flat(column)
        scores, places = [np.zeros(0)], []
        for a, b in slices(offsets):
            bag = bags(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], model.bits)
            scores.append(model.documents(bag))
            if locate:
                p = model.sentences(bag)
                rows: list[list[dict]] = [[] for _ in range(bag.n_rows)]
                for s in np.flatnonzero(p >= threshold).tolist():
                    rows[bag.row[s]].append({"start": bag.start[s], "end": bag.end[s], "score": p[s]})
                places += rows
        out = [pa.array(np.concatenate(scores), pa.float64())]
        if locate:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            out.append(pa.array(places, kind))
        return out

    return append_columns(df, text_col, [SCORE, OFFENDING] if locate else [SCORE], run)
