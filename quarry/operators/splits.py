"""Sampling and splitting.

Two families:

* Spark's own ``sampleBy`` / ``subtract`` (the reference behaviour). Rows
  depend on how the input is partitioned, and ``subtract`` is a left-anti join
  plus a distinct over the whole table.
* Hash-bucket variants keyed on a row id: the same rows on every partitioning
  and cluster size, no shuffle at all (a filter per part), the test part is
  the complement of the same predicate, and nested fractions give nested
  samples (20 % is inside 40 %).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import hash_bucket, unit_interval

# The seed used throughout the recorded analyses.
SEED = 31891
PERCENT_BUCKETS = 100
# Each kind of draw hashes the key with its own salt, so a sample taken from a
# split part (or folds cut from a sample) is independent of that split.
SPLIT_SALT = str(SEED)
SAMPLE_SALT = f"{SEED}-sample"
FOLD_SALT = f"{SEED}-cv"


def sample_by(df: DataFrame, label_col: str, fractions: dict | float, seed: int = SEED,
              labels: Sequence | None = None) -> DataFrame:
    """D1 (Spark): stratified Bernoulli sample with a fraction per class.

    With a single float every class gets it; ``labels`` lists the classes,
    which are else read from the data (a class that ``sampleBy`` isn't told
    would vanish).
    """
    if not isinstance(fractions, dict):
        labels = class_labels(df, label_col) if labels is None else labels
        fractions = {lab: float(fractions) for lab in labels}
    return df.sampleBy(label_col, fractions, seed)


def subtract_split(df: DataFrame, label_col: str, train_fraction: float, labels: Sequence | None = None,
                   seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """D2 + X2 (Spark): ``train = sampleBy``, ``test = df.subtract(train)`` (EXCEPT DISTINCT)."""
    train = sample_by(df, label_col, train_fraction, seed, labels)
    return train, df.subtract(train)


def bucket_col(id_cols, buckets: int = PERCENT_BUCKETS, salt: str | None = SPLIT_SALT) -> Column:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return hash_bucket(*ids, buckets=buckets, salt=salt)


def hash_sample(df: DataFrame, id_cols, fraction: float | dict, salt: str | None = SAMPLE_SALT,
                label_col: str | None = None) -> DataFrame:
    """D1 (deterministic): keep rows whose key hashes below ``fraction``.

    A dict gives a fraction per class of ``label_col``; a class that it
    doesn't name is an error at run time, never dropped.

    Every row is an independent draw, so each class keeps the same expected
    fraction (stratified by construction). Nested: a smaller fraction selects
    a subset of a larger one.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    limit = F.lit(fraction) if not isinstance(fraction, dict) else _class_fraction(fraction, label_col)
    return df.filter(unit_interval(*ids, salt=salt) < limit.cast("double"))


def _class_fraction(fractions: dict, label_col: str) -> Column:
    label = F.col(label_col)
    out = F.when(label.isNull(), F.lit(0.0))
    for value, fraction in fractions.items():
        out = out.when(label == F.lit(value), F.lit(float(fraction)))
    return out.otherwise(F.raise_error(F.concat(F.lit("no fraction for class "), label.cast("string"))).cast("double"))


def class_labels(df: DataFrame, label_col: str) -> list:
    """The classes present (A5): one short row per class reaches the driver."""
    return sorted(r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull()).distinct().collect())


def hash_split(df: DataFrame, id_cols, train_fraction: float = 0.8,
               salt: str | None = SPLIT_SALT) -> tuple[DataFrame, DataFrame]:
    """D2 (deterministic): train / test as a predicate and its complement.

    The parts are disjoint and complete by construction; duplicates stay
    where they are (no de-duplication, unlike ``subtract``).
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    u = unit_interval(*ids, salt=salt)
    return df.filter(u < F.lit(float(train_fraction))), df.filter(u >= F.lit(float(train_fraction)))


def split_label(df: DataFrame, id_cols, train_fraction: float = 0.8, part_col: str = "split",
                salt: str | None = SPLIT_SALT) -> DataFrame:
    """The split as a column (``train``/``test``), for one-pass per-part statistics."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    u = unit_interval(*ids, salt=salt)
    return df.withColumn(part_col, F.when(u < F.lit(float(train_fraction)), F.lit("train")).otherwise(F.lit("test")))


def with_fold(df: DataFrame, id_cols, k: int, fold_col: str = "fold",
              salt: str | None = SPLIT_SALT) -> DataFrame:
    """Deterministic fold id in ``[0, k)``."""
    return df.withColumn(fold_col, bucket_col(id_cols, k, salt))


def fold_split(df_with_fold: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """D3: train = every other fold, test = this fold."""
    return (df_with_fold.filter(F.col(fold_col) != fold), df_with_fold.filter(F.col(fold_col) == fold))


def random_fold(df: DataFrame, k: int, seed: int = SEED, fold_col: str = "fold") -> DataFrame:
    """D3 (reference form): ``(rand(seed) * k)`` as int — depends on partitioning."""
    return df.withColumn(fold_col, (F.rand(seed) * k).cast("int"))


def nested_sample_sizes(df: DataFrame, id_cols, fractions: Sequence[float],
                        label_col: str | None = None, salt: str | None = SAMPLE_SALT) -> DataFrame:
    """Sizes of nested samples for several fractions in one pass
    (``fraction, [label,] count``)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    u = unit_interval(*ids, salt=salt)
    aggs = [F.sum(F.when(u < F.lit(float(f)), 1).otherwise(0)).cast("bigint").alias(f"n{i}")
            for i, f in enumerate(fractions)]
    keys = [label_col] if label_col else []
    wide = df.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"{float(f)}D, n{i}" for i, f in enumerate(fractions))
    return wide.selectExpr(*keys, f"stack({len(fractions)}, {stack}) AS (fraction, count)")
