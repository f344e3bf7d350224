"""Feature engineering (E1-E5) with multi-column MLlib stages.

One multi-column ``StringIndexer`` fits every categorical column in a single
pass (instead of one job per column), and one ``OneHotEncoder`` encodes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import settled


def index_suffix(col: str) -> str:
    return f"{col}_index"


def vec_suffix(col: str) -> str:
    return f"{col}_vec"


def string_indexer(cols: Sequence[str], handle_invalid: str = "error",
                   order: str = "frequencyDesc") -> StringIndexer:
    """Category -> index; frequency descending, ties by value; unseen
    values fail unless ``handle_invalid`` is ``keep`` or ``skip``."""
    return StringIndexer(inputCols=list(cols), outputCols=[index_suffix(c) for c in cols],
                         stringOrderType=order, handleInvalid=handle_invalid)


def counted_index(df: DataFrame, cols: Sequence[str], n_col: str, handle_invalid: str = "error") -> list[StringIndexerModel]:
    """E1 fitted on rows that stand for ``n_col`` rows each: the index of all rows, a model for each column (labels on
    the driver, as in any ``StringIndexerModel``)."""
    models = []
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.sum(n_col).alias("n")).collect()
        labels = [r["value"] for r in sorted(counts, key=lambda r: (-r["n"], r["value"]))]
        models.append(StringIndexerModel.from_labels(labels, c, index_suffix(c), handle_invalid))
    return models


class DistributedIndex:
    """E1 for columns of any number of values: the labels stay a table.

    ``StringIndexer`` keeps every label on the driver and in the model. Here the
    counted values are range-partitioned by (count descending, value), numbered
    within their range, and shifted by the sizes of the ranges before; rows get
    their index by a join. NULL is an invalid value, as for ``StringIndexer``.
    """

    def __init__(self, labels: DataFrame, col: str) -> None:
        self.labels, self.col = labels, col

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> DistributedIndex:
        """``labels``: (value, index), index 0 for the most frequent value, ties by value."""
        counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        ranged = settled(counted.repartitionByRange(F.desc("n"), "value").withColumn("range", F.spark_partition_id()))
        sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))  # one row a range
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
        place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("n"), "value"))
        labels = (ranged.withColumn("place", place).join(F.broadcast(offsets), "range")
                  .select("value", (F.col("offset") + F.col("place") - 1).cast("long").alias("index")))
        return cls(settled(labels), col)

    def transform(self, df: DataFrame, out_col: str | None = None, handle_invalid: str = "error") -> DataFrame:
        """``df`` with the index of its value; unseen values and NULL fail (``error``), share one
        index after all others (``keep``) or lose their rows (``skip``)."""
        out_col = out_col or index_suffix(self.col)
        labels = self.labels.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        joined = df.join(labels, F.col(self.col).cast("string") == F.col("_value"), "inner" if handle_invalid == "skip" else "left")
        index = F.col("_index")
        if handle_invalid == "keep":
            index = F.coalesce(index, F.lit(self.labels.count()))
        elif handle_invalid == "error":
            unseen = F.raise_error(F.concat(F.lit(f"{self.col} has an unseen value: "), F.coalesce(F.col(self.col).cast("string"), F.lit("NULL"))))
            index = F.coalesce(index, unseen.cast("long"))
        return joined.withColumn(out_col, index).drop("_value", "_index")


def one_hot_encoder(cols: Sequence[str], drop_last: bool = False, handle_invalid: str = "error") -> OneHotEncoder:
    """One-hot of the indexed columns, keeping every level by default."""
    return OneHotEncoder(inputCols=[index_suffix(c) for c in cols], outputCols=[vec_suffix(c) for c in cols],
                         dropLast=drop_last, handleInvalid=handle_invalid)


def assembler(cols: Sequence[str], out_col: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    """Concatenate numeric / vector columns into one vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out_col, handleInvalid=handle_invalid)


def standardizer(in_col: str, out_col: str = "scaled", with_mean: bool = True,
                 with_std: bool = True) -> StandardScaler:
    """Centre and scale by the *sample* standard deviation (a constant column becomes 0)."""
    return StandardScaler(inputCol=in_col, outputCol=out_col, withMean=with_mean, withStd=with_std)


def categorical_pipeline(cols: Sequence[str], out_col: str = "features", drop_last: bool = False,
                         handle_invalid: str = "error", n_col: str | None = None, counted: DataFrame | None = None) -> Pipeline:
    """E1 + E2 + E3: index, one-hot and assemble categorical columns. With ``counted``
    the indices are of its rows, each of which stands for ``n_col`` rows.

    ``keep`` adds one slot per column for unseen values: the indexer's index
    for them, which the encoder treats as a level like any other."""
    indexers = [string_indexer(cols, handle_invalid)] if counted is None else counted_index(counted, cols, n_col, handle_invalid)
    return Pipeline(stages=[*indexers, one_hot_encoder(cols, drop_last),
                            assembler([vec_suffix(c) for c in cols], out_col)])


def fit_transform(pipeline: Pipeline, train: DataFrame, *others: DataFrame) -> tuple[PipelineModel, list[DataFrame]]:
    """E5: fit on the training part only, transform it and every other part."""
    model = pipeline.fit(train)
    return model, [model.transform(train)] + [model.transform(o) for o in others]


def array_features(df: DataFrame, array_col: str, out_col: str = "features") -> DataFrame:
    """An ``array<float>`` column as an ML vector (parquet arrays may contain NULLs)."""
    return df.withColumn(out_col, array_to_vector(F.col(array_col)))


def vector_elements(df: DataFrame, vec_col: str, out_col: str) -> DataFrame:
    """An ML vector column as ``array<double>``."""
    return df.withColumn(out_col, vector_to_array(F.col(vec_col)))
