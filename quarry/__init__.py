"""quarry — web-log analytics and tabular/recommender ML operators on PySpark.

Every operator takes and returns DataFrames; heavy work stays on the cluster
(partial aggregates, window group limits, joins), and results only reach the
driver when a caller decides to collect them.

Sub-packages:

* ``quarry.sources``   — table readers, stand-in inputs derived from tables, result sinks
* ``quarry.functions`` — column expressions (log parsing, classifiers, recodes, hash buckets)
* ``quarry.operators`` — ranking, grids, splits, features, metrics, models, tuning
* ``quarry.plans``     — the composite analyses (web logs, tuned GLMs, wide classifiers,
  scaling study, recommender + clusters)
* ``quarry.streaming`` — the stateless log analyses run incrementally on a file stream
"""

from quarry.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
