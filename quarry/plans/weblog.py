"""Web-log analysis (C1-C4): requests per host class, organisations per class,
top-N organisations, rank of one organisation, share-with-remainder table and
the busiest organisation's day x hour grid.

Plan shape: the log is scanned and parsed once and reduced, in one shuffle,
to a *cube* of counts per (class, organisation, day, hour). Every answer is
derived from that cube, whose size is bounded by classes x organisations x
31 x 24 no matter how many log lines there are; hot hosts are combined
map-side by the partial aggregate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.classify import ACADEMIC_SUFFIXES, organisation, suffix_class
from quarry.functions.logparse import parse_log
from quarry.operators.aggregates import distinct_count_per_group
from quarry.operators.joins import join_bounded
from quarry.operators.ranking import rank_of, share_with_remainder, top_n_per_group
from quarry.session import settled

CLASS = "country_code"
ORG = "institution"
DAYS = range(1, 32)
HOURS = range(0, 24)


def classify_hosts(parsed: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """F8 + P7: add the host class and keep only classified hosts."""
    labels = [label for _, label in rules]
    return (parsed.withColumn(CLASS, suffix_class(F.col("host"), rules))
                  .filter(F.col(CLASS).isin(labels)))


def with_organisation(classified: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """add the organisation label."""
    return classified.withColumn(ORG, organisation(F.col("host"), F.col(CLASS), rules))


def academic_requests(lines: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """Parsed, classified requests with their organisation (row level)."""
    return with_organisation(classify_hosts(parse_log(lines), rules), rules)


def request_cube(lines: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """Counts per (class, organisation, day, hour); NULL day/hour rows are kept
    so class and organisation totals stay exact."""
    req = academic_requests(lines, rules).select(CLASS, ORG, "day", "hour")
    return req.groupBy(CLASS, ORG, "day", "hour").agg(F.count(F.lit(1)).alias("count"))


def _every_class(found: DataFrame, count_col: str, rules) -> DataFrame:
    """One row per class of the rules, 0 where the log has no request of it."""
    classes = found.sparkSession.createDataFrame([(label,) for label in dict.fromkeys(x for _, x in rules)],
                                                 f"{CLASS} string")
    return classes.join(found, CLASS, "left").select(CLASS, F.coalesce(count_col, F.lit(0)).cast("bigint").alias(count_col))


def class_totals(cube: DataFrame) -> DataFrame:
    """Requests per host class that occurs."""
    return cube.groupBy(CLASS).agg(F.sum("count").cast("bigint").alias("count"))


def class_counts(cube: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """Requests per host class, 0 for a class without requests."""
    return _every_class(class_totals(cube), "count", rules)


def org_counts(cube: DataFrame) -> DataFrame:
    """Requests per (class, organisation).

    The organisation is never NULL for a classified host (a failed match is
    ``''``), so the reference's not-NULL filter (P10) is vacuous and left out:
    an extra filter here would be pushed into the scan of this branch only and
    stop Spark from reusing the cube's shuffle across branches.
    """
    return cube.groupBy(CLASS, ORG).agg(F.sum("count").cast("bigint").alias("count"))


def org_distinct(cube: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """Distinct organisations per class (``''`` counts as one), 0 for a class without requests."""
    return _every_class(distinct_count_per_group(cube, CLASS, ORG, count_col="n_institutions"), "n_institutions", rules)


def org_top(cube: DataFrame, n: int = 9) -> DataFrame:
    """The ``n`` busiest organisations per class (ties by name)."""
    return top_n_per_group(org_counts(cube), CLASS, "count", n, tie_cols=[ORG])


def org_rank(cube: DataFrame, name: str, klass: str | None = None, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """Rank of organisation ``name`` within its class (all classes when ``klass`` is None)."""
    counts = org_counts(cube)
    if klass is not None:
        counts = counts.filter(F.col(CLASS) == klass)
    return rank_of(counts, CLASS, ORG, name, bounded_groups=True)


def org_share(cube: DataFrame, n: int = 9) -> DataFrame:
    """Top-``n`` organisations plus ``Others`` per class, against the class total."""
    return share_with_remainder(org_counts(cube), CLASS, ORG, n, totals=class_totals(cube))


def busiest_org_grid(cube: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """The day x hour request grid (31 x 24, zeros filled) of each class's busiest organisation.

    The busiest organisation of each class (ties by name) comes first, one row
    per class; only its cells are gathered, 744 at most. Rows with NULL or
    out-of-range day/hour count towards the totals but are not cells.
    """
    nx, ny = len(DAYS), len(HOURS)
    valid = F.col("day").between(DAYS.start, DAYS.stop - 1) & F.col("hour").between(HOURS.start, HOURS.stop - 1)
    cell_id = (F.col("day") - DAYS.start) * ny + (F.col("hour") - HOURS.start)
    busiest = org_counts(cube).groupBy(F.col(CLASS).alias("_c")).agg(
        F.min_by(ORG, F.struct((-F.col("count")).alias("n"), F.col(ORG))).alias("_o"))
    # null-safe, as a plain equality would add filters to one branch of the cube and cost a second scan
    same = F.col(CLASS).eqNullSafe(F.col("_c")) & F.col(ORG).eqNullSafe(F.col("_o"))
    cells = (join_bounded(cube, busiest, on=same).groupBy(CLASS, ORG)
             .agg(F.map_from_entries(F.collect_list(F.when(valid, F.struct(cell_id.alias("k"), F.col("count").alias("v")))))
                  .alias("_cells")))
    grid = cells.select(CLASS, ORG, "_cells", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("_i"))
    return grid.select(
        CLASS, ORG,
        (F.lit(DAYS.start) + (F.col("_i") / F.lit(ny)).cast("int")).cast("int").alias("day"),
        (F.lit(HOURS.start) + F.col("_i") % F.lit(ny)).cast("int").alias("hour"),
        F.coalesce(F.element_at("_cells", F.col("_i")), F.lit(0)).cast("bigint").alias("count"))


class WeblogAnalysis:
    """All C1-C4 answers from one scan of the log.

    The cube (bounded by classes x organisations x 744 rows) is computed once
    and read by every answer: from the shared checkpoint folder where the
    deployment names one (an executor lost later never sends Spark back to
    re-scan the raw log), else from the cache.
    """

    def __init__(self, lines: DataFrame, rules=ACADEMIC_SUFFIXES, top_n: int = 9):
        self.rules = rules
        self.top_n = top_n
        self.cube = settled(request_cube(lines, rules))

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.cube.unpersist()

    def results(self, rank_name: str | None = None, rank_class: str | None = None) -> dict[str, DataFrame]:
        out = {
            "class_counts": class_counts(self.cube, self.rules),
            "org_distinct": org_distinct(self.cube, self.rules),
            "org_top": org_top(self.cube, self.top_n),
            "org_share": org_share(self.cube, self.top_n),
            "busiest_grid": busiest_org_grid(self.cube, self.rules),
        }
        if rank_name is not None:
            out["org_rank"] = org_rank(self.cube, rank_name, rank_class, self.rules)
        return out
