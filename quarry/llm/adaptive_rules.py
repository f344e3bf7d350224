"""Quality rules with adaptive thresholds, by column expressions only.

Each text is reduced to a few counts.  Texts that pass the base rules feed
mergeable quantile sketches (KLL) of four ratios, one per language and source;
sketches of a language are merged.  A ratio's limit is its tail quantile plus
``reach`` times the distance of that quantile from the median, so both the
place and the width of what is allowed come from the data; no limit is fixed.
The quantiles of a language and source are drawn towards those of the language
by ``prior`` texts' worth: few texts hardly move them, many decide them, and
no size switches from one to the other.  The limits are written once and join
back to the counts by language and source.

The sketch keeps ``sketch_k`` items a level: up to that many texts a group the
quantiles are exact, beyond they are off by some tenths of a percent in rank
and may differ in that order from run to run; within a run all rows are judged
by the same limits, also after a lost executor.

Cases: a null or empty text has counts 0 and fails the base rules; null
languages or sources form groups of their own; repeated rows count each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Ratio: (numerator, denominator, tail quantile, reach, whether a low value is out of range too).  Symbols and
#: word lengths have compact bodies, of which junk is told by a wide reach from an inner quantile; repeats
#: have long tails in good text too, which the outer quantile covers.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words", 0.90, 2.0, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.99, 0.5, False),
    "repeat_share": ("n_repeat_words", "n_words", 0.99, 0.5, False),
    "chars_per_word": ("word_chars", "n_words", 0.90, 2.0, True),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(found: Column) -> Column:
    """Words of an array in 3-word windows that occur in it twice or more.

    Windows are packed as (hash, place) in one long each and sorted, so equal
    windows are neighbours; equal hashes are confirmed on the words.
    """
    n = F.size(found)
    bits = F.ceil(F.log2(n + F.lit(1.0))).cast("int")

    def counted(bits: Column) -> Column:
        def packed(word: Column, i: Column) -> Column:
            code = F.xxhash64(word, F.get(found, i + 1), F.get(found, i + 2))
            return F.coalesce(F.call_function("shiftleft", code, bits).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(x: Column, y: Column) -> Column:
            near = F.call_function("shiftrightunsigned", x, bits) == F.call_function("shiftrightunsigned", y, bits)
            for k in range(3):
                near = near & (F.get(found, place(x) + k) == F.get(found, place(y) + k))
            return F.coalesce(near, F.lit(False))

        def covered(places: Column) -> Column:
            # a window adds its words up to the start of the next
            return F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p,
                                                                                          F.lit(3)))),
                               F.lit(0), lambda a, x: a + x)

        windows = F.slice(F.transform(found, packed), F.lit(1), F.greatest(n - 2, F.lit(0)))
        return let(F.sort_array(windows), lambda ordered: let(
            F.sort_array(F.transform(
                F.filter(ordered, lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1))), place)),
            covered))

    return F.when(n < 3, F.lit(0)).otherwise(let(bits, counted))


def counts(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda found: F.struct(
        F.size(found).cast("long").alias("n_words"),
        F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeated_words(found).cast("long").alias("n_repeat_words")))


def _range(own: Column, language: Column, n: Column, prior: float, tail: float, reach: float) -> Column:
    """The allowed values from the sketches of a group of ``n`` texts and of its language."""
    def quantile(q: float) -> Column:
        one, all_ = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for sketch in (own, language))
        return (n * one + F.lit(prior) * all_) / (n + F.lit(prior))

    low, middle, high = quantile(1 - tail), quantile(0.5), quantile(tail)
    return F.struct((low - reach * (middle - low)).alias("low"), (high + reach * (high - middle)).alias("high"))


def thresholds(measured: DataFrame, *, prior: float = 200.0, sketch_k: int = 1024) -> DataFrame:
    """(lang_key, source_key, <ratio> ranges) from rows with the ratios and the two keys."""
    sketches = measured.groupBy("lang_key", "source_key").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.kll_sketch_agg_double(F.col(r), F.lit(sketch_k)).alias(r) for r in RATIOS])
    merged = sketches.groupBy("lang_key").agg(*[F.kll_merge_agg_double(F.col(r)).alias(f"all_{r}") for r in RATIOS])
    return sketches.join(merged, "lang_key").select(
        "lang_key", "source_key",
        *[_range(F.col(r), F.col(f"all_{r}"), F.col("n"), prior, tail, reach).alias(f"range_{r}")
          for r, (_, _, tail, reach, _) in RATIOS.items()])


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", **options) -> DataFrame:
    """(id, counts, base_failed, kept, reasons): ``reasons`` names the ratios out of range."""
    rows = df.select(F.col(id_col).alias("doc_id"),
                     *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(k)
                       for c, k in ((lang_col, "lang_key"), (source_col, "source_key"))],
                     counts(F.col(text_col)).alias("c")).select("doc_id", "lang_key", "source_key", "c.*")
    rows = checkpointed(rows)  # some hundred bytes a row; the texts are read once
    rows = rows.select("*", ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
                       .alias("base_failed"),
                       *[(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(r) for r, (a, b, _, _, _) in RATIOS.items()])
    # one row a language and source; written, as sketches of a stage that runs again may differ
    ranges = checkpointed(thresholds(rows.where(~F.col("base_failed")), **options))
    judged = rows.join(ranges, ["lang_key", "source_key"], "left")
    out = [F.when((F.col(r) > F.col(f"range_{r}.high")) | ((F.col(r) < F.col(f"range_{r}.low")) & F.lit(both)), F.lit(r))
           for r, (_, _, _, _, both) in RATIOS.items()]
    return judged.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(F.array_compact(F.array(*out))) == 0)).alias("kept"),
        F.array_compact(F.array(*out)).alias("reasons"))
