"""Hard negatives by rotated one-bit codes with stored alignments.

A vector is scaled, floored to integers and kept with a code: its direction is
rotated (random signs and a Hadamard transform, twice), the signs of the
coordinates are the code, one bit each, and the inner product of code and
direction is stored as their alignment.  What the code leaves over is rotated
and coded again, ``LEVELS`` times; each residual is at right angles to its
code.

An anchor's own rotated coordinates are cut to ``PLANES`` bit planes, so that
its product with a code is a sum of popcounts.  The estimate of an inner
product adds the aligned codes; Cauchy-Schwarz bounds what the last residual
and the cut planes can add or take away.  Rows whose interval, level after
level, can't hold a score that is asked for are dropped, all others are scored
in integers: the intervals are never used as scores.

Rows are dealt evenly into blocks, anchors are packed as they come.  Every
block of anchors meets every block of rows, in tiles that carry codes and
integers of both; a tile sends its best rows of each anchor on, and these meet
in a window that is cut before the shuffle.  No task and no tile grows with a
frequent label.  The first round finds the positives (same label), the second
the negatives in their score ranges.

Cases: rows with a null label, a null vector or a null or non-finite component
take no part; so do rows with a component too large for exact 64-bit scores
(2^19 for 64 components at a scale of 256); shorter vectors are filled up with
zeros; an empty vector scores 0 everywhere; a null key is never an anchor and
comes last in ties; rows that repeat a key are rows of their own, so an
anchor's copy is one of its "other rows", and each anchor row gets its result;
an anchor without positives, or a positive without negatives, gives no rows;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import with_package, written

LEVELS = 6
PLANES = 6
#: Anchors that meet the codes of a block at once.
MEET = 64
#: Rows of a block, and anchors of a block of anchors, at most.
ROWS = 4096
ANCHORS = 512
#: Stands for a null key, last in ties.
NO_KEY = (1 << 63) - 1
_SEED = 20240607


# ---------------------------------------------------------------- codes
class Rotation:
    """``LEVELS`` rotations of vectors filled up to a power of two, 64 at least."""

    def __init__(self, width: int) -> None:
        self.size = max(64, 1 << max(width - 1, 0).bit_length())
        self.signs = np.random.default_rng(_SEED).choice([-1.0, 1.0], (LEVELS, 2, self.size))

    def apply(self, x: np.ndarray, level: int) -> np.ndarray:
        for signs in self.signs[level]:
            x, half = x * signs, 1
            while half < self.size:
                pairs = x.reshape(len(x), -1, 2, half)
                x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2)
                x, half = x.reshape(len(x), self.size), half * 2
            x = x / np.sqrt(self.size)
        return x

    def directions(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit vectors, their lengths before)."""
        norm = np.sqrt((vectors ** 2).sum(axis=1))
        unit = np.zeros((len(vectors), self.size))
        unit[:, :vectors.shape[1]] = vectors / np.where(norm > 0, norm, 1)[:, None]
        return unit, norm

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes: rows x levels x words, alignments: rows x levels, lengths)."""
        rest, norm = self.directions(vectors)
        codes = np.zeros((len(rest), LEVELS, self.size // 64), np.uint64)
        align = np.zeros((len(rest), LEVELS))
        for level in range(LEVELS):
            rest = self.apply(rest, level)
            up = rest >= 0
            codes[:, level] = np.packbits(up, axis=1).view(np.uint64)
            align[:, level] = np.abs(rest).sum(axis=1) / np.sqrt(self.size)
            rest = rest - np.where(up, 1, -1) * (align[:, level] / np.sqrt(self.size))[:, None]
        return codes, align, norm

    def planes(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of queries: (bit planes: rows x levels x planes x words, low, step, sum, error: rows x levels, lengths)."""
        x, norm = self.directions(vectors)
        planes = np.zeros((len(x), LEVELS, PLANES, self.size // 64), np.uint64)
        low, step, total, error = (np.zeros((len(x), LEVELS)) for _ in range(4))
        for level in range(LEVELS):
            x = self.apply(x, level)
            low[:, level] = x.min(axis=1)
            step[:, level] = (x.max(axis=1) - low[:, level]) / ((1 << PLANES) - 1)
            cut = np.rint((x - low[:, level:level + 1]) / np.where(step[:, level] > 0, step[:, level], 1)[:, None]).astype(np.uint8)
            near = low[:, level:level + 1] + step[:, level:level + 1] * cut
            total[:, level] = near.sum(axis=1)
            error[:, level] = np.sqrt(((x - near) ** 2).sum(axis=1)) + 1e-12
            for k in range(PLANES):
                planes[:, level, k] = np.packbits(cut >> k & 1, axis=1).view(np.uint64)
        return planes, low, step, total, error, norm


class Block:
    """Unpacked rows with codes, ready for anchors."""

    def __init__(self, row: dict) -> None:
        self.id, self.label, self.number = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "numbers"))
        n = len(self.id)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, -1).astype(np.float64)
        self.greatest = np.abs(self.vectors).max(initial=0)
        # one array for each level (and word): a level reads only its own
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(n, LEVELS, -1).transpose(1, 2, 0).copy()
        self.align = np.frombuffer(row["align"], np.float64).reshape(n, LEVELS).T.copy()
        self.norm = np.frombuffer(row["norms"], np.float64)
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        #: length of what the levels so far leave over
        self.left = np.sqrt(np.maximum((self.norm > 0) - np.cumsum(self.align ** 2, axis=0), 0)) + 1e-9

    def intervals(self, at: np.ndarray, level: int, query: tuple[np.ndarray, ...], sums: np.ndarray, errors: np.ndarray):
        """(lower, upper) bounds of the scores of the rows ``at``; ``sums`` and ``errors`` of earlier levels are carried on."""
        planes, low, step, total, error, norm = query
        hits = np.zeros(len(at), np.uint32)
        for word, bits in zip(self.codes[level], planes[level].T, strict=True):
            code = word[at]
            for k in range(PLANES):
                hits += np.bitwise_count(code & bits[k]) * np.uint32(1 << k)
        align = self.align[level][at]
        product = low[level] * self.ones[level][at] + step[level] * hits
        product = (2 * product - total[level]) / np.sqrt(planes.shape[2] * 64)
        sums = sums + align * product
        errors = errors + align * error[level]
        across = np.sqrt(np.maximum(1 - np.maximum(np.abs(product) - error[level], 0) ** 2, 0))
        size = self.norm[at] * norm
        middle, wide = size * sums, size * (errors + self.left[level][at] * across) + 1 + 1e-9 * size
        return middle - wide, middle + wide, sums, errors

    def bounds(self, query: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """``intervals`` of the last level, of all rows with several queries: (lower, upper), queries x rows.

        The popcounts of a code with all planes of a query are one product of its
        signs and the cut coordinates, so queries meet codes as matrices.
        """
        planes, low, step, _, error, norm = query
        size = planes.shape[3] * 64
        sums, errors, weights = np.zeros((len(low), len(self.id))), np.zeros((len(low), len(self.id))), 1 << np.arange(PLANES)
        for level in range(LEVELS):
            signs = np.unpackbits(np.ascontiguousarray(self.codes[level].T).view(np.uint8), axis=1) * 2.0 - 1
            cut = np.tensordot(weights, np.unpackbits(np.ascontiguousarray(planes[:, level]).view(np.uint8), axis=2), (0, 1))
            near = low[:, level, None] + step[:, level, None] * cut
            product = near @ signs.T / np.sqrt(size)
            sums += self.align[level] * product
            errors += error[:, level, None] * self.align[level]
        across = np.sqrt(np.maximum(1 - np.maximum(np.abs(product) - error[:, -1:], 0) ** 2, 0))
        length = norm[:, None] * self.norm
        middle, wide = length * sums, length * (errors + self.left[-1] * across) + 1 + 1e-9 * length
        return middle - wide, middle + wide


def _scores(block: Block, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integers."""
    vectors = block.vectors[at]
    if block.greatest * np.abs(query).max(initial=0) * len(query) >= 2 ** 53:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    return (vectors @ query).astype(np.int64)


def _survivors(lower: np.ndarray, upper: np.ndarray, ranges: list[tuple[float, float]], best: int) -> np.ndarray:
    """Places of the intervals that may hold one of the ``best`` greatest scores of a score range.

    The ranges of an anchor's positives overlap almost wholly, so they are cut as
    one: from the least low to the greatest high, and rows that lie in all of
    them raise each low.
    """
    ranges = [r for r in ranges if r[0] <= r[1]]
    if not ranges:
        return np.zeros(0, np.int64)
    least, most = min(r[0] for r in ranges), max(r[1] for r in ranges)
    sure = lower[(lower >= max(r[0] for r in ranges)) & (upper <= min(r[1] for r in ranges))]
    if len(sure) >= best:  # so many rows of every range score this much at least
        least = max(least, np.partition(sure, len(sure) - best)[len(sure) - best])
    return np.flatnonzero((upper >= least) & (lower <= most))


def _first(score: np.ndarray, key: np.ndarray, best: int) -> np.ndarray:
    return np.lexsort((key, -score))[:best]


# ---------------------------------------------------------------- blocks and tiles
PACKED = ["ids", "labels", "numbers", "vectors", "codes", "align", "norms"]


def _packed(rows: DataFrame, size: int, width: int, extra: list[str]) -> DataFrame:
    """Blocks of at most ``size`` rows (number, id, label, vector), each with its distinct labels."""
    def run(batches):
        rotation = Rotation(width)
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                n = part.num_rows
                vectors = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.int64).reshape(n, -1)
                codes, align, norm = rotation.encode(vectors.astype(np.float64))
                label = part.column("label").to_numpy()
                binary = [part.column("id").to_numpy(), label, part.column("number").to_numpy(), vectors, codes, align, norm]
                values = [pa.array([np.unique(label).tolist()], pa.list_(pa.int64())),
                          *[pa.array([x.tobytes()], pa.binary()) for x in binary]]
                for name in extra:
                    values.append(pa.array([part.column(name).to_pylist()], pa.list_(pa.list_(pa.list_(pa.int64())))))
                yield pa.RecordBatch.from_arrays(values, names=["held", *PACKED, *extra])

    schema = ", ".join(["held array<long>", *[f"{c} binary" for c in PACKED], *[f"{c} array<array<array<long>>>" for c in extra]])
    return (rows.sortWithinPartitions("label", "number").select("number", "id", "label", "vector", *extra)
            .mapInArrow(run, schema))


def _tiles(anchors: DataFrame, blocks: DataFrame, cells: int, wanted: Column) -> DataFrame:
    """Each block of anchors beside each block of rows that ``wanted`` (of held, b_held) lets through."""
    dealt = blocks.withColumnsRenamed({c: f"b_{c}" for c in blocks.columns})
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("b_numbers"), F.lit(cells)))
    return (anchors.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
            .hint("merge").join(dealt, "cell").where(wanted).drop("cell", "held", "b_held"))


def _search(tiles: DataFrame, width: int, best: int, same: bool) -> DataFrame:
    """(number, id, part, score, found): the first ``best`` rows of each tile, anchor and score range (part)."""
    def run(batches):
        rotation = Rotation(width)
        for batch in batches:
            for row in batch.to_pylist():
                anchors = Block(row)
                block = Block({c: row[f"b_{c}"] for c in PACKED})
                planes = rotation.planes(anchors.vectors)
                out = []
                for k in range(len(anchors.id)):
                    if k % MEET == 0:
                        lower, upper = block.bounds(tuple(x[k:k + MEET] for x in planes))
                    alike = block.label == anchors.label[k]
                    at = np.flatnonzero(alike & (block.number != anchors.number[k]) if same else ~alike)
                    ranges = [(-np.inf, np.inf)] if same else [tuple(r) for r in row["ranges"][k]]
                    at = at[_survivors(lower[k % MEET][at], upper[k % MEET][at], ranges, best)]
                    score = _scores(block, at, anchors.vectors[k])
                    for part, (low, high) in enumerate(ranges):
                        inside = np.flatnonzero((score >= low) & (score <= high))
                        first = inside[_first(score[inside], block.id[at[inside]], best)]
                        out += [(anchors.number[k], anchors.id[k], part, score[i], block.id[at[i]]) for i in first]
                columns = np.array(out, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["number", "id", "part", "score", "found"])

    return tiles.mapInArrow(run, "number long, id long, part long, score long, found long")


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("number", "part").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, scale: int, width: int) -> DataFrame:
    """(id, label, anchor, vector) of the rows that take part; the vector as 64-bit integers."""
    limit = 2.0 ** ((62 - max(width, 1).bit_length()) // 2)

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            length = column.value_lengths().to_numpy()
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            scaled = np.floor(flat * scale)
            good = np.abs(scaled) < limit  # false for what is not finite
            whole = np.bincount(row[~good], minlength=len(length)) == 0
            vectors = np.zeros((len(length), max(width, 1)), np.int64)
            vectors[row[good], place[good]] = scaled[good].astype(np.int64)
            keep = pa.array(whole)
            packed = pa.array([v.tobytes() for v in vectors[whole]], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(keep) for c in ("id", "label", "anchor")], packed],
                                             names=["id", "label", "anchor", "vector"])

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"),
                     F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()
                      & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    return rows.mapInArrow(run, "id long, label long, anchor boolean, vector binary")


def mine(df: DataFrame, *, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` marks the anchor rows.  A negative of a positive with score p
    scores between ``low`` and ``high`` hundredths of p.
    """
    with_package(df.sparkSession)
    width = int(df.agg(F.max(F.size(vector_col))).first()[0] or 0)
    rows = written(_rows(df, id_col, vector_col, label_col, anchor, scale, width)
                   .withColumn("number", F.monotonically_increasing_id()))
    blocks = written(_packed(rows.repartition(-(-rows.count() // ROWS) or 1), ROWS, width, []))
    cells = max(1, blocks.count() // 2)
    anchors = rows.where("anchor").select("number", "id", "label", "vector")

    tiles = _tiles(_packed(anchors, ANCHORS, width, []), blocks, cells, F.arrays_overlap("held", "b_held"))
    best = _ranked(_search(tiles, width, positives, True), positives)
    # an anchor's positives in one row
    found = F.struct("rank", F.col("found").alias("positive"), "score")
    picked = written(best.groupBy("number").agg(F.array_sort(F.collect_list(found)).alias("picked")))
    ranges = F.transform("picked", lambda p: _range(p["score"], low, high))
    asked = anchors.hint("merge").join(picked, "number").withColumn("ranges", ranges)

    tiles = _tiles(_packed(asked, ANCHORS, width, ["ranges"]), blocks, cells,
                   (F.size("held") > 1) | (F.size("b_held") > 1) | (F.col("held") != F.col("b_held")))
    found = _ranked(_search(tiles, width, negatives, False), negatives)
    both = found.withColumnRenamed("score", "negative_score").hint("merge").join(picked, "number")
    positive = F.element_at("picked", (F.col("part") + 1).cast("int"))

    def key(c: Column) -> Column:
        return F.when(c != NO_KEY, c)

    return both.select(F.col("id").alias("anchor_id"), key(positive["positive"]).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                       key(F.col("found")).alias("negative_id"), positive["score"].alias("positive_score"), "negative_score")


def _range(score: Column, low: int, high: int) -> Column:
    """The least and greatest whole number n with low * score <= 100 * n <= high * score."""
    up, down = F.lit(low) * score, F.lit(high) * score
    return F.array(-_floor_div(-up, 100), _floor_div(down, 100))


def _floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))
