"""Column expressions over probability vectors, features, pixel vectors and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_ROWS, GRID_COLUMNS = 8, 9


# --- probability vectors -------------------------------------------------------------------


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it.

    The optimizer substitutes expressions for their names; a lambda variable is not substituted.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(logits: Column) -> Column:
    def scaled(z):
        return bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    return bound(logits, lambda z: normalised(scaled(z)))


def normalised(weights: Column) -> Column:
    return bound(
        weights,
        lambda w: F.aggregate(
            w, F.lit(0.0), lambda total, x: total + x, lambda total: F.transform(w, lambda x: x / total)
        ),
    )


def predicted_index(probs: Column) -> Column:
    """Lowest index that attains the maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def true_probability(probs: Column, target: Column) -> Column:
    """Probability of the truth; 0 for a label behind the last one the model knows."""
    return F.coalesce(F.try_element_at(probs, target + 1), F.lit(0.0))


def log_loss_term(probability: Column) -> Column:
    return -F.log(F.least(F.greatest(probability, F.lit(1e-12)), F.lit(1.0)))


def brier_term(probs: Column, target: Column) -> Column:
    squares = F.transform(
        probs,
        lambda p, i: F.pow(p - F.when(i == target, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(2.0)),
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def true_rank(probs: Column, target: Column) -> Column:
    """How many classes come before the true one; equal scores favour the lower index."""
    p = true_probability(probs, target)
    ahead = F.transform(probs, lambda x, i: ((x > p) | ((x == p) & (i < target))).cast("int"))
    return F.aggregate(ahead, F.lit(0), lambda total, x: total + x)


def blended(first: Column, second: Column, second_weight: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: (1.0 - second_weight) * a + second_weight * b)


def bin_edges(bins: int) -> list[float]:
    """Edges of equal-width bins over [0, 1], multiplied out rather than divided so that ties agree."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def bin_index(value: Column, bins: int) -> Column:
    """Bin of a share in [0, 1]: left-closed bins, the last one closed on both sides."""
    edges = F.array(*[F.lit(edge) for edge in bin_edges(bins)[:-1]])
    return bound(value, lambda v: F.size(F.filter(edges, lambda edge: edge <= v)) - 1)


# --- features ------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit_vector(v: Column) -> Column:
    """Vector of length one; the zero vector stays zero."""

    def scaled(w):
        return F.aggregate(
            w,
            F.lit(0.0),
            lambda total, x: total + x * x,
            lambda total: F.transform(w, lambda x: F.when(total > 0, x / F.sqrt(total)).otherwise(F.lit(0.0))),
        )

    return bound(v.cast("array<double>"), scaled)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit_vector(a), unit_vector(b))


def mean_absolute_error(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x) / F.size(a)


def guarded_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long vectors; 0 when either side is constant."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "b", "aa", "bb", "ab")])
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))

    def step(s, p):
        return F.struct(
            (s.a + p.x).alias("a"),
            (s.b + p.y).alias("b"),
            (s.aa + p.x * p.x).alias("aa"),
            (s.bb + p.y * p.y).alias("bb"),
            (s.ab + p.x * p.y).alias("ab"),
        )

    def finish(s):
        n = F.size(a)
        spread_a, spread_b = n * s.aa - s.a * s.a, n * s.bb - s.b * s.b
        return F.when((spread_a <= 0) | (spread_b <= 0), F.lit(0.0)).otherwise(
            (n * s.ab - s.a * s.b) / (F.sqrt(spread_a) * F.sqrt(spread_b))
        )

    return F.aggregate(pairs, start, step, finish)


# --- difference hash -----------------------------------------------------------------------


def dhash_from_grid(grid: Column) -> Column:
    """64-bit difference hash of a row-major 8 x 9 grid; bit ``8*row+col`` compares right neighbours."""

    def bit(row: int, col: int) -> Column:
        left = F.get(grid, F.lit(row * GRID_COLUMNS + col))
        right = F.get(grid, F.lit(row * GRID_COLUMNS + col + 1))
        mask = F.lit(signed64(1 << (8 * row + col))).cast("bigint")
        return F.when(left > right, mask).otherwise(F.lit(0).cast("bigint"))

    # plain comparisons, one per bit, compile to straight-line code
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(r, c) for r in range(GRID_ROWS) for c in range(8)])


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shares(total: int, count: int) -> list[range]:
    """Cut 0 .. total into ``count`` neighbouring ranges whose lengths differ by one at most."""
    if not 1 <= count <= max(total, 1):
        raise ValueError(f"{total} places cannot be cut into {count} shares.")
    edges = [total * i // count for i in range(count + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def signed64(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def hash_bands(value: Column, count: int) -> Column:
    """Array of (band, size, value): the bits of each of ``count`` bands, as exact-match keys."""

    def key(number: int, band: range) -> Column:
        bits = F.shiftrightunsigned(value.cast("bigint"), band.start).bitwiseAND(F.lit(signed64((1 << len(band)) - 1)))
        return F.struct(F.lit(number).alias("band"), F.lit(len(band)).alias("size"), bits.alias("value"))

    return F.array(*[key(i, band) for i, band in enumerate(shares(64, count))])


def band_masks(count: int, kept: int) -> list[int]:
    """Signed masks of every choice of ``kept`` out of ``count`` disjoint bands.

    Two hashes that differ in at most ``count - kept`` bits agree on at least one of these masks.
    """
    bands = [sum(1 << bit for bit in share) for share in shares(64, count)]
    return [signed64(sum(chosen)) for chosen in combinations(bands, kept)]


# --- pixel vectors -------------------------------------------------------------------------


def _clamped(value: Column, limits: tuple[float, float] | None) -> Column:
    return value if limits is None else F.least(F.greatest(value, F.lit(limits[0])), F.lit(limits[1]))


def brightness(px: Column, factor: float, limits: tuple[float, float] | None = (0.0, 255.0)) -> Column:
    return F.transform(px, lambda x: _clamped(x * F.lit(factor), limits))


def contrast(px: Column, factor: float, pivot: Column, limits: tuple[float, float] | None = (0.0, 255.0)) -> Column:
    return F.transform(px, lambda x: _clamped(pivot + (x - pivot) * F.lit(factor), limits))


def rounded_mean(px: Column) -> Column:
    """Whole-number mean that a contrast change pivots on."""
    total = F.aggregate(px, F.lit(0.0), lambda t, x: t + x)
    return F.floor(total / F.size(px) + 0.5).cast("double")


def centred(length: int, fraction: float) -> tuple[int, int]:
    """First place inside and first place behind the middle ``fraction`` of an axis, in whole pixels."""
    inside = int(length * fraction)
    start = (length - inside) // 2
    return start, start + inside


def occlude_centre(px: Column, width: int, height: int, fraction: float = 0.6, fill: float = 128.0) -> Column:
    """Fill the central box; its right and bottom edges are included."""
    (left, right), (top, bottom) = centred(width, fraction), centred(height, fraction)

    def value(x, i):
        row, col = F.floor(i / width), i % width
        return F.when(col.between(left, right) & row.between(top, bottom), F.lit(fill)).otherwise(x)

    return F.transform(px, value)


def occlude_border(px: Column, width: int, height: int, keep: float = 0.6, fill: float = 128.0) -> Column:
    """Keep only the central box; its right and bottom edges are excluded."""
    (left, right), (top, bottom) = centred(width, keep), centred(height, keep)

    def value(x, i):
        row, col = F.floor(i / width), i % width
        return F.when(col.between(left, right - 1) & row.between(top, bottom - 1), x).otherwise(F.lit(fill))

    return F.transform(px, value)
