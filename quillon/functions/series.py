"""Functions of a series (array<double>) as Column expressions, so that Catalyst plans and compiles them.

Positions are 0-based and ranges half-open, as in Python; Spark's own 1-based functions stay inside.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import cos, pi, sin
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def part(v: Column, start: int, end: int) -> Column:
    return F.slice(v, start + 1, end - start)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body uses it and wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean(v: Column) -> Column:
    return let(v, lambda w: total(w) / F.size(w))


def _spread(w: Column, m: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(w)


def variance(v: Column) -> Column:
    """Population variance in two passes, so that cancellation can't make it negative."""
    return let(v, lambda w: let(mean(w), lambda m: _spread(w, m)))


def sd(v: Column) -> Column:
    return F.sqrt(variance(v))


def znorm(v: Column) -> Column:
    """(x - mean) / sd; all zeros for a constant series."""
    scaled = lambda w, m, s: F.transform(w, lambda x: F.when(s > 1e-12, (x - m) / s).otherwise(F.lit(0.0)))
    return let(v, lambda w: let(mean(w), lambda m: let(F.sqrt(_spread(w, m)), lambda s: scaled(w, m, s))))


#: Points of a stretch that is summed by appending, which copies what is there at each point.
STRETCH = 128


def _appended_sum(v: Column) -> Column:
    return F.aggregate(v, F.expr("cast(array() as array<double>)"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))


def running_sum(v: Column) -> Column:
    """Sums of all points so far: of each stretch, plus the sum of the stretches before, so that long series aren't copied once a point."""
    cuts = lambda w: F.when(F.size(w) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / STRETCH).cast("int")))
    stretches = lambda w: F.transform(cuts(w), lambda i: _appended_sum(F.slice(w, i * STRETCH + 1, F.lit(STRETCH))))
    before = lambda sums: F.concat(F.array(F.lit(0.0)), _appended_sum(F.transform(sums, lambda s: F.element_at(s, -1))))
    joined = lambda sums, b: F.flatten(F.transform(sums, lambda s, i: F.transform(s, lambda x: x + F.get(b, i))))
    return let(v, lambda w: let(stretches(w), lambda sums: let(before(sums), lambda b: joined(sums, b))))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def equal_segments(length: int, segments: int) -> list[int]:
    """Ends of equal segments; the last one takes the rest."""
    step = length // segments
    return [step * (i + 1) for i in range(segments - 1)] + [length]


def segment_stats(v: Column, ends: list[int]) -> Column:
    """array<struct<mean, sd>> of the segments that end where told."""
    starts = [0, *ends[:-1]]
    return F.array(*[F.struct(mean(part(v, s, e)).alias("mean"), sd(part(v, s, e)).alias("sd")) for s, e in zip(starts, ends, strict=True)])


def paa(v: Column, segments: int, length: int) -> Column:
    """Means of equal segments of length // segments points; points beyond the last are left out."""
    step = length // segments
    return F.array(*[mean(part(v, i * step, (i + 1) * step)) for i in range(segments)])


def breakpoints(cardinality: int) -> list[float]:
    """The standard normal quantiles that cut it into so many equal parts."""
    return [NormalDist().inv_cdf(i / cardinality) for i in range(1, cardinality)]


def symbol(x: Column, cardinality: int) -> Column:
    """Number of breakpoints strictly below x."""
    cuts = F.array(*[F.lit(b) for b in breakpoints(cardinality)])
    return F.size(F.filter(cuts, lambda b: b < x))


def sax(v: Column, segments: int, length: int, cardinality: int) -> Column:
    return F.transform(paa(v, segments, length), lambda x: symbol(x, cardinality))


def sax_bits(word: Column, bits: int) -> Column:
    """The word as binary digits, symbols apart by spaces."""
    return F.array_join(F.transform(word, lambda s: F.lpad(F.bin(s), bits, "0")), " ")


def root_mask(word: Column, bits: int) -> Column:
    """The top bits of the symbols as one number, the first symbol's highest."""
    return F.aggregate(word, F.lit(0).cast("long"), lambda a, s: a * 2 + F.shiftright(s, bits - 1))


def dft(v: Column, length: int, coefficients: int, skip_first: bool = True) -> Column:
    """Real and imaginary parts in turn of the first Fourier coefficients, scaled by 1 / sqrt(length); without that of frequency 0 if told."""
    out = []
    for k in range(int(skip_first), coefficients + int(skip_first)):
        for wave in (cos, lambda t: -sin(t)):
            weights = F.array(*[F.lit(wave(2 * pi * k * t / length) / length**0.5) for t in range(length)])
            out.append(total(F.zip_with(v, weights, lambda x, w: x * w)))
    return F.array(*out)


def query_order(v: Column) -> Column:
    """Positions by falling absolute value, ties by position."""
    pairs = F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("key"), i.alias("at")))
    return F.transform(F.array_sort(pairs), lambda p: p["at"])


def envelope(v: Column, length: int, band: int) -> Column:
    """array<struct<upper, lower>>: the extremes within band points."""
    ranges = [(max(0, i - band), min(length, i + band + 1)) for i in range(length)]
    return F.array(*[F.struct(F.array_max(part(v, s, e)).alias("upper"), F.array_min(part(v, s, e)).alias("lower")) for s, e in ranges])


def _square(x: Column) -> Column:
    return x * x


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def lb_keogh(q: Column, env: Column) -> Column:
    """Sum of squared distances of q to the envelope."""
    gap = lambda x, e: F.greatest(x - e["upper"], e["lower"] - x, F.lit(0.0))
    return total(F.zip_with(q, env, lambda x, e: gap(x, e) * gap(x, e)))


def sax_mindist(paa_: Column, word: Column, segments: int, length: int, cardinality: int) -> Column:
    """Squared lower bound of the distance between a series of these means and any series of the word; outer cells are open."""
    cuts = breakpoints(cardinality)
    lower, upper = F.array(F.lit(-1e300), *map(F.lit, cuts)), F.array(*map(F.lit, cuts), F.lit(1e300))
    terms = []
    for i in range(segments):
        x, s = F.get(paa_, F.lit(i)), F.get(word, F.lit(i))
        terms.append(_square(F.greatest(F.get(lower, s) - x, x - F.get(upper, s), F.lit(0.0))))
    return F.lit(float(length // segments)) * _sum(terms)


def envelope_means(env: Column, segments: int, length: int) -> list[Column]:
    """Two arrays: the means over equal segments of an envelope's upper and lower extremes."""
    step = length // segments
    cells = [part(env, i * step, (i + 1) * step) for i in range(segments)]
    return [F.array(*[mean(F.transform(c, lambda e: e[side])) for c in cells]) for side in ("upper", "lower")]


def cell_borders(word: Column, cardinality: int) -> list[Column]:
    """Two arrays: the lower and upper borders of the symbols' cells; outer cells are open."""
    cuts = breakpoints(cardinality)
    return [F.transform(word, lambda s: F.get(borders, s)) for borders in (F.array(F.lit(-1e300), *map(F.lit, cuts)), F.array(*map(F.lit, cuts), F.lit(1e300)))]


def interval_gap(top: Column, low: Column, cell_low: Column, cell_high: Column, segments: int, length: int) -> Column:
    """Squared lower bound under time warping, from ``envelope_means`` of one series and ``cell_borders`` of the other."""
    at = lambda c, i: F.get(c, F.lit(i))
    terms = [_square(F.greatest(at(cell_low, i) - at(top, i), at(low, i) - at(cell_high, i), F.lit(0.0))) for i in range(segments)]
    return F.lit(float(length // segments)) * _sum(terms)


def dtw_mindist(env: Column, word: Column, segments: int, length: int, cardinality: int) -> Column:
    """Squared lower bound under time warping: as sax_mindist, of the envelope's segment extremes against the cells. Against many words, make
    ``envelope_means`` once a series."""
    return interval_gap(*envelope_means(env, segments, length), *cell_borders(word, cardinality), segments, length)


def eapca_lower(a: Column, b: Column, lengths: list[int]) -> Column:
    """Squared lower bound from the segment statistics of two series."""
    s = lambda c, i, f: F.get(c, F.lit(i))[f]
    return _sum([F.lit(float(n)) * (_square(s(a, i, "mean") - s(b, i, "mean")) + _square(s(a, i, "sd") - s(b, i, "sd"))) for i, n in enumerate(lengths)])


def eapca_upper(a: Column, b: Column, lengths: list[int]) -> Column:
    """Squared upper bound from the segment statistics of two series."""
    s = lambda c, i, f: F.get(c, F.lit(i))[f]
    return _sum([F.lit(float(n)) * (_square(s(a, i, "mean") - s(b, i, "mean")) + _square(s(a, i, "sd") + s(b, i, "sd"))) for i, n in enumerate(lengths)])


def dft_lower(a: Column, b: Column) -> Column:
    """Squared lower bound from Fourier coefficients without frequency 0 of real series: each stands for its mirror too."""
    return F.lit(2.0) * squared_distance(a, b)


def node_lower(q: Column, node: Column, lengths: list[int]) -> Column:
    """Squared lower bound of the distance from q to any series in a node; node: array<struct<max_mean, min_mean, max_sd, min_sd>>."""
    terms = []
    for i, n in enumerate(lengths):
        s, e = F.get(q, F.lit(i)), F.get(node, F.lit(i))
        m = F.greatest(e["min_mean"] - s["mean"], s["mean"] - e["max_mean"], F.lit(0.0))
        d = F.greatest(e["min_sd"] - s["sd"], s["sd"] - e["max_sd"], F.lit(0.0))
        terms.append(F.lit(float(n)) * (_square(m) + _square(d)))
    return _sum(terms)


def node_upper(q: Column, node: Column, lengths: list[int]) -> Column:
    """Squared upper bound of the distance from q to any series in a node."""
    terms = []
    for i, n in enumerate(lengths):
        s, e = F.get(q, F.lit(i)), F.get(node, F.lit(i))
        far = F.greatest(F.abs(s["mean"] - e["min_mean"]), F.abs(s["mean"] - e["max_mean"]))
        terms.append(F.lit(float(n)) * (_square(s["sd"] + e["max_sd"]) + _square(far)))
    return _sum(terms)


def node_qos(node: Column, lengths: list[int]) -> Column:
    """How loose a node's sketch is: sum of length * (range of means squared + largest sd squared)."""
    e = lambda i: F.get(node, F.lit(i))
    return _sum([F.lit(float(n)) * (_square(e(i)["max_mean"] - e(i)["min_mean"]) + _square(e(i)["max_sd"])) for i, n in enumerate(lengths)])


def node_sketch(stats: Column, segments: int) -> Column:
    """Aggregate: the sketch of all series of a group from their segment statistics."""
    return F.array(*[F.struct(F.max(F.get(stats, F.lit(i))["mean"]).alias("max_mean"), F.min(F.get(stats, F.lit(i))["mean"]).alias("min_mean"), F.max(F.get(stats, F.lit(i))["sd"]).alias("max_sd"), F.min(F.get(stats, F.lit(i))["sd"]).alias("min_sd")) for i in range(segments)])
