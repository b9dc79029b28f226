"""Vectors and logits as arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clip_score(a: Column, b: Column, weight: float = 2.5) -> Column:
    return weight * F.greatest(cosine(a, b), F.lit(0.0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though lambdas inside refer to it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_sum_exp(v: Column) -> Column:
    return once(F.array_max(doubles(v)), lambda top: top + F.ln(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """label counts from 0."""
    return log_sum_exp(logits) - F.get(doubles(logits), label)


def soft_capped(v: Column, cap: float = 30.0) -> Column:
    return F.transform(doubles(v), lambda x: cap * F.tanh(x / cap))


def rms_normalised(v: Column, epsilon: float = 1e-6) -> Column:
    return once(F.sqrt(dot(v, v) / F.size(v) + epsilon), lambda size: F.transform(doubles(v), lambda x: x / size))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean over places where mask is 1; null without any."""
    total = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.aggregate(mask, F.lit(0.0), lambda s, m: s + m))


def sinusoid(position: Column, dim: int) -> Column:
    """Sinusoidal encoding: sines of the first half's frequencies, then cosines."""
    half = dim // 2
    angle = lambda i: position / F.pow(F.lit(10000.0), i / half)
    places = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(places, lambda i: F.sin(angle(i))), F.transform(places, lambda i: F.cos(angle(i))))


def perplexity(losses: Column, mask: Column) -> Column:
    """Of a padded sequence: the exponential of the mean loss where the mask is 1; null where it is nowhere."""
    return F.exp(masked_mean(losses, mask))


def perplexity_after(losses: Column, prompt: Column) -> Column:
    """Of what follows a prompt of so many tokens, all of which count: losses[i] is that of token i + 1."""
    rest = F.slice(losses, prompt.cast("int") + 1, F.greatest(F.size(losses) - prompt.cast("int"), F.lit(0)))
    return F.when(F.size(rest) > 0, F.exp(F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)))


def _summed(rows: Column, dim: Column) -> Column:
    """Sum of the vectors of an array, place by place."""
    return F.aggregate(rows, F.transform(F.sequence(F.lit(1), dim), lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def mean_vector(rows: Column) -> Column:
    """Mean of the vectors of a non-empty array, else null."""
    n = F.size(rows)
    return F.when(n > 0, F.transform(_summed(rows, F.size(F.get(rows, F.lit(0)))), lambda x: x / n))


def pooled_features(frames: Column, how: tuple[str, ...]) -> Column:
    """Vectors of an image or a film, array of frames of positions of doubles, pooled and put one after the other in the
    order of how: spatial (a frame's mean, for each frame), temporal (a position's mean over frames, for each
    position), last (the last frame's positions). Frames have equally many positions."""
    known = {"spatial", "temporal", "last"}
    if not how or set(how) - known:
        raise ValueError(f"pooling is one of {sorted(known)}, not {how}")
    positions = F.size(F.get(frames, F.lit(0)))
    parts = {
        "spatial": lambda: F.transform(frames, mean_vector),
        "temporal": lambda: F.transform(F.sequence(F.lit(0), positions - 1), lambda p: mean_vector(F.transform(frames, lambda f: F.get(f, p)))),
        "last": lambda: F.element_at(frames, -1),
    }
    return F.concat(*(parts[h]() for h in how))


def merged_sequence(first: Column, first_mask: Column, second: Column, second_mask: Column) -> Column:
    """struct<values, mask> of an image's vectors before a text's, with their masks."""
    return F.struct(F.concat(first, second).alias("values"), F.concat(first_mask, second_mask).alias("mask"))


def softmax(v: Column) -> Column:
    """Shares of the exponentials; null components share nothing."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    return once(e, lambda w: once(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(w, lambda x: x / total)))


def rotated(v: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary position: component i of the first half and its partner in the second half are turned by the angle
    position / base^(i / half); v has an even number of components."""
    half = (F.size(v) / 2).cast("int")

    def angle(i: Column) -> Column:
        return position / F.pow(F.lit(base), F.pmod(i, half) / half)

    return F.transform(v, lambda x, i: F.when(i < half, x * F.cos(angle(i)) - F.get(v, i + half) * F.sin(angle(i))).otherwise(x * F.cos(angle(i)) + F.get(v, i - half) * F.sin(angle(i))))
