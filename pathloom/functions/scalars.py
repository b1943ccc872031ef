"""Scalar expressions of the estimators and planners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softplus(x: Column) -> Column:
    """log(1 + e**x) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def step_cost(p: Column, var: Column, t_base: Column, t_penalty: float, risk: float) -> Column:
    """Expected time of a step: its base, the penalty of failing, and the risk-weighted variance."""
    return t_base + (1 - p) * t_penalty + risk * F.coalesce(var, F.lit(0.0))


def prereq_ratio(mastered: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(mastered / total)


def tie_break_score(ratio: Column, node: Column) -> Column:
    """The fallback's score: the ratio, then the smaller node."""
    return ratio + 1e-6 / (node + 1)


# Mastery states: arrays of 64-bit words with a bit for each node.
WORD = 64


def n_words(n_nodes: int) -> int:
    return max(1, -(-n_nodes // WORD))


def _bit(idx: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (idx % WORD).cast("int"))


def _in_word(idx: Column, w: int) -> Column:
    return F.when(F.floor(idx / WORD) == w, _bit(idx))


def no_bits(words: int) -> Column:
    return F.array(*[F.lit(0).cast("long")] * words)


def one_bit(idx: Column, words: int) -> Column:
    return F.array(*[F.coalesce(_in_word(idx, w), F.lit(0).cast("long")) for w in range(words)])


def collect_bits(idx: Column, words: int, over=None) -> Column:
    """The bits of a group's (or window's) idx; null ones are passed over."""
    each = [F.bit_or(_in_word(idx, w)) for w in range(words)]
    return F.array(*[F.coalesce(c.over(over) if over is not None else c, F.lit(0).cast("long")) for c in each])


def has_bit(state: Column, idx: Column) -> Column:
    return F.get(state, F.floor(idx / WORD).cast("int")).bitwiseAND(_bit(idx)) != 0


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def contains(state: Column, needed: Column) -> Column:
    """All bits of ``needed`` are in ``state``."""
    return F.forall(F.zip_with(state, needed, lambda s, n: s.bitwiseAND(n) == n), lambda ok: ok)


def bits_of(state: Column) -> Column:
    """The idx of the bits, ascending."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(WORD - 1).cast("long"))
    return F.flatten(F.transform(state, lambda x, w: F.transform(F.filter(places, lambda b: x.bitwiseAND(_bit(b)) != 0), lambda b: b + w * WORD)))
