"""Decay, reinforcement, importance, learning multipliers, vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import CONFIG, Config


def half_life(memory_type: Column, c: Config = CONFIG) -> Column:
    return F.when(memory_type == "episodic", c.half_life_episodic).when(memory_type == "procedural", c.half_life_procedural).otherwise(c.half_life_semantic)


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def effective_age(age: Column, accesses: Column, c: Config = CONFIG) -> Column:
    return F.greatest(F.lit(0.0), age) / (1.0 + c.access_damping * F.log(1.0 + accesses))


def decay(age: Column, accesses: Column, memory_type: Column, c: Config = CONFIG) -> Column:
    return F.greatest(F.lit(c.decay_floor), F.exp(-F.log(F.lit(2.0)) * effective_age(age, accesses, c) / half_life(memory_type, c)))


def reinforcement(accesses: Column, c: Config = CONFIG) -> Column:
    return F.least(c.reinforcement * F.log(1.0 + accesses), F.lit(c.reinforcement_cap))


def decayed(score: Column, age: Column, accesses: Column, memory_type: Column, c: Config = CONFIG) -> Column:
    return score * decay(age, accesses, memory_type, c) * (1.0 + reinforcement(accesses, c))


def importance_boost(importance: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.25), F.least(F.lit(4.0), importance)))


def importance_normal(importance: Column) -> Column:
    finite = F.when(F.isnan(importance) | importance.isNull() | (F.abs(importance) == float("inf")), 1.0).otherwise(importance)
    return F.greatest(F.lit(0.1), F.least(F.lit(5.0), finite))


def learning_score(score: Column, status: Column, in_scope: Column, confidence: Column, importance: Column) -> Column:
    """Score times multipliers for status, scope, confidence and importance."""
    clamp = lambda x: F.greatest(F.lit(0.5), F.least(F.lit(2.0), x))
    by_status = F.when(status == "rule", 1.3).when(status == "confirmed", 1.1).when(status == "candidate", 0.9).otherwise(0.5)
    return score * by_status * F.when(in_scope, 1.2).otherwise(1.0) * clamp(0.5 + confidence) * clamp(0.5 + 1.5 * importance / 5.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def truncated(a: Column, dim: int) -> Column:
    """The first ``dim`` values at unit length."""
    cut = F.slice(a, 1, dim)
    return F.transform(cut, lambda x: x.cast("double") / norm(cut))


def channels(vector: Column, lexical: Column, graph: Column) -> Column:
    named = F.array(*[F.when(F.coalesce(c, F.lit(0.0)) > 0, F.lit(n)) for n, c in (("vector", vector), ("bm25", lexical), ("ppr", graph))])
    return F.filter(named, lambda x: x.isNotNull())
