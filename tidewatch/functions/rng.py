"""Deterministic uniforms as column expressions: functions of an id and a salt, so recomputed rows never change."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers and increment of the mixer; all products stay below 2^63 in any SQL engine.
A, B, C, M1, M2, M = 1103515245, 1640531527, 12345, 2146121005, 73244475, 1 << 32


def uniform(ident: Column, salt: int | Column) -> Column:
    """[0, 1): id and salt mixed by two rounds of shift, exclusive or and multiplication, exact in any SQL engine.

    The rounds are not linear, so draws of one id under different salts are independent.
    """
    first = F.lit((salt + 1) * B + C) if isinstance(salt, int) else (salt + 1) * B + C
    x = ((ident % M) * A + first) % M
    for by, times in ((16, M1), (15, M2)):
        x = (x.bitwiseXOR(F.shiftright(x, by)) * times) % M
    return x.cast("double") / F.lit(float(M))


def uniform_array(ident: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The same in numpy, for ids and salts that are not negative."""
    x = (ident.astype(np.uint64) % np.uint64(M)) * np.uint64(A) + (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(B) + np.uint64(C)
    x &= np.uint64(M - 1)
    for by, times in ((16, M1), (15, M2)):
        x ^= x >> np.uint64(by)
        x *= np.uint64(times)
        x &= np.uint64(M - 1)
    return x.astype(np.float64) / float(M)


def uniform_sql(ident: str, salt: int | str) -> str:
    """The same as SQL text."""
    first = (salt + 1) * B + C if isinstance(salt, int) else f"(({salt}) + 1) * {B} + {C}"
    x = f"(((({ident}) % {M}) * {A} + {first}) % {M})"
    for by, times in ((16, M1), (15, M2)):
        x = f"((xor({x}, ({x} >> {by})) * {times}) % {M})"
    return f"({x} / {M}.0)"


def normal(ident: Column, salt: int) -> Column:
    """Standard normal by Box and Muller from two uniforms."""
    u, v = uniform(ident, salt), uniform(ident, salt + 7919)
    return F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(1.0 / M)))) * F.cos(2.0 * F.pi() * v)


def normal_sql(ident: str, salt: int) -> str:
    """The same as SQL text."""
    u, v = uniform_sql(ident, salt), uniform_sql(ident, salt + 7919)
    return f"(sqrt(-2.0 * ln(greatest({u}, 1.0 / {M}))) * cos(2.0 * pi() * {v}))"


def poisson_most(mean: float) -> int:
    """The least count whose upper tail is below the generator's resolution."""
    term = total = math.exp(-mean)
    k = 0
    while 1 - total > 1 / M and k < 10_000:
        k += 1
        term *= mean / k
        total += term
    return k


def poisson(u: Column, mean: Column, most: float) -> Column:
    """Poisson count by inversion of a uniform; `most` is the greatest value that the mean takes."""
    step = lambda a, k: F.struct((a["term"] * mean / k).alias("term"), (a["total"] + a["term"] * mean / k).alias("total"), (a["n"] + (u >= a["total"]).cast("int")).alias("n"))
    none = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, poisson_most(most)))), none, step, lambda a: a["n"])


def poisson_sql(u: str, mean: str, most: float) -> str:
    """The same as SQL text: a list of the sums of the terms, and how many of them u reaches."""
    terms = [f"exp(-({mean}))"]
    for k in range(1, poisson_most(most)):
        terms.append(f"{terms[0]} * pow({mean}, {k}) / {math.factorial(k)}.0")
    return "(" + " + ".join(f"({u} >= {' + '.join(terms[: k + 1])})::INT" for k in range(len(terms))) + ")"
