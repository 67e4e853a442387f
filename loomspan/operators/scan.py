"""Linear recurrences along a series, block by block.

A recurrence ``s' = m s + n e`` with a constant matrix is a chain of affine maps, and such maps compose. So a series is cut into blocks of
``BLOCK`` places, and each block tells how many rows it has and what it makes of a start at zero; blocks are composed in groups of ``BLOCK``,
groups by key, and the starts that follow go back down: key to group, group to block, block to rows. No task holds more than a block,
a group's blocks, or a key's groups (one for 65,536 places), so one key of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def _add(*terms: str) -> str:
    return " + ".join(terms)


def _moved(state: str, k: int, m: Sequence[str]) -> list[str]:
    """m times the state of channel ``k``, m given as four expressions."""
    return [f"{m[0]} * {state}.p{k} + {m[1]} * {state}.v{k}", f"{m[2]} * {state}.p{k} + {m[3]} * {state}.v{k}"]


def _struct(values: list[tuple[str, str]]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {v}" for name, v in values) + ")"


def linear(rows: DataFrame, keys: list[str], order: str, channels: list[str], m: np.ndarray, n: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``rows`` with each of ``channels`` replaced by the first part of its state after the row. The state of a channel has two parts and
    starts, before a key's first row, as (the channel's first value, 0); ``m``: 2 by 2, ``n``: of length 2. order: whole numbers,
    each once in a key."""
    c = range(len(channels))
    fixed = [f"{float(x)!r}D" for x in m.ravel()]
    push = [f"{float(x)!r}D" for x in n]
    power = [np.linalg.matrix_power(m, k).ravel() for k in range(block + 1)]
    powers = "array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in p) + ")" for p in power) + ")"
    names = [f"{s}{k}" for k in c for s in "pv"]
    zero = _struct([(s, "0.0D") for s in names])
    step = _struct([(f"{s}{k}", _add(_moved("s", k, fixed)[i], f"{push[i]} * e.{channels[k]}")) for k in c for i, s in enumerate("pv")])
    rest = [x for x in rows.columns if x not in (*keys, order, *channels)]

    b = rows.withColumn("_b", F.floor(F.col(order) / block)).groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *channels, *rest))).alias("_a"))
    # what a block makes of a start at zero
    told = b.select(*keys, "_b", F.size("_a").alias("n"), F.struct(*[F.col("_a")[0][x].alias(x) for x in channels]).alias("first"), F.expr(f"aggregate(_a, {zero}, (s, e) -> {step})").alias("z"))
    g = told.withColumn("_g", F.floor(F.col("_b") / block)).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct("_b", "n", "first", "z"))).alias("_bs"))
    at = [f"element_at(_pw, e.n + 1)[{i}]" for i in range(4)]
    through = [(f"{s}{k}", f"{_moved('s', k, at)[i]} + e.z.{s}{k}") for k in c for i, s in enumerate("pv")]
    # a group's map: its matrix, and what it makes of a start at zero
    product = [(f"m{2 * r + j}", f"{at[2 * r]} * s.m{j} + {at[2 * r + 1]} * s.m{2 + j}") for r in range(2) for j in range(2)]
    unit = [("m0", "1.0D"), ("m1", "0.0D"), ("m2", "0.0D"), ("m3", "1.0D")]
    g = g.withColumn("_pw", F.expr(powers)).withColumn("_t", F.expr(f"aggregate(_bs, {_struct([*unit, *[(s, '0.0D') for s in names]])}, (s, e) -> {_struct([*product, *through])})")).drop("_pw")
    whole = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_g", F.col("_bs")[0]["first"].alias("first"), "_t"))).alias("_gs"))
    begin = _struct([(f"{s}{k}", f"{{0}}[0].first.{channels[k]}" if s == "p" else "0.0D") for k in c for s in "pv"])
    fields = ",".join(f"{s}:double" for s in names)

    def starts(items: str, first: str, move: str) -> str:
        """The states before each of ``items``."""
        empty = f"cast(array() as array<struct<{fields}>>)"
        return f"aggregate({items}, named_struct('s', {first}, 'out', {empty}), (t, e) -> named_struct('s', transform(array(t.s), s -> {move})[0], 'out', array_append(t.out, t.s)), t -> t.out)"

    group_move = _struct([(f"{s}{k}", f"{_moved('s', k, [f'e._t.m{j}' for j in range(4)])[i]} + e._t.{s}{k}") for k in c for i, s in enumerate("pv")])
    down = whole.select(*keys, F.explode(F.arrays_zip(F.expr("transform(_gs, e -> e._g)").alias("_g"), F.expr(starts("_gs", begin.format("_gs"), group_move)).alias("s"))).alias("_x"))
    down = down.select(*keys, F.col("_x._g").alias("_g"), F.col("_x.s").alias("_s"))
    mid = g.select(*keys, "_g", "_bs").join(down, [*keys, "_g"]).withColumn("_pw", F.expr(powers))
    mid = mid.select(*keys, F.explode(F.arrays_zip(F.expr("transform(_bs, e -> e._b)").alias("_b"), F.expr(starts("_bs", "_s", _struct(through))).alias("s"))).alias("_x"))
    mid = mid.select(*keys, F.col("_x._b").alias("_b"), F.col("_x.s").alias("_s"))
    last = b.join(mid, [*keys, "_b"])
    after = f"aggregate(_a, named_struct('s', _s, 'out', cast(array() as array<struct<{fields}>>)), (t, e) -> transform(array(transform(array(t.s), s -> {step})[0]), s -> named_struct('s', s, 'out', array_append(t.out, s)))[0], t -> t.out)"
    out = last.select(*keys, F.explode(F.arrays_zip(F.col("_a"), F.expr(after).alias("_m"))).alias("_x"))
    value = {x: F.col(f"_x._m.p{k}").alias(x) for k, x in enumerate(channels)}
    return out.select(*[x if x in keys else F.col("_x._a._o").alias(x) if x == order else value.get(x, F.col(f"_x._a.{x}").alias(x)) for x in rows.columns])
