"""Look-ups in short sorted lists that a plan carries as constants."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def constant_array(values: list[int | None]) -> Column:
    """An array<bigint> constant; Spark folds the parsing away."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def points_below(value: Column, points: list[int], closed: bool) -> Column:
    """How many of the ascending ``points`` are below ``value`` (``closed``: or equal to it), by bisection."""
    ends = constant_array(points)

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        point = F.get(ends, mid)
        below = (point <= value) if closed else (point < value)
        up = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        down = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(below, up).otherwise(down)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), len(points).bit_length()), start, step)["lo"]
