"""Array expressions whose cost is linear, or nearly, in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are put together before they join the others.
BLOCK = 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def walk(items: Column, zero: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """An array (of this type) of emit(state, item) for each item, the state going from zero through step(state, item)."""
    none = F.array().cast(kind)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))

    def inner(state: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(state.alias("s"), none.alias("o")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["o"], F.array(emit(a["s"], x))).alias("o")))

    return F.aggregate(
        blocks,
        F.struct(zero.alias("s"), F.array().cast(f"array<{kind}>").alias("o")),
        lambda a, block: let(inner(a["s"], block), lambda v: F.struct(v["s"].alias("s"), F.concat(a["o"], F.array(v["o"])).alias("o"))),
        lambda a: F.flatten(a["o"]),
    )
