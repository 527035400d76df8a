"""Model replies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(reply: Column) -> Column:
    """The body of a reply: between code fences if it starts with one, without leading letters of `json`."""
    text = F.trim(reply)
    inner = F.get(F.split(text, "```"), F.lit(1))
    return F.trim(F.when(text.startswith("```"), F.ltrim(inner, F.lit("json"))).otherwise(text))


def ratings(reply: Column, names: tuple[str, ...] = ("emotion", "memorability")) -> Column:
    """Struct of the named numbers over 10 within 0..1, null where absent; quoted numbers count."""
    parsed = F.from_json(unfenced(reply), ", ".join(f"{n} STRING" for n in names))
    value = lambda n: parsed[n].try_cast("double") / 10
    return F.struct(*[F.when(value(n).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value(n)))).alias(n) for n in names])


def rank_list(reply: Column, length: Column) -> Column:
    """Array of ranks if the reply is a list of the expected length, else null."""
    ranks = F.from_json(unfenced(reply), "array<int>")
    return F.when(F.size(ranks) == length, ranks)
