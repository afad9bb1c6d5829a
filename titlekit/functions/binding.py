"""Evaluate an expression once where a lambda uses it for every element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(function: Callable[..., Column], *columns) -> Column:
    """``function(*columns)`` with the columns computed once per row.

    A lambda evaluates the expressions it mentions for every element, and the optimizer may have merged a whole
    tokenizer into such an expression. Handing the values in as lambda variables keeps the work linear.
    """
    named = [part for i, c in enumerate(columns) for part in (F.lit(f"v{i}"), F.col(c) if isinstance(c, str) else c)]
    places = range(len(columns))
    once = F.transform(F.array(F.named_struct(*named)), lambda s: function(*[s[f"v{i}"] for i in places]))
    return F.get(once, 0)
