"""Window functions over records; the frame is always the whole partition."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import Scalars
from tallyhouse.refusal import Refused
from tallyhouse.sql.nodes import Call, Lit, Star


def whole(e: Any, least: int) -> int:
    if not isinstance(e, Lit) or not isinstance(e.value, int) or e.value < least:
        raise Refused("sql_window_shape", "a whole number expected")
    return e.value


def window_column(call: Call, scalars: Scalars, id_column: str | None) -> Column:
    """call OVER its window: partitions, then the order with absent values last, then the record id where ties would leave a choice."""
    name, args, over = call.name, call.args, call.over
    parts = [scalars.column(p) for p in over.partition]
    keys = [scalars.column(e).desc_nulls_last() if down else scalars.column(e).asc_nulls_last() for e, down in over.order]
    base = Window.partitionBy(*parts)
    peers = base.orderBy(*keys) if keys else base
    ordered = base.orderBy(*keys, *([F.col(id_column)] if id_column else [])) if keys else base
    entire = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if name in ("rank", "dense_rank", "percent_rank", "cume_dist"):
        return getattr(F, name)().over(peers)
    if name == "row_number":
        return F.row_number().over(ordered)
    if name == "ntile":
        return F.ntile(whole(args[0], 1) if args else 0).over(ordered)
    if name == "count":
        return (F.count(F.lit(1)) if not args or isinstance(args[0], Star) else F.count(scalars.column(args[0]))).over(base)
    if not args or isinstance(args[0], Star):
        raise Refused("sql_window_shape", f"{name} of a column")
    x = scalars.column(args[0])
    if name in ("lag", "lead"):
        n = whole(args[1], 0) if len(args) > 1 else 1
        return x if n == 0 else getattr(F, name)(x, n).over(ordered)
    if name == "first_value":
        return F.first(x).over(entire)
    if name == "last_value":
        return F.last(x).over(entire)
    if name == "nth_value":
        if len(args) < 2:
            raise Refused("bad_arity", "nth_value")
        return F.nth_value(x, whole(args[1], 1)).over(entire)
    if name in ("runningdifference", "running_difference"):
        return x - F.lag(x, 1).over(ordered)
    if name in ("sum", "avg", "min", "max"):
        return getattr(F, name)(x).over(base)
    raise Refused("sql_window_shape", name)
