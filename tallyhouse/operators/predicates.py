"""Conditions as Spark columns under two-valued logic: a comparison with an absent value is false, and NOT is the complement.

In positive places leaves stay bare, so that Catalyst pushes them to the scan; under NOT each leaf is
made true or false first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.kinds import NUMERIC, Field, digits_after_point, parse_date, parse_stamp
from tallyhouse.functions.scalars import SUB_DAY, unit_of
from tallyhouse.refusal import Refused
from tallyhouse.sql.nodes import Between, Bin, Call, Col, InList, InSelect, Like, Lit, Now, Sampled, Segment, Un

FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
MAX_IDS = 4096


def compared(c: Column, op: str, v: Any) -> Column:
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def in_days(key: str, low: dt.date | None, high: dt.date | None) -> Callable[[Column], Column]:
    """Whether a pair of key and time has the key and lies in whole days."""

    def test(pair: Column) -> Column:
        out = pair["key"] == key
        if low is not None:
            out = out & (pair["at"].cast("date") >= F.lit(low))
        if high is not None:
            out = out & (pair["at"].cast("date") <= F.lit(high))
        return out

    return test


def conjuncts(e: Any) -> list[Any]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Bin) and e.op == "and" else [e]


class Predicates:
    """resolve: Col -> (column, Field); segment: view -> its condition; member: (field's column, InSelect) -> a column that is true for members; within_days: (time quantum, key, first and last day) -> a column that is true for records that have the key on one of these days, or None."""

    def __init__(self, resolve: Callable[[Col], tuple[Column, Field]], segment: Callable[[str], Any] | None = None, member: Callable[[Column, InSelect], Column] | None = None, within_days: Callable[[Field, str, dt.date | None, dt.date | None], Column | None] | None = None):
        self.resolve, self.segment, self.member, self.within_days = resolve, segment, member, within_days

    def holds(self, e: Any) -> Column:
        """Null or false where the condition doesn't hold."""
        if isinstance(e, Bin) and e.op == "and":
            return self.all_of(conjuncts(e))
        if isinstance(e, Bin) and e.op == "or":
            return self.holds(e.left) | self.holds(e.right)
        if isinstance(e, Un) and e.op == "not":
            return ~self.sure(e.of)
        return self.leaf(e)

    def sure(self, e: Any) -> Column:
        """True or false, never null."""
        if isinstance(e, Bin) and e.op in ("and", "or"):
            if e.op == "and" and (window := self.windows(conjuncts(e))) is not None:
                own, rest = window
                out = F.coalesce(own, F.lit(False))
                for x in rest:
                    out = out & self.sure(x)
                return out
            a, b = self.sure(e.left), self.sure(e.right)
            return a & b if e.op == "and" else a | b
        if isinstance(e, Un) and e.op == "not":
            return ~self.sure(e.of)
        return F.coalesce(self.leaf(e), F.lit(False))

    def all_of(self, terms: list[Any]) -> Column:
        window = self.windows(terms)
        out = None
        if window is not None:
            out, terms = window
        for t in terms:
            own = self.holds(t)
            out = own if out is None else out & own
        return out

    # --- leaves
    def leaf(self, e: Any) -> Column:
        if isinstance(e, Col):
            c, f = self.resolve(e)
            if f.kind != "bool":
                raise Refused("operator_not_allowed", f"{e.name} is no condition")
            return c
        if isinstance(e, Lit) and isinstance(e.value, bool):
            return F.lit(e.value)
        if isinstance(e, Bin) and e.op in FLIPPED:
            if isinstance(e.left, Lit) and not isinstance(e.right, Lit):
                return self.leaf(Bin(FLIPPED[e.op], e.right, e.left))
            if isinstance(e.left, Call):
                return self.rounded(e.left, e.op, e.right)
            if isinstance(e.left, Col) and isinstance(e.right, (Lit, Now)):
                c, f = self.resolve(e.left)
                return self.compare(c, f, e.op, e.right)
            raise Refused("sql_unsupported", "a column against a value")
        if isinstance(e, InList):
            c, f = self.column(e.of)
            out = None
            for v in e.values:
                own = self.compare(c, f, "=", Lit(v))
                out = own if out is None else out | own
            return out
        if isinstance(e, Between):
            if isinstance(e.of, Call):
                return self.rounded(e.of, ">=", e.low) & self.rounded(e.of, "<=", e.high)
            c, f = self.column(e.of)
            return self.compare(c, f, ">=", e.low) & self.compare(c, f, "<=", e.high)
        if isinstance(e, Like):
            c, f = self.column(e.of)
            if not f.keyed:
                raise Refused("operator_not_allowed", f"LIKE on {f.name}")
            test = lambda x: x.ilike(e.pattern) if e.any_case else x.like(e.pattern)
            if f.kind == "timequantum":
                return F.exists(c, lambda x: test(x["key"]))
            return F.exists(c, test) if f.multiple else test(c)
        if isinstance(e, Segment):
            if self.segment is None:
                raise Refused("sql_segment_unexpanded", e.view)
            return self.holds(self.segment(e.view))
        if isinstance(e, Sampled):
            return F.pmod(self.resolve(Col("_record_id"))[0], F.lit(e.n)) == 0
        if isinstance(e, InSelect):
            if self.member is None:
                raise Refused("sql_unsupported", "no subquery here")
            c, f = self.column(e.of)
            if f.kind not in ("int", "signed"):
                raise Refused("operator_not_allowed", f"{f.name} holds no record ids")
            return self.member(c, e)
        if isinstance(e, Call):
            raise Refused("sql_scalar_in_filter", e.name)
        raise Refused("sql_unsupported", type(e).__name__)

    def column(self, e: Any) -> tuple[Column, Field]:
        if isinstance(e, Call):
            raise Refused("sql_scalar_in_filter", e.name)
        if not isinstance(e, Col):
            raise Refused("sql_unsupported", "a column expected")
        return self.resolve(e)

    def compare(self, c: Column, f: Field, op: str, right: Any) -> Column:
        if isinstance(right, Now):
            if not f.temporal:
                raise Refused("bad_argument", f"{f.name} and a time")
            v = F.date_trunc("second", F.current_timestamp())
            return compared(c, op, v.cast("date") if f.kind == "date" else v)
        v = right.value if isinstance(right, Lit) else None
        if f.keyed:
            if op != "=" or not isinstance(v, str):
                raise Refused("operator_not_allowed", f"{f.name} {op}")
            if f.kind == "timequantum":
                return F.exists(c, lambda x: x["key"] == v)
            return F.array_contains(c, v) if f.multiple else c == v
        if f.kind == "bool":
            if op != "=" or not isinstance(v, bool):
                raise Refused("operator_not_allowed", f"{f.name} {op}")
            return compared(c, op, F.lit(v))
        if f.temporal:
            if not isinstance(v, str):
                raise Refused("bad_argument", f"{f.name} and a date")
            return compared(c, op, F.lit(parse_date(v) if f.kind == "date" else parse_stamp(v)))
        if f.kind not in NUMERIC or isinstance(v, (bool, str)) or v is None:
            raise Refused("bad_argument", f"{f.name} and a number")
        return self.number(c, f, op, v)

    @staticmethod
    def number(c: Column, f: Field, op: str, v: Any) -> Column:
        if f.kind in ("float32", "float64"):
            return compared(c.cast("double"), op, F.lit(float(v)))
        if f.kind == "decimal":
            if digits_after_point(v) > f.scale:
                raise Refused("too_precise", f"{f.name} has {f.scale} places")
            return compared(c, op, F.lit(Decimal(v)))
        if v != int(v):
            raise Refused("too_precise", f"{f.name} is whole")
        v = int(v)
        return compared(c, op, F.lit(v if -(2**63) <= v < 2**63 else Decimal(v)))

    # --- windows of time-quantum keys
    def windows(self, terms: list[Any]) -> tuple[Column, list[Any]] | None:
        """A key and bounds in seconds on one time-quantum column become one test: whole UTC days, both ends included."""
        keys: dict[Col, str] = {}
        bounds: dict[Col, list[tuple[str, int]]] = {}
        rest = []
        for t in terms:
            if isinstance(t, Bin) and t.op in FLIPPED and isinstance(t.left, Col) and isinstance(t.right, Lit) and self.resolve(t.left)[1].kind == "timequantum":
                if t.op == "=" and isinstance(t.right.value, str):
                    keys[t.left] = t.right.value
                    continue
                if t.op in ("<", "<=", ">", ">=") and isinstance(t.right.value, int):
                    bounds.setdefault(t.left, []).append((t.op[0], t.right.value))
                    continue
            if isinstance(t, Between) and isinstance(t.of, Col) and isinstance(t.low, Lit) and isinstance(t.low.value, int) and isinstance(t.high, Lit) and self.resolve(t.of)[1].kind == "timequantum":
                bounds.setdefault(t.of, []).extend([(">", t.low.value), ("<", t.high.value)])
                continue
            rest.append(t)
        if not bounds:
            return None
        if set(bounds) - set(keys):
            raise Refused("operator_not_allowed", "bounds need a key")
        day = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc).date()
        out = None
        for col, key in keys.items():
            if col not in bounds:
                rest.append(Bin("=", col, Lit(key)))
                continue
            c, f = self.resolve(col)
            low = max((day(s) for op, s in bounds[col] if op == ">"), default=None)
            high = min((day(s) for op, s in bounds[col] if op == "<"), default=None)

            own = self.within_days(f, key, low, high) if self.within_days else None
            if own is None:
                own = F.exists(c, in_days(key, low, high))
            out = own if out is None else out & own
        return out, rest

    # --- roundings, as ranges of the bare column
    def rounded(self, call: Call, op: str, right: Any) -> Column:
        name = call.name.lower()
        if name in ("round", "floor", "ceil", "ceiling"):
            return self.grid(call, name, op, right)
        if name in ("date_trunc", "datetrunc", "todate", "toyear"):
            return self.calendar(call, name, op, right)
        raise Refused("sql_scalar_in_filter", call.name)

    def grid(self, call: Call, name: str, op: str, right: Any) -> Column:
        c, f = self.column(call.args[0])
        v = right.value if isinstance(right, Lit) else None
        if f.kind not in NUMERIC or isinstance(v, (bool, str)) or v is None:
            raise Refused("bad_rounding", f"{name} of {f.name}")
        places = call.args[1].value if len(call.args) > 1 and isinstance(call.args[1], Lit) else 0
        if len(call.args) > 2 or not isinstance(places, int) or (name != "round" and len(call.args) > 1):
            raise Refused("bad_rounding", name)
        step, v = Decimal(10) ** -places, Decimal(v)
        on_grid = (v / step) == (v / step).to_integral_value()
        if op in ("=", "!=") and not on_grid:
            raise Refused("sql_rounded_value", f"{v} is no rounded value")
        if name == "round":
            # half goes away from zero, so values of the cell of v reach from v - step / 2 to v + step / 2, with the end that is nearer to zero
            return self.cell(c, f, op, v, step)
        down = (v / step).to_integral_value(ROUND_FLOOR) * step
        up = (v / step).to_integral_value(ROUND_CEILING) * step
        wide = c.cast("double") if f.kind.startswith("float") else c
        lit = lambda x: F.lit(float(x)) if f.kind.startswith("float") else F.lit(x)
        if name == "floor":
            tests = {"=": (wide >= lit(v)) & (wide < lit(v + 1)), "!=": (wide < lit(v)) | (wide >= lit(v + 1)), ">=": wide >= lit(up), ">": wide >= lit(down + 1), "<": wide < lit(up), "<=": wide < lit(down + 1)}
        else:
            tests = {"=": (wide > lit(v - 1)) & (wide <= lit(v)), "!=": (wide <= lit(v - 1)) | (wide > lit(v)), ">": wide > lit(down), ">=": wide > lit(up - 1), "<=": wide <= lit(down), "<": wide <= lit(up - 1)}
        return tests[op]

    @staticmethod
    def cell(c: Column, f: Field, op: str, v: Decimal, step: Decimal) -> Column:
        wide = c.cast("double") if f.kind.startswith("float") else c
        lit = lambda x: F.lit(float(x)) if f.kind.startswith("float") else F.lit(x)
        half = step / 2

        def above(g: Decimal) -> Column:
            """round(c) >= g for a value g of the grid."""
            return wide >= lit(g - half) if g > 0 else wide > lit(g - half)

        floor = (v / step).to_integral_value(ROUND_FLOOR) * step
        ceiling = (v / step).to_integral_value(ROUND_CEILING) * step
        if op == ">=":
            return above(ceiling)
        if op == ">":
            return above(floor + step)
        if op == "<":
            return ~above(ceiling)
        if op == "<=":
            return ~above(floor + step)
        inside = above(v) & ~above(v + step)
        return inside if op == "=" else ~inside

    def calendar(self, call: Call, name: str, op: str, right: Any) -> Column:
        c, f = self.column(call.args[-1])
        if not f.temporal:
            raise Refused("bad_rounding", f"{name} of {f.name}")
        v = right.value if isinstance(right, Lit) else None
        if name == "toyear":
            if not isinstance(v, int) or isinstance(v, bool):
                raise Refused("bad_argument", "a year")
            low, high = dt.date(v, 1, 1), dt.date(v + 1, 1, 1)
            exact = True
        else:
            unit = "day" if name == "todate" else unit_of(call.args[0])
            if f.kind == "date" and unit in SUB_DAY:
                raise Refused("bad_rounding", f"a date has no {unit}")
            at = parse_stamp(v) if isinstance(v, str) else None
            if at is None:
                raise Refused("bad_date", repr(v))
            start = bound(unit, at)
            exact = start == at
            if op in ("=", "!=") and not exact:
                raise Refused("sql_rounded_value", f"{v} starts no {unit}")
            low, high = start, following(unit, start)
        as_lit = lambda x: F.lit(dt.date(x.year, x.month, x.day)) if f.kind == "date" else F.lit(x if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day, tzinfo=dt.timezone.utc))
        lo, hi = as_lit(low), as_lit(high)
        tests = {"=": (c >= lo) & (c < hi), "!=": (c < lo) | (c >= hi), ">=": c >= (lo if exact else hi), ">": c >= hi, "<": c < (lo if exact else hi), "<=": c < hi}
        return tests[op]


def bound(unit: str, at: dt.datetime) -> dt.datetime:
    """The start of the unit that holds a time."""
    day = at.replace(hour=0, minute=0, second=0)
    if unit == "week":
        return day - dt.timedelta(days=day.weekday())
    return {
        "second": at, "minute": at.replace(second=0), "hour": at.replace(minute=0, second=0), "day": day, "month": day.replace(day=1),
        "quarter": day.replace(day=1, month=(day.month - 1) // 3 * 3 + 1), "year": day.replace(day=1, month=1),
    }[unit]


def following(unit: str, start: dt.datetime) -> dt.datetime:
    if unit in ("month", "quarter", "year"):
        n = start.month - 1 + {"month": 1, "quarter": 3, "year": 12}[unit]
        return start.replace(year=start.year + n // 12, month=n % 12 + 1)
    return start + {"second": dt.timedelta(seconds=1), "minute": dt.timedelta(minutes=1), "hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1), "week": dt.timedelta(weeks=1)}[unit]
