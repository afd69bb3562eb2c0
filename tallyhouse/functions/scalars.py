"""Scalar expressions of the dialect as Spark columns.

Null in gives null out but for coalesce and its kin; in AND, OR and conditions an absent value is
false; comparisons answer 1 or 0; division by zero is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.kinds import Field
from tallyhouse.refusal import Refused
from tallyhouse.sql.nodes import Bin, Call, Case, Col, Lit, Now, Un

#: Calendar units by their spellings.
UNITS = {"year": "year", "quarter": "quarter", "month": "month", "week": "week", "day": "day", "hour": "hour", "minute": "minute", "min": "minute", "second": "second", "sec": "second"}
SUB_DAY = ("hour", "minute", "second")


def unit_of(word: Any) -> str:
    w = word.value if isinstance(word, Lit) else word.name if isinstance(word, Col) else word
    w = str(w).lower()
    if w not in UNITS and w.endswith("s"):
        w = w[:-1]
    if w not in UNITS:
        raise Refused("sql_bad_trunc_unit", str(w))
    return UNITS[w]


class Typed:
    """A column and what it holds: number, text, date, datetime, bool, list."""

    def __init__(self, column: Column, kind: str, scale: int | None = None):
        self.column, self.kind, self.scale = column, kind, scale


KIND_OF_FIELD = {"int": "number", "signed": "number", "decimal": "number", "float32": "number", "float64": "number", "date": "date", "datetime": "datetime", "bool": "bool"}


def literal(v: Any) -> Typed:
    if isinstance(v, bool):
        return Typed(F.lit(v), "bool")
    if isinstance(v, str):
        return Typed(F.lit(v), "text")
    if isinstance(v, int) and not -(2**63) <= v < 2**63:
        v = Decimal(v)
    return Typed(F.lit(v), "number")


def truth(x: Typed) -> Column:
    """Absent is false; numbers are true unless zero, texts unless empty."""
    c = x.column
    test = c if x.kind == "bool" else c != 0 if x.kind == "number" else F.length(c) > 0 if x.kind == "text" else c.isNotNull()
    return F.coalesce(test, F.lit(False))


def flag(test: Column) -> Typed:
    return Typed(test.cast("int"), "number")


def truncated(unit: str, x: Typed) -> Typed:
    if x.kind not in ("date", "datetime"):
        raise Refused("bad_rounding", "a date or a time")
    if x.kind == "date":
        if unit in SUB_DAY:
            raise Refused("bad_rounding", f"a date has no {unit}")
        return Typed(F.date_trunc(unit, x.column).cast("date"), "date")
    return Typed(F.date_trunc(unit, x.column), "datetime")


def months(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def difference(unit: str, a: Typed, b: Typed) -> Column:
    """How many bounds of the unit lie between; quarters and years are whole threes and twelves of months, rounded down."""
    if unit in ("month", "quarter", "year"):
        n = months(b.column) - months(a.column)
        return F.floor(n / {"month": 1, "quarter": 3, "year": 12}[unit]).cast("bigint")
    if unit == "week":
        return F.floor(F.datediff(F.date_trunc("week", b.column).cast("date"), F.date_trunc("week", a.column).cast("date")) / 7).cast("bigint")
    if unit == "day":
        return F.datediff(b.column.cast("date"), a.column.cast("date")).cast("bigint")
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    seconds = lambda x: F.unix_timestamp(x.column.cast("timestamp"))
    return (F.floor(seconds(b) / size) - F.floor(seconds(a) / size)).cast("bigint")


def shifted(unit: str, n: Column, x: Typed) -> Typed:
    """Calendar units clamp to the month's last day; a date stays a date."""
    if x.kind == "date":
        if unit in SUB_DAY:
            raise Refused("bad_rounding", f"a date has no {unit}")
        step = {"year": 12, "quarter": 3, "month": 1}.get(unit)
        return Typed(F.add_months(x.column, (n * step).cast("int")) if step else F.date_add(x.column, (n * (7 if unit == "week" else 1)).cast("int")), "date")
    n = n.cast("int")
    if unit in ("year", "quarter", "month"):
        return Typed(x.column + F.make_ym_interval(F.lit(0), n * {"year": 12, "quarter": 3, "month": 1}[unit]), "datetime")
    seconds = n.cast("bigint") * {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return Typed(F.timestamp_micros(F.unix_micros(x.column) + seconds * 1_000_000), "datetime")


#: The parts of a format and Spark's patterns for them.
FORMAT_PARTS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd"}


def formatted(x: Typed, fmt: str) -> Column:
    parts: list[Column] = []
    for piece in re.findall(r"%.|[^%]+|%$", fmt, re.DOTALL):
        if piece[0] == "%" and piece[1:] in FORMAT_PARTS:
            parts.append(F.date_format(x.column, FORMAT_PARTS[piece[1:]]))
        else:
            parts.append(F.when(x.column.isNotNull(), F.lit("%" if piece == "%%" else piece)))
    return F.concat(*parts) if parts else F.when(x.column.isNotNull(), F.lit(""))


def log_of(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(f(c))


MATH = {
    "floor": F.floor, "ceil": F.ceil, "ceiling": F.ceil, "sqrt": F.sqrt, "exp": F.exp, "ln": log_of(F.ln), "log": log_of(F.ln), "log10": log_of(F.log10), "log2": log_of(F.log2),
}
PARTS = {"toyear": F.year, "tomonth": F.month, "todayofmonth": F.dayofmonth, "tohour": F.hour, "tominute": F.minute, "tosecond": F.second}
JSON_NAMES = {
    "jsonextractstring": "string", "json_extract_string": "string", "jsonextractint": "int", "json_extract_int": "int", "jsonextractfloat": "float", "json_extract_float": "float",
    "jsonextractraw": "raw", "json_query": "raw", "json_extract_raw": "raw", "jsonhas": "has", "json_has": "has",
}
ARITY = {
    "abs": (1, 1), "round": (1, 2), "pow": (2, 2), "power": (2, 2), "sign": (1, 1), "bitand": (2, 2), "bitor": (2, 2), "bitxor": (2, 2), "bitnot": (1, 1), "bitshiftleft": (2, 2), "bitshiftright": (2, 2),
    "lower": (1, 1), "lcase": (1, 1), "upper": (1, 1), "ucase": (1, 1), "length": (1, 1), "char_length": (1, 1), "character_length": (1, 1), "substring": (2, 3), "substr": (2, 3), "position": (2, 2), "concat": (1, 99),
    "trim": (1, 1), "ltrim": (1, 1), "rtrim": (1, 1), "reverse": (1, 1), "startswith": (2, 2), "endswith": (2, 2), "splitbychar": (2, 2),
    "toint64": (1, 1), "touint64": (1, 1), "toint32": (1, 1), "touint32": (1, 1), "tofloat64": (1, 1), "tofloat32": (1, 1), "tostring": (1, 1), "coalesce": (1, 99), "ifnull": (2, 2), "nullif": (2, 2), "if": (3, 3), "multiif": (3, 99),
    "todate": (1, 1), "date_trunc": (2, 2), "datetrunc": (2, 2), "date_diff": (3, 3), "datediff": (3, 3), "date_add": (3, 3), "dateadd": (3, 3), "date_sub": (3, 3), "datesub": (3, 3), "formatdatetime": (2, 2),
} | dict.fromkeys(MATH, (1, 1)) | dict.fromkeys(PARTS, (1, 1)) | dict.fromkeys(JSON_NAMES, (2, 2))


class Scalars:
    """Compiles expressions over columns that resolve() finds: Col -> (Spark column, Field or kind)."""

    def __init__(self, resolve: Callable[[Col], tuple[Column, Field]]):
        self.resolve = resolve

    def column(self, e: Any) -> Column:
        return self.typed(e).column

    def typed(self, e: Any) -> Typed:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Now):
            return Typed(F.date_trunc("second", F.current_timestamp()), "datetime")
        if isinstance(e, Col):
            column, f = self.resolve(e)
            if f.multiple:
                return Typed(column, "list")
            return Typed(column, KIND_OF_FIELD.get(f.kind, "text"), f.scale)
        if isinstance(e, Un):
            if e.op == "not":
                x = self.typed(e.of)
                return Typed(F.when(x.column.isNotNull(), (~truth(x)).cast("int")), "number")
            return Typed(-self.number(e.of), "number")
        if isinstance(e, Case):
            return self.case(e.whens, e.other)
        if isinstance(e, Bin):
            return self.binary(e)
        if isinstance(e, Call):
            return self.call(e)
        raise Refused("sql_unsupported", type(e).__name__)

    def number(self, e: Any) -> Column:
        x = self.typed(e)
        if x.kind == "bool":
            return x.column.cast("int")
        if x.kind != "number":
            raise Refused("sql_unsupported", "a number expected")
        return x.column

    def text(self, e: Any) -> Column:
        x = self.typed(e)
        if x.kind != "text":
            raise Refused("sql_unsupported", "a text expected")
        return x.column

    def case(self, whens: tuple, other: Any) -> Typed:
        results = [self.typed(r) for _, r in whens] + ([self.typed(other)] if other is not None else [])
        out = None
        for (c, _), r in zip(whens, results, strict=False):
            out = F.when(truth(self.typed(c)), r.column) if out is None else out.when(truth(self.typed(c)), r.column)
        return Typed(out.otherwise(results[-1].column) if other is not None else out, results[0].kind, results[0].scale)

    def binary(self, e: Bin) -> Typed:
        if e.op in ("and", "or"):
            a, b = truth(self.typed(e.left)), truth(self.typed(e.right))
            return flag(a & b if e.op == "and" else a | b)
        a, b = self.typed(e.left), self.typed(e.right)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            x, y = a.column, b.column
            for one, two in ((a, b), (b, a)):  # a literal date reads as what it is compared with
                if one.kind in ("date", "datetime") and two.kind == "text":
                    if two is b:
                        y = y.cast("date" if one.kind == "date" else "timestamp")
                    else:
                        x = x.cast("date" if one.kind == "date" else "timestamp")
            return flag({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op])
        if a.kind in ("date", "datetime") or b.kind in ("date", "datetime"):
            return self.calendar(e.op, a, b)
        x, y = self.number(e.left), self.number(e.right)
        if e.op == "/":
            return Typed(F.try_divide(x.cast("double"), y.cast("double")), "number")
        if e.op == "%":
            return Typed(F.try_mod(x, y), "number")
        return Typed({"+": x + y, "-": x - y, "*": x * y}[e.op], "number")

    def calendar(self, op: str, a: Typed, b: Typed) -> Typed:
        if op == "-" and a.kind == b.kind:
            if a.kind == "date":
                return Typed(F.datediff(a.column, b.column).cast("bigint"), "number")
            return Typed(F.unix_timestamp(a.column) - F.unix_timestamp(b.column), "number")
        if op == "+" and a.kind == "number":
            a, b = b, a
        if op in ("+", "-") and b.kind == "number":
            n = b.column if op == "+" else -b.column
            return shifted("day" if a.kind == "date" else "second", n, a)
        raise Refused("sql_unsupported", f"{a.kind} {op} {b.kind}")

    def call(self, e: Call) -> Typed:
        name, args = e.name.lower(), e.args
        if name not in ARITY:
            raise Refused("sql_unsupported", f"{e.name}()")
        low, high = ARITY[name]
        if not low <= len(args) <= high:
            raise Refused("bad_arity", e.name)
        if name in MATH:
            x = self.number(args[0])
            return Typed(MATH[name](x if name in ("floor", "ceil", "ceiling") else x.cast("double")), "number")
        if name in PARTS:
            x = self.typed(args[0])
            if x.kind not in ("date", "datetime"):
                raise Refused("sql_unsupported", "a date or a time expected")
            return Typed(PARTS[name](x.column), "number")
        if name in JSON_NAMES:
            return self.json(JSON_NAMES[name], args)
        return getattr(self, f"_{name}")(*args)

    # numbers
    def _abs(self, x: Any) -> Typed:
        return Typed(F.abs(self.number(x)), "number")

    def _round(self, x: Any, d: Any = Lit(0)) -> Typed:  # noqa: B008
        places = d.value if isinstance(d, Lit) else None
        if not isinstance(places, int):
            raise Refused("sql_unsupported", "places are a literal")
        return Typed(F.round(self.number(x), places), "number")

    def _pow(self, x: Any, y: Any) -> Typed:
        return Typed(F.pow(self.number(x).cast("double"), self.number(y).cast("double")), "number")

    _power = _pow

    def _sign(self, x: Any) -> Typed:
        return Typed(F.signum(self.number(x).cast("double")).cast("int"), "number")

    def _whole(self, x: Any) -> Column:
        return self.number(x).cast("bigint")

    def _bitand(self, x: Any, y: Any) -> Typed:
        return Typed(self._whole(x).bitwiseAND(self._whole(y)), "number")

    def _bitor(self, x: Any, y: Any) -> Typed:
        return Typed(self._whole(x).bitwiseOR(self._whole(y)), "number")

    def _bitxor(self, x: Any, y: Any) -> Typed:
        return Typed(self._whole(x).bitwiseXOR(self._whole(y)), "number")

    def _bitnot(self, x: Any) -> Typed:
        return Typed(F.bitwise_not(self._whole(x)), "number")

    def _shift(self, x: Any, n: Any, call: str) -> Typed:
        if not isinstance(n, Lit) or not isinstance(n.value, int) or n.value < 0:
            raise Refused("sql_unsupported", "shifts are by a literal")
        x = self._whole(x)
        if n.value > 63:  # Spark would shift by the rest of the division by 64
            gone = F.lit(0).cast("bigint") if call == "shiftleft" else F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
            return Typed(F.when(x.isNotNull(), gone), "number")
        return Typed(getattr(F, call)(x, n.value), "number")

    def _bitshiftleft(self, x: Any, n: Any) -> Typed:
        return self._shift(x, n, "shiftleft")

    def _bitshiftright(self, x: Any, n: Any) -> Typed:
        return self._shift(x, n, "shiftright")

    # texts
    def _lower(self, x: Any) -> Typed:
        return Typed(F.lower(self.text(x)), "text")

    def _upper(self, x: Any) -> Typed:
        return Typed(F.upper(self.text(x)), "text")

    _lcase, _ucase = _lower, _upper

    def _length(self, x: Any) -> Typed:
        return Typed(F.length(self.text(x)), "number")

    _char_length = _character_length = _length

    def _substring(self, x: Any, start: Any, n: Any = None) -> Typed:
        begin = F.greatest(self.number(start).cast("int"), F.lit(1))
        return Typed(F.substr(self.text(x), begin, F.greatest(self.number(n).cast("int"), F.lit(0)) if n is not None else F.lit(2**31 - 1)), "text")

    _substr = _substring

    def _position(self, x: Any, needle: Any) -> Typed:
        return Typed(F.position(self.text(needle), self.text(x)), "number")

    def _concat(self, *xs: Any) -> Typed:
        return Typed(F.concat(*[self.text(x) for x in xs]), "text")

    def _trim(self, x: Any) -> Typed:
        return Typed(F.regexp_replace(self.text(x), r"(?U)^\s+|\s+$", ""), "text")

    def _ltrim(self, x: Any) -> Typed:
        return Typed(F.regexp_replace(self.text(x), r"(?U)^\s+", ""), "text")

    def _rtrim(self, x: Any) -> Typed:
        return Typed(F.regexp_replace(self.text(x), r"(?U)\s+$", ""), "text")

    def _reverse(self, x: Any) -> Typed:
        return Typed(F.reverse(self.text(x)), "text")

    def _startswith(self, x: Any, y: Any) -> Typed:
        return flag(F.startswith(self.text(x), self.text(y)))

    def _endswith(self, x: Any, y: Any) -> Typed:
        return flag(F.endswith(self.text(x), self.text(y)))

    def _splitbychar(self, sep: Any, x: Any) -> Typed:
        if not isinstance(sep, Lit) or not isinstance(sep.value, str) or not sep.value:
            raise Refused("sql_unsupported", "a separator expected")
        return Typed(F.split(self.text(x), re.escape(sep.value[0]), -1), "list")

    # casts and choices
    def _toint64(self, x: Any) -> Typed:
        t = self.typed(x)
        if t.kind == "text":
            return Typed(F.lit(None).cast("bigint"), "number")
        if t.kind == "date":
            return Typed(F.unix_date(t.column).cast("bigint"), "number")
        if t.kind == "datetime":
            return Typed(F.unix_timestamp(t.column), "number")
        return Typed(t.column.try_cast("bigint"), "number")

    _touint64 = _toint32 = _touint32 = _toint64

    def _tofloat64(self, x: Any) -> Typed:
        t = self.typed(x)
        return Typed(F.lit(None).cast("double") if t.kind == "text" else self._toint64(x).column.cast("double") if t.kind in ("date", "datetime") else t.column.cast("double"), "number")

    _tofloat32 = _tofloat64

    def _tostring(self, x: Any) -> Typed:
        t = self.typed(x)
        return Typed(F.date_format(t.column, "yyyy-MM-dd HH:mm:ss") if t.kind == "datetime" else t.column.cast("int").cast("string") if t.kind == "bool" else t.column.cast("string"), "text")

    def _coalesce(self, *xs: Any) -> Typed:
        typed = [self.typed(x) for x in xs]
        return Typed(F.coalesce(*[t.column for t in typed]), typed[0].kind, typed[0].scale)

    _ifnull = _coalesce

    def _nullif(self, x: Any, y: Any) -> Typed:
        a = self.typed(x)
        return Typed(F.nullif(a.column, self.typed(y).column), a.kind, a.scale)

    def _if(self, c: Any, x: Any, y: Any) -> Typed:
        return self.case(((c, x),), y)

    def _multiif(self, *xs: Any) -> Typed:
        if len(xs) % 2 == 0:
            raise Refused("bad_arity", "multiIf")
        return self.case(tuple(zip(xs[:-1:2], xs[1::2], strict=True)), xs[-1])

    # calendar
    def _todate(self, x: Any) -> Typed:
        t = self.typed(x)
        return Typed(t.column.try_cast("date") if t.kind == "text" else t.column.cast("date"), "date")

    def _date_trunc(self, unit: Any, x: Any) -> Typed:
        return truncated(unit_of(unit), self.typed(x))

    _datetrunc = _date_trunc

    def _date_diff(self, unit: Any, a: Any, b: Any) -> Typed:
        return Typed(difference(unit_of(unit), self.typed(a), self.typed(b)), "number")

    _datediff = _date_diff

    def _date_add(self, unit: Any, n: Any, x: Any) -> Typed:
        return shifted(unit_of(unit), self.number(n), self.typed(x))

    _dateadd = _date_add

    def _date_sub(self, unit: Any, n: Any, x: Any) -> Typed:
        return shifted(unit_of(unit), -self.number(n), self.typed(x))

    _datesub = _date_sub

    def _formatdatetime(self, x: Any, fmt: Any) -> Typed:
        if not isinstance(fmt, Lit) or not isinstance(fmt.value, str):
            raise Refused("sql_unsupported", "a literal format")
        return Typed(formatted(self.typed(x), fmt.value), "text")

    def json(self, what: str, args: tuple) -> Typed:
        doc, key = self.text(args[0]), args[1].value if isinstance(args[1], Lit) else None
        if not isinstance(key, str) or "'" in key:
            raise Refused("sql_unsupported", "a literal key")
        if what == "has":
            return flag(F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False)))
        raw = F.get_json_object(doc, f"$['{key}']")
        if what == "raw":
            return Typed(raw, "text")
        # malformed documents have no members, and of doubled keys the first counts; a member's own type decides, so
        # quoted numbers are no numbers: among the members of a list, strings keep their quotes
        quoted = F.when(F.json_object_keys(doc).isNotNull(), F.get_json_object(F.concat(F.lit("["), doc, F.lit("]")), f"$[*]['{key}']"))
        if what == "string":
            return Typed(F.when(quoted.startswith('"'), raw), "text")
        if what == "int":
            return Typed(F.when(quoted.rlike(r"^-?[0-9]+$"), raw.try_cast("bigint")), "number")
        return Typed(F.when(quoted.rlike(r"^-?[0-9]"), raw.try_cast("double")), "number")
