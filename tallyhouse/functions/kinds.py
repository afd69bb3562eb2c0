"""Kinds of fields: their SQL spellings, Spark types and the checks of values that are written."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import types as T

from tallyhouse.refusal import Refused

INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "integer": 32, "bigint": 64}
KEYED = ("set", "mutex", "enum", "timequantum")
NUMERIC = ("int", "signed", "decimal", "float32", "float64")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    bits: int | None = None
    scale: int | None = None
    members: tuple[str, ...] = ()
    multiple: bool = False  # a set or time quantum that is stored as an array
    spelling: str = field(default="", compare=False)

    @property
    def keyed(self) -> bool:
        return self.kind in KEYED

    @property
    def temporal(self) -> bool:
        return self.kind in ("date", "datetime")

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "int":
            return T.DecimalType(20, 0) if self.bits == 64 else T.LongType()
        if self.kind == "decimal":
            return T.DecimalType(min(38, max(19, (self.scale or 0) + 1)), self.scale or 0)
        if self.kind == "set" and self.multiple:
            return T.ArrayType(T.StringType())
        if self.kind == "timequantum":
            return T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.TimestampType())]))
        return {"signed": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampType(), "bool": T.BooleanType()}.get(self.kind, T.StringType())

    @property
    def ddl(self) -> str:
        return self.spelling or {"int": f"UINT({self.bits})", "signed": f"SIGNED({self.bits})", "decimal": f"DECIMAL(18, {self.scale})", "float32": "FLOAT", "float64": "DOUBLE", "enum": "ENUM(" + ", ".join(f"'{m}'" for m in self.members) + ")"}.get(self.kind, self.kind.upper())

    def as_json(self) -> dict:
        return {"name": self.name, "kind": self.kind, "bits": self.bits, "scale": self.scale, "members": list(self.members), "multiple": self.multiple, "spelling": self.spelling}

    @classmethod
    def from_json(cls, x: dict) -> Field:
        return cls(x["name"], x["kind"], x["bits"], x["scale"], tuple(x["members"]), x["multiple"], x["spelling"])


def field_of(column: T.StructField) -> Field:
    """The field that a column of an attached DataFrame is."""
    t = column.dataType
    if isinstance(t, T.DecimalType):
        return Field(column.name, "decimal", 64, t.scale)
    if isinstance(t, T.ArrayType):
        pair = isinstance(t.elementType, T.StructType)
        return Field(column.name, "timequantum" if pair else "set", multiple=True)
    kinds = {T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.FloatType: "float32", T.DoubleType: "float64"}
    if type(t) in kinds:
        return Field(column.name, kinds[type(t)], {"float32": 32, "float64": 64}.get(kinds[type(t)]))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Field(column.name, "signed", 64)
    return Field(column.name, "mutex")


def column_kind(name: str, word: str, args: list, modifier: str | None, spelling: str) -> Field:
    """The field that a CREATE TABLE column declares: a type name, its arguments and SIGNED or UNSIGNED behind it."""
    w = word.lower()
    make = lambda kind, **k: Field(name, kind, spelling=spelling, **k)
    if w in INTEGERS:
        if args:
            raise Refused("sql_unknown_column_type", f"{word} takes no width")
        return make("signed" if modifier == "signed" else "int", bits=INTEGERS[w])
    if w in ("uint", "signed"):
        bits = args[0] if args else 64
        if not isinstance(bits, int) or not 1 <= bits <= 64:
            raise Refused("sql_bit_depth", "1 to 64 bits")
        return make("int" if w == "uint" else "signed", bits=bits)
    if w in ("decimal", "numeric", "dec"):
        if len(args) != 2 or args[1] > args[0]:
            raise Refused("sql_decimal_scale", "DECIMAL(p, s) with s up to p")
        bits = math.ceil(10 * args[0] / 3)
        if bits > 64:
            raise Refused("sql_bit_depth", "at most 19 digits")
        return make("decimal", bits=bits, scale=args[1])
    if w in ("enum", "enum8", "enum16"):
        if not args or not all(isinstance(a, str) for a in args) or len(set(args)) < len(args):
            raise Refused("sql_enum_type", "distinct names in quotes")
        return make("enum", members=tuple(args))
    if w == "lowcardinality":
        if args != ["string"]:
            raise Refused("sql_unknown_column_type", "LowCardinality(String)")
        return make("set", multiple=True)
    if w == "nullable":
        raise Refused("sql_nullable_type", "every field may be absent")
    if w in ("array", "map", "tuple", "nested"):
        raise Refused("sql_composite_type", word)
    if w in ("bitmap", "aggregatefunction"):
        raise Refused("sql_bitmap_type", word)
    if w in ("hll", "quantile_state", "simpleaggregatefunction"):
        raise Refused("sql_sketch", word)
    if args and w in ("varchar", "char", "text", "string"):
        raise Refused("sql_no_constraints", "no length limits")
    plain = {"bool": "bool", "boolean": "bool", "date": "date", "datetime": "datetime", "timestamp": "datetime", "mutex": "mutex", "timequantum": "timequantum", "float": "float32", "float32": "float32", "real": "float32", "double": "float64", "float64": "float64"}
    if args:
        raise Refused("sql_unknown_column_type", spelling)
    if w == "ipv4":
        return make("int", bits=32)
    if w in ("set", "text", "varchar", "char", "string"):
        return make("set", multiple=True)
    if w not in plain:
        raise Refused("sql_unknown_column_type", word)
    kind = plain[w]
    return make(kind, bits={"float32": 32, "float64": 64}.get(kind), multiple=kind == "timequantum")


_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_STAMP = re.compile(r"(\d{4}-\d\d-\d\d)(?:[ T](\d\d:\d\d:\d\d))?")


def parse_date(text: str) -> dt.date:
    if isinstance(text, str) and _DATE.fullmatch(text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            pass
    raise Refused("bad_date", repr(text))


def parse_stamp(text: str) -> dt.datetime:
    if isinstance(text, str) and (m := _STAMP.fullmatch(text)):
        try:
            return dt.datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}").replace(tzinfo=dt.timezone.utc)
        except ValueError:
            pass
    raise Refused("bad_date", repr(text))


def digits_after_point(x) -> int:
    return max(0, -Decimal(str(x)).normalize().as_tuple().exponent)


def stored(f: Field, value):
    """The Python value that f stores for a literal; refuses what doesn't fit."""
    if value is None:
        raise Refused("sql_no_nulls", "leave the column out")
    if f.kind in ("int", "signed"):
        if isinstance(value, bool) or not isinstance(value, (int, Decimal)) or value != int(value):
            raise Refused("bad_argument", f"{f.name} holds whole numbers")
        low, high = (0, 2**f.bits - 1) if f.kind == "int" else (-(2 ** (f.bits - 1)), 2 ** (f.bits - 1) - 1)
        if not low <= value <= high:
            raise Refused("value_out_of_range", f"{value} doesn't fit {f.bits} bits of {f.name}")
        return Decimal(value) if f.kind == "int" and f.bits == 64 else int(value)
    if f.kind == "decimal":
        if isinstance(value, bool) or not isinstance(value, (int, Decimal)):
            raise Refused("bad_argument", f"{f.name} holds decimals")
        if digits_after_point(value) > f.scale:
            raise Refused("too_precise", f"{f.name} has {f.scale} decimal places")
        if value < 0:
            raise Refused("value_out_of_range", f"{f.name} is unsigned")
        return Decimal(value)
    if f.kind in ("float32", "float64"):
        if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)) or math.isnan(float(value)):
            raise Refused("bad_argument", f"{f.name} holds numbers")
        return float(value) + 0.0
    if f.kind == "bool":
        if not isinstance(value, bool):
            raise Refused("bad_argument", f"{f.name} is true or false")
        return value
    if f.kind == "date":
        return parse_date(value)
    if f.kind == "datetime":
        return parse_stamp(value)
    if not isinstance(value, str):
        raise Refused("bad_argument", f"{f.name} holds keys")
    if f.kind == "timequantum":
        key, at, seconds = value.rpartition("@")
        if at and not re.fullmatch(r"-?\d+", seconds):
            raise Refused("bad_argument", "key@seconds")
        return [{"key": _key(key if at else value), "at": dt.datetime.fromtimestamp(int(seconds), dt.timezone.utc) if at else None}]
    if f.kind == "enum" and value not in f.members:
        raise Refused("unknown_member", f"{value!r} is none of {f.name}'s members")
    return [_key(value)] if f.multiple else _key(value)


def _key(text: str) -> str:
    if len(text.encode()) > 104:
        raise Refused("key_too_long", "keys have at most 104 bytes")
    return text
