"""SELECT as a DataFrame: the plan is declared and Catalyst chooses how it runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.kinds import Field
from tallyhouse.functions.scalars import Scalars, truncated, unit_of
from tallyhouse.operators.grouping import Measure, grouped, grouping_sets, whole
from tallyhouse.operators.joins import joined
from tallyhouse.operators.predicates import Predicates, conjuncts
from tallyhouse.operators.windows import window_column
from tallyhouse.refusal import Refused
from tallyhouse.sql.nodes import Between, Bin, Call, Case, Col, InSelect, Item, Lit, Query, Select, Star, Un
from tallyhouse.sql.parser import Parser

ID = "_record_id"


@dataclass
class Source:
    """A table as it is read: its records with their ids, and its fields in order; days: of a time quantum, its key, day and record id, partitioned by day."""

    frame: DataFrame
    fields: list[Field]
    has_ids: bool = True
    days: dict[str, DataFrame] = field(default_factory=dict)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name.lower() == name.lower():
                return f
        if name.lower() == ID and self.has_ids:
            return Field(ID, "signed", 64)
        raise Refused("unknown_field", name)


class Catalog(Protocol):
    spark: SparkSession
    ordered: bool

    def source(self, name: str) -> Source: ...

    def view_condition(self, view: str, table: str) -> Any: ...


AGGREGATES = ("count", "sum", "min", "max", "avg", "uniq", "quantile", "topK")
DEFAULT_NAMES = {"uniq": "count"}


def default_name(item: Item) -> str:
    e = item.expr
    if isinstance(e, Col):
        return e.name
    if isinstance(e, Call) and e.name in AGGREGATES:
        return DEFAULT_NAMES.get(e.name, e.name)
    if isinstance(e, Call) and e.over is not None:
        return "runningDifference" if e.name.startswith("running") else e.name
    return item.text


def unique(names: list[str]) -> list[str]:
    """Names for columns inside plans, where no two may be alike."""
    return [f"c{i}_" for i in range(len(names))]


def walk(e: Any, f: Callable[[Any], Any]) -> Any:
    """e with f's replacements, which are not looked into again."""
    if (own := f(e)) is not None:
        return own
    if isinstance(e, Bin):
        return Bin(e.op, walk(e.left, f), walk(e.right, f))
    if isinstance(e, Un):
        return Un(e.op, walk(e.of, f))
    if isinstance(e, Case):
        return Case(tuple((walk(c, f), walk(r, f)) for c, r in e.whens), walk(e.other, f) if e.other is not None else None)
    if isinstance(e, Call) and e.over is None:
        return Call(e.name, tuple(walk(a, f) for a in e.args), e.params, e.distinct, e.where)
    return e


def columns_in(e: Any, out: list[Col] | None = None) -> list[Col]:
    out = [] if out is None else out
    if isinstance(e, Col):
        out.append(e)
    for part in (getattr(e, n, None) for n in ("left", "right", "of", "low", "high", "other")):
        if part is not None and not isinstance(part, (str, tuple)):
            columns_in(part, out)
    for part in getattr(e, "args", ()) or ():
        columns_in(part, out)
    for w in getattr(e, "whens", ()) or ():
        for part in w:
            columns_in(part, out)
    return out


class Selecting:
    """One SELECT over one source, or over the sides of a join."""

    def __init__(self, catalog: Catalog, select: Select):
        self.catalog, self.select = catalog, select
        self.source = catalog.source(select.table)
        self.extra: list[DataFrame] = []
        self.frame = self.source.frame
        self.predicates = Predicates(self.resolve, lambda view: catalog.view_condition(view, select.table), self.member, self.within_days)
        self.scalars = Scalars(self.resolve)
        self.flags = 0

    def resolve(self, c: Col) -> tuple[Column, Field]:
        if c.table is not None and c.table not in (self.select.alias, self.select.table):
            raise Refused("sql_ambiguous_column", f"{c.table}.{c.name}")
        f = self.source.field(c.name)
        return F.col(f"`{f.name}`"), f

    # --- which records
    def ids(self, e: InSelect) -> DataFrame:
        inner = Selecting(self.catalog, Select([Item(Col(ID), None, ID)], e.table, e.table, where=e.where))
        return inner.records().select(F.col(ID).alias("member_"))

    def member(self, column: Column, e: InSelect) -> Column:
        """Inside a larger condition a membership is a column of its own, from a left join on the distinct ids."""
        self.flags += 1
        name = f"in{self.flags}_"
        ids = self.ids(e).select(F.col("member_").alias(f"{name}id")).distinct().withColumn(name, F.lit(True))
        self.frame = self.frame.join(ids, column == F.col(f"{name}id"), "left").drop(f"{name}id")
        return F.coalesce(F.col(name), F.lit(False))

    def within_days(self, f: Field, key: str, low: dt.date | None, high: dt.date | None) -> Column | None:
        """Whether a record has a time quantum's key on a day from low to high, by the table's rows for each day, of which only those days are read; None if it has no such rows."""
        days = self.source.days.get(f.name)
        if days is None:
            return None
        self.flags += 1
        name = f"day{self.flags}_"
        ids = days.where(F.col("key") == key)
        if low is not None:
            ids = ids.where(F.col("day") >= F.lit(low))
        if high is not None:
            ids = ids.where(F.col("day") <= F.lit(high))
        ids = ids.select(F.col(ID).alias(f"{name}id")).distinct().withColumn(name, F.lit(True))
        self.frame = self.frame.join(ids, F.col(ID) == F.col(f"{name}id"), "left").drop(f"{name}id")
        return F.coalesce(F.col(name), F.lit(False))

    def records(self) -> DataFrame:
        s = self.select
        rest = []
        for term in conjuncts(s.where) if s.where is not None else []:
            minus = isinstance(term, Un) and term.op == "not" and isinstance(term.of, InSelect)
            if isinstance(term, InSelect) or minus:
                own = term.of if minus else term
                column, f = self.predicates.column(own.of)
                if f.kind not in ("int", "signed"):
                    raise Refused("operator_not_allowed", f"{f.name} holds no record ids")
                self.frame = self.frame.join(self.ids(own), column == F.col("member_"), "left_anti" if minus else "left_semi")
            else:
                rest.append(term)
        if rest:
            test = self.predicates.all_of(rest)  # may join memberships to the frame
            self.frame = self.frame.where(test)
        if s.sample:
            if not self.source.has_ids:
                raise Refused("sql_no_sample", "the table has no record ids")
            self.frame = self.frame.where(F.pmod(F.col(ID), F.lit(s.sample)) == 0)
        return self.frame

    def filtered(self, where: Any) -> Column | None:
        return None if where is None else self.predicates.sure(where)

    # --- measures
    def measure(self, name: str, call: Call) -> Measure:
        where = self.filtered(call.where)
        if call.name == "count":
            return Measure(name, "count", where=where)
        column, f = self.resolve(call.args[0])
        level = call.params[0].value if call.params else None
        return Measure(name, call.name, column, f, where, level)

    def collect(self, exprs: list[Any]) -> tuple[list[Measure], list[Any]]:
        """The distinct aggregates in exprs as measures, and exprs with columns in their place."""
        found: list[tuple[Call, str]] = []

        def swap(e: Any) -> Any:
            if isinstance(e, Call) and e.over is None and e.name in AGGREGATES:
                for call, name in found:
                    if call == e:
                        return Col(name, "agg_")
                found.append((e, f"m{len(found)}_"))
                return Col(found[-1][1], "agg_")
            return None

        swapped = [walk(e, swap) for e in exprs]
        calls = [c for c, _ in found]
        if sum(2 if c.name == "avg" else 1 for c in calls) > 16:
            raise Refused("sql_too_many_aggregates", "at most sixteen plans")
        self.by_name = {name: call for call, name in found}
        return [self.measure(name, call) for call, name in found], swapped

    def after(self, e: Any, keys: dict[Any, str]) -> Column:
        """A column over aggregated rows: measures and keys."""

        def resolve(c: Col) -> tuple[Column, Field]:
            if c.table == "agg_":
                call = self.by_name[c.name]
                f = Field(c.name, "signed", 64) if call.name in ("count", "uniq") else Field(c.name, "float64") if call.name == "avg" else Field(c.name, "set", multiple=True) if call.name == "topK" else self.resolve(call.args[0])[1]
                return F.col(c.name), f
            for key, name in keys.items():
                if isinstance(key, Col) and key.name.lower() == c.name.lower():
                    f = self.resolve(key)[1]
                    return F.col(name), Field(name, "mutex" if f.keyed else f.kind, f.bits, f.scale)
            raise Refused("sql_unsupported", f"{c.name} is no group")

        if e in keys:
            return F.col(keys[e])
        if isinstance(e, Col) and e.table != "agg_" or isinstance(e, Call) and Parser.bucket(e):
            for key, name in keys.items():
                if self.same_key(key, e):
                    return F.col(name)
            raise Refused("sql_unsupported", "neither a group nor an aggregate")
        return Scalars(resolve).column(e)

    def same_key(self, a: Any, b: Any) -> bool:
        if isinstance(a, Col) and isinstance(b, Col):
            return a.name.lower() == b.name.lower()
        if Parser.bucket(a) and Parser.bucket(b):
            return unit_of(a.args[0]) == unit_of(b.args[0]) and self.same_key(a.args[1], b.args[1])
        return a == b

    def having(self, e: Any, exprs: dict[str, Any]) -> Column:
        """A condition over aggregates: an absent number makes a comparison false."""
        if isinstance(e, Bin) and e.op in ("and", "or"):
            a, b = self.having(e.left, exprs), self.having(e.right, exprs)
            return a & b if e.op == "and" else a | b
        if isinstance(e, Un) and e.op == "not":
            return ~self.having(e.of, exprs)
        if isinstance(e, Between):
            return self.having(Bin(">=", e.of, e.low), exprs) & self.having(Bin("<=", e.of, e.high), exprs)
        if not isinstance(e, Bin) or e.op not in ("=", "!=", "<", "<=", ">", ">="):
            raise Refused("sql_unsupported", "a comparison of aggregates")
        sides = []
        for x in (e.left, e.right):
            if isinstance(x, Lit):
                sides.append(F.lit(x.value))
                continue
            call = self.aliased.get(x.name) if isinstance(x, Col) else x
            if not isinstance(call, Call) or call.name not in AGGREGATES:
                raise Refused("sql_unsupported", "an aggregate or a number")
            if call.name == "avg" or call.name == "sum" and self.resolve(call.args[0])[1].kind.startswith("float") and self.strict:
                raise Refused("sql_unsupported", "averages and sums of floats aren't compared")
            name = next((n for n, c in self.by_name.items() if c == call), None)
            if name is None:
                raise Refused("sql_unsupported", "HAVING names aggregates of the select list")
            sides.append(F.col(name))
        if isinstance(e.left, Lit) and isinstance(e.right, Lit):
            raise Refused("sql_unsupported", "two numbers")
        x, y = sides
        return F.coalesce({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op], F.lit(False))

    strict = False

    # --- shapes
    def frame_of(self) -> tuple[DataFrame, list[str]]:
        """The result with columns c0_, c1_, …, in its order, and the names to show."""
        s = self.select
        if s.joins:
            return joined(self.catalog, s, self)
        windows = any(isinstance(i.expr, Call) and i.expr.over is not None for i in s.items)
        aggregates = any(Parser.has_aggregate(i.expr) for i in s.items)
        if any(isinstance(i.expr, Star) for i in s.items) and (aggregates or windows or s.group):
            raise Refused("sql_window_shape" if windows else "sql_unsupported", "* stands alone")
        if windows and (s.group or aggregates):
            raise Refused("sql_window_shape" if s.group else "sql_unsupported", "windows are over records")
        if s.group:
            return self.groups()
        if aggregates:
            return self.row()
        if s.having is not None:
            raise Refused("sql_unsupported", "HAVING without aggregates")
        if s.offset:
            raise Refused("sql_unsupported", "OFFSET is for groups")
        return self.projection()

    def shown(self) -> list[str]:
        return [i.alias or default_name(i) for i in self.select.items]

    def row(self) -> tuple[DataFrame, list[str]]:
        s = self.select
        if s.order:
            raise Refused("sql_unsupported_order", "one row has no order")
        if s.limit is not None or s.offset:
            raise Refused("sql_unsupported", "LIMIT of one row")
        for i in s.items:
            if not Parser.has_aggregate(i.expr) or any(c.table != "agg_" for c in columns_in(walk(i.expr, lambda e: Col("x", "agg_") if isinstance(e, Call) and e.name in AGGREGATES else None))):
                raise Refused("sql_unsupported", "aggregates and columns don't mix without GROUP BY")
        self.aliased = {i.alias: i.expr for i in s.items if i.alias}
        measures, exprs = self.collect([i.expr for i in s.items])
        test = self.having(s.having, self.aliased) if s.having is not None else None
        out = whole(self.records(), measures)
        if test is not None:
            out = out.where(test)
        names = unique(s.items)
        return out.select(*[self.after(e, {}).alias(n) for e, n in zip(exprs, names, strict=True)]), self.shown()

    def keys(self) -> list[tuple[str, Column, Field | None]]:
        s, out = self.select, []
        by_alias = {i.alias: i.expr for i in s.items if i.alias}
        s.group = [by_alias.get(g.name, g) if isinstance(g, Col) and g.table is None and g.name in by_alias else g for g in s.group]
        for k, g in enumerate(s.group):
            if isinstance(g, Col):
                column, f = self.resolve(g)
                out.append((f"k{k}_", column, f))
            elif Parser.bucket(g):
                out.append((f"k{k}_", truncated(unit_of(g.args[0]), self.scalars.typed(g.args[1])).column, None))
            else:
                raise Refused("sql_group_expression", "columns and date_trunc")
        return out

    def groups(self) -> tuple[DataFrame, list[str]]:
        s = self.select
        keys = self.keys()
        self.aliased = {i.alias: i.expr for i in s.items if i.alias}
        order = [self.aliased.get(o.expr.name, o.expr) if isinstance(o.expr, Col) and o.expr.table is None else o.expr for o in s.order]
        exprs = [i.expr for i in s.items]
        measures, swapped = self.collect(exprs + [o for o in order if Parser.has_aggregate(o)])
        if len(measures) > len(self.collect(exprs)[0]):
            raise Refused("sql_unsupported_order", "ORDER BY names the select list")
        measures, swapped = self.collect(exprs + [o for o in order if Parser.has_aggregate(o)])
        named = {g: f"k{k}_" for k, g in enumerate(s.group)}
        test = self.having(s.having, self.aliased) if s.having is not None else None
        rows = self.records()
        names = unique(s.items)
        if s.sets is not None:
            out = grouping_sets(rows, keys, s.sets, measures)
            by = ["set_", *[F.col(n).asc_nulls_last() for n, _, _ in keys]]
            if test is not None:
                out = out.where(test)
            out = out.orderBy(*by) if self.catalog.ordered else out
            return out.select(*[self.after(e, named).alias(n) for e, n in zip(swapped, names, strict=False)]), self.shown()
        out = grouped(rows, keys, measures)
        if test is not None:
            out = out.where(test)
        by = [F.col(n).asc_nulls_last() for n, _, _ in keys]
        first = None
        if s.order:
            first = self.after(self.collect_again(order[0]), named) if Parser.has_aggregate(order[0]) else self.order_key(order[0], named)
            by = [first.desc_nulls_last() if s.order[0].descending else first.asc_nulls_last(), *by]
        out = self.cut(out, by, first)
        return out.select(*[self.after(e, named).alias(n) for e, n in zip(swapped, names, strict=False)]), self.shown()

    def collect_again(self, e: Any) -> Any:
        names = {call: name for name, call in self.by_name.items()}
        return walk(e, lambda x: Col(names[x], "agg_") if isinstance(x, Call) and x in names else None)

    def order_key(self, e: Any, named: dict[Any, str]) -> Column:
        for key, name in named.items():
            if self.same_key(key, e):
                return F.col(name)
        raise Refused("sql_unsupported_order", "a key or an aggregate of the select list")

    def cut(self, out: DataFrame, by: list[Column], key: Column | None = None) -> DataFrame:
        """Order, then skip, then take, with the ties of the last row taken if asked for; key is what the first ordering compares. What the statement doesn't order is sorted for a catalog with ordered answers only."""
        s = self.select
        if not (s.order or s.offset or s.ties or s.limit is not None or self.catalog.ordered):
            return out
        ranked = out.orderBy(*by)
        if s.ties and s.limit:
            # one row sets the value up to which rows are kept; none, or one without a value, keeps all
            edge = ranked.offset(s.offset + s.limit - 1).limit(1).select(key.alias("v")).agg(F.max("v").alias("edge_"))
            rest = ranked.offset(s.offset) if s.offset else out
            far = key >= F.col("edge_") if s.order[0].descending else key <= F.col("edge_")
            return rest.join(F.broadcast(edge)).where(F.col("edge_").isNull() | far).drop("edge_").orderBy(*by)
        out = ranked.offset(s.offset) if s.offset else ranked
        return out.limit(s.limit) if s.limit is not None else out

    def projection(self) -> tuple[DataFrame, list[str]]:
        s = self.select
        items = s.items
        if len(items) == 1 and isinstance(items[0].expr, Star):
            items = [Item(Col(f.name), None, f.name) for f in self.source.fields]
            if not items:
                items = [Item(Col(ID), None, ID)]
        elif any(isinstance(i.expr, Star) for i in items):
            raise Refused("sql_unsupported", "* stands alone")
        for i in items:
            if not columns_in(i.expr) and not isinstance(i.expr, Call):
                raise Refused("sql_unsupported", "an expression reads a column")
        names = unique(items)
        rows = self.records()
        columns = []
        for i in items:
            if isinstance(i.expr, Call) and i.expr.over is not None:
                columns.append(window_column(i.expr, self.scalars, ID if self.source.has_ids else None))
            elif isinstance(i.expr, Col):
                columns.append(self.resolve(i.expr)[0])
            else:
                columns.append(self.scalars.column(i.expr))
        keep = [F.col(ID)] if self.source.has_ids else []
        out = rows.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], *keep)
        shown = [i.alias or default_name(i) for i in items]
        by = [F.col(ID)] if self.source.has_ids else []
        key = None
        if s.order:
            e = s.order[0].expr
            at = next((k for k, i in enumerate(items) if i.alias and isinstance(e, Col) and e.name == i.alias), None)
            if at is None:
                at = next((k for k, i in enumerate(items) if i.expr == e or isinstance(e, Col) and isinstance(i.expr, Col) and e.name.lower() == i.expr.name.lower()), None)
            if at is None:
                raise Refused("sql_unsupported_order", "ORDER BY names an output column")
            key = c = F.col(names[at])
            by = [c.desc_nulls_last() if s.order[0].descending else c.asc_nulls_last(), *by]
        if by:
            out = self.cut(out, by, key)
        elif s.limit is not None:
            out = out.limit(s.limit)
        return out.select(*names), shown


def numbers(spark: SparkSession, s: Select) -> tuple[DataFrame, list[str]]:
    item = s.items[0].expr
    if len(s.items) > 1 or not (isinstance(item, Star) or isinstance(item, Col) and item.name.lower() == "number") or s.where is not None or s.group or s.order or s.limit is not None or s.joins:
        raise Refused("sql_unsupported", "SELECT number FROM numbers(n)")
    return spark.range(s.numbers).select(F.col("id").alias("c0_")), [s.items[0].alias or "number"]


def compile_query(catalog: Catalog, query: Query) -> DataFrame:
    """The rows of a query; the branches of a UNION ALL under the names of the first, and one after the other for a catalog with ordered answers."""
    parts = []
    for s in query.branches:
        if s.numbers is not None:
            parts.append(numbers(catalog.spark, s))
        elif s.table.lower().startswith("system."):
            parts.append(catalog.system(s))
        else:
            parts.append(Selecting(catalog, s).frame_of())
    width = len(parts[0][1])
    if any(len(names) != width for _, names in parts):
        raise Refused("sql_union", "branches of one width")
    if len(parts) == 1:
        out = parts[0][0]
    elif not catalog.ordered:
        out = reduce(DataFrame.union, [f for f, _ in parts])
    else:
        own = [f.withColumn("branch_", F.lit(k)).withColumn("place_", F.monotonically_increasing_id()) for k, (f, _) in enumerate(parts)]
        out = reduce(DataFrame.union, own).orderBy("branch_", "place_").drop("branch_", "place_")
    shown = parts[0][1]
    doubled = {n for n in shown if shown.count(n) > 1}
    return out.toDF(*[n if n not in doubled or not getattr(catalog, "distinct_names", False) else f"{n}_{k}" for k, n in enumerate(shown)])
