"""Joins on one shared key, answered without making pairs.

Each side is first aggregated by the key: how many records hold it, and the sums and extremes asked for.
These small tables are joined, and each key stands for the product of its counts. A missing key of an
optional side counts once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.kinds import Field
from tallyhouse.functions.scalars import Scalars
from tallyhouse.operators.predicates import Predicates, conjuncts
from tallyhouse.refusal import Refused
from tallyhouse.sql.nodes import Bin, Call, Col, InSelect, Join, Lit, Select, Un

ID = "_record_id"


@dataclass
class Side:
    alias: str
    table: str
    source: Any
    required: bool = True
    key: str | None = None
    where: list[Any] = field(default_factory=list)

    def resolve(self, c: Col) -> tuple[Column, Field]:
        f = self.source.field(c.name)
        return F.col(f"`{f.name}`"), f


class Sides:
    def __init__(self, catalog: Any, s: Select):
        self.catalog, self.select = catalog, s
        self.sides = [Side(s.alias, s.table, catalog.source(s.table))]
        for j in s.joins:
            self.add(j)
        if len({x.alias for x in self.sides}) < len(self.sides):
            raise Refused("sql_ambiguous_column", "two sides of one name")
        for term in conjuncts(s.where) if s.where is not None else []:
            own = {self.of(c).alias for c in columns(term)}
            if len(own) != 1:
                raise Refused("sql_join_filter" if own else "sql_unsupported", "a condition names one side")
            side = self.side(own.pop())
            side.where.append(term)
            side.required = True

    def side(self, name: str | None) -> Side:
        for x in self.sides:
            if name is not None and name == x.alias:
                return x
        raise Refused("sql_ambiguous_column", str(name))

    def of(self, c: Col) -> Side:
        return self.side(c.table)

    def add(self, j: Join) -> None:
        new = Side(j.alias, j.table, self.catalog.source(j.table), j.how in ("inner", "right"))
        pair = {j.left.table: j.left, j.right.table: j.right}
        if j.alias not in pair or len(pair) != 2:
            raise Refused("sql_join_condition", "each join names its own table and one before it")
        theirs = next(c for t, c in pair.items() if t != j.alias)
        known = next((x for x in self.sides if x.alias == theirs.table), None)
        if known is None:
            raise Refused("sql_join_condition", f"no table {theirs.table} before it")
        mine = pair[j.alias]
        for side, c in ((known, theirs), (new, mine)):
            f = side.source.field(c.name)
            if side.key is not None and side.key != f.name:
                raise Refused("sql_join_condition", "one key for all tables")
            side.key = f.name
        if known is not self.sides[0] and self.sides[0].key is None:
            raise Refused("sql_join_condition", "one key for all tables")
        if j.how in ("right", "full"):
            for x in self.sides:
                x.required = False
        self.sides.append(new)

    def frame(self, side: Side) -> DataFrame:
        """The side's records that its conditions keep, with the key as key_; those without the key, and all but one of a record's equal keys, go."""
        out = side.source.frame
        predicates = Predicates(side.resolve, lambda v: self.catalog.view_condition(v, side.table))
        rest = []
        for term in side.where:
            minus = isinstance(term, Un) and term.op == "not" and isinstance(term.of, InSelect)
            rest.append(term)
            if isinstance(term, InSelect) or minus:
                raise Refused("sql_join_filter", "no membership inside a join")
        if rest:
            out = out.where(predicates.all_of(rest))
        c, f = side.resolve(Col(side.key))
        if f.kind == "timequantum":
            c = F.transform(c, lambda x: x["key"])
        return out.withColumn("key_", F.explode(F.array_distinct(c)) if f.multiple else c).where("key_ is not null")


def columns(e: Any) -> list[Col]:
    from tallyhouse.plans.select import columns_in

    return columns_in(e)


def by_record(s: Select, catalog: Any) -> Select | None:
    """A join on a record id as a membership: the first table's records whose column holds an id of the other's kept records."""
    ids = [j for j in s.joins if ID in (j.left.name.lower(), j.right.name.lower())]
    if not ids:
        return None
    terms = conjuncts(s.where) if s.where is not None else []
    for j in s.joins:
        if j not in ids:
            raise Refused("sql_join_condition", "keys and record ids don't mix")
        mine, theirs = (j.left, j.right) if j.left.name.lower() == ID else (j.right, j.left)
        if mine.table != j.alias or theirs.table != s.alias:
            raise Refused("sql_join_condition", "first.column = second._record_id")
        if j.how in ("right", "full"):
            raise Refused("sql_no_outer_joins", "inner and left")
        own = [t for t in terms if {c.table for c in columns(t)} == {j.alias}]
        terms = [t for t in terms if t not in own]
        if own or j.how == "inner":
            inner = None
            for t in own:
                inner = t if inner is None else Bin("and", inner, t)
            terms.append(InSelect(Col(theirs.name, s.alias), j.table, unqualified(inner, j.alias)))
    if any({c.table for c in columns(t)} - {s.alias} for t in terms if not isinstance(t, InSelect)):
        raise Refused("sql_join_filter", "a condition names one side")
    where = None
    for t in terms:
        where = t if where is None else Bin("and", where, t)
    return Select(s.items, s.table, s.alias, [], where, s.group, s.sets, s.having, s.order, s.limit, s.offset, s.ties)


def unqualified(e: Any, alias: str) -> Any:
    """e with the columns of one table written without it."""
    import dataclasses

    if isinstance(e, Col):
        return Col(e.name) if e.table == alias else e
    if dataclasses.is_dataclass(e):
        return dataclasses.replace(e, **{f.name: unqualified(getattr(e, f.name), alias) for f in dataclasses.fields(e)})
    if isinstance(e, tuple):
        return tuple(unqualified(x, alias) for x in e)
    return e


def joined(catalog: Any, s: Select, selecting: Any) -> tuple[DataFrame, list[str]]:
    """Columns c0_, c1_, … and the names to show, of a SELECT over joined tables."""
    from tallyhouse.plans.select import AGGREGATES, Selecting, default_name, walk
    from tallyhouse.sql.parser import Parser

    if any(isinstance(i.expr, Call) and i.expr.over is not None for i in s.items):
        raise Refused("sql_window_shape", "no windows over joins")
    if (single := by_record(s, catalog)) is not None:
        return Selecting(catalog, single).frame_of()
    sides = Sides(catalog, s)
    if s.sets is not None:
        raise Refused("sql_unsupported", "no rollups over joins")
    found: list[Call] = []

    def swap(e: Any) -> Any:
        if isinstance(e, Call) and e.over is None and e.name in AGGREGATES:
            if e.where is not None:
                raise Refused("sql_join_filter", "FILTER inside a join")
            if e not in found:
                found.append(e)
            return Col(f"m{found.index(e)}_", "agg_")
        return None

    exprs = [walk(i.expr, swap) for i in s.items]
    if not found and not s.group:
        raise Refused("sql_unsupported", "joins are aggregated")
    wanted: dict[str, list[tuple[str, Call]]] = {x.alias: [] for x in sides.sides}
    for k, call in enumerate(found):
        if call.name == "count":
            continue
        c = call.args[0]
        side = sides.of(c)
        f = side.source.field(c.name)
        if call.name == "uniq":
            if f.name != side.key:
                raise Refused("sql_unsupported", "distinct keys of the join only")
        elif call.name not in ("sum", "avg", "min", "max"):
            raise Refused("sql_unsupported", f"{call.name} over a join")
        elif f.keyed or f.kind == "bool" or f.temporal and call.name in ("sum", "avg"):
            raise Refused("operator_not_allowed", f"{call.name} of {f.name}")
        else:
            wanted[side.alias].append((f"m{k}_", call))
    for g in s.group:
        if not isinstance(g, Col) or sides.of(g).key != sides.of(g).source.field(g.name).name:
            raise Refused("sql_unsupported", "grouping by the key of the join only")

    out, needed = None, False
    for x in sides.sides:
        aggregates = [F.count(F.lit(1)).alias(f"n_{x.alias}")]
        for name, call in wanted[x.alias]:
            c = x.resolve(call.args[0])[0]
            if call.name == "avg":
                c = c.cast("double")
            aggregates.append((F.sum(c) if call.name in ("sum", "avg") else F.min(c) if call.name == "min" else F.max(c)).alias(name))
        own = sides.frame(x).groupBy("key_").agg(*aggregates)
        if out is None:
            out, needed = own, x.required
        else:
            how = {(True, True): "inner", (True, False): "left", (False, True): "right", (False, False): "full"}[needed, x.required]
            out, needed = out.join(own, "key_", how), needed or x.required
    count = lambda x: F.coalesce(F.col(f"n_{x.alias}"), F.lit(1))

    def product(but: Side | None = None) -> Column:
        result = F.lit(1).cast("bigint")
        for x in sides.sides:
            if x is not but:
                result = result * count(x)
        return result

    measures = [product().alias("pairs_")]
    for k, call in enumerate(found):
        if call.name in ("sum", "avg"):
            side = sides.of(call.args[0])
            measures.append((F.coalesce(F.col(f"m{k}_"), F.lit(0)) * product(side)).alias(f"m{k}_"))
        elif call.name in ("min", "max"):
            measures.append(F.col(f"m{k}_"))
    rows = out.select("key_", *measures)

    def final(k: int, call: Call) -> Column:
        if call.name == "count":
            return F.coalesce(F.sum("pairs_"), F.lit(0))
        if call.name == "uniq":
            return F.count(F.lit(1))
        if call.name == "sum":
            return F.coalesce(F.sum(f"m{k}_"), F.lit(0))
        if call.name == "avg":
            return F.sum(f"m{k}_") / F.nullif(F.sum("pairs_"), F.lit(0))
        return (F.min if call.name == "min" else F.max)(f"m{k}_")

    totals = [final(k, c).alias(f"m{k}_") for k, c in enumerate(found)]
    selecting.by_name = {f"m{k}_": c for k, c in enumerate(found)}
    selecting.aliased = {i.alias: i.expr for i in s.items if i.alias}
    selecting.resolve = lambda c: sides.of(c).resolve(c)
    shown = [i.alias or default_name(i) for i in s.items]

    def resolve(c: Col) -> tuple[Column, Field]:
        if c.table == "agg_":
            call = selecting.by_name[c.name]
            f = Field(c.name, "signed", 64) if call.name in ("count", "uniq") else Field(c.name, "float64") if call.name == "avg" else selecting.resolve(call.args[0])[1]
            return F.col(c.name), f
        side = sides.of(c)
        f = side.source.field(c.name)
        if not s.group or f.name != side.key:
            raise Refused("sql_unsupported", f"{c.name} is no key of the join")
        return F.col("key_"), Field("key_", "mutex" if f.keyed else f.kind, f.bits, f.scale)

    scalars = Scalars(resolve)
    if s.group:
        out = rows.groupBy("key_").agg(*(totals or [F.count(F.lit(1)).alias("n_")]))
    else:
        if s.order or s.limit is not None or s.offset:
            raise Refused("sql_unsupported_order" if s.order else "sql_unsupported", "one row")
        for e in exprs:
            if any(c.table != "agg_" for c in columns(e)):
                raise Refused("sql_unsupported", "aggregates and columns don't mix without GROUP BY")
        out = rows.agg(*totals)
    if s.having is not None:
        out = out.where(selecting.having(s.having, selecting.aliased))
    if s.group:
        by: list[Any] = [F.col("key_").asc_nulls_last()]
        key = None
        if s.order:
            e = s.order[0].expr
            e = selecting.aliased.get(e.name, e) if isinstance(e, Col) and e.table is None else e
            if Parser.has_aggregate(e) and any(isinstance(c, Call) and c not in found for c in [e]):
                raise Refused("sql_unsupported_order", "an aggregate of the select list")
            key = scalars.column(walk(e, swap))
            by = [key.desc_nulls_last() if s.order[0].descending else key.asc_nulls_last(), *by]
        out = selecting.cut(out, by, key)
    return out.select(*[(scalars.column(e) if not isinstance(e, Lit) else F.lit(e.value)).alias(f"c{i}_") for i, e in enumerate(exprs)]), shown
