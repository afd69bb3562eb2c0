"""Aggregates over records: whole sets, groups, grouping sets, exact quantiles and top keys."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.kinds import Field
from tallyhouse.refusal import Refused


@dataclass
class Measure:
    """One aggregate: its name in the result, what it is, its column and the condition of its records."""

    name: str
    what: str  # count, sum, min, max, avg, uniq, quantile, topK
    column: Column | None = None
    field: Field | None = None
    where: Column | None = None
    level: Decimal | int | None = None

    def check(self) -> None:
        f = self.field
        if self.what in ("sum", "avg") and (f.keyed or f.temporal or f.kind == "bool"):
            raise Refused("operator_not_allowed", f"{self.what} of {f.name}")
        if self.what in ("min", "max") and (f.keyed or f.kind == "bool"):
            raise Refused("operator_not_allowed", f"{self.what} of {f.name}")
        if self.what == "quantile" and (f.keyed or f.temporal or f.kind == "bool"):
            raise Refused("operator_not_allowed", f"quantile of {f.name}")

    @property
    def of(self) -> Column:
        if self.column is None:
            return F.lit(1) if self.where is None else F.when(self.where, F.lit(1))
        return self.column if self.where is None else F.when(self.where, self.column)

    def spark(self) -> Column:
        """As an aggregate; sums over nothing are 0, and an average divides by all records, also those without the value."""
        x = self.of
        if self.what == "count":
            return F.count(x)
        if self.what == "sum":
            return F.coalesce(F.sum(x), zero(self.field))
        if self.what == "avg":
            n = F.count(F.lit(1) if self.where is None else F.when(self.where, F.lit(1)))
            return F.coalesce(F.sum(x.cast("double")), F.lit(0.0)) / F.nullif(n, F.lit(0))
        if self.what == "uniq":
            return F.countDistinct(x)
        return F.min(x) if self.what == "min" else F.max(x)


def zero(f: Field) -> Column:
    return F.lit(0.0) if f.kind.startswith("float") else F.lit(Decimal(0)) if f.kind == "decimal" or f.bits == 64 and f.kind == "int" else F.lit(0)


def rank_of(level: Decimal | int, n: int) -> int:
    return max(1, math.ceil(Decimal(level) * n))


#: Distinct values that one histogram brings to the driver.
FEW = 5000


def exact_quantile(df: DataFrame, column: str, level: Decimal) -> object:
    """The value at rank ceil(level * n), at least 1, of a whole DataFrame; None without values.

    Each pass sketches two quantiles close to the rank and counts what lies below and between them, until
    few distinct values lie between. The values are neither sorted nor gathered.
    """
    present = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    kind = present.schema["v"].dataType
    n = present.count()
    if not n:
        return None
    rank, low, high, below = rank_of(level, n), None, None, 0  # of the present values, below lie under low
    lit = lambda x: F.lit(x).cast(kind)
    while True:
        inside = present if low is None else present.where((F.col("v") >= lit(low)) & (F.col("v") <= lit(high)))
        size, distinct, least, most = inside.agg(F.count("v"), F.approx_count_distinct("v", 0.02), F.min("v"), F.max("v")).first()
        if distinct <= FEW or least == most:
            for v, times in sorted(inside.groupBy("v").count().collect()):
                below += times
                if below >= rank:
                    return v
        p = (rank - below) / size
        low, high = inside.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, p - 0.001)), F.lit(min(1.0, p + 0.001))), F.lit(10000))).first()[0]
        under, over = inside.agg(F.count(F.when(F.col("v") < lit(low), 1)), F.count(F.when(F.col("v") <= lit(high), 1))).first()
        if rank <= below + under:  # the sketch was off: below the bracket
            low, high = least, low
        elif rank > below + over:
            low, high = high, most
            below += inside.where(F.col("v") < lit(low)).count()
        else:
            below += under


#: How far the bracket of a group's quantile reaches to both sides, and the ranks that its sketch tells apart.
REACH, SKETCH = 0.001, 10_000


def group_quantile(rows: DataFrame, m: Measure, by: list[str]) -> DataFrame:
    """by and m's quantile of each group, without sorting a whole group in one task.

    A sketch gives each group a bracket of two values around the rank. The counts of values below it are
    summed, and only the values inside it are put in order; where the rank turns out to lie outside, all of
    the group's are.
    """
    present = rows.select(*by, m.of.alias("v_")).where("v_ is not null")
    level = float(m.level)
    ends = F.percentile_approx("v_", F.array(F.lit(max(0.0, level - REACH)), F.lit(min(1.0, level + REACH))), F.lit(SKETCH))
    brackets = present.groupBy(*by).agg(ends.alias("e_"), F.count(F.lit(1)).alias("n_"))
    counts = present.groupBy(*by, "v_").agg(F.count(F.lit(1)).alias("c_")).join(brackets, by)
    low, high = F.col("e_")[0], F.col("e_")[1]
    rank = F.greatest(F.ceil(F.lit(Decimal(m.level)) * F.col("n_")), F.lit(1))
    sums = counts.groupBy(*by).agg(F.sum(F.when(F.col("v_") < low, F.col("c_")).otherwise(0)).alias("below_"), F.sum(F.when(F.col("v_") <= high, F.col("c_")).otherwise(0)).alias("within_"))
    held = (F.col("below_") < rank) & (rank <= F.col("within_"))
    near = counts.join(sums, by).where(~held | F.col("v_").between(low, high))
    upto = F.sum("c_").over(Window.partitionBy(*by).orderBy("v_")) + F.when(held, F.col("below_")).otherwise(0)
    return near.withColumn("upto_", upto).where(F.col("upto_") >= rank).groupBy(*by).agg(F.min("v_").alias(m.name))


def single(measures: list[Measure]) -> tuple[list[Measure], list[Measure]]:
    """Those that one aggregation answers, and those that need their own: quantiles, top keys and distinct keys of multi-valued columns."""
    apart = [m for m in measures if m.what in ("topK", "quantile") or m.what == "uniq" and m.field is not None and m.field.multiple]
    return [m for m in measures if m not in apart], apart


def keys_of(df: DataFrame, m: Measure, by: list[str]) -> DataFrame:
    """by and a column key_ of each record, one row for each of its keys."""
    own = df if m.where is None else df.where(m.where)
    c = m.column
    if m.field.kind == "timequantum":
        c = F.transform(c, lambda x: x["key"])
    return own.select(*by, (F.explode(c) if m.field.multiple else c).alias("key_")).where("key_ is not null")


def whole(df: DataFrame, measures: list[Measure]) -> DataFrame:
    """One row over all records, which exists over none too."""
    for m in measures:
        if m.what not in ("count", "uniq", "topK"):
            m.check()
    plain, apart = single(measures)
    out = df.agg(*[m.spark().alias(m.name) for m in plain]) if plain else None
    for m in apart:
        if m.what == "quantile":
            of = df.select(m.of.alias("v"))
            own = df.sparkSession.range(1).select(F.lit(exact_quantile(of, "v", m.level)).cast(of.schema["v"].dataType).alias(m.name))
            out = own if out is None else out.join(F.broadcast(own))
            continue
        keys = keys_of(df, m, [])
        if m.what == "uniq":
            own = keys.agg(F.countDistinct("key_").alias(m.name))
        else:
            top = keys.groupBy("key_").count().orderBy(F.desc("count"), "key_").limit(m.level)
            ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "key_")))
            own = top.agg(F.transform(ranked, lambda x: x["key_"]).alias(m.name))
        # single rows side by side
        out = own if out is None else out.join(F.broadcast(own))
    return out.select(*[m.name for m in measures])


def grouped(df: DataFrame, keys: list[tuple[str, Column, Field | None]], measures: list[Measure]) -> DataFrame:
    """A row for each combination of keys that records have; a record is in one group for each key of a multi-valued column, and in none where a key is absent."""
    for m in measures:
        if m.what == "topK":
            raise Refused("sql_unsupported", "topK is for whole sets")
        if m.what not in ("count", "uniq"):
            m.check()
    names = [n for n, _, _ in keys]
    plain, apart = single(measures)
    rows = df
    for name, column, f in keys:
        if f is not None and f.kind == "timequantum":
            column = F.transform(column, lambda x: x["key"])
        rows = rows.withColumn(name, F.explode(F.array_distinct(column)) if f is not None and f.multiple else column)
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    out = rows.groupBy(*names).agg(*([m.spark().alias(m.name) for m in plain] or [F.count(F.lit(1)).alias("n_")]))
    for m in apart:
        if m.what == "quantile":
            out = out.join(group_quantile(rows, m, names), names, "left")
            continue
        own = keys_of(rows, m, names).groupBy(*names).agg(F.countDistinct("key_").alias(m.name))
        out = out.join(own, names, "left").withColumn(m.name, F.coalesce(m.name, F.lit(0)))
    return out.select(*names, *[m.name for m in measures])


def grouping_sets(df: DataFrame, keys: list[tuple[str, Column, Field | None]], sets: list[tuple[int, ...]], measures: list[Measure], inner: str = "set_") -> DataFrame:
    """The groups of each set, with null for the keys that it leaves out, and the set's number in column inner.

    Single-valued keys go through Spark's own grouping sets, in one pass. The empty set's row exists over
    no records too, which Spark's doesn't, and takes in records without the keys; for that a row goes along
    that no measure takes in, and that has no key.
    """
    names = [n for n, _, _ in keys]
    kinds = grouped(df.limit(0), keys, []).schema
    parts = []
    plain, apart = single(measures)
    one_pass = not apart and not any(f is not None and f.multiple for _, _, f in keys)
    some = [s for s in sets if s]
    if one_pass and len(some) > 1:
        for m in measures:
            if m.what not in ("count", "uniq"):
                m.check()
        rows = df
        for name, column, _ in keys:
            rows = rows.withColumn(name, column)
        chosen = some
        if len(some) < len(sets):
            chosen = sets
            none = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(True).alias("none_"))
            rows = rows.withColumn("none_", F.lit(False)).unionByName(none)
            measures = [replace(m, where=~F.col("none_") if m.where is None else ~F.col("none_") & m.where) for m in measures]
        # a set leaves out only records that lack one of its own keys
        tagged = rows.groupingSets([[names[i] for i in s] for s in chosen], *names).agg(F.grouping_id().alias("gid_"), *[m.spark().alias(m.name) for m in measures])
        number = {sum(1 << (len(names) - 1 - i) for i in range(len(names)) if i not in s): k for k, s in enumerate(sets)}
        pick = F.coalesce(*[F.when(F.col("gid_") == g, F.lit(k)) for g, k in number.items()])
        present = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(names[i]).isNotNull() for i in sets[k]], F.col("gid_") == g) for g, k in number.items()])
        return tagged.where(present).select(pick.alias(inner), *names, *[m.name for m in measures])
    else:
        for k, s in enumerate(sets):
            if s:
                own = grouped(df, [keys[i] for i in s], measures)
                parts.append(own.select(F.lit(k).alias(inner), *[F.col(n) if i in s else F.lit(None).cast(kinds[n].dataType).alias(n) for i, n in enumerate(names)], *[m.name for m in measures]))
    for k, s in enumerate(sets):
        if not s:
            own = whole(df, measures)
            parts.append(own.select(F.lit(k).alias(inner), *[F.lit(None).cast(kinds[n].dataType).alias(n) for n in names], *[m.name for m in measures]))
    return reduce(DataFrame.unionByName, parts)
