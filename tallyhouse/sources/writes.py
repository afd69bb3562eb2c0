"""INSERT, UPDATE, DELETE and imports as rewrites of Parquet versions."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.kinds import Field, stored
from tallyhouse.operators.predicates import Predicates
from tallyhouse.plans.select import ID
from tallyhouse.refusal import Refused
from tallyhouse.sources.store import Store, Table


def field_named(t: Table, name: str) -> Field:
    for f in t.fields:
        if f.name.lower() == name.lower():
            return f
    raise Refused("unknown_field", name)


def newer(f: Field, old: Column, new: Column) -> Column:
    """What a field holds after a write: several keys add up, other values take the old one's place."""
    if f.multiple:
        return F.when(new.isNull(), old).when(old.isNull(), F.array_distinct(new)).otherwise(F.array_union(old, new))
    return F.coalesce(new, old)


def insert_values(store: Store, name: str, columns: list[str], rows: list[list[Any]], overwrite: bool = False) -> int:
    """Rows of literals. Records that exist keep the fields that aren't named; rows without ids get the next ones."""
    t = store.writable(name)
    fields = [None if c.lower() == ID else field_named(t, c) for c in columns]
    if overwrite:
        t.next_id = 1
    given = ID in [c.lower() for c in columns]
    merged: dict[int, dict[str, Any]] = {}
    for row in rows:
        values = {f.name: stored(f, v) for f, v in zip(fields, row, strict=True) if f is not None}
        at = next((v for f, v in zip(fields, row, strict=True) if f is None), None)
        if at is None:
            at, t.next_id = t.next_id, t.next_id + 1
        own = merged.setdefault(at, {})
        for f in fields:
            if f is not None:
                own[f.name] = own[f.name] + values[f.name] if f.multiple and f.name in own else values[f.name]
    t.next_id = max(t.next_id, 1 + max(merged, default=0))
    data = [tuple([i, *(v.get(f.name) for f in t.fields)]) for i, v in merged.items()]
    frame = store.spark.createDataFrame(data, t.schema)
    if overwrite:
        store.replace(name, frame)
    elif given and t.parts:
        upsert(store, name, frame)
    else:
        store.append(name, frame)
    store.save()
    return len(rows)


def upsert(store: Store, name: str, new: DataFrame) -> None:
    """Merge rows with distinct ids into a table; plainly appended when none of the ids is there."""
    t = store.table(name)
    old = store.frame(t)
    if old.join(F.broadcast(new.select(ID)) if new.count() <= 100_000 else new.select(ID), ID, "left_semi").isEmpty():
        store.append(name, new)
        return
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{ID}") == F.col(f"b.{ID}"), "full")
    store.replace(name, both.select(F.coalesce(f"b.{ID}", f"a.{ID}").alias(ID), *[newer(f, F.col(f"a.`{f.name}`"), F.col(f"b.`{f.name}`")).alias(f.name) for f in t.fields]))


def numbered(rows: DataFrame, first: int) -> tuple[DataFrame, int]:
    """rows with ids from first on, without gaps and in their order, and how many they are; rows is read from a written table."""
    held = rows.withColumn("m_", F.monotonically_increasing_id()).withColumn("p_", F.shiftright("m_", 33))
    counts = held.groupBy("p_").agg(F.count(F.lit(1)).alias("n_"))
    # one row for each partition
    starts = counts.select("p_", (F.sum("n_").over(Window.orderBy("p_")) - F.col("n_")).alias("s_"))
    total = counts.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    out = held.join(F.broadcast(starts), "p_").withColumn(ID, F.col("s_") + F.col("m_").bitwiseAND((1 << 33) - 1) + first)
    return out.drop("m_", "p_", "s_"), total


def insert_select(store: Store, name: str, columns: list[str], rows: DataFrame, overwrite: bool = False) -> int:
    """Rows of a query, under the next ids. Float cells are refused, as are more or fewer columns."""
    t = store.writable(name)
    fields = [field_named(t, c) for c in columns]
    if len(rows.columns) != len(fields):
        raise Refused("sql_insert_shape", "as many columns as named")
    for c, f in zip(rows.schema, fields, strict=True):
        if isinstance(c.dataType, (T.FloatType, T.DoubleType)):
            raise Refused("sql_insert_shape", f"{f.name} from a float")
    # the source is read before anything of the target goes
    staged = f"{store.root}/staged/{uuid.uuid4().hex}"
    plain = rows.toDF(*[f"c{i}_" for i in range(len(fields))])
    plain.write.parquet(staged)
    held = store.spark.read.schema(plain.schema).parquet(staged)
    if overwrite:
        t.next_id = 1
    out, n = numbered(held, t.next_id)
    given = {f.name: F.col(f"c{i}_") for i, f in enumerate(fields)}

    def cell(f: Field) -> Column:
        c = given.get(f.name)
        if c is None:
            return F.lit(None).cast(f.spark_type)
        single = not isinstance(plain.schema[f"c{[x.name for x in fields].index(f.name)}_"].dataType, T.ArrayType)
        if f.kind == "timequantum":
            return F.when(c.isNotNull(), F.array(F.struct(c.cast("string").alias("key"), F.lit(None).cast("timestamp").alias("at"))))
        return F.when(c.isNotNull(), F.array(c.cast("string"))) if f.multiple and single else checked(f, c)

    frame = out.select(ID, *[cell(f).alias(f.name) for f in t.fields])
    if overwrite:
        store.replace(name, frame)
    else:
        store.append(name, frame)
    t.next_id += n
    store.save()
    path, fs = store._path(staged.removeprefix(f"{store.root}/"))
    fs.delete(path, True)
    return n


def checked(f: Field, c: Column) -> Column:
    """The value cast to the field's type; one that doesn't fit stops the write."""
    if f.kind in ("int", "signed"):
        low, high = (0, 2**f.bits - 1) if f.kind == "int" else (-(2 ** (f.bits - 1)), 2 ** (f.bits - 1) - 1)
        wide = c.cast("decimal(38,0)")
        return F.when(wide.isNull() | wide.between(low, high), c).otherwise(F.raise_error(F.lit(f"value_out_of_range: {f.name}"))).cast(f.spark_type)
    if f.kind == "enum":
        return F.when(c.isNull() | c.isin(*f.members), c).otherwise(F.raise_error(F.lit(f"unknown_member: {f.name}")))
    return c.cast(f.spark_type)


def condition(store: Store, t: Table, where: Any) -> Column:
    def resolve(c: Any) -> tuple[Column, Field]:
        if c.name.lower() == ID:
            return F.col(ID), Field(ID, "signed", 64)
        f = field_named(t, c.name)
        return F.col(f"`{f.name}`"), f

    return Predicates(resolve).sure(where)


def guarded(store: Store, name: str, test: Column, settings: dict[str, int]) -> int:
    """How many records a write is going to change. Only max_delete_records bounds them: a rewrite holds no ids, and readers keep the old version until it is done."""
    n = store.frame(store.table(name)).where(test).count()
    most = settings.get("max_delete_records")
    if most is not None and n > most:
        raise Refused("sql_delete_too_large", f"{n} records")
    return n


def delete(store: Store, name: str, where: Any, settings: dict[str, int]) -> int:
    t = store.writable(name)
    test = condition(store, t, where)
    if n := guarded(store, name, test, settings):
        store.replace(name, store.frame(t).where(~test))
        store.save()
    return n


def delete_ids(store: Store, name: str, ids: DataFrame) -> int:
    """Delete the records whose ids stand in the first column of ids."""
    t = store.writable(name)
    gone = ids.select(ids[ids.columns[0]].cast("long").alias(ID)).distinct()
    n = store.frame(t).join(gone, ID, "left_semi").count()
    if n:
        store.replace(name, store.frame(t).join(gone, ID, "left_anti"))
        store.save()
    return n


def update(store: Store, name: str, sets: list[tuple[str, Any]], where: Any, settings: dict[str, int]) -> int:
    t = store.writable(name)
    changed = {}
    for c, v in sets:
        f = field_named(t, c)
        if f.kind in ("set", "timequantum"):
            raise Refused("sql_update_column", f"{c} holds several keys")
        changed[f.name] = F.lit(stored(f, v)).cast(f.spark_type)
    test = condition(store, t, where)
    if n := guarded(store, name, test, settings):
        rows = store.frame(t)
        store.replace(name, rows.select(ID, *[F.when(test, changed[f.name]).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in changed else F.col(f"`{f.name}`") for f in t.fields]))
        store.save()
    return n


def records(store: Store, name: str, after: int | None = None, limit: int = 1000) -> DataFrame:
    """A page of record ids, ascending, behind a cursor."""
    rows = store.frame(store.table(name)).select(ID)
    return (rows if after is None else rows.where(F.col(ID) > after)).orderBy(ID).limit(limit)
