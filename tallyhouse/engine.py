"""The engine: SQL and calls in, DataFrames out."""

from __future__ import annotations

import threading
import uuid
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import access
from tallyhouse.functions.kinds import Field, parse_date
from tallyhouse.operators.predicates import conjuncts
from tallyhouse.plans import calls
from tallyhouse.plans.explain import explain
from tallyhouse.plans.select import ID, Selecting, Source, compile_query
from tallyhouse.refusal import Refused
from tallyhouse.sources import facts, formats, writes
from tallyhouse.sources.store import Store, Table
from tallyhouse.sql.nodes import Bin, Col, Lit, Query, Select, Star
from tallyhouse.sql.parser import Parser, parse

VIEW_DEPTH, VIEW_BYTES = 8, 4096
SHARD_BITS = 20

SYSTEM = {
    "tables": "database string, name string, type string, engine string, columns long",
    "columns": "database string, table string, name string, kind string, bit_depth int, scale int, granularity string",
    "databases": "name string, tables long",
    "parts": "node string, database string, table string, field string, view string, shard long, count long",
}


class Engine:
    """Tables of a store, and what can be asked of them.

    Answers are DataFrames whose plans are declared when sql() returns; they run when they are read.
    Statements that change something run at once and give one row. With ordered, rows that no ORDER BY
    sorts come by record or by group, at the price of a global sort; without, in any order.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, ordered: bool = False):
        self.spark, self.ordered = spark, ordered
        self.store = Store(spark, root)
        self.running: dict[str, str] = {}
        self.depth = 0

    # --- what plans need of a catalog
    def source(self, name: str) -> Source:
        d, t = self.store.split(name)
        if f"{d}.{t}" in self.store.views:
            return self.view_source(f"{d}.{t}")
        return self.store.source(name)

    def view_select(self, view: str) -> Select:
        d, t = self.store.split(view)
        text = self.store.views.get(f"{d}.{t}")
        if text is None:
            raise Refused("unknown_view", view)
        return parse(text).branches[0]

    def view_source(self, view: str) -> Source:
        """A view's records: those of its table that its condition keeps, with the columns that it names."""
        self.depth += 1
        try:
            if self.depth > VIEW_DEPTH:
                raise Refused("sql_view_depth", view)
            s = self.view_select(view)
            inner = Selecting(self, replace(s, limit=None))
            rows = inner.records()
            if len(s.items) == 1 and isinstance(s.items[0].expr, Star):
                return Source(rows, inner.source.fields, inner.source.has_ids, inner.source.days)
            columns, fields, olds = [], [], []
            for i in s.items:
                c, f = inner.resolve(i.expr)
                olds.append(f)
                columns.append(c.alias(i.alias or f.name))
                fields.append(replace(f, name=i.alias or f.name))
            days = {f.name: inner.source.days[old.name] for f, old in zip(fields, olds, strict=True) if old.name in inner.source.days}
            return Source(rows.select(*([F.col(ID)] if inner.source.has_ids else []), *columns), fields, inner.source.has_ids, days)
        finally:
            self.depth -= 1

    def view_condition(self, view: str, table: str) -> Any:
        s = self.view_select(view)
        if self.store.split(s.table) != self.store.split(table):
            raise Refused("sql_segment_table", f"{view} is of {s.table}")
        return s.where if s.where is not None else Lit(True)

    def system(self, s: Select) -> tuple[DataFrame, list[str]]:
        what = s.table.split(".", 1)[1].lower()
        if what not in SYSTEM:
            raise Refused("sql_system_table", s.table)
        if s.group or s.order or s.limit is not None or s.joins or s.having is not None:
            raise Refused("sql_system_clause", "columns, and WHERE database = and table =")
        out = self.system_table(what)
        for term in conjuncts(s.where) if s.where is not None else []:
            if not (isinstance(term, Bin) and term.op == "=" and isinstance(term.left, Col) and term.left.name in ("database", "table") and isinstance(term.right, Lit)):
                raise Refused("sql_system_clause", "WHERE database = and table =")
            out = out.where(F.col(term.left.name if term.left.name in out.columns else "name") == term.right.value)
        names = out.columns if isinstance(s.items[0].expr, Star) else [i.expr.name if isinstance(i.expr, Col) and i.expr.name in out.columns else self._no(i) for i in s.items]
        return out.select(*[F.col(n).alias(f"c{k}_") for k, n in enumerate(names)]), names if isinstance(s.items[0].expr, Star) else [i.alias or n for i, n in zip(s.items, names, strict=True)]

    @staticmethod
    def _no(item: Any) -> str:
        raise Refused("sql_system_clause" if not isinstance(item.expr, Col) else "unknown_field", item.text)

    def system_table(self, what: str) -> DataFrame:
        rows: list[tuple] = []
        dbs = self.store.databases
        if what == "tables":
            rows = [(d, t, "BASE TABLE", x.engine, len(x.fields)) for d, ts in dbs.items() for t, x in ts.items()]
            rows += [(v.split(".")[0], v.split(".")[1], "VIEW", "", len(self.source(v).fields)) for v in self.store.views]
        elif what == "columns":
            rows = [(d, t, *self.described(f)) for d, ts in dbs.items() for t, x in ts.items() for f in x.fields]
        elif what == "databases":
            rows = [(d, len(ts)) for d, ts in dbs.items()]
        else:
            parts = []
            for d, ts in dbs.items():
                for t, x in ts.items():
                    if x.has_ids and x.fields:
                        shard = F.shiftright(F.col(ID), SHARD_BITS).alias("shard")
                        counts = self.store.frame(x).groupBy(shard).agg(*[F.count(F.col(f"`{f.name}`")).alias(f"f{k}") for k, f in enumerate(x.fields)])
                        pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"f{k}").alias("count")) for k, f in enumerate(x.fields)]))
                        standard = counts.select("shard", pairs.alias("p")).select("p.field", F.lit("standard").alias("view"), "shard", "p.count")
                        # of a time quantum, a view for each day beside the one of all keys
                        views = [standard] + [days.groupBy(shard, "day").agg(F.countDistinct(ID).alias("count")).select(F.lit(f).alias("field"), F.date_format("day", "'standard_'yyyyMMdd").alias("view"), "shard", "count") for f, days in self.store.days(x).items()]
                        parts += [v.select(F.lit("spark").alias("node"), F.lit(d).alias("database"), F.lit(t).alias("table"), "field", "view", "shard", "count") for v in views]
            if parts:
                return reduce(DataFrame.unionByName, parts)
        return self.spark.createDataFrame(rows, SYSTEM[what])

    @staticmethod
    def described(f: Field) -> tuple:
        return f.name, f.kind, f.bits if f.bits is not None else 32, f.scale, "day" if f.kind == "timequantum" else None

    # --- entries
    def sql(self, text: str, database: str | None = None, role: str | None = None) -> DataFrame:
        """The answer of one statement. database is where unqualified names lie; role is checked against its grants."""
        held, self.store.current = self.store.current, database or self.store.current
        try:
            if self.store.current not in self.store.databases:
                raise Refused("unknown_database", self.store.current)
            statement = parse(text)
            access.allowed(self.store, role, statement)
            if isinstance(statement, Query):
                return self.query(statement)
            return getattr(self, "do_" + statement.verb.replace(" ", "_"))(statement.parts)
        finally:
            self.store.current = held

    def query(self, q: Query) -> DataFrame:
        out = compile_query(self, q)
        most = q.settings.get("max_result_rows")
        if most is not None:
            n = out.limit(most + 1).count()
            if n > most:
                raise Refused("result_too_large", f"more than {most} rows")
        return out

    def pql(self, table: str, text: str, database: str | None = None, role: str | None = None) -> DataFrame:
        """The answer of a call over one table."""
        held, self.store.current = self.store.current, database or self.store.current
        try:
            q = Query([calls.read(text, table)])
            access.allowed(self.store, role, q)
            return self.query(q)
        finally:
            self.store.current = held

    def collect(self, text: str, query_id: str | None = None, **options: Any) -> list[Row]:
        """Run a query under an id, by which kill() stops it, and within max_execution_time."""
        query_id = query_id or uuid.uuid4().hex
        statement = parse(text)
        seconds = statement.settings.get("max_execution_time") if isinstance(statement, Query) else None
        self.running[query_id] = text
        sc = self.spark.sparkContext
        sc.setJobGroup(query_id, text[:200], interruptOnCancel=True)
        timer = threading.Timer(seconds, sc.cancelJobGroup, [query_id]) if seconds else None
        if timer:
            timer.start()
        try:
            return self.sql(text, **options).collect()
        except Exception as e:
            if "cancel" in str(e).lower():
                raise Refused("query_cancelled", query_id) from e
            raise
        finally:
            if timer:
                timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
            self.running.pop(query_id, None)

    def kill(self, query_id: str) -> bool:
        found = query_id in self.running
        self.spark.sparkContext.cancelJobGroup(query_id)
        return found

    def render(self, text: str, **options: Any) -> str:
        """The answer as text, in the format that the statement names."""
        statement = parse(text)
        fmt = statement.format if isinstance(statement, Query) else statement.parts.get("format", "JSON")
        return formats.render(self.sql(text, **options), fmt)

    def bound(self, text: str, values: list[Any]) -> str:
        """The statement with its ? replaced by literals, in order."""
        from tallyhouse.sql.lexer import tokens

        out, at, rest = [], 0, list(values)
        for t in tokens(text):
            if t.kind == "op" and t.text == "?":
                if not rest:
                    raise Refused("bad_arity", "more ? than values")
                v = rest.pop(0)
                shown = "true" if v is True else "false" if v is False else f"'{str(v).replace(chr(39), chr(39) * 2)}'" if not isinstance(v, (int, float)) and not hasattr(v, "as_tuple") else str(v)
                out += [text[at : t.start], shown]
                at = t.end
        if rest:
            raise Refused("bad_arity", "more values than ?")
        return "".join([*out, text[at:]])

    def attach(self, name: str, frame: DataFrame, record_id: str | None = None, kinds: dict[str, Field] | None = None) -> None:
        self.store.attach(name, frame, record_id, kinds)

    def records(self, table: str, after: int | None = None, limit: int = 1000) -> DataFrame:
        return writes.records(self.store, table, after, limit)

    def import_facts(self, table: str, path: str) -> int:
        return facts.import_files(self.store, table, path)

    def load_facts(self, table: str, path: str, name: str, chunk_bytes: int = facts.CHUNK_BYTES) -> int:
        """Import the files of a folder in chunks, from where the load of this name stopped last; how many facts came this time."""
        return facts.load_files(self.store, table, path, name, chunk_bytes)

    def delete_ids(self, table: str, ids: DataFrame) -> int:
        return writes.delete_ids(self.store, table, ids)

    def seen(self, table: str, field: str, keys: DataFrame) -> DataFrame:
        """Those of keys (the first column) that some record has in a field, once each: what a sink asks before it writes."""
        source = self.source(table)
        f = source.field(field)
        own = F.col(f"`{f.name}`")
        own = F.explode(F.transform(own, lambda x: x["key"]) if f.kind == "timequantum" else own) if f.multiple else own
        name = keys.columns[0]
        return keys.select(name).distinct().join(source.frame.select(own.alias("held_")), F.col(name).eqNullSafe(F.col("held_")) & F.col(name).isNotNull(), "left_semi")

    def backup(self, path: str) -> None:
        """A copy of all managed tables and the catalog, from which Engine(spark, path) reads."""
        other = Store(self.spark, path)
        for d, ts in self.store.databases.items():
            other.databases.setdefault(d, {})
            for t, x in ts.items():
                if not x.attached:
                    other.databases[d][t] = replace(x, parts=[])
                    if x.parts:
                        other.append(f"{d}.{t}", self.store.frame(x))
        other.views, other.roles = dict(self.store.views), dict(self.store.roles)
        other.save()

    def compact(self, table: str) -> None:
        """Rewrite a table as one version, in record order."""
        x = self.store.writable(table)
        self.store.replace(table, self.store.frame(x).repartitionByRange(F.col(ID)).sortWithinPartitions(ID))
        self.store.save()

    def answer(self, name: str, n: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(n).cast("long").alias(name))

    # --- statements
    def do_explain(self, p: dict) -> DataFrame:
        compile_query(_Dry(self), p["query"])
        return self.spark.createDataFrame([(line,) for line in explain(p["query"], p["half"])], "explain string").coalesce(1)

    def do_create_database(self, p: dict) -> DataFrame:
        if p["name"] in self.store.databases:
            if not p["quiet"]:
                raise Refused("database_exists", p["name"])
            return self.answer("database", 0)
        self.store.databases[p["name"]] = {}
        self.store.save()
        return self.answer("database", 1)

    def do_drop_database(self, p: dict) -> DataFrame:
        own = self.store.databases.get(p["name"])
        if own is None:
            if not p["quiet"]:
                raise Refused("unknown_database", p["name"])
            return self.answer("dropped", 0)
        if p["name"] == "default":
            raise Refused("sql_read_only", "default stays")
        if own and not p["cascade"]:
            raise Refused("database_not_empty", p["name"])
        del self.store.databases[p["name"]]
        self.store.views = {k: v for k, v in self.store.views.items() if not k.startswith(p["name"] + ".")}
        self.store.save()
        return self.answer("dropped", 1)

    def free(self, name: str) -> tuple[str, str]:
        d, t = self.store.split(name)
        if d not in self.store.databases:
            raise Refused("unknown_database", d)
        if t in self.store.databases[d] or f"{d}.{t}" in self.store.views:
            raise Refused("table_exists", name)
        return d, t

    def do_create_table(self, p: dict) -> DataFrame:
        d, t = self.store.split(p["name"])
        if p["quiet"] and t in self.store.databases.get(d, {}):
            return self.answer("table", 0)
        self.free(p["name"])
        self.store.databases[d][t] = Table(list(p["fields"]), p["engine"])
        self.store.save()
        return self.answer("table", 1)

    def do_drop_table(self, p: dict) -> DataFrame:
        d, t = self.store.split(p["name"])
        if t not in self.store.databases.get(d, {}):
            if not p["quiet"]:
                raise Refused("unknown_table", p["name"])
            return self.answer("dropped", 0)
        del self.store.databases[d][t]
        self.store.save()
        return self.answer("dropped", 1)

    def do_truncate(self, p: dict) -> DataFrame:
        d, t = self.store.split(p["name"])
        if p["quiet"] and t not in self.store.databases.get(d, {}):
            return self.answer("truncated", 0)
        self.store.writable(p["name"]).next_id = 1
        self.store.replace(p["name"], None)
        self.store.save()
        return self.answer("truncated", 1)

    def do_exchange(self, p: dict) -> DataFrame:
        (d1, t1), (d2, t2) = self.store.split(p["one"]), self.store.split(p["two"])
        a, b = self.store.writable(p["one"]), self.store.writable(p["two"])
        self.store.databases[d1][t1], self.store.databases[d2][t2] = b, a
        self.store.save()
        return self.answer("exchanged", 2)

    def do_alter(self, p: dict) -> DataFrame:
        name, n = p["name"], 0
        t = self.store.writable(name)
        for what, x in p["steps"]:
            if what == "rename":
                d, new = self.free(x)
                old_d, old = self.store.split(name)
                self.store.databases[d][new] = self.store.databases[old_d].pop(old)
                name = x
                n += 1
            elif what == "add":
                if any(f.name.lower() == x.name.lower() for f in t.fields):
                    raise Refused("field_exists", x.name)
                t.fields.append(x)
                if x.kind == "timequantum" and t.parts:
                    self.store.replace(name, self.store.frame(t))  # so that each part has its days
                n += 1
            elif what == "drop":
                f = writes.field_named(t, x)
                # the column leaves the files too, so that a field of its name can come later
                t.fields.remove(f)
                if t.parts:
                    self.store.replace(name, self.store.frame(t))
                n += 1
            else:
                day, column = x
                f = writes.field_named(t, column)
                if f.kind != "timequantum":
                    raise Refused("operator_not_allowed", f"{column} has no days")
                t.days_from[f.name] = max(t.days_from.get(f.name, "0001-01-01"), parse_date(day).isoformat())
                n += 1
        self.store.save()
        return self.answer("fields", n)

    def do_create_view(self, p: dict) -> DataFrame:
        d, t = self.store.split(p["name"])
        key = f"{d}.{t}"
        if key in self.store.views and not p["replace"]:
            if p["quiet"]:
                return self.answer("view", 0)
            raise Refused("table_exists", p["name"])
        if key not in self.store.views:
            self.free(p["name"])
        q = p["query"]
        s = q.branches[0]
        plain = len(q.branches) == 1 and not (s.group or s.joins or s.order or s.having is not None or s.limit is not None or s.offset or s.sample or s.numbers is not None)
        if not plain or any(Parser.has_aggregate(i.expr) for i in s.items):
            raise Refused("sql_view_body", "columns of one table and a WHERE")
        if not (len(s.items) == 1 and isinstance(s.items[0].expr, Star)) and any(not isinstance(i.expr, Col) for i in s.items):
            raise Refused("sql_view_column", "bare columns")
        if len(p["text"].encode()) > VIEW_BYTES:
            raise Refused("sql_view_body", "too long")
        held = self.store.views.get(key)
        self.store.views[key] = p["text"]
        try:
            self.view_source(key)
        except Refused:
            if held is None:
                del self.store.views[key]
            else:
                self.store.views[key] = held
            raise
        self.store.save()
        return self.answer("view", 1)

    def do_drop_view(self, p: dict) -> DataFrame:
        key = ".".join(self.store.split(p["name"]))
        if key not in self.store.views:
            if not p["quiet"]:
                raise Refused("unknown_view", p["name"])
            return self.answer("dropped", 0)
        del self.store.views[key]
        self.store.save()
        return self.answer("dropped", 1)

    def do_insert(self, p: dict) -> DataFrame:
        if "rows" in p:
            n = writes.insert_values(self.store, p["name"], p["columns"], p["rows"], p["overwrite"])
        else:
            self.store.writable(p["name"])
            n = writes.insert_select(self.store, p["name"], p["columns"], compile_query(self, p["query"]), p["overwrite"])
        return self.answer("inserted", n)

    def do_delete(self, p: dict) -> DataFrame:
        return self.answer("deleted", writes.delete(self.store, p["name"], p["where"], p["settings"]))

    def do_update(self, p: dict) -> DataFrame:
        return self.answer("updated", writes.update(self.store, p["name"], p["sets"], p["where"], p["settings"]))

    def do_kill(self, p: dict) -> DataFrame:
        return self.answer("killed", int(self.kill(p["id"])))

    def do_create_role(self, p: dict) -> DataFrame:
        if p["name"] in self.store.roles:
            raise Refused("role_exists", p["name"])
        self.store.roles[p["name"]] = []
        self.store.save()
        return self.answer("role", 1)

    def do_drop_role(self, p: dict) -> DataFrame:
        if self.store.roles.pop(p["name"], None) is None and not p["quiet"]:
            raise Refused("unknown_role", p["name"])
        self.store.save()
        return self.answer("dropped", 1)

    def do_grant(self, p: dict) -> DataFrame:
        access.grant(self.store, p["role"], p["on"], p["privileges"])
        self.store.save()
        return self.answer("granted", len(p["privileges"]))

    def do_revoke(self, p: dict) -> DataFrame:
        access.revoke(self.store, p["role"], p["on"], p["privileges"])
        self.store.save()
        return self.answer("revoked", len(p["privileges"]))

    def do_show(self, p: dict) -> DataFrame:
        what, of = p["what"], p["of"]
        make = self.spark.createDataFrame
        if what == "tables":
            d = of or self.store.current
            if d not in self.store.databases:
                raise Refused("unknown_database", d)
            rows = [(t, "BASE TABLE", x.engine, len(x.fields)) for t, x in self.store.databases[d].items()]
            return make(rows, "name string, type string, engine string, fields long")
        if what == "views":
            d = of or self.store.current
            return make([(v.split(".", 1)[1], text) for v, text in self.store.views.items() if v.startswith(d + ".")], "name string, statement string")
        if what == "databases":
            return make([(d, len(ts)) for d, ts in self.store.databases.items()], "name string, tables long")
        if what == "columns":
            return make([self.described(f) for f in self.source(of).fields], "name string, kind string, bit_depth int, scale int, granularity string")
        if what in ("create", "create view"):
            key = ".".join(self.store.split(of))
            if key in self.store.views:
                return make([(f"CREATE VIEW {of} AS {self.store.views[key]}",)], "statement string")
            t = self.store.table(of)
            body = ",\n".join(f"    {f.name} {f.ddl}" for f in t.fields)
            return make([(f"CREATE TABLE {of} (\n{body}\n) ENGINE = '{t.engine}'",)], "statement string")
        if what == "roles":
            return make([(r,) for r in sorted(self.store.roles)], "role string")
        if what == "grants":
            rows = [(r, g["on"], ", ".join(g["privileges"])) for r, gs in sorted(self.store.roles.items()) for g in gs if of in (None, r)]
            return make(rows, "role string, object string, privileges string")
        return make(sorted(self.running.items()), T.StructType([T.StructField("id", T.StringType()), T.StructField("statement", T.StringType())]))


class _Dry:
    """A catalog whose tables have their fields but no records, to check a query without reading anything."""

    def __init__(self, engine: Engine):
        self.engine, self.spark, self.ordered = engine, engine.spark, engine.ordered

    def source(self, name: str) -> Source:
        own = self.engine.source(name)
        return Source(own.frame.limit(0), own.fields, own.has_ids, {f: x.limit(0) for f, x in own.days.items()})

    def view_condition(self, view: str, table: str) -> Any:
        return self.engine.view_condition(view, table)

    def system(self, s: Select) -> tuple[DataFrame, list[str]]:
        return self.engine.system(s)


