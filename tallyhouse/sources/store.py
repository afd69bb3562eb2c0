"""Managed tables: Parquet folders in versions, and a catalog file that names the current ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.kinds import Field, field_of
from tallyhouse.plans.select import ID, Source
from tallyhouse.refusal import Refused


#: Versions of the catalog that stay, and what the folder of a part's days ends in.
KEPT, DAYS = 5, ".days"


@dataclass
class Table:
    fields: list[Field]
    engine: str = "bitmap+columnar"
    parts: list[str] = field(default_factory=list)  # folders of the current version
    next_id: int = 1
    days_from: dict[str, str] = field(default_factory=dict)  # of a time quantum, the first day that is left
    loads: dict[str, str] = field(default_factory=dict)  # of a load in chunks, the last file that is in
    frame: DataFrame | None = None  # of an attached table
    has_ids: bool = True

    @property
    def attached(self) -> bool:
        return self.frame is not None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ID, T.LongType(), False), *(T.StructField(f.name, f.spark_type) for f in self.fields)])


def without_days(before: str) -> Callable[[Column], Column]:
    """Retention drops the days, not the keys: a pair whose day is gone is read without its time."""

    def pair(x: Column) -> Column:
        gone = F.coalesce(x["at"].cast("date") < F.lit(before).cast("date"), F.lit(False))
        return F.struct(x["key"].alias("key"), F.when(~gone, x["at"]).alias("at"))

    return pair


class Store:
    """Databases with their tables and views. With a root folder, managed tables and the catalog live there, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.databases: dict[str, dict[str, Table]] = {"default": {}}
        self.views: dict[str, str] = {}
        self.roles: dict[str, list[dict]] = {}
        self.current = "default"
        self.version = 0
        if root:
            self.load()

    # --- the catalog file
    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the catalog files that are there, ascending."""
        p, fs = self._path("catalog")
        if not fs.exists(p):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(p))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self) -> None:
        found = self.versions()
        if not found:
            return
        self.version = found[-1]
        p, _ = self._path(f"catalog/{self.version}.json")
        data = json.loads("".join(r[0] for r in self.spark.read.text(p.toString(), wholetext=True).collect()))
        self.databases = {d: {t: Table([Field.from_json(f) for f in x["fields"]], x["engine"], x["parts"], x["next_id"], x["days_from"], x.get("loads", {})) for t, x in tables.items()} for d, tables in data["databases"].items()}
        self.views, self.roles = data["views"], data["roles"]

    def save(self) -> None:
        """Write the next version of the catalog and rename it into place: readers see this one or the one before, and of two writers one fails."""
        if not self.root:
            return
        data = {
            "databases": {d: {t: {"fields": [f.as_json() for f in x.fields], "engine": x.engine, "parts": x.parts, "next_id": x.next_id, "days_from": x.days_from, "loads": x.loads} for t, x in tables.items() if not x.attached} for d, tables in self.databases.items()},
            "views": self.views,
            "roles": self.roles,
        }
        tmp, fs = self._path(f"catalog/{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()
        new, _ = self._path(f"catalog/{self.version + 1}.json")
        if fs.exists(new) or not fs.rename(tmp, new):
            fs.delete(tmp, False)
            raise Refused("catalog_changed", "another writer was faster; load() reads what it wrote")
        self.version += 1
        for old in self.versions()[:-KEPT]:
            fs.delete(self._path(f"catalog/{old}.json")[0], False)

    # --- names
    def split(self, name: str) -> tuple[str, str]:
        d, _, t = name.rpartition(".")
        return d or self.current, t

    def table(self, name: str) -> Table:
        d, t = self.split(name)
        found = self.databases.get(d, {}).get(t)
        if found is None:
            raise Refused("unknown_table" if d in self.databases else "unknown_database", name)
        return found

    def writable(self, name: str) -> Table:
        d, t = self.split(name)
        if f"{d}.{t}" in self.views:
            raise Refused("sql_read_only", "a view")
        found = self.table(name)
        if found.attached:
            raise Refused("sql_read_only", f"{name} is attached")
        if not self.root:
            raise Refused("sql_read_only", "the engine has no folder of its own")
        return found

    def attach(self, name: str, frame: DataFrame, record_id: str | None = None, kinds: dict[str, Field] | None = None) -> None:
        """Name a DataFrame as a table; record_id is the column that holds its ids. Times without a zone are read as UTC."""
        d, t = self.split(name)
        frame = frame.withColumns({c.name: F.col(f"`{c.name}`").cast("timestamp") for c in frame.schema if isinstance(c.dataType, T.TimestampNTZType)})
        fields = [(kinds or {}).get(c.name) or field_of(c) for c in frame.schema if c.name != record_id or record_id != ID]
        frame = frame.withColumn(ID, F.col(f"`{record_id}`").cast("long")) if record_id else frame
        self.databases.setdefault(d, {})[t] = Table(fields, frame=frame, has_ids=record_id is not None)

    # --- reading
    def frame(self, t: Table) -> DataFrame:
        if t.attached:
            return t.frame
        if not t.parts:
            return self.spark.createDataFrame([], t.schema)
        out = self.spark.read.schema(t.schema).parquet(*t.parts)
        for name, day in t.days_from.items():
            out = out.withColumn(name, F.transform(name, without_days(day)))
        return out

    def days(self, t: Table) -> dict[str, DataFrame]:
        """Of each time quantum of a managed table, key, record id and day of its values, from folders by day; days that retention dropped are left out."""
        out = {}
        for f in t.fields if not t.attached else []:
            if f.kind == "timequantum":
                schema = T.StructType([T.StructField("key", T.StringType()), T.StructField(ID, T.LongType()), T.StructField("day", T.DateType())])
                rows = self.spark.read.schema(schema).parquet(*[f"{p}{DAYS}/{f.name}" for p in t.parts]) if t.parts else self.spark.createDataFrame([], schema)
                out[f.name] = rows.where(F.col("day") >= F.lit(t.days_from[f.name]).cast("date")) if f.name in t.days_from else rows
        return out

    def source(self, name: str) -> Source:
        t = self.table(name)
        return Source(self.frame(t), t.fields, t.has_ids, self.days(t))

    # --- writing
    def new_part(self, name: str) -> str:
        d, t = self.split(name)
        return f"{self.root}/data/{d}/{t}/{uuid.uuid4().hex}"

    def write(self, t: Table, rows: DataFrame, part: str) -> None:
        """Rows as a folder of Parquet, and beside it the days of each time quantum, read back from what was written."""
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in t.schema]).write.parquet(part)
        for f in t.fields:
            if f.kind == "timequantum":
                pairs = self.spark.read.schema(t.schema).parquet(part).select(ID, F.explode(f"`{f.name}`").alias("p"))
                days = pairs.select(F.col("p.key").alias("key"), ID, F.to_date("p.at").alias("day")).where("day is not null").distinct()
                # a folder for a table without days too, which can be read like any other
                days.write.partitionBy("day").parquet(f"{part}{DAYS}/{f.name}")

    def append(self, name: str, rows: DataFrame) -> None:
        t = self.table(name)
        part = self.new_part(name)
        self.write(t, rows, part)
        t.parts = [*t.parts, part]

    def replace(self, name: str, rows: DataFrame | None) -> None:
        """The table's rows become these, which may read the old ones; the old folders stay until vacuum()."""
        t = self.table(name)
        parts = []
        if rows is not None:
            part = self.new_part(name)
            self.write(t, rows, part)
            parts = [part]
        t.parts = parts

    def vacuum(self, name: str) -> int:
        """Delete the folders of a table's earlier versions; how many went."""
        d, t = self.split(name)
        live = {p.rsplit("/", 1)[1] + x for p in self.table(name).parts for x in ("", DAYS)}
        p, fs = self._path(f"data/{d}/{t}")
        if not fs.exists(p):
            return 0
        old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName() not in live]
        for x in old:
            fs.delete(x, True)
        return len(old)
