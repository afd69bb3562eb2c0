"""Import of facts: lines of a field, a record and a value."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.kinds import Field
from tallyhouse.plans.select import ID
from tallyhouse.refusal import Refused
from tallyhouse.sources.store import Store
from tallyhouse.sources.writes import upsert

#: Bytes of files that one chunk of a load takes in, if more than one.
CHUNK_BYTES = 1 << 30


def read_facts(lines: DataFrame) -> DataFrame:
    """field, record, value and place (which orders them) of lines (value, place) that hold three parts divided by spaces; blank lines go, others stop the import."""
    parts = F.split(F.trim("value"), r"\s+", 3)
    found = lines.where(F.length(F.trim("value")) > 0).select(parts.alias("p"), "place")
    bad = F.raise_error(F.concat(F.lit("bad_fact: "), F.array_join("p", " ")))
    return found.select(
        F.when(F.size("p") == 3, F.col("p")[0]).otherwise(bad).alias("field"),
        F.when(F.size("p") == 3, F.col("p")[1].cast("long")).otherwise(bad).alias("record"),
        F.when(F.size("p") == 3, F.col("p")[2]).otherwise(bad).alias("value"), "place",
    )


def placed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of text files, ordered by file name, then place: splits of one file by their offset, the lines of a split as they are read."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(paths).select("value", at.alias("place"))


def value_of(f: Field) -> Column:
    """A fact's text as the field's value: decimals come in stored units, a time quantum as key@seconds."""
    v = F.col("value")
    if f.kind == "decimal":
        return (v.cast("decimal(38,0)") / F.lit(10**f.scale)).cast(f.spark_type)
    if f.kind == "date":
        return F.when(v.rlike(r"^-?\d+$"), F.date_from_unix_date(v.try_cast("int"))).otherwise(v.try_cast("date"))
    if f.kind == "datetime":
        return F.when(v.rlike(r"^-?\d+$"), F.timestamp_seconds(v.try_cast("long"))).otherwise(v.try_cast("timestamp"))
    if f.kind == "timequantum":
        at = F.regexp_extract(v, r"@(-?\d+)$", 1)
        key = F.when(at != "", F.regexp_replace(v, r"@-?\d+$", "")).otherwise(v)
        return F.struct(key.alias("key"), F.when(at != "", F.timestamp_seconds(at.try_cast("long"))).alias("at"))
    if f.kind == "enum":
        return F.when(v.isin(*f.members), v).otherwise(F.raise_error(F.concat(F.lit(f"unknown_member: {f.name} "), v)))
    if f.multiple:
        return v
    return v.cast(f.spark_type)


def import_facts(store: Store, name: str, lines: DataFrame, load: tuple[str, str] | None = None) -> int:
    """Merge facts into a table: the last value of a record's field holds, several keys add up; how many facts came.

    lines has a column value, and one place that orders them, else they count as they come. They are parsed
    once, into a folder of their own, and read from there. load: a load's name and the file that it then has
    reached, which becomes true together with the facts.
    """
    t = store.writable(name)
    if "place" not in lines.columns:
        lines = lines.withColumn("place", F.monotonically_increasing_id())
    staged = f"staged/{uuid.uuid4().hex}"
    read_facts(lines).write.parquet(f"{store.root}/{staged}")
    facts = store.spark.read.parquet(f"{store.root}/{staged}")
    try:
        n, top = facts.agg(F.count(F.lit(1)), F.max("record")).first()
        known = [f.name for f in t.fields]
        unknown = facts.where(~F.col("field").isin(*known)).select("field").limit(1).collect()
        if unknown:
            raise Refused("unknown_field", unknown[0][0])
        if n:
            columns = []
            for f in t.fields:
                own = F.when(F.col("field") == f.name, value_of(f))
                columns.append((F.collect_set(own) if f.multiple else F.max_by(own, F.when(F.col("field") == f.name, F.col("place")))).alias(f.name))
            rows = facts.groupBy(F.col("record").alias(ID)).agg(*columns)
            upsert(store, name, rows.select(ID, *[F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if f.multiple else F.col(f.name) for f in t.fields]))
            t.next_id = max(t.next_id, top + 1)
        if load:
            t.loads[load[0]] = load[1]
        if n or load:
            store.save()
    finally:
        path, fs = store._path(staged)
        fs.delete(path, True)
    return n


def files(store: Store, path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of the files in a folder, by name."""
    p = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(store.spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((x.getPath().toString(), x.getLen()) for x in found if x.isFile() and not x.getPath().getName().startswith(("_", ".")))


def import_files(store: Store, name: str, path: str) -> int:
    return import_facts(store, name, placed(store.spark, [path]))


def load_files(store: Store, name: str, path: str, load: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Import the files of a folder by name, some chunk_bytes of them at a time (a file at least).

    How far a load of this name has come stands in the catalog beside the facts themselves, so one that
    failed goes on behind the last chunk that is in, and none counts twice. Later files may arrive meanwhile,
    under later names.
    """
    done, n, chunk, size = store.writable(name).loads.get(load, ""), 0, [], 0
    waiting = [x for x in files(store, path) if x[0].rsplit("/", 1)[1] > done]
    for k, (file, length) in enumerate(waiting):
        chunk.append(file)
        size += length
        if k + 1 == len(waiting) or size + waiting[k + 1][1] > chunk_bytes:
            n += import_facts(store, name, placed(store.spark, chunk), (load, file.rsplit("/", 1)[1]))
            chunk, size = [], 0
    return n
