"""Live queries, micro-batched writes and replay, on Structured Streaming.

A live query answers again after each batch and tells when the answer has changed: windows, rollups and
joins of the dialect don't stream, so each trigger runs the statement as a batch over what has arrived.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyhouse.engine import Engine
from tallyhouse.refusal import Refused
from tallyhouse.sources import writes
from tallyhouse.sql.nodes import Query
from tallyhouse.sql.parser import parse

#: Milliseconds between the triggers of a live query at least and at most.
FASTEST, SLOWEST = 50, 300_000


class Watch:
    """A statement that is asked again after each batch; told(answer, batch) is called when its rows differ from the last ones told."""

    def __init__(self, engine: Engine, text: str, told: Callable[[DataFrame, int], None], role: str | None = None):
        if not isinstance(parse(text), Query):
            raise Refused("sql_read_only", "live queries are SELECTs")
        self.engine, self.text, self.told, self.role = engine, text, told, role
        self.last: tuple | None = None

    def mark(self, answer: DataFrame) -> tuple:
        """A digest of the answer's rows, whatever their order: their number and the sum of their hashes."""
        h = F.xxhash64(*[F.col(f"`{c}`") for c in answer.columns]) if answer.columns else F.lit(0)
        return tuple(answer.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first())

    def ask(self, batch: int) -> bool:
        """Ask, check the grant again, and tell if the answer has changed."""
        answer = self.engine.sql(self.text, role=self.role).persist()  # for the digest and the telling
        try:
            mark = self.mark(answer.toDF(*[f"c{i}" for i in range(len(answer.columns))]))
            if mark == self.last:
                return False
            self.last = mark
            self.told(answer, batch)
            return True
        finally:
            answer.unpersist()


def watch(engine: Engine, text: str, stream: DataFrame, told: Callable[[DataFrame, int], None], interval: int = 1000, checkpoint: str | None = None, role: str | None = None) -> StreamingQuery:
    """Ask text after each micro-batch of stream, every interval milliseconds at most; what the batches hold doesn't matter, as text reads its own tables."""
    if not FASTEST <= interval <= SLOWEST:
        raise Refused("bad_argument", f"{FASTEST} to {SLOWEST} ms")
    own = Watch(engine, text, told, role)
    writer = stream.writeStream.foreachBatch(lambda _, k: own.ask(k)).trigger(processingTime=f"{interval} milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def ingest(engine: Engine, table: str, stream: DataFrame, checkpoint: str, dedup: str | None = None, interval: int = 200, once: bool = False) -> StreamingQuery:
    """Append a stream's rows to a managed table, with the next record ids, batch by batch.

    Columns go to fields by name. With dedup, rows whose key in that field the table already has are left
    out, so that a batch that comes again after a failure changes nothing.
    """
    t = engine.store.writable(table)
    names = [f.name for f in t.fields if f.name in stream.columns]

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.select(*names)
        if dedup is not None:
            rows = rows.dropDuplicates([dedup])
            held = engine.store.frame(engine.store.table(table)).select(F.col(dedup).alias("held_")).distinct()
            rows = rows.join(held, F.col(dedup) == F.col("held_"), "left_anti")
        writes.insert_select(engine.store, table, names, rows)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} milliseconds")).start()


def settled(query: StreamingQuery) -> None:
    """Wait until what has arrived is written: what is read then sees it."""
    query.processAllAvailable()


def running_counts(stream: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window of event time, with late rows dropped behind a watermark; for append or update output."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def replayed(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Events written to a managed table by a stream that reads them in batches, and the last answer that a watch over it tells."""
    from tallyhouse.queries import folder

    root = folder(spark)
    schema: StructType = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = f"{root}/incoming"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(batches).write.parquet(source)
    engine = Engine(spark, root)
    engine.sql("CREATE TABLE arrived (event_type MUTEX, cents DECIMAL(18, 2), at DATETIME)")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).select("event_type", F.col("value").cast("decimal(18,2)").alias("cents"), F.col("ts").alias("at"))
    answers: list[DataFrame] = []
    own = Watch(engine, "SELECT event_type, count(*) AS n, sum(cents) AS total FROM arrived GROUP BY event_type", lambda df, _: answers.append(df))

    def write(batch: DataFrame, k: int) -> None:
        writes.insert_select(engine.store, "arrived", ["event_type", "cents", "at"], batch.select("event_type", "cents", "at"))
        own.ask(k)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/progress-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return answers[-1] if answers else engine.sql(own.text)


