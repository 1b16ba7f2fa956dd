"""Change data subscriptions: filters, a serializer and a sink over a stream or batch of change events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.ingest import debezium
from tidemark.operators.changes import table_filter


@dataclass
class Subscription:
    """Events have event_type, schema, table, lsn, ts_ms, before and after."""

    name: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    format: str = "json"
    query: StreamingQuery | None = None

    def wanted(self, events: DataFrame) -> DataFrame:
        df = events.where(table_filter(F.concat_ws(".", "schema", "table"), self.include, self.exclude))
        return df.where(F.col("event_type").isin(self.kinds)) if self.kinds else df

    def serialized(self, events: DataFrame) -> DataFrame:
        """(key, value): the table's name and the event as JSON."""
        df = self.wanted(events)
        if self.format == "debezium":
            value = debezium(F.col("event_type"), F.col("before"), F.col("after"), F.col("schema"), F.col("table"), F.col("lsn"), F.col("ts_ms"))
        else:
            value = F.to_json(F.struct(*[c for c in events.columns]))
        return df.select(F.concat_ws(".", "schema", "table").alias("key"), value.alias("value"))

    def to_files(self, events: DataFrame, path: str, checkpoint: str, max_records: int = 1_000_000) -> StreamingQuery:
        w = self.serialized(events).select("value").writeStream.queryName(self.name).format("text").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", max_records)
        self.query = w.trigger(availableNow=True).start()
        return self.query

    def to_kafka(self, events: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
        w = self.serialized(events).writeStream.queryName(self.name).format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
        self.query = w.start()
        return self.query

    def to_each(self, events: DataFrame, send, checkpoint: str) -> StreamingQuery:
        """send(rows, batch_id) for each micro-batch, such as posts to a web hook; a repeated batch has the same number."""
        self.query = self.serialized(events).writeStream.queryName(self.name).foreachBatch(send).option("checkpointLocation", checkpoint).start()
        return self.query

    def to_folder(self, events: DataFrame, path: str, checkpoint: str, max_records: int = 1_000_000, max_files: int | None = None) -> StreamingQuery:
        """As to_files, a folder for each micro-batch; of more than max_files folders the oldest go."""

        def write(df: DataFrame, number: int) -> None:
            df.select("value").write.mode("overwrite").option("maxRecordsPerFile", max_records).text(f"{path}/batch={number:012d}")
            if max_files:
                spark = df.sparkSession
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
                names = sorted(s.getPath().getName() for s in fs.listStatus(at))
                for old in [n for n in names if n.startswith("batch=")][:-max_files]:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)

        self.query = self.serialized(events).writeStream.queryName(self.name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        return self.query

    def to_url(self, events: DataFrame, url: str, checkpoint: str, headers: dict[str, str] | None = None, timeout: float = 10, retries: int = 3) -> StreamingQuery:
        """Posts each event to a web hook, from the tasks; the batch fails, and is sent again, if a post fails for good."""
        headers = {"Content-Type": "application/json"} | (headers or {})

        def send(rows) -> None:
            from urllib.request import Request, urlopen

            for r in rows:
                for attempt in range(retries + 1):
                    try:
                        urlopen(Request(url, r.value.encode(), headers), timeout=timeout).close()
                        break
                    except OSError:
                        if attempt == retries:
                            raise

        return self.to_each(events, lambda df, number: df.foreachPartition(send), checkpoint)

    def stop(self) -> None:
        if self.query:
            self.query.stop()

    pause = stop

    def status(self) -> str:
        return "created" if not self.query else "running" if self.query.isActive else "stopped"

    def lag(self) -> int | None:
        """Rows of the last micro-batch."""
        return self.query.lastProgress["numInputRows"] if self.query and self.query.lastProgress else None


@dataclass
class Subscriptions:
    """Subscriptions by name, each with how it is started; its checkpoint says where it goes on."""

    known: dict[str, tuple[Subscription, Callable[[Subscription], StreamingQuery]]] = field(default_factory=dict)

    def create(self, subscription: Subscription, start: Callable[[Subscription], StreamingQuery]) -> Subscription:
        if subscription.name in self.known:
            raise ValueError(f"there is a subscription {subscription.name}")
        self.known[subscription.name] = subscription, start
        return subscription

    def start(self, name: str) -> StreamingQuery:
        s, start = self.known[name]
        return s.query if s.query and s.query.isActive else start(s)

    resume = start

    def pause(self, name: str) -> None:
        self.known[name][0].stop()

    stop = pause

    def restart(self, name: str) -> StreamingQuery:
        self.pause(name)
        return self.start(name)

    def drop(self, name: str) -> None:
        self.pause(name)
        del self.known[name]

    def list(self) -> dict[str, dict]:
        return {n: {"status": s.status(), "lag": s.lag()} for n, (s, _) in self.known.items()}
