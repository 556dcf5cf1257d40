"""The audit log as a stream: entries as they are appended, chained to those before, and the latest one of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import jsontext
from ..operators import audit

FIELDS = "timestamp string, operation string, commit string, page string, outcome string, content_hash string, prev_hash string, entry_hash string"


def follow(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the entries of JSON lines that files below ``path`` gain; lines that are no JSON have null fields and keep their text in ``raw``."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path).where("value != ''")
    return raw.select(F.col("value").alias("raw"), F.from_json("value", FIELDS).alias("e")).select("raw", "e.*")


def latest(entries: DataFrame) -> DataFrame:
    """The latest generated entry of each page, by time: one row of state for each page."""
    good = entries.where("operation = 'generate' and coalesce(content_hash, '') != '' and outcome != 'error'")
    return good.groupBy("page").agg(F.max_by(F.struct("timestamp", "commit", "outcome", "content_hash"), "timestamp").alias("e")).select("page", "e.*")


def counts(entries: DataFrame, lateness: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Entries by window of time, operation and outcome; entries later than ``lateness`` are no longer counted."""
    timed = entries.where("timestamp is not null").withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window).alias("window"), "operation", "outcome").agg(F.count("*").alias("n"))


class Appender(StatefulProcessor):
    """Chains the new entries of each log to its last one; the state of a log is its last position and hash."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, entry_hash string")

    def handleInputRows(self, key, rows, timers):
        import pandas as pd

        before = self.last.get() if self.last.exists() else (None, None)
        at, link = before
        new = pd.concat(list(rows), ignore_index=True)
        out = []
        for seq, body in sorted(zip(new["seq"].tolist(), new["body"].tolist(), strict=True)):
            if at is not None and seq <= at:
                continue  # this entry is in the log already
            prev, link = link, audit.entry_hash(jsontext.parsed(body) | {"prev_hash": link})
            at = seq
            out.append((key[0], seq, body, prev, link))
        if out:
            self.last.update((at, link))
        yield pd.DataFrame(out, columns=["log", "seq", "body", "prev_hash", "entry_hash"]).astype({"log": "int64", "seq": "int64"})

    def close(self) -> None:
        pass


def appended(entries: DataFrame, fields: list[str], by: str = "log", order: str = "seq") -> DataFrame:
    """A stream of entries, chained: (log, seq, body, prev_hash, entry_hash), each position of a log once.

    ``entries`` is a stream with the columns ``fields`` whose rows have a place ``order``
    in their log ``by`` (both longs). Batches come in the order of these places: an entry
    at a place not beyond its log's last one counts as there already and adds nothing, so
    a batch that comes again changes nothing. The
    state of a log is one row, kept in the checkpoint; of the new entries of one log a
    task holds those of a micro-batch, which the source's rate bounds.
    """
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = entries.where(F.col(order).isNotNull() & F.col(by).isNotNull()).select(F.col(by).cast("long").alias("log"), F.col(order).cast("long").alias("seq"), body.alias("body"))
    return rows.groupBy("log").transformWithStateInPandas(statefulProcessor=Appender(), outputStructType="log long, seq long, body string, prev_hash string, entry_hash string", outputMode="Append", timeMode="None")


def append_to(chained: DataFrame, path: str, checkpoint: str, **trigger):
    """Write chained entries as JSON lines below ``path``, each once: the file sink commits a batch's files by its log.

    A line is the entry with its two hashes; the lines' parsed values are what was hashed.
    """
    line = F.concat(F.expr("left(body, char_length(body) - 1)"), F.lit(',"prev_hash":'), F.coalesce(F.concat(F.lit('"'), "prev_hash", F.lit('"')), F.lit("null")), F.lit(',"entry_hash":"'), "entry_hash", F.lit('"}'))
    out = chained.select("log", "seq", line.alias("raw"))
    return out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
