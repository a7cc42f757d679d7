"""Archives from arriving files, running checksums of arriving chunks, and the progress of both."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from packframe.sources import sinks


#: For a stream of files: else Spark lists a batch's files by a task for each, and reads four or so of them in a task.
FEW_TASKS = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "16", "spark.sql.files.openCostInBytes": "65536"}


def arriving_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """(path, content) of files as they arrive under root. The stream has a copy of the session, as Spark reads its settings from the one it was made in."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in FEW_TASKS.items():
        own.conf.set(k, v)
    reader = own.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", per_batch).load(root).select("path", "content")


def archive_stream(files: DataFrame, root: str, checkpoint: str, kind: str = "pack", archives: int = 8) -> StreamingQuery:
    """Each micro-batch becomes archives under root, in a folder of its number: a batch that runs twice writes the same files again. Ends when all that is there was read."""

    def write(batch: DataFrame, number: int) -> None:
        sinks.write_archives(batch, f"{root}/batch-{number:06d}", archives, kind).write.format("noop").mode("overwrite").save()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunningSums(StatefulProcessor):
    """Per key: entries, bytes, CRC-32 and Adler-32 of all chunks so far, in order of their number within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "entries long, bytes long, crc long, adler long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, size, crc, adler = self.state.get() if self.state.exists() else (0, 0, 0, 1)
        for part in rows:
            for content in part.sort_values("number")["content"]:
                content = bytes(content or b"")
                entries, size, crc, adler = entries + 1, size + len(content), zlib.crc32(content, crc), zlib.adler32(content, adler)
        self.state.update((int(entries), int(size), int(crc), int(adler)))
        yield pd.DataFrame([(key[0], entries, size, crc, adler)], columns=["key", "entries", "bytes", "crc", "adler"])

    def close(self) -> None:
        pass


SUMS = "key string, entries long, bytes long, crc long, adler long"


def running_sums(chunks: DataFrame) -> DataFrame:
    """A stream of (key, number, content) -> a row for each key whenever chunks of it arrive. The sums are state, so a restart goes on from them."""
    return chunks.groupBy("key").transformWithStateInPandas(RunningSums(), SUMS, "update", "none")


class Progress(StreamingQueryListener):
    """Tells a callback how far queries are: (batch, rows so far, step)."""

    def __init__(self, tell: Callable[[int, int, str], None]):
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        self.tell(0, 0, "started")

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.tell(event.progress.batchId, self.rows, "batch")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(-1, self.rows, "failed" if event.exception else "done")


def arrivals(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """An extension of ours: entries and bytes that arrive in each window, with a bound on how late they may be."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return x.agg(F.count("*").alias("entries"), F.sum(F.octet_length("props")).alias("bytes")).select(F.col("w.start").alias("start"), "event_type", "entries", "bytes")
