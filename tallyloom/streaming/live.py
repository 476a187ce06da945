"""Live queries: a result that follows its table as files arrive."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyloom.sources.scratch import shared_folder


def follow(spark: SparkSession, folder: str, schema: StructType, query: Callable[[DataFrame], DataFrame], name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keeps an aggregate of a folder's Parquet files current, incrementally, in the in-memory table `name`. New parameters: stop it and follow anew."""
    stream = query(spark.readStream.schema(schema).parquet(folder)).writeStream.format("memory").queryName(name).outputMode("complete")
    return stream.option("checkpointLocation", checkpoint or shared_folder(spark)).start()


def on_change(spark: SparkSession, folder: str, schema: StructType, query: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs any batch query again over the whole folder with each batch of new files, and hands its result to emit."""
    again = lambda _, batch: emit(query(spark.read.schema(schema).parquet(folder)), batch)
    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).start()


def once(spark: SparkSession, path: str, schema: StructType, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Streams all that is there now through an aggregate and returns its final state, written in the shared folder: none of it goes to the driver."""
    folder = shared_folder(spark)
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern may name one file; a plain path has to be a folder
    result = query(spark.readStream.schema(schema).parquet(path))
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/state")
    stream = result.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/state")


class Shared:
    """One live query for many readers: it starts with the first, and ends `grace` seconds after the last has left.

    A reader that comes back in time finds the state as it was. start: makes the query.
    """

    def __init__(self, start: Callable[[], StreamingQuery], grace: float = 5.0):
        self._start, self._grace = start, grace
        self._lock, self._readers = threading.Lock(), 0
        self._query: StreamingQuery | None = None
        self._timer: threading.Timer | None = None

    def __enter__(self) -> StreamingQuery:
        with self._lock:
            self._readers += 1
            if self._timer:
                self._timer.cancel()
                self._timer = None
            if self._query is None:
                self._query = self._start()
            return self._query

    def __exit__(self, *_: object) -> None:
        with self._lock:
            self._readers -= 1
            if not self._readers:
                self._timer = threading.Timer(self._grace, self._stop)
                self._timer.daemon = True
                self._timer.start()

    def _stop(self) -> None:
        with self._lock:
            if not self._readers and self._query is not None:
                self._query.stop()
                self._query = None
