"""Following log files as they grow: a streaming source of new lines, stateful assembly with an idle timeout, and the loop into a table."""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.assemble import assemble
from ..sources.formats import Parser
from ..sources.store import Merged

#: A line of a file: the byte it starts at, in an epoch of the file (a file that shrank starts a new one).
LINES = "source_file string, epoch int, at long, text string"
_SCHEMA = pa.schema([("source_file", pa.string()), ("epoch", pa.int32()), ("at", pa.int64()), ("text", pa.string())])


@dataclass
class Stretch(InputPartition):
    """The lines of a file that start in a range of its bytes, up to the byte ``stop`` where the batch ends."""

    path: str
    epoch: int
    first: int
    last: int
    stop: int


class TailReader(DataSourceStreamReader):
    """New whole lines of files, in stretches of bytes that tasks read for themselves; an unfinished last line waits.

    The driver sees sizes, and of each file that grew the few bytes up to its last line end. Offsets are bytes and the
    epoch. Where a query is started again, the first batch learns of a file that shrank meanwhile when it is planned.
    """

    def __init__(self, options: dict):
        self.pattern, self.stretch = options["path"], int(options.get("stretch", 16 << 20))
        self.seen: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(self.pattern)):
            size, old = os.path.getsize(path), self.seen.get(path, {"offset": 0, "epoch": 0, "size": 0})
            shrank = size < old["size"]
            low = 0 if shrank else old["offset"]
            self.seen[path] = {"offset": self._line_end(path, low, size), "epoch": old["epoch"] + shrank, "size": size}
        return {p: json.dumps({k: v[k] for k in ("offset", "epoch")}) for p, v in self.seen.items()}

    @staticmethod
    def _line_end(path: str, low: int, size: int, step: int = 1 << 16) -> int:
        """The byte after the last line end before ``size``, ``low`` without one after it."""
        with open(path, "rb") as f:
            while size > low:
                begin = max(low, size - step)
                f.seek(begin)
                at = f.read(size - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                size = begin
        return low

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, told in end.items():
            new, old = json.loads(told), json.loads(start.get(path, '{"offset": 0, "epoch": 0}'))
            low, stop, epoch = old["offset"], new["offset"], new["epoch"]
            if epoch < old["epoch"] or (epoch == old["epoch"] and stop < low):  # shrank while no query looked
                epoch = old["epoch"] + 1
                if path in self.seen:
                    self.seen[path]["epoch"] = epoch
            if epoch != old["epoch"]:
                low = 0
            out += [Stretch(path, epoch, a, min(a + self.stretch, stop), stop) for a in range(low, stop, self.stretch)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """A line belongs to the stretch in which it starts: a stretch skips the end of the line before it and reads its last line to the end."""
        name, at = os.path.basename(partition.path), partition.first
        with open(partition.path, "rb") as f:
            if at > 0:
                f.seek(at - 1)
                at += len(f.readline(partition.stop - at + 1)) - 1
            f.seek(at)
            while at < partition.last:
                lines = f.readlines(1 << 20) if partition.last - at > 1 << 20 else [f.readline()]
                starts = at + np.r_[0, np.cumsum([len(x) for x in lines])]
                kept = [(int(s), x) for s, x in zip(starts[:-1], lines, strict=True) if s < partition.last and s + len(x) <= partition.stop]
                if not kept:
                    return
                texts = [x.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for _, x in kept]
                n = len(kept)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([partition.epoch] * n, pa.int32()), pa.array([s for s, _ in kept], pa.int64()), pa.array(texts)], schema=_SCHEMA)
                at = int(starts[-1])

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the query's own checkpoint."""


class TailSource(DataSource):
    """``spark.readStream.format("log_tail").option("path", "/logs/*.log").load()``; option ``stretch``: bytes a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, stretch: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", path).option("stretch", str(stretch)).load()


EVENT = "source_file string, epoch int, sequence long, line_number long, line_count int, lines array<string>"
_STATE = "sequence long, number long, next long, first long, lines array<string>"


def _millis(idle: str) -> int:
    return int(idle.split()[0]) * {"second": 1000, "seconds": 1000, "minute": 60000, "minutes": 60000}[idle.split()[1]]


def assemble_stream(lines: DataFrame, parser: Parser, idle: str = "5 seconds") -> DataFrame:
    """Events (their lines) out of a stream of LINES: an event is given out when the next header of its file comes, or when nothing came for ``idle``.

    State, for each file and epoch: the counts of events and lines, the byte up to which lines were taken, and the lines of
    the open event. A line before that byte was taken already and is passed over, so a batch may come twice. After a
    timeout further lines without a header make an event of their own, with their own line number.
    """
    wait = _millis(idle)
    marked = lines.withColumn("header", parser(F.col("text")).isNotNull())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, number, taken, first, held = (*state.get[:4], list(state.get[4])) if state.exists else (0, 0, 0, 0, [])
        closed: list[tuple[int, list[str]]] = []
        if state.hasTimedOut:
            closed, held = [(first, held)] if held else [], []
        else:
            rows = pd.concat(list(batches)).drop_duplicates("at").sort_values("at")
            rows = rows[rows["at"] >= taken]
            text = rows["text"].tolist()
            # the lines between two headers are an event; those before the first belong to the open one
            cuts = np.flatnonzero(rows["header"].to_numpy(bool)).tolist()
            before = text[: cuts[0] if cuts else len(text)]
            first = first if held else number + 1
            held += before
            for a, b in zip(cuts, [*cuts[1:], len(text)][: len(cuts)], strict=True):
                if held:
                    closed.append((first, held))
                first, held = number + a + 1, text[a:b]
            number += len(text)
            taken = max(taken, int(rows["at"].max()) + 1 if len(rows) else 0)
        state.update((sequence + len(closed), number, taken, first, held))
        if held:
            state.setTimeoutDuration(wait)
        if closed:
            yield pd.DataFrame([(*key, sequence + i, at, len(x), x) for i, (at, x) in enumerate(closed)], columns=["source_file", "epoch", "sequence", "line_number", "line_count", "lines"])

    return marked.groupBy("source_file", "epoch").applyInPandasWithState(step, EVENT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_lines(events: DataFrame, dataset_id: str) -> DataFrame:
    """Lines of complete events again, for operators.assemble within a micro-batch (foreachBatch)."""
    return events.select(F.lit(dataset_id).alias("dataset_id"), "source_file", F.posexplode("lines").alias("i", "text"), "line_number").select("dataset_id", "source_file", (F.col("line_number") + F.col("i")).cast("int").alias("line_no"), "text")


def follow(lines: DataFrame, parser: Parser, dataset_id: str, link: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, idle: str = "5 seconds", every: str = "2 seconds", share: float = 0.5) -> StreamingQuery:
    """The whole loop: lines to events, events through ``link`` (matching, frames) into the merged table at ``table``, by log_id.

    A batch adds a folder with its own rows to the table (see store.Merged; ``share`` is when it is compacted), so its cost
    does not grow with the table; a batch that is repeated after a failure brings the same ids with the same rows. Offsets
    and open events are in the checkpoint; ``drain`` gives out what is open when the loop is to end.
    """
    merged = Merged(lines.sparkSession, table, "log_id")

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        batch.persist()
        try:
            events = assemble(to_lines(batch, dataset_id), parser).drop("sequence")
            numbered = batch.select("source_file", F.col("line_number").cast("int").alias("line_number"), "sequence")
            merged.write(link(events.join(numbered, ["source_file", "line_number"])), merged.next_batch())
            merged.compact(share)
        finally:
            batch.unpersist()

    return assemble_stream(lines, parser, idle).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(query: StreamingQuery, again: Callable[[], StreamingQuery], idle: str = "5 seconds", most: float = 300) -> None:
    """Ends a loop and gives out its open events: stops ``query``, runs the same loop (``again``, on the same checkpoint) until nothing has come for ``idle``, and stops it.

    The timeouts of open events are part of the checkpoint, so after ``idle`` without lines every file is flushed. Lines that still come are taken; an error after ``most`` seconds without such a pause.
    """
    query.stop()
    running, began = again(), time.time()
    try:
        quiet = None
        while running.isActive and time.time() - began < most:
            told = running.lastProgress
            if told is not None and told["numInputRows"] == 0 and all(s["numRowsUpdated"] == 0 for s in told["stateOperators"]):
                quiet = quiet or time.time()
                if time.time() - quiet > _millis(idle) / 1000 + 1:
                    return
            else:
                quiet = None
            time.sleep(0.2)
        if running.exception() is not None:
            raise running.exception()
        raise TimeoutError(f"lines still came after {most} seconds")
    finally:
        running.stop()
