"""Landed pages and tiles of many logs as one source with a cursor for each log.

A fetcher outside Spark lands what it gets, a folder for each log:

    <log>/1200.json  or  log=<log>/start=1200/part-0.txt    a page, by its first index
    <log>/tile/data/x001/234  and  .../234.p/17             a data tile, a partial one

The stream's offset is the next index of every log, so one slow or broken log holds
up no other. With the options ``cursors`` (a file of its own for each query) and
``units`` a trigger takes at most so many pages or tiles of a log; what was admitted
is written before Spark logs the offset, so a restart never goes back behind it. Without
them a trigger takes all that is there. A file that cannot be read gives one row with
the error instead of failing the batch. Files are opened in tasks, by any scheme that
pyarrow knows; a partition holds up to PART_UNITS pages and tiles of about PART_BYTES.

    spark.dataSource.register(LandedLogs)
    spark.readStream.format("landed_logs").options(units=20, cursors=...).load(path)
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import decode

ROW = "log string, cert_index bigint, leaf_input binary, tile binary, cursor bigint, error string"
_ARROW = pa.schema([("log", pa.string()), ("cert_index", pa.int64()), ("leaf_input", pa.binary()), ("tile", pa.binary()), ("cursor", pa.int64()), ("error", pa.string())])
WIDTH = 256
#: Of one partition; fewer units while there are less than PARTS full ones.
PART_UNITS, PART_BYTES, PARTS = 200, 32 << 20, 32
#: Of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
_PAGE = re.compile(r"(?:start=)?(\d+)(?:\.json|/part-[^/]*)$")
_TILE = re.compile(r"tile/data/((?:x\d{3}/)*\d{3})(?:\.p/(\d+))?$")


@dataclass
class Unit:
    """A page or tile: the log's entries from ``first`` to before ``end``. The end of
    a page is known only when it is read, so its first entry stands for it."""

    log: str
    path: str
    first: int
    end: int
    tile: bool
    cursor: int = 0
    size: int = 0


@dataclass
class Part(InputPartition):
    """Units that one task reads."""

    units: list[Unit]


def unit(log: str, path: str, rest: str) -> Unit | None:
    """What a file below a log's folder holds; nothing for other files."""
    if m := _TILE.search(rest):
        first = int(re.sub("[x/]", "", m[1])) * WIDTH
        return Unit(log, path, first, first + int(m[2] or WIDTH), True)
    if m := _PAGE.fullmatch(rest):
        return Unit(log, path, int(m[1]), int(m[1]) + 1, False)
    return None


def landed(path: str) -> dict[str, list[Unit]]:
    """The units of each log, in their order. Names that begin with _ or a dot are
    no files of a log."""
    store, root = fs.FileSystem.from_uri(path)
    out: dict[str, list[Unit]] = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path[len(root) :].strip("/").split("/")
        if f.type != fs.FileType.File or len(parts) < 2 or any(p[0] in "_." for p in parts):
            continue
        log = parts[0].removeprefix("log=")
        if u := unit(log, f.path, "/".join(parts[1:])):
            u.size = f.size or 0
            out.setdefault(log, []).append(u)
    for units in out.values():
        units.sort(key=lambda u: (u.first, u.end, u.path))
    return out


def admitted(units: dict[str, list[Unit]], cursors: dict[str, int], most: int | None) -> dict[str, int]:
    """The cursors after at most so many more units of each log."""
    out = dict(cursors)
    for log, every in units.items():
        new = [u.end for u in every if u.end > out.get(log, 0)][:most]
        out[log] = max([out.get(log, 0), *new])
    return dict(sorted(out.items()))


def between(units: dict[str, list[Unit]], start: dict[str, int], end: dict[str, int]) -> list[Unit]:
    """The units that the cursors pass. A tile that was partial before counts from
    the old cursor on."""
    out = []
    for log, to in end.items():
        at = start.get(log, 0)
        out += [Unit(u.log, u.path, u.first, u.end, u.tile, at, u.size) for u in units.get(log, []) if at < u.end <= to]
    return out


def dealt(units: list[Unit]) -> list[Part]:
    """All units in partitions, in their order: a task for each of many small files would
    take longer to start than to read them."""
    most = min(PART_UNITS, math.ceil(len(units) / PARTS))
    out, size = [], 0
    for u in units:
        if not out or len(out[-1].units) >= most or size + u.size > PART_BYTES:
            out.append(Part([]))
            size = 0
        out[-1].units.append(u)
        size += u.size
    return out


def rows(store: fs.FileSystem, u: Unit) -> list[tuple]:
    """The rows of one unit, or one that tells why there are none."""
    try:
        with store.open_input_stream(u.path) as f:
            content = f.read()
        if u.tile:
            return [(u.log, u.first, None, content, u.cursor, None)]
        entries = json.loads(content)["entries"]
        return [(u.log, u.first + i, base64.b64decode(e["leaf_input"], validate=True), None, u.cursor, None) for i, e in enumerate(entries)]
    except (OSError, ValueError, KeyError, TypeError) as e:
        return [(u.log, u.first, None, None, u.cursor, f"{u.path.rsplit('/', 1)[-1]}: {type(e).__name__}: {str(e)[:200]}")]


def batches(path: str, units: list[Unit]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition's units, in bounded batches."""
    store, _ = fs.FileSystem.from_uri(path)
    made = lambda some: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _ARROW)], schema=_ARROW)
    held, size = [], 0
    for u in units:
        for row in rows(store, u):
            held.append(row)
            size += len(row[2] or row[3] or b"")
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def land_pages(pages: DataFrame, path: str) -> None:
    """Pages (log, start, value) as the files of a fetcher, written by the tasks, which
    share all pages evenly. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        known = set()
        for batch in batches:
            for log, start, value in zip(*(batch[c].to_pylist() for c in ("log", "start", "value"))):
                if log not in known:
                    store.create_dir(f"{root}/{log}", recursive=True)
                    known.add(log)
                with store.open_output_stream(f"{root}/{log}/{start}.json") as f:
                    f.write(value.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    parts = 4 * pages.sparkSession.sparkContext.defaultParallelism
    pages.select("log", "start", "value").repartition(parts, "log", "start").mapInArrow(run, "n long").agg(F.sum("n")).collect()


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.store = options["path"], options.get("cursors")
        self.most = int(options["units"]) if "units" in options else None
        if self.most is not None and not self.store:
            raise ValueError("a limit of units needs a file for its cursors")
        self.cursors = self._stored()
        self.listed: tuple[dict[str, int], dict[str, list[Unit]]] | None = None

    def _stored(self) -> dict[str, int]:
        if not self.store:
            return {}
        store, path = fs.FileSystem.from_uri(self.store)
        if store.get_file_info(path).type != fs.FileType.File:
            return {}
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _keep(self) -> None:
        store, path = fs.FileSystem.from_uri(self.store)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path + ".new") as f:
            f.write(json.dumps(self.cursors).encode())
        store.move(path + ".new", path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        units = landed(self.path)
        new = admitted(units, self.cursors, self.most)
        self.listed = new, units  # the trigger that follows reads what this listing admitted
        if new != self.cursors:
            self.cursors = new
            if self.store:
                self._keep()
        return self.cursors

    def partitions(self, start: dict, end: dict) -> list[Part]:
        units = self.listed[1] if self.listed and self.listed[0] == end else landed(self.path)
        return dealt(between(units, start, end))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition.units)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        units = landed(self.path)
        return dealt(between(units, {}, admitted(units, {}, None)))

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:  # Spark asks once where there are no partitions
        return batches(self.path, partition.units) if partition is not None else iter(())


class LandedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_logs"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def landed_logs(spark: SparkSession, path: str, stream: bool = False, units: int | None = None, cursors: str | None = None) -> DataFrame:
    """The rows of all logs' files (ROW), as a batch or a stream."""
    spark.dataSource.register(LandedLogs)
    r = (spark.readStream if stream else spark.read).format("landed_logs")
    for name, value in (("units", units), ("cursors", cursors)):
        r = r.option(name, value) if value is not None else r
    return r.load(path)


def entries(batch: DataFrame, logs: DataFrame) -> DataFrame:
    """Entries (schemas.ENTRY) of a batch of rows; ``logs`` (log, description, operator,
    submission_url, monitoring_url) has a row for each log, a list of a few hundred."""
    d = batch.filter("error is null").join(logs, "log", "left")
    leaves = decode.log_leaves(d.filter("leaf_input is not null").drop("tile", "cursor", "error", "log"))
    tiles = d.filter("tile is not null").withColumnRenamed("cert_index", "base_index").drop("leaf_input", "error", "log")
    return leaves.unionByName(decode.log_tiles(tiles))


def errors(batch: DataFrame, source: Column) -> DataFrame:
    """source and message of what could not be read, as ``polls.source_runs`` takes them."""
    return batch.filter("error is not null").select(source.alias("source"), F.concat_ws(": ", "log", "error").alias("message"))
