"""The input formats as one data source: `spark.read.format("seriesloom")` and `spark.readStream.format("seriesloom")`.

    register(spark)
    spark.read.format("seriesloom").option("dataset", "nab").load(path)

Every format gives points, one row each: dataset, file (its path below the root), series_key, t (place in the file's
series, from 0), time (text; null where the format has none), value, label (null where the format has none). Files are
planned by size: small ones share a task, each is read in steps of ROWS rows or a line, so memory does not grow with a
file. Paths are local or of a file system that pyarrow knows (hdfs, s3, gs); columns of a format as options:

| layout | data sets | options |
|-|-|-|
| economic | fred | `target`: a column's name; without one all columns are series |
| labelled | ucr2018 | `series`, `split` (names in series_key), `separator`, `label_last` |
| metrics | nab | |
| wide | others | `time`: the time column; `series`: names by comma, without them all but the time column |

A stream notes the files that it has seen in a log of its own, a folder named by the option `log`: an entry for each
batch of new files, written whole before the batch, and offsets are numbers of entries. So a file counts once whatever
its time of change, a batch that comes again reads the same files, and files may be removed once their batch is done.
Files are to be put into the folder whole and left alone, as for Spark's own file source.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import islice, zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import layout_of, time_column

POINTS = "dataset string, file string, series_key string, t long, time string, value double, label int"
_ARROW = pa.schema([("dataset", pa.string()), ("file", pa.string()), ("series_key", pa.string()), ("t", pa.int64()), ("time", pa.string()), ("value", pa.float64()), ("label", pa.int32())])
#: Rows of a file that are read at once; bytes of a task's files, and what opening one counts as.
ROWS, TASK_BYTES, OPEN_BYTES = 8_192, 128 << 20, 1 << 20
_TIME = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?(?: ?(?:UTC|[+-]\d{1,2}(?::?\d{2})?))?)?)?)?")


@dataclass
class Files(InputPartition):
    """What one task reads: paths below the root."""

    names: tuple[str, ...]


def is_time(text: str) -> bool:
    """Whether the text is a date or a date and time, as ISO 8601 writes them."""
    match = _TIME.fullmatch(text)
    if not match:
        return False
    year, month, day, hour, minute, second = (int(g) if g else None for g in match.groups())
    try:
        return bool(datetime(year, month or 1, day or 1, hour or 0, minute or 0, second or 0))
    except ValueError:
        return False


def numbers(cells: list) -> np.ndarray:
    """Cells as doubles; NaN for what is missing or no number."""
    return pd.to_numeric(pd.Series(cells, dtype=object).str.strip(), errors="coerce").to_numpy(np.float64)


def _points(key: str, first: int, values: np.ndarray, times: list | None = None, label: int | None = None) -> dict:
    return {"series_key": key, "t": first + np.arange(len(values)), "time": times, "value": values, "label": label}


def wide_points(file: io.TextIOBase, options: dict) -> Iterator[dict]:
    """A table with a header: a series a column. Short rows have gaps at their end, cells without a name are not read."""
    rows = csv.reader(file)
    names = [n.strip() for n in next(rows, [])]
    if not names:
        return
    clock = options.get("time") or time_column(names)
    wanted = [s.strip() for s in options["series"].split(",")] if options.get("series") else [n for n in names if n != clock]
    first, own = 0, (row for row in rows if row)
    while part := list(islice(own, ROWS)):
        columns = dict(zip(names, zip_longest(*[row[: len(names)] for row in part]), strict=False))
        blank = [None] * len(part)
        for name in wanted:
            if name in names:
                yield _points(name, first, numbers(list(columns.get(name, blank))), list(columns.get(clock, blank)))
        first += len(part)


def metric_points(file: io.TextIOBase, options: dict) -> Iterator[dict]:
    """Rows of a time and a value, a file a series; rows of which either is bad are left out."""
    rows, first = csv.reader(file), 0
    next(rows, None)
    while part := list(islice(rows, ROWS)):
        pairs = [(row[0].strip().removesuffix("Z"), row[1]) for row in part if len(row) > 1]
        values = numbers([v for _, v in pairs])
        good = [i for i, (t, _) in enumerate(pairs) if is_time(t) and not np.isnan(values[i])]
        yield _points(options["file"], first, values[good], [pairs[i][0] for i in good])
        first += len(good)


def labelled_points(file: io.TextIOBase, options: dict) -> Iterator[dict]:
    """A series a line: its label and its values, gaps filled with the last known value, else the next, else 0."""
    separator, last = options.get("separator", "\t"), str(options.get("label_last", "false")).lower() == "true"
    root = f"{options.get('series', 'series')}/{options.get('split', 'TRAIN')}"
    for n, line in enumerate(file):
        line = line.rstrip("\r\n")
        if not line.strip():
            continue
        cells = line.split("\t") if separator == "\t" else re.split(separator, line.strip())
        label, rest = (cells[-1], cells[:-1]) if last else (cells[0], cells[1:])
        number = numbers([label])[0]
        filled = pd.Series(numbers(rest)).ffill().bfill().fillna(0.0).to_numpy()
        yield _points(f"{root}/{n:06d}", 0, filled, None, int(number) if np.isfinite(number) and abs(number) < 2**31 else None)


def economic_points(file: io.TextIOBase, options: dict) -> Iterator[dict]:
    """JSON lines: a series a column, `index/name`, with the values of timeseriesN by place; what is missing counts as 0.
    Bad lines and those without columns or times are left out."""
    for line in file:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if not isinstance(row, dict):
            continue
        names, times = row.get("cols"), row.get("timestamp")
        if not (isinstance(names, list) and names and isinstance(times, list) and times):
            continue
        for place, name in enumerate(names, 1):
            if options.get("target") in (None, name):
                own = row.get(f"timeseries{place}")
                own = own if isinstance(own, list) else []
                values = [v if isinstance(v, int | float) and not isinstance(v, bool) else 0.0 for v in own[: len(times)]]
                yield _points(f"{row.get('index')}/{name}", 0, np.array(values + [0.0] * (len(times) - len(values)), np.float64), [None if t is None else str(t) for t in times])


LAYOUTS = {"wide": wide_points, "metrics": metric_points, "labelled": labelled_points, "economic": economic_points}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/*(?=/)", "", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))


class _Root:
    """The folder, or file, that is read: its listing and the points of its files."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        if "path" not in self.options:
            raise ValueError("seriesloom: load() needs a path")
        self.dataset = self.options.get("dataset", "series")
        self.layout = self.options.get("layout") or layout_of(self.dataset)
        if self.layout not in LAYOUTS:
            raise ValueError(f"seriesloom: layout {self.layout!r} is none of {', '.join(LAYOUTS)}")

    def listing(self) -> list[tuple[str, int]]:
        """(path below the root, bytes) of each file, in order."""
        system, root = _located(self.options["path"])
        top = system.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for info in found:
            name = info.path[len(root) :].lstrip("/") or info.base_name
            hidden = any(part.startswith(("_", ".")) for part in name.split("/"))
            if info.type == fs.FileType.File and not hidden and (self.layout != "metrics" or name.endswith(".csv")):
                out.append((name, info.size))
        return sorted(out)

    def tasks(self, files: list[tuple[str, int]]) -> list[Files]:
        """Files in order of path, dealt to tasks of at most TASK_BYTES; a larger file is a task of its own."""
        limit, out, room = int(self.options.get("task_bytes", TASK_BYTES)), [], 0
        for name, size in sorted(files):
            if not out or size + OPEN_BYTES > room:
                out.append([])
                room = limit
            out[-1].append(name)
            room -= size + OPEN_BYTES
        return [Files(tuple(names)) for names in out]

    def points(self, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        system, root = _located(self.options["path"])
        single = system.get_file_info(root).type == fs.FileType.File
        for name in names:
            with system.open_input_stream(root if single else f"{root}/{name}") as raw, io.TextIOWrapper(raw, "utf-8", errors="replace", newline="") as file:
                for part in LAYOUTS[self.layout](file, self.options | {"file": name}):
                    for begin in range(0, len(part["value"]), ROWS):
                        yield self._batch(name, part, begin, min(ROWS, len(part["value"]) - begin))

    def _batch(self, name: str, part: dict, begin: int, n: int) -> pa.RecordBatch:
        values, cut = part["value"][begin : begin + n], slice(begin, begin + n)
        times = pa.nulls(n, pa.string()) if part["time"] is None else pa.array(part["time"][cut], pa.string())
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        return pa.RecordBatch.from_arrays([same(self.dataset, pa.string()), same(name, pa.string()), same(part["series_key"], pa.string()), pa.array(part["t"][cut], pa.int64()), times, pa.array(values, pa.float64(), mask=np.isnan(values)), same(part["label"], pa.int32())], schema=_ARROW)


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = _Root(options)

    def partitions(self) -> list[Files]:
        return self.root.tasks(self.root.listing()) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.root.points(partition.names)


class SeriesStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = _Root(options)
        if "log" not in options:
            raise ValueError("seriesloom: a stream needs the option log, a folder of its own")
        self.system, self.log = _located(options["log"])
        self.system.create_dir(self.log, recursive=True)
        self.entries, self.seen = 0, set()

    def _entry(self, number: int) -> list[tuple[str, int]]:
        with self.system.open_input_stream(f"{self.log}/{number}") as file:
            return [tuple(pair) for pair in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        while self.system.get_file_info(f"{self.log}/{self.entries + 1}").type == fs.FileType.File:
            self.entries += 1
            self.seen.update(name for name, _ in self._entry(self.entries))
        new = [f for f in self.root.listing() if f[0] not in self.seen]
        if new:
            part = f"{self.log}/_{uuid.uuid4().hex}"
            with self.system.open_output_stream(part) as file:
                file.write(json.dumps(new).encode())
            self.system.move(part, f"{self.log}/{self.entries + 1}")
            self.entries += 1
            self.seen.update(name for name, _ in new)
        return {"entry": self.entries}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [f for n in range(start["entry"] + 1, end["entry"] + 1) for f in self._entry(n)]
        return self.root.tasks(files) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.root.points(partition.names)


class SeriesSource(DataSource):
    """The format `seriesloom`; see the module."""

    @classmethod
    def name(cls) -> str:
        return "seriesloom"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)

    def streamReader(self, schema) -> SeriesStreamReader:
        return SeriesStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes `seriesloom` a format of the session."""
    spark.dataSource.register(SeriesSource)
