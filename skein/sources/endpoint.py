"""A metrics endpoint as a data source: each scrape's lines, in batches and as a stream.

`spark.dataSource.register(MetricSource)` makes the format `metric_text` known;
metrics.scrapes() and metrics.scrape_stream() do so and parse the lines. Options:

* `url`, `path` (a file that is written anew, or for a batch a folder of kept
  scrapes) or `call` ("package.module:function", which gives the text): where a
  scrape comes from.
* `log`: the shared folder where a stream keeps each scrape before it counts, one
  file each. Offsets number these files, so a batch that was begun before a
  restart reads the same text again, and none is lost or read twice.
* `every`: seconds between scrapes of a stream; 1 unless given.

A scrape that fails is one row that holds the error alone; the stream goes on.
Files are reached through Arrow's file systems, so the log may lie in any of them.
"""

from __future__ import annotations

import importlib
import time
import urllib.request
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "scrape long, time timestamp, line int, value string, error string"
TIMEOUT_S = 2.0
#: How the first line of a kept scrape begins; what follows is its time and whether it failed.
HEAD = "# scraped "


def _open(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def _read(place: str) -> str:
    files, path = _open(place)
    with files.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def scrape(options: dict[str, str]) -> str:
    """The text that an endpoint gives now, below a line that says when."""
    at = time.time()
    try:
        if call := options.get("call"):
            module, _, name = call.partition(":")
            text = getattr(importlib.import_module(module), name)()
        elif url := options.get("url"):
            with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer:
                text = answer.read().decode("utf-8", "replace")
        else:
            text = _read(options["path"])
        return f"{HEAD}{at} ok\n{text}"
    except Exception as e:  # an endpoint that does not answer is a result as well
        return f"{HEAD}{at} error\n{type(e).__name__}: {' '.join(str(e).split())}\n"


def rows(number: int, text: str, at: float | None = None) -> Iterator[tuple]:
    """A scrape's lines; one without a head has the time given."""
    lines, failed = text.split("\n"), False
    if lines[0].startswith(HEAD):
        stamp, how = lines[0][len(HEAD) :].split()
        at, failed, lines = float(stamp), how == "error", lines[1:]
    when = None if at is None else datetime.fromtimestamp(at, timezone.utc)
    if failed:
        yield number, when, None, None, lines[0]
        return
    for n, line in enumerate(lines):
        if line.strip():
            yield number, when, n, line, None


class Kept(InputPartition):
    """A kept scrape: its number and its file. Without a file the endpoint is asked."""

    def __init__(self, number: int, place: str | None, at: float | None = None) -> None:
        super().__init__(number)
        self.number, self.place, self.at = number, place, at


class Batch(DataSourceReader):
    """One scrape now, or all scrapes of a folder, a partition each, numbered by name."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        top = self.options.get("log") or self.options.get("path")
        if not top:
            return [Kept(0, None)]
        files, path = _open(top)
        if files.get_file_info(path).type != fs.FileType.Directory:
            return [Kept(0, None)]
        kept = sorted((i for i in files.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name[0] not in "._"), key=lambda i: i.base_name)
        prefix = top.rstrip("/")
        return [Kept(n, f"{prefix}/{i.base_name}", i.mtime.timestamp() if i.mtime else None) for n, i in enumerate(kept)]

    def read(self, partition: Kept) -> Iterator[tuple]:
        yield from rows(partition.number, _read(partition.place) if partition.place else scrape(self.options), partition.at)


class Stream(DataSourceStreamReader):
    """Scrapes kept in a log; an offset is the number of them."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("log"):
            raise ValueError("a stream of scrapes needs the option log, a shared folder")
        self.options, self.every = options, float(options.get("every", "1"))
        self.files, self.path = _open(options["log"])
        self.files.create_dir(self.path, recursive=True)
        done = [int(i.base_name.partition(".")[0]) for i in self.files.get_file_info(fs.FileSelector(self.path)) if i.is_file and i.base_name.endswith(".prom")]
        self.count, self.last = max(done, default=-1) + 1, 0.0

    def _file(self, n: int) -> str:
        return f"{n:012d}.prom"

    def initialOffset(self) -> dict:
        return {"scrapes": 0}

    def latestOffset(self) -> dict:
        if time.time() - self.last >= self.every:
            self.last = time.time()
            name = f"{self.path.rstrip('/')}/{self._file(self.count)}"
            with self.files.open_output_stream(f"{name}.tmp") as f:
                f.write(scrape(self.options).encode())
            self.files.move(f"{name}.tmp", name)  # a scrape counts once it is whole
            self.count += 1
        return {"scrapes": self.count}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        top = self.options["log"].rstrip("/")
        return [Kept(n, f"{top}/{self._file(n)}") for n in range(start["scrapes"], end["scrapes"])]

    def read(self, partition: Kept) -> Iterator[tuple]:
        yield from rows(partition.number, _read(partition.place), partition.at)


class MetricSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metric_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(dict(self.options))
