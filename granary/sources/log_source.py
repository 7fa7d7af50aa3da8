"""A Spark data source over files of log rows, read newest first in pages."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.shipping import ship

FIELDS = pa.schema([("id", pa.string()), ("p", pa.string()), ("signer", pa.string()), ("time", pa.int64())])
#: Rows of a batch.
BATCH = 4096


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path there."""
    return fs.FileSystem.from_uri(path)


def text_of(v: object) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def row_of(line: bytes) -> tuple | None:
    """A line's row; none where it isn't a JSON object. A time that isn't a whole number of 64 bits is null."""
    try:
        held = json.loads(line)
    except ValueError:
        return None
    if not isinstance(held, dict):
        return None
    time = held.get("time")
    sound = isinstance(time, int) and not isinstance(time, bool) and -(2**63) <= time < 2**63
    return *(text_of(held.get(c)) for c in ("id", "p", "signer")), time if sound else None


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most, self.after = options["path"], int(options.get("maxPages", 0)), options.get("after", "")
        self.suffix = options.get("suffix", ".jsonl")

    def partitions(self) -> list[Page]:
        system, root = located(self.path)
        held = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file}
        names = sorted((x for x in held if x.endswith(self.suffix) and x > self.after), reverse=True)
        return [Page(f"{self.path.rstrip('/')}/{x}") for x in (names[: self.most] if self.most else names)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        system, path = located(page.path)
        rows: list[tuple] = []
        with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
            for line in f:
                if (row := row_of(line)) is not None:
                    rows.append(row)
                if len(rows) == BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), FIELDS)], schema=FIELDS)


class LogSource(DataSource):
    """format("granary_log"): one JSON object a line, a file a page, on any file system that Arrow knows.

    Option maxPages reads the newest pages alone; option after, the name of the last page that was read, the ones since;
    option suffix is what the pages' names end in, .jsonl where it isn't given.
    """

    @classmethod
    def name(cls) -> str:
        return "granary_log"

    def schema(self) -> str:
        return "id string, p string, signer string, time long"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and the package to the workers that plan and read it."""
    ship(spark)
    spark.dataSource.register(LogSource)
