"""A folder of Parquet files as a Spark data source: filters pushed as far as declared, and a change feed that can expire.

format("evidence_table") reads files row group by row group. It takes only the filters on columns that the option
"searchable" names and gives Spark all others back, which applies them itself; a task leaves out row groups by their statistics.

format("evidence_feed") reads segments, files named for the first and last history id in them, from an offset. The oldest
segments may be deleted at any time (a range without changes has none); an offset before what is left is answered by one row of kind 'resync', which says what is
lost, and then by what is there. The same rows come in a batch (option "since") and in a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema

SEGMENT = re.compile(r"^(\d{20})-(\d{20})\.parquet$")
ROWS = 8_192


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The Parquet files at a path or URI, with their sizes: a folder's, or the file itself."""
    where, root = (fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path))
    info = where.get_file_info(root)
    found = where.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info] if info.type == fs.FileType.File else []
    return where, sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(".parquet") and not x.base_name.startswith((".", "_")))


# --- A table with pushed filters -------------------------------------------------


COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def pushed_expression(f: Filter) -> tuple[str, str, object] | None:
    """(column, sign, value) of a filter that a row group can be judged by, or None."""
    if type(f) in COMPARED and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
        return f.attribute[0], COMPARED[type(f)], f.value
    if isinstance(f, In) and len(f.attribute) == 1 and f.value and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in f.value):
        return f.attribute[0], "in", tuple(f.value)
    return (f.attribute[0], "known", None) if isinstance(f, IsNotNull) and len(f.attribute) == 1 else None


def _matches(tests: list[tuple[str, str, object]]) -> pc.Expression | None:
    out = None
    for column, sign, value in tests:
        c = pc.field(column)
        one = {"==": lambda: c == value, ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value, "in": lambda: c.isin(list(value)), "known": lambda: c.is_valid()}[sign]()  # noqa: B023
        out = one if out is None else out & one
    return out


@dataclass
class _File(InputPartition):
    path: str


class TableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.searchable = options["path"], {c.strip() for c in options.get("searchable", "").split(",") if c.strip()}
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the filters that the source can carry and gives back the residual ones."""
        for f in filters:
            test = pushed_expression(f)
            if test and test[0] in self.searchable:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p, _ in _files(self.path)[1]]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):  # what Spark passes for a table without files
            return
        where, _ = _files(self.path)
        # The scanner leaves out row groups whose statistics rule the filters out, and rows that they do.
        yield from ds.dataset(partition.path, format="parquet", filesystem=where).scanner(filter=_matches(self.tests), batch_size=ROWS).to_batches()


class EvidenceTable(DataSource):
    """Options: path, a file, a folder or a URI that pyarrow opens; searchable, the columns whose filters the source carries."""

    @classmethod
    def name(cls) -> str:
        return "evidence_table"

    def schema(self):
        where, found = _files(self.options["path"])
        if not found:
            raise ValueError(f"there is no Parquet file at {self.options['path']}")
        return from_arrow_schema(pq.read_schema(found[0][0], filesystem=where), prefer_timestamp_ntz=True)

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options)


# --- A feed that can expire --------------------------------------------------------


FEED = "kind string, history_id long, thread_id string, event_type string, lost_from long, lost_to long"


@dataclass
class _Span(InputPartition):
    """The rows of a segment with ids above since and up to until; without a segment, ids that are lost."""

    path: str | None
    since: int
    until: int


def _segments(path: str) -> list[tuple[int, int, str]]:
    out = []
    for p, _ in _files(path)[1]:
        if m := SEGMENT.match(p.rsplit("/", 1)[-1]):
            out.append((int(m[1]), int(m[2]), p))
    return sorted(out)


def _spans(path: str, since: int, until: int | None) -> list[_Span]:
    """What has to be read for the ids above since and up to until, a declared loss first."""
    segments = _segments(path)
    last = max((b for _, b, _ in segments), default=since) if until is None else until
    oldest = min((a for a, _, _ in segments), default=last + 1)
    lost = [_Span(None, since, min(oldest - 1, last))] if since + 1 < oldest and last > since else []
    return lost + [_Span(p, max(since, a - 1), min(last, b)) for a, b, p in segments if b > since and a <= last]


def _read(path: str, span: _Span) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FEED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    resync = lambda a, b: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(("resync", None, None, None, a, b), types, strict=True)], names=names)
    if span.path is None:
        yield resync(span.since + 1, span.until)
        return
    where, _ = _files(path)
    try:
        t = pq.ParquetFile(span.path, filesystem=where)
    except FileNotFoundError:  # deleted between the plan and now: lost like the rest
        yield resync(span.since + 1, span.until)
        return
    for b in t.iter_batches(ROWS, columns=["history_id", "thread_id", "event_type"]):
        b = b.filter(pc.and_(pc.greater(b["history_id"], span.since), pc.less_equal(b["history_id"], span.until)))
        if b.num_rows:
            n = b.num_rows
            cols = [pa.array(["change"] * n), b["history_id"].cast(pa.int64()), b["thread_id"].cast(pa.string()), b["event_type"].cast(pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.since = options["path"], int(options.get("since", 0))

    def partitions(self) -> list[InputPartition]:
        return _spans(self.path, self.since, None)

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, _Span):
            yield from _read(self.path, partition)


class FeedStreamReader(DataSourceStreamReader):
    """Offsets are history ids; the next batch ends at the last segment that is there, or most segments on."""

    def __init__(self, options: dict[str, str]):
        self.path, self.since, self.most = options["path"], int(options.get("since", 0)), int(options.get("segments", 1 << 30))
        self.at = None

    def initialOffset(self) -> dict:
        return {"history_id": self.since}

    def latestOffset(self) -> dict:
        at = self.since if self.at is None else self.at
        ahead = [b for _, b, _ in _segments(self.path) if b > at][: self.most]
        self.at = ahead[-1] if ahead else at
        return {"history_id": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(end["history_id"], self.at or 0)
        return _spans(self.path, start["history_id"], end["history_id"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class EvidenceFeed(DataSource):
    """Options: path of the segments; since, the id after which to begin; segments, how many a micro-batch takes."""

    @classmethod
    def name(cls) -> str:
        return "evidence_feed"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets it push filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EvidenceTable)
    spark.dataSource.register(EvidenceFeed)


def write_segments(feed: DataFrame, path: str, width: int) -> DataFrame:
    """Appends a feed (history_id, thread_id, event_type) as segments of width ids; gives segment, rows. A segment is written whole, by
    one task, under its own name, so a task that runs again replaces what it wrote."""

    def run(t: pa.Table) -> pa.Table:
        where, root = fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        n = t["segment"][0].as_py()
        name = f"{n * width + 1:020d}-{(n + 1) * width:020d}.parquet"
        pq.write_table(t.drop_columns("segment").sort_by("history_id"), f"{root}/.{name}", filesystem=where)
        where.move(f"{root}/.{name}", f"{root}/{name}")
        return pa.table({"segment": [name], "rows": [t.num_rows]})

    segment = F.floor((F.col("history_id") - 1) / width).cast("long").alias("segment")
    rows = feed.filter("history_id >= 1").select(segment, F.col("history_id").cast("long"), F.col("thread_id").cast("string"), "event_type")
    return rows.groupBy("segment").applyInArrow(run, "segment string, rows long")


def since(spark: SparkSession, path: str, marker: int) -> DataFrame:
    """The changes after a marker (kind 'change'), and a row of kind 'resync' if the feed no longer reaches back to it."""
    return spark.read.format("evidence_feed").option("path", path).option("since", str(marker)).load()
