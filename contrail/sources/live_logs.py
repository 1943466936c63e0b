"""Growing event logs as a stream: a data source whose offsets are bytes of files.

Every trigger reads, of each watched file, the lines whose line end came since the last one; a last line without its end waits. Which bytes
belong to which trigger is kept in snapshots (file, bytes read) in a shared folder, and Spark's own offset log holds their numbers only, so that it doesn't grow with the
number of sessions and a trigger that is run again reads the same bytes.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from contrail.sources.events import ENVELOPE, well_formed

FORMAT = "event_lines"
#: Bytes that one task reads, and that are read at a time.
SPLIT, STEP = 64 << 20, 4 << 20
#: What opening a file counts as in a task's bytes, so that many small files share a task.
OPEN = 64 << 10


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Where a path without a scheme is a local one; stores are reached by their own scheme (hdfs, s3, gs, ..)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def log_files(base: str, pattern: str, watched: Sequence[str] = ()) -> dict[str, int]:
    """Bytes of each log: base/<session>/<file like pattern>. Sessions whose folder starts with a dot or holds `.hidden` are left out, unless the file is
    watched already. No base: none."""
    own, root = file_system(base)
    files = own.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    parts = {f.path: f.path[len(root.rstrip("/")) + 1 :].split("/") for f in files if f.type == fs.FileType.File}
    hidden = {p[0] for p in parts.values() if len(p) == 2 and p[1] == ".hidden"}
    fits = lambda p: len(p) == 2 and p[0][0] != "." and p[1][0] not in "._" and fnmatch.fnmatchcase(p[1], pattern)
    seen = set(watched)
    return {f.path: f.size for f in files if f.path in parts and fits(parts[f.path]) and (f.path in seen or parts[f.path][0] not in hidden)}


@dataclass
class Span(InputPartition):
    """Bytes start to end of a file: the lines that end there."""

    path: str
    start: int
    end: int


@dataclass
class Spans(InputPartition):
    """What one task reads."""

    spans: list[Span]


def packed_spans(spans: Sequence[Span]) -> list[Spans]:
    """Spans in turn, those of small files together: a task has about SPLIT bytes, an opened file counting as OPEN."""
    out: list[Spans] = []
    left = 0
    for span in spans:
        size = span.end - span.start + OPEN
        if not out or size > left:
            out.append(Spans([]))
            left = SPLIT
        out[-1].spans.append(span)
        left -= size
    return out


def lines_of(own: fs.FileSystem, span: Span) -> Iterator[list[bytes]]:
    """The lines whose line end lies in the span, however far before it they begin."""
    with own.open_input_file(span.path) as f:
        at, rest = span.start, None
        while at < span.end:
            block = f.read_at(min(STEP, span.end - at), at)
            if not block:
                return
            if rest is None:
                # nothing ends here yet: what comes before the span is only read once a line end is found
                cut = block.find(b"\n")
                if cut < 0:
                    at += len(block)
                    continue
                rest, block, at = [_before(f, at + cut)], block[cut:], at + cut
            *whole, last = block.split(b"\n")
            if whole:
                yield [b"".join([*rest, whole[0]]), *whole[1:]]
                rest = []
            rest.append(last)
            at += len(block)


def _before(f, end: int) -> bytes:
    """The bytes from the last line end before `end` up to it."""
    parts: list[bytes] = []
    while end > 0:
        start = max(0, end - STEP)
        block = f.read_at(end - start, start)
        cut = block.rfind(b"\n")
        parts.append(block[cut + 1 :])
        if cut >= 0:
            break
        end = start
    return b"".join(reversed(parts))


def _batch(text: list[str], paths: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(paths, pa.string())], ["value", "file"])


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.base, self.pattern = options["path"], options.get("pattern", "events.jsonl")
        self.limit = int(options.get("maxbytespertrigger", 0))
        self.positions = options["positions"].rstrip("/")

    def _snapshot(self, n: int) -> dict[str, int]:
        if not n:
            return {}
        own, root = file_system(self.positions)
        with own.open_input_file(f"{root}/{n:012d}.json") as f:
            return json.loads(f.read())

    def _numbers(self) -> list[int]:
        own, root = file_system(self.positions)
        names = (f.base_name for f in own.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        return sorted(int(x[:-5]) for x in names if x.endswith(".json"))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        n = max(self._numbers(), default=0)
        before = self._snapshot(n)
        sizes, now, left = log_files(self.base, self.pattern, list(before)), dict(before), self.limit
        for path, size in sorted(sizes.items()):
            grown = size - before.get(path, 0)
            if grown > 0 and (left > 0 or not self.limit):
                step = min(grown, left) if self.limit else grown
                now[path] = before.get(path, 0) + step
                left -= step
        if now == before:
            return {"n": n}
        own, root = file_system(self.positions)
        own.create_dir(root, recursive=True)
        with own.open_output_stream(f"{root}/.{n + 1}") as f:
            f.write(json.dumps(now).encode())
        own.move(f"{root}/.{n + 1}", f"{root}/{n + 1:012d}.json")
        return {"n": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        before, now = self._snapshot(start["n"]), self._snapshot(end["n"])
        out = []
        for path, last in now.items():
            first = before.get(path, 0)
            out += [Span(path, a, min(a + SPLIT, last)) for a in range(first, last, SPLIT)]
        return packed_spans(out)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(self.base)
        text: list[str] = []
        paths: list[str] = []
        size = 0
        for span in partition.spans:
            for lines in lines_of(own, span):
                text += [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]
                paths += [span.path] * len(lines)
                size += sum(map(len, lines))
                if size >= STEP:
                    yield _batch(text, paths)
                    text, paths, size = [], [], 0
        if text:
            yield _batch(text, paths)

    def commit(self, end: dict) -> None:
        """Snapshots before the last committed one are never read again."""
        own, root = file_system(self.positions)
        for n in self._numbers():
            if n < end["n"]:
                own.delete_file(f"{root}/{n:012d}.json")


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string, file string"

    def streamReader(self, schema: T.StructType) -> LineReader:
        return LineReader(self.options)


def stream_lines(spark: SparkSession, base: str, positions: str, pattern: str = "events.jsonl", max_bytes: int | None = None) -> DataFrame:
    """value, file: each ended line of base/<session>/<pattern> once, new sessions and lines added to files as they come.

    positions: a shared folder that belongs to the query's checkpoint. max_bytes bounds what a trigger reads."""
    spark.dataSource.register(EventLines)
    reader = spark.readStream.format(FORMAT).option("positions", positions).option("pattern", pattern)
    return (reader.option("maxBytesPerTrigger", str(max_bytes)) if max_bytes else reader).load(base)


def stream_events(spark: SparkSession, base: str, positions: str, pattern: str = "events.jsonl", max_bytes: int | None = None) -> DataFrame:
    """The well-formed events of growing logs, each once: blank and malformed lines are skipped, a last line without its end waits for the rest,
    new session folders are picked up. Hidden sessions (a folder that starts with a dot, or that holds a file `.hidden`) are skipped; what is being read
    already is read on, and a session that is no longer hidden is read from its beginning. A file that shrinks is not read again."""
    lines = stream_lines(spark, base, positions, pattern, max_bytes).where(F.trim("value") != "")
    whole = T.StructType([*ENVELOPE.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select(F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")
    return rows.where(well_formed(rows)).drop("_corrupt")
