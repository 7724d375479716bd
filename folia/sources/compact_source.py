"""Compact files as a data source: ``spark.read.format("folia_compact")`` and ``df.write.format("folia_compact")``.

Register it once a session with :func:`register`. Files are read in splits. A
split begins at a mark, a place in the file where a line begins and of which it
is known how many elements stand before it; so every split knows its lines'
numbers, and none is moved to be numbered. The writer leaves the marks of its
files in ``_folia_index.json``; for other files :func:`load` counts lines in a
first job. A file without marks is one split. A split whose elements are not as
many as its marks say is refused: the file has changed, or is another. Where
splits are smaller than they need be, neighbours are read as one: so many tasks
as ``TASKS`` or the bytes ask for, whatever the distance of the marks, and what
the driver keeps of a file doesn't grow with the number of its lines.

Each task writes a file in a folder of its own; files come to their place when
all tasks have succeeded, and a failed job leaves nothing. Rows are written as
they come: elements whose orders fall are refused, unless they begin another
document by the columns of the option ``doc``.

Any store that pyarrow can open will do. For stores that only Spark can read
there is :func:`folia.sources.compact.read_compact`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from folia.schema import FIELDS
from folia.sources.compact import ATTRIBUTE_CODES, TABLE_VERSION, TYPE_CODES
from folia.workers import reach_workers

INDEX = "_folia_index.json"
SCHEMA = "filename string, pos int, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int"
COUNTED = "filename string, start bigint, first bigint, lines bigint"
#: Bytes from one mark to the next, and so of a split.
SPLIT_BYTES = 8 << 20
#: Splits of less than that are about so many in a read; a file has at most so many marks that lie closer.
TASKS, MARKS = 128, 1_024
_BATCH_ROWS = 8_192

_TYPE_OF = {code: (kind, name) for kind, codes in TYPE_CODES.items() for code, name in codes.items()}
_CODE_OF = {pair: code for code, pair in _TYPE_OF.items()}
_KEY_CODE = {key: code for code, key in ATTRIBUTE_CODES.items()}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo], dict]:
    """The files of a folder, or the one file, and the marks of those that have some."""
    store, name = _opened(path)
    info = store.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return store, [info], {}
    found = store.get_file_info(pafs.FileSelector(name, recursive=True))
    own = sorted((f for f in found if f.type == pafs.FileType.File and not any(x.startswith(("_", ".")) for x in f.path[len(name) :].split("/") if x)), key=lambda f: f.path)
    marks = {}
    if any(f.path == f"{name.rstrip('/')}/{INDEX}" for f in found):
        with store.open_input_stream(f"{name.rstrip('/')}/{INDEX}") as f:
            marks = {f"{name.rstrip('/')}/{k}": v for k, v in json.loads(f.read())["files"].items()}
    return store, own, marks


def _step(files: list[pafs.FileInfo]) -> int:
    """The least bytes of a split: below the usual size there are no more splits than ``TASKS`` and one a file."""
    return max(1, min(SPLIT_BYTES, sum(f.size for f in files) // TASKS))


def decode(line: dict) -> tuple[str, str, str | None, int, str, list[tuple[str, str]]]:
    """(kind, element type, content, level, encoding, attributes by key) of a parsed line; refuses what the format doesn't allow."""
    code = line.get("t")
    pair = _TYPE_OF.get(code)
    if pair is None:
        if code is None or ":" not in code:
            raise ValueError("compact: unknown type code")
        pair = tuple(code.split(":", 1))
    if line.get("l") is None:
        raise ValueError("compact: missing level")
    coded = line.get("a") or {}
    if not coded.keys() <= ATTRIBUTE_CODES.keys():
        raise ValueError("compact: unknown attribute code")
    merged = dict(line.get("m") or {}) | {ATTRIBUTE_CODES[k]: v for k, v in coded.items() if v is not None}
    encoding = line.get("e")
    return *pair, line.get("c"), line["l"], {None: "text", "t": "text", "j": "json"}.get(encoding, encoding), sorted(merged.items())


def encode(kind: str, element_type: str, content: str | None, level: int | None, encoding: str | None, attributes: list | None, order: int | None) -> str:
    """An element's line, without its end; refuses what can't be told from a line."""
    wrong = "null level" if level is None else "null encoding" if encoding is None else "encoding is a reserved code" if encoding in ("t", "j") else "null attributes" if attributes is None else ""
    if not wrong and any(v is None for _, v in attributes):
        wrong = "null attribute value"
    if wrong:
        raise ValueError(f"compact: {wrong} at element_order {'null' if order is None else order}")
    out: dict = {"t": _CODE_OF.get((kind, element_type), f"{kind}:{element_type}")}
    if content is not None:
        out["c"] = content
    out["l"] = level
    if encoding != "text":
        out["e"] = "j" if encoding == "json" else encoding
    known = {_KEY_CODE[k]: v for k, v in attributes if k in _KEY_CODE}
    others = {k: v for k, v in attributes if k not in _KEY_CODE}
    out |= {name: pairs for name, pairs in (("a", known), ("m", others)) if pairs}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _elements(data: bytes) -> Iterator[dict]:
    """The parsed lines that are elements; blank lines and headers are none."""
    for raw in data.split(b"\n"):
        if raw.strip():
            line = json.loads(raw)
            if "@" not in line or line.get("t") is not None:
                yield line


@dataclass
class Split(InputPartition):
    """A stretch of a file that begins and ends where lines do, or, with ``loose``, somewhere."""

    path: str
    start: int
    stop: int
    first: int = 0
    lines: int | None = None
    loose: bool = False


def _stretch(path: str, split: Split) -> tuple[int, bytes]:
    """Where the first line that begins in a split begins, and all lines that do."""
    store, name = _opened(path)
    with store.open_input_file(name) as f:
        size = f.size()
        begin = max(0, split.start - 1) if split.loose else split.start
        data = f.read_at(split.stop - begin, begin)
        if not split.loose:
            return begin, data
        if split.start:
            at = data.find(b"\n") + 1
            if not at:
                return split.stop, b""
            begin, data = begin + at, data[at:]
        parts, end = [data], split.stop
        while data and not parts[-1].endswith(b"\n") and end < size:  # the last line goes on behind the split
            more = f.read_at(1 << 16, end)
            cut = more.find(b"\n") + 1 or len(more)
            parts.append(more[:cut])
            end += cut
        return begin, b"".join(parts)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.counting = options.get("counting", "false") == "true"
        self.marks = json.loads(options.get("marks", "{}"))

    def partitions(self) -> list[Split]:
        store, files, index = _files(self.path)
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        least = _step(files)
        step = max(self.split_bytes, least)
        out = []
        for f in files:
            name, known = prefix + f.path, self.marks.get(f.path) or index.get(f.path)
            if self.counting:
                out += [Split(name, at, min(at + step, f.size), loose=True) for at in range(0, f.size, step)]
            elif known is None:
                out.append(Split(name, 0, f.size))
            else:
                if known["bytes"] != f.size:
                    raise ValueError(f"compact: {f.path} has changed since its lines were counted")
                begins = known["marks"][:1]
                for at, n in known["marks"][1:]:
                    if f.path in self.marks or at - begins[-1][0] >= least:  # counted ones are as far apart as splits
                        begins.append([at, n])
                ends = [*begins[1:], [f.size, known["lines"]]]
                out += [Split(name, a, b, n, m - n) for (a, n), (b, m) in zip(begins, ends, strict=True)]
        return out or [Split("", 0, 0)]

    def __getstate__(self) -> dict:
        """Without the marks: splits have theirs, and a task would get those of all files."""
        return self.__dict__ | {"marks": {}}

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        begin, data = _stretch(split.path, split)
        if self.counting:
            n = sum(1 for _ in _elements(data))
            yield pa.RecordBatch.from_arrays([pa.array([_opened(split.path)[1]]), pa.array([split.start], pa.int64()), pa.array([begin], pa.int64()), pa.array([n], pa.int64())], names=["filename", "start", "first", "lines"])
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        number = split.first
        rows: list = []

        def batch() -> pa.RecordBatch:
            first = number - len(rows)
            columns = []
            for field in arrow:  # only what is asked for
                if field.name == "filename":
                    values = [split.path] * len(rows)
                elif field.name in ("pos", "element_order"):
                    values = range(first, number)
                else:
                    i = FIELDS.index(field.name)
                    values = [r[i] for r in rows]
                columns.append(pa.array(values, type=field.type))
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for line in _elements(data):
            rows.append(decode(line))
            number += 1
            if len(rows) == _BATCH_ROWS:
                yield batch()
                rows.clear()
        if split.lines is not None and number != split.first + split.lines:
            raise ValueError(f"compact: {split.path} has changed since its lines were counted")
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    name: str
    bytes: int
    lines: int
    marks: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.doc = [c for c in options.get("doc", "").split(",") if c]
        self.mark_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def _temporary(self) -> tuple[pafs.FileSystem, str, str]:
        store, name = _opened(self.path)
        return store, name, f"{name}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _, temporary = self._temporary()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.blocks.jsonl"
        store.create_dir(temporary, recursive=True)
        size, lines, marks, document, last, apart = 0, 0, [[0, 0]], None, 0, self.mark_bytes
        header = json.dumps({"@": TABLE_VERSION}, separators=(",", ":"))
        with store.open_output_stream(f"{temporary}/{task.attemptNumber()}-{name}") as f:
            for batch in iterator:
                columns = [batch[c].to_pylist() for c in FIELDS]
                keys = list(zip(*[batch[c].to_pylist() for c in self.doc], strict=True)) if self.doc else [()] * len(batch)
                out = []
                for key, *row in zip(keys, *columns, strict=True):
                    order = row[-1] or 0
                    if key != document:
                        out.append(header)
                        size += len(header) + 1
                        document = key
                    elif order < last:
                        raise ValueError(f"compact: element_order {order} behind {last}: rows must come in their order")
                    last = order
                    if size - marks[-1][0] >= apart:
                        marks.append([size, lines])
                        if len(marks) > MARKS and apart < SPLIT_BYTES:
                            marks, apart = marks[::2], 2 * apart
                    out.append(encode(*row))
                    size += len(out[-1].encode()) + 1
                    lines += 1
                f.write(("\n".join(out) + "\n").encode() if out else b"")
        return _Written(name if lines else "", size, lines, marks)

    def commit(self, messages: list[_Written | None]) -> None:
        store, name, temporary = self._temporary()
        store.create_dir(name, recursive=True)
        index: dict = {}
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(name)):
                if f.path.rstrip("/") != temporary.rstrip("/"):
                    store.delete_dir(f.path) if f.type == pafs.FileType.Directory else store.delete_file(f.path)
        elif store.get_file_info(f"{name}/{INDEX}").type == pafs.FileType.File:
            with store.open_input_stream(f"{name}/{INDEX}") as f:
                index = json.loads(f.read())["files"]
        there = {f.path.rsplit("/", 1)[1].split("-", 1)[1]: f.path for f in store.get_file_info(pafs.FileSelector(temporary, allow_not_found=True)) if f.size}
        for m in messages:
            if m is not None and m.name:
                store.move(there[m.name], f"{name}/{m.name}")
                index[m.name] = {"bytes": m.bytes, "lines": m.lines, "marks": m.marks}
        with store.open_output_stream(f"{name}/{INDEX}") as f:
            f.write(json.dumps({"version": TABLE_VERSION, "files": index}).encode())
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _, temporary = self._temporary()
        if store.get_file_info(temporary).type == pafs.FileType.Directory:
            store.delete_dir(temporary)


class CompactSource(DataSource):
    """Options: ``path``, ``splitBytes``, ``doc`` (when writing), ``marks`` and ``counting`` (from :func:`load`).

    A schema of some of the columns reads only these.
    """

    @classmethod
    def name(cls) -> str:
        return "folia_compact"

    def schema(self) -> str:
        return COUNTED if self.options.get("counting") == "true" else SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        options = {k.lower(): v for k, v in self.options.items()}
        self.options.pop("marks", None)  # this object goes to every task
        return _Reader(schema, options)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        options = {k.lower(): v for k, v in self.options.items()}
        missing = {*FIELDS, *[c for c in options.get("doc", "").split(",") if c]} - {f.name for f in schema}
        if missing:
            raise ValueError(f"compact: no columns {', '.join(sorted(missing))}")
        return _Writer(options, overwrite)


def register(spark: SparkSession) -> None:
    reach_workers(spark)
    spark.dataSource.register(CompactSource)


def counted(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> dict:
    """Marks of all files of a path, counted by a job: one for each split."""
    register(spark)
    found = spark.read.format("folia_compact").option("counting", "true").option("splitBytes", split_bytes).load(path)
    marks: dict = {}
    _, files, _ = _files(path)
    for r in sorted(found.collect()):
        f = marks.setdefault(r["filename"], {"lines": 0, "marks": []})
        if r["lines"] or not f["marks"]:
            f["marks"].append([r["first"], f["lines"]])
        f["lines"] += r["lines"]
    return {f.path: {"bytes": f.size, **marks.get(f.path, {"lines": 0, "marks": [[0, 0]]})} for f in files}


def load(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, schema: str | None = None) -> DataFrame:
    """Files in the format, in row form with ``filename``, ``pos`` and ``element_order`` by line; lines of files without an index are counted first."""
    register(spark)
    _, files, index = _files(path)
    reader = spark.read.format("folia_compact")
    if any(f.path not in index and f.size > max(split_bytes, _step(files)) for f in files):
        reader = reader.option("marks", json.dumps(counted(spark, path, split_bytes)))
    return (reader.schema(schema) if schema else reader).load(path)


def save(rows: DataFrame, path: str, doc_cols: list[str], mode: str = "append", split_bytes: int = SPLIT_BYTES) -> None:
    """Documents in row form, each whole in one file, with a header before each. ``mode``: append or overwrite."""
    register(rows.sparkSession)
    dealt = rows.repartition(*doc_cols).sortWithinPartitions(*doc_cols, "pos").select(*doc_cols, *FIELDS)
    dealt.write.format("folia_compact").option("doc", ",".join(doc_cols)).option("splitBytes", split_bytes).mode(mode).save(path)
