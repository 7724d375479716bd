"""Table functions for SQL: sections, a section's rows, and violations, of all documents of a table.

``register(spark)`` creates

* ``document_sections(TABLE(t), 'doc')``,
* ``document_section(TABLE(t), 'doc', 'pattern')``,
* ``document_violations(TABLE(t), 'doc')``.

``t`` has rows of elements with ``pos``; the second argument names the columns
(with commas between them) that tell documents apart, and results begin with
them. The functions ask the engine for the rows of a document together and in
their order, so the table is dealt by document once; each result is that of the
DataFrame operator of the same meaning, for documents that fit in a task.
"""

from __future__ import annotations

import bisect
import re
import string
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from folia.operators.outline import _names
from folia.operators.retrieve import _ends
from folia.operators.tree import _relate
from folia.schema import ELEMENT, FIELDS
from folia.vocabulary import ENCODINGS, KINDS
from folia.workers import reach_workers

_RANK = re.compile(r"[ \t\n\x0b\f\r]*([+-]?[0-9]+)")
_OTHER = re.compile(r"[^a-z0-9_]+")
_TEXT, _INT = T.StringType(), T.IntegerType()
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rank(attributes: dict | None, level: int | None) -> int:
    """A heading's rank, as :func:`folia.functions.lists.rank_of` has it."""
    given = _RANK.match((attributes or {}).get("heading_level") or "")
    if given and -(1 << 31) <= int(given[1]) < 1 << 31:
        return int(given[1])
    return 1 if level is None else level


def slug(title: str) -> str:
    return _OTHER.sub("-", title.translate(_LOWER)).strip("-")


def _inline(r: Row) -> str:
    content = r["content"] or ""
    if r["element_type"] in ("space", "softbreak"):
        return " "
    if r["element_type"] == "linebreak":
        return "\n"
    return (r["attributes"] or {}).get("alt") or "" if r["element_type"] == "image" and not content else content


def headings(rows: list[Row]) -> list[dict]:
    """A document's headings outside of values: pos, rank, title, id, order, and the order of what follows the title (null at the end)."""
    found: list[dict] = []
    root, inside, open_ = 0, False, None
    for r in rows:
        level = 1 if r["level"] is None else r["level"]
        if r["kind"] == "value":
            root, inside = level, True
        elif inside and level <= root:
            inside = False
        if r["kind"] == "inline":
            if open_ is not None:
                open_["run"] += _inline(r)
            continue
        if open_ is not None:
            open_["body"] = r["element_order"] or 0
        open_ = None
        if r["element_type"] == "heading" and not inside:
            open_ = {"pos": r["pos"], "rank": rank(r["attributes"], r["level"]), "content": r["content"] or "", "run": "", "id": (r["attributes"] or {}).get("id") or "", "order": r["element_order"] or 0, "body": None}
            found.append(open_)
    for h in found:
        h["title"] = h["content"] or h["run"]
    return found


def _analyzed(result: list[tuple[str, T.DataType]], rows: AnalyzeArgument, doc: AnalyzeArgument) -> AnalyzeResult:
    """The document's columns and those of ``result``; asks for a document's rows together and by place."""
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    if not doc.isConstantExpression or not isinstance(doc.value, str):
        raise ValueError("the second argument names the columns that tell documents apart")
    names = [c.strip() for c in doc.value.split(",")]
    there = {f.name.lower(): f for f in rows.dataType.fields}
    missing = [c for c in [*names, "pos", *FIELDS] if c.lower() not in there]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    schema = T.StructType([*[T.StructField(c, there[c.lower()].dataType) for c in names], *[T.StructField(*x) for x in result]])
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in names], orderBy=[OrderingColumn("pos")])


class _ByDocument:
    """Gathers a document's rows; ``found`` turns them into results."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.doc: list[str] = []
        self.given: tuple = ()

    def eval(self, row: Row, doc: str, *given) -> None:
        if not self.rows:
            self.doc, self.given = [c.strip() for c in doc.split(",")], given
        self.rows.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            own = tuple(self.rows[0][c] for c in self.doc)
            for result in self.found(*self.given):
                yield (*own, *result)

    def found(self) -> Iterator[tuple]:
        raise NotImplementedError


class DocumentSections(_ByDocument):
    @staticmethod
    def analyze(rows: AnalyzeArgument, doc: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed([("section_id", _TEXT), ("section_path", _TEXT), ("level", _INT), ("title", _TEXT), ("parent_id", _TEXT), ("start_order", _INT), ("end_order", _INT), ("content_start_order", _INT)], rows, doc)

    def found(self) -> Iterator[tuple]:
        h = headings(self.rows)
        last = max(r["element_order"] or 0 for r in self.rows)
        named = _names([i == 0 for i in range(len(h))], [x["rank"] for x in h], [slug(x["title"]) for x in h])
        for i, (x, id_, path, parent) in enumerate(zip(h, *named, strict=True)):
            end = h[i + 1]["order"] - 1 if i + 1 < len(h) else last
            yield id_, path, x["rank"], x["title"], parent, x["order"], end, end + 1 if x["body"] is None else x["body"]


class DocumentSection(_ByDocument):
    @staticmethod
    def analyze(rows: AnalyzeArgument, doc: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed([("pos", _INT), *[(f.name, f.dataType) for f in ELEMENT.fields]], rows, doc)

    def found(self, pattern: str | None) -> Iterator[tuple]:
        if pattern is None:
            return
        like = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{pattern}%"), re.IGNORECASE | re.DOTALL)
        h = sorted(headings(self.rows), key=lambda x: (x["order"], x["pos"]))
        (ends,) = _ends([i == 0 for i in range(len(h))], [x["order"] for x in h], [x["rank"] for x in h])
        spans: dict[int, int] = {}
        for x, end in zip(h, ends, strict=True):
            if like.fullmatch(x["title"]) or x["id"] == pattern:
                spans[x["order"]] = min(end, spans.get(x["order"], end))
        top: list[tuple[int, int]] = []
        for start, end in sorted(spans.items()):
            if not top or top[-1][1] < end:
                top.append((start, end))
        starts = [start for start, _ in top]
        for r in self.rows:
            order = r["element_order"] or 0
            at = bisect.bisect_right(starts, order) - 1
            if at >= 0 and order <= top[at][1]:
                yield (r["pos"], *[r[f] for f in FIELDS])


class DocumentViolations(_ByDocument):
    @staticmethod
    def analyze(rows: AnalyzeArgument, doc: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed([("element_order", _INT), ("rule", _TEXT), ("field", _TEXT), ("message", _TEXT)], rows, doc)

    def found(self) -> Iterator[tuple]:
        rows = self.rows
        kinds, types = [r["kind"] or "" for r in rows], [r["element_type"] or "" for r in rows]
        depths = [1 if r["level"] is None else r["level"] for r in rows]
        block = [k == "block" for k in kinds]
        masks = [(k != "inline") + 2 * (b and t in ("list", "deflist")) + 4 * (b and t in ("figure", "table")) for k, b, t in zip(kinds, block, types, strict=True)]
        above, _, _, _, scopes = _relate([i == 0 for i in range(len(rows))], depths, masks, [k == "value" for k in kinds])
        top = min(range(len(rows)), key=depths.__getitem__)
        seen: set[int] = set()
        before, last = None, -1
        for i, r in enumerate(rows):
            kind, etype, level, given = kinds[i], types[i], r["level"], r["element_order"]
            order = -1 if given is None else given
            document = block[i] and etype == "document" and level == 0
            low = level is not None and level < 1 and not document
            needed = 1 if kind == "inline" else {"list_item": 2, "caption": 4}.get(etype, 0) if block[i] else 0
            stray = bool(needed) and not above[i] & needed
            encoding = r["encoding"] or ""
            for rule, holds, field, message in (
                ("V1", level is None, "level", "level is null"),
                ("V2", low, "level", f"level {level} is below 1"),
                ("V3", level is not None and not low and (before or 0) > 0 and level > (before or 0) + 1, "level", f"level {level} follows level {before}"),
                ("V4", document and bool(r["content"]), "content", "a document root has content"),
                ("V5", kind != "" and kind not in KINDS, "kind", f"unknown kind {kind}"),
                ("V6", etype == "", "element_type", "no element type"),
                ("V7", encoding != "" and encoding not in ENCODINGS, "encoding", f"unknown encoding {encoding}"),
                ("V8", order < 0, "element_order", "order is null or negative"),
                ("V9", order >= 0 and order in seen, "element_order", f"order {order} stands twice"),
                ("L1", order != (last + 1 if i else 0), "list", "orders must run from 0 without gaps"),
                ("L2", i == top and depths[i] > 1, "list", f"the top level is {depths[i]}"),
                ("L6", kind == "inline" and depths[i] == scopes[i], "list", "an inline stands at the level of the value before it"),
                ("L4", block[i] and stray, "list", f"{etype} stands outside of what it belongs in"),
                ("L5", kind == "inline" and stray, "list", "an inline stands outside of any block or value"),
            ):
                if holds:
                    yield order, rule, field, message
            seen.add(order)
            before, last = before if level is None else level, order


FUNCTIONS = {"document_sections": DocumentSections, "document_section": DocumentSection, "document_violations": DocumentViolations}


def register(spark: SparkSession) -> list[str]:
    """Creates the table functions in this session and returns their names."""
    reach_workers(spark)
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
    return list(FUNCTIONS)
