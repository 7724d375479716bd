"""Tree relations over the row form, from depth and adjacency alone.

A row's ancestors are found on a stack, in one pass over the document's rows
in their order. The engine deals rows by document and sorts them by place; the
pass streams over the sorted rows as Arrow batches and adds columns, at a cost
in proportion to the rows, however deep documents are. What is asked of an
ancestor is a boolean column, which the engine works out before the pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from folia.workers import reach_workers


def by_document(doc_cols: list[str]) -> WindowSpec:
    return Window.partitionBy(*doc_cols).orderBy("pos")


def depth(level: Column) -> Column:
    """A null level reads as 1, the depth of a top-level element."""
    return F.coalesce(level, F.lit(1))


def _whole_documents(batches: Iterator, first: str) -> Iterator:
    """Arrow tables of whole documents, one or more, from batches of rows; ``first`` marks each document's first row."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        starts = [i for i, x in enumerate(batch.column(first).to_pylist()) if x]
        if not starts:
            held.append(batch)
            continue
        held.append(batch.slice(0, starts[-1]))
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held)
        held = [batch.slice(starts[-1])]
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


Pass = Callable[..., list[list]]


def in_order(rows: DataFrame, doc_cols: list[str], inputs: dict[str, Column], outputs: str, step: Pass, order: list[str | Column] | None = None) -> DataFrame:
    """Adds the columns of ``outputs`` (DDL) that ``step`` computes along each document's rows, sorted by ``order`` (default: ``pos``).

    ``step`` gets the list of marks of documents' first rows and a list for
    each of ``inputs``, of some whole documents, and returns a list for each
    output. Only inputs become Python objects; other columns pass as Arrow
    data. One exchange by document.
    """
    reach_workers(rows.sparkSession)
    own = rows.columns
    run = Window.partitionBy(*doc_cols).orderBy(*(order or ["pos"]))
    marked = rows.withColumns({"__first": F.row_number().over(run) == 1, **{f"__in{i}": c for i, c in enumerate(inputs.values())}})
    # the window deals rows by document; other windows may stand above it by now, so the order is asked for once more
    marked = marked.sortWithinPartitions(*doc_cols, *(order or ["pos"]))
    added = T._parse_datatype_string(outputs).fields
    schema = T.StructType([*rows.schema.fields, *added])
    n_inputs = len(inputs)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in added]

    def work(batches):
        import pyarrow as pa

        for table in _whole_documents(batches, "__first"):
            found = step(table["__first"].to_pylist(), *[table[f"__in{i}"].to_pylist() for i in range(n_inputs)])
            out = pa.table([table[c] for c in own] + [pa.array(x, type=t) for x, t in zip(found, arrow, strict=True)], names=schema.names)
            yield from out.to_batches()

    return marked.mapInArrow(work, schema)


def _relate(firsts: list[bool], levels: list[int], masks: list[int], values: list[bool], above_first: list | None = None, behind: list | None = None) -> list[list]:
    """For each row: what holds of some ancestor, of the parent, of the next row that isn't deeper, that one's level, and the level of the open value.

    Where rows are pieces of documents, a piece's first row says what lies
    around the piece: the elements still open (``above_first``: level, mask,
    value, from the root) and those behind it that close any (``behind``: level,
    mask, in order, each less deep than the one before).
    """
    n = len(levels)
    above, parents, following, next_level, scopes = [0] * n, [0] * n, [0] * n, [None] * n, [None] * n
    in_value = [False] * n
    levels, masks, values = list(levels), list(masks), list(values)  # open elements of earlier pieces go behind the rows

    def push(level: int, mask: int, value: bool) -> None:
        up = stack[-1] if stack else None
        stack.append(len(levels))
        for column, x in ((levels, level), (masks, mask), (values, value), (following, 0), (next_level, None)):
            column.append(x)
        above.append(0 if up is None else above[up] | masks[up])
        in_value.append(up is not None and (in_value[up] or values[up]))

    def close(later: list) -> None:
        for i in stack:
            # the first that isn't deeper
            found = next((x for x in later if x["level"] <= levels[i]), None)
            if found is not None:
                following[i], next_level[i] = found["mask"], found["level"]

    stack: list[int] = []  # rows that are open
    scope, later = None, []
    for i in range(n):
        level, mask = levels[i], masks[i]
        if firsts[i]:
            if later:
                close(later)
            stack, scope, later = [], None, (behind[i] or []) if behind else []
            for e in (above_first[i] or []) if above_first else []:
                push(e["level"], e["mask"], e["value"])
                if e["value"] and scope is None:
                    scope = e["level"]
        while stack and levels[stack[-1]] >= level:
            closed = stack.pop()
            following[closed], next_level[closed] = mask, level
        if stack:
            up = stack[-1]
            parents[i], above[i] = masks[up], above[up] | masks[up]
            in_value[i] = in_value[up] or values[up]
        scopes[i] = scope
        if values[i] and not in_value[i]:
            scope = level
        elif scope is not None and level <= scope:
            scope = None
        stack.append(i)
    if later:
        close(later)
    return [above[:n], parents, following[:n], next_level[:n], scopes]


def _summed_up(firsts: list[bool], levels: list[int], masks: list[int], values: list[bool]) -> list[list]:
    """At each piece's last row: the elements that it leaves open, and those that close elements of earlier pieces."""
    n = len(levels)
    opened, closing = [None] * n, [None] * n
    stack: list[int] = []
    least: list[int] = []
    for i in range(n):
        if firsts[i]:
            stack, least = [], []
        while stack and levels[stack[-1]] >= levels[i]:
            stack.pop()
        stack.append(i)
        if not least or levels[i] < levels[least[-1]]:
            least.append(i)
        if i + 1 == n or firsts[i + 1]:
            opened[i] = [{"level": levels[j], "mask": masks[j], "value": values[j]} for j in stack]
            closing[i] = [{"level": levels[j], "mask": masks[j]} for j in least]
    return [opened, closing]


def _carried(firsts: list[bool], opened: list[list], closing: list[list]) -> list[list]:
    """From all pieces of a document what lies around each: open elements before it, closing ones behind it."""
    n = len(firsts)
    before, behind = [None] * n, [None] * n
    stack: list[dict] = []
    for i in range(n):
        before[i] = stack = [] if firsts[i] else stack
        # of what was open, a piece leaves what is less deep than all of its rows
        stack = [e for e in stack if e["level"] < closing[i][-1]["level"]] + opened[i]
    later: list[dict] = []
    for i in reversed(range(n)):
        behind[i] = later
        later = [] if firsts[i] else closing[i] + [e for e in later if e["level"] < closing[i][-1]["level"]]
    return [before, behind]


_OPEN, _CLOSE = "array<struct<level int, mask int, value boolean>>", "array<struct<level int, mask int>>"
_RELATED = "__above int, __parent int, __next int, __next_level int, __scope int"


def _in_pieces(rows: DataFrame, doc_cols: list[str], inputs: dict[str, Column], piece_rows: int) -> DataFrame:
    """``rows`` with the columns of :func:`_relate`, by pieces of ``piece_rows`` places of each document.

    First each piece tells which elements it leaves open and which of its rows
    close earlier ones; from these few, in a document's order, follows what lies
    around each piece; then each piece is gone through with that. Tasks hold
    pieces, and for each document the elements open between its pieces.
    """
    rows = rows.withColumn("__piece", F.floor(F.col("pos") / piece_rows).cast("bigint"))
    piece = [*doc_cols, "__piece"]
    large = rows.groupBy(*doc_cols).agg((F.max("__piece") > F.min("__piece")).alias("__large")).where("__large").drop("__large")
    if doc_cols:
        same = [rows[c].eqNullSafe(large[c]) for c in doc_cols]
        narrow = rows.select(*piece, "pos", *[c.alias(f"__{name}") for name, c in inputs.items()]).join(large, same, "left_semi")
    else:
        narrow = rows.select(*piece, "pos", *[c.alias(f"__{name}") for name, c in inputs.items()])
    first = F.min("pos").over(Window.partitionBy(*piece))
    told = in_order(narrow.withColumn("__first_pos", first), piece, {name: F.col(f"__{name}") for name in inputs}, f"__opened {_OPEN}, __closing {_CLOSE}", _summed_up)
    pieces = told.where(F.col("__opened").isNotNull()).select(*piece, "__first_pos", "__opened", "__closing")
    around = in_order(pieces, doc_cols, {"opened": F.col("__opened"), "closing": F.col("__closing")}, f"__before {_OPEN}, __behind {_CLOSE}", _carried, ["__piece"])
    known = around.select(*[F.col(c).alias(f"__d{i}") for i, c in enumerate(piece)], "__first_pos", "__before", "__behind")
    on = [rows[c].eqNullSafe(known[f"__d{i}"]) for i, c in enumerate(piece)] + [rows["pos"] == known["__first_pos"]]
    met = rows.join(known, on, "left").drop("__first_pos", *[f"__d{i}" for i in range(len(piece))])
    return in_order(met, piece, {**inputs, "above_first": F.col("__before"), "behind": F.col("__behind")}, _RELATED, _relate).drop("__piece", "__before", "__behind")


class Related:
    """Rows with their relations: ``df``, and columns that tell what holds around a row.

    With ``piece_rows``, a document's rows needn't meet in one task: they are
    dealt in pieces of so many places.
    """

    def __init__(self, rows: DataFrame, doc_cols: list[str], tests: dict[str, Column], piece_rows: int | None = None):
        self._bit = {name: 1 << i for i, name in enumerate(tests)}
        mask = F.lit(0)
        for name, test in tests.items():
            mask = mask + F.when(F.coalesce(test, F.lit(False)), self._bit[name]).otherwise(0)
        value = F.coalesce(F.col("kind") == "value", F.lit(False))
        inputs = {"level": depth(F.col("level")), "mask": mask, "value": value}
        self.df = in_order(rows, doc_cols, inputs, _RELATED, _relate) if piece_rows is None else _in_pieces(rows, doc_cols, inputs, piece_rows)
        self.added = ["__above", "__parent", "__next", "__next_level", "__scope"]

    def above(self, name: str) -> Column:
        """Whether the test holds of some ancestor."""
        return F.col("__above").bitwiseAND(self._bit[name]) != 0

    def parent(self, name: str) -> Column:
        """Whether the test holds of the parent; false for a row without one."""
        return F.col("__parent").bitwiseAND(self._bit[name]) != 0

    def following(self, name: str) -> Column:
        """Whether the test holds of the first later row that isn't deeper; its level is ``__next_level``, null if there is none."""
        return F.col("__next").bitwiseAND(self._bit[name]) != 0


def is_inline() -> Column:
    return F.coalesce(F.col("kind") == "inline", F.lit(False))


def body(rows: DataFrame, doc_cols: list[str], piece_rows: int | None = None) -> DataFrame:
    """The rows of the body: no values, no metadata, nothing below them; orders and ``pos`` stay.

    One shuffle by document; with ``piece_rows`` by pieces of documents of so many places.
    """
    root = F.coalesce((F.col("kind") == "value") | (F.col("element_type") == "metadata"), F.lit(False))
    related = Related(rows, doc_cols, {"hidden": root}, piece_rows)
    return related.df.where(~root & ~related.above("hidden") & F.coalesce(F.col("kind").isin("block", "inline"), F.lit(False))).drop(*related.added)


def heading_scope(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """Adds ``in_value``: whether all rows since the last value element are deeper than it.

    That isn't "has a value ancestor": each value element begins the scope anew.
    """
    run = by_document(doc_cols)
    group = F.sum((F.coalesce(F.col("kind"), F.lit("")) == "value").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__values", group)
    inside = Window.partitionBy(*doc_cols, "__values").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = F.min(F.when(F.coalesce(F.col("kind"), F.lit("")) != "value", depth(F.col("level")))).over(inside)
    root = F.first(depth(F.col("level"))).over(inside)
    is_value = F.coalesce(F.col("kind"), F.lit("")) == "value"
    return rows.withColumn("in_value", (F.col("__values") > 0) & (is_value | (top > root))).drop("__values")
