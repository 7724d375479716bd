"""Normalizing and repairing documents.

Both insert or delete elements one after the other, each step depending on the
last, so they work on one document at a time in an Arrow UDF over the list form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folia.schema import FIELDS, LIST
from folia.workers import reach_workers

def _plain(element) -> dict:
    """An element as a dict, whichever form it arrived in."""
    return {f: element[f] for f in FIELDS}


def _level(e: dict) -> int:
    return 1 if e["level"] is None else e["level"]


def _next_at_or_above(levels: list[int]) -> list[int]:
    """For each place the first later one that isn't deeper; the length without one."""
    found = [len(levels)] * len(levels)
    waiting: list[int] = []
    for i, level in enumerate(levels):
        while waiting and levels[waiting[-1]] >= level:
            found[waiting.pop()] = i
        waiting.append(i)
    return found


def normalize_elements(blocks: list[dict]) -> list[dict]:
    """Moves the text of each lone plain block into its container, until none is left.

    A plain block is lone if the element before it is a block without content one
    level above, and the next element that isn't deeper isn't a block of its
    level. Its inlines go up one level, and orders behind it go down by one.

    One pass: whether a block is lone depends on what stands before it, which is
    settled by then, and on the next element that isn't deeper, which no
    collapse changes.
    """
    levels = [_level(b) for b in blocks]
    after = _next_at_or_above(levels)
    out: list[dict] = []
    dissolved: list[int] = []  # levels of the collapsed blocks that the place lies in
    gone = 0
    for i, block in enumerate(blocks):
        while dissolved and levels[i] <= dissolved[-1]:
            dissolved.pop()
        e = dict(block)
        if dissolved:
            e["level"] = levels[i] - len(dissolved)
        level = _level(e)
        if e["kind"] == "block" and e["element_type"] == "plain" and level > 1 and out:
            above = out[-1]
            j = after[i]
            beside = j < len(blocks) and blocks[j]["kind"] == "block" and levels[j] == levels[i] - len(dissolved) + sum(levels[j] > d for d in dissolved)
            if above["kind"] == "block" and not above["content"] and above["level"] == level - 1 and not beside:
                above["content"] = e["content"]
                dissolved.append(levels[i])
                gone += 1
                continue
        if e["element_order"] is not None:
            e["element_order"] -= gone
        out.append(e)
    return out


#: What may have to lie above an element, and what does for it: (kind, types); no types: any.
_NEEDS = {
    "holder": lambda kind, name: kind != "inline",
    "list": lambda kind, name: kind == "block" and name in ("list", "deflist"),
    "figure": lambda kind, name: kind == "block" and name in ("figure", "table"),
}


def _need(e: dict) -> tuple[str, str] | None:
    """What has to lie above an element, and the type of the block that is put there if nothing does."""
    if e["kind"] == "inline":
        return "holder", "plain"
    return {("block", "list_item"): ("list", "list"), ("block", "caption"): ("figure", "figure")}.get((e["kind"], e["element_type"]))


def _wrapped(work: list[dict]) -> list[dict]:
    """Strays, in runs, inside the container that they need.

    For each need the least level at which an element that does for it is open
    tells whether a deeper element has one above it.
    """
    out: list[dict] = []
    least = dict.fromkeys(_NEEDS, math.inf)
    run = None  # of the strays being wrapped: level, what their siblings must be, levels that they go down

    def opened(kind: str, name: str, level: int) -> None:
        for need, does in _NEEDS.items():
            if does(kind, name):
                least[need] = min(least[need], level)

    for e in work:
        level, need = e["level"], _need(e)
        alike = "inline" if e["kind"] == "inline" else (e["kind"], e["element_type"])
        if run is None or level < run[0] or (level == run[0] and alike != run[1]):
            run = None
            least = {n: at if at < level else math.inf for n, at in least.items()}
            if need is None or least[need[0]] < level:
                opened(e["kind"], e["element_type"], level)
            else:
                name, down = need[1], int(level <= 1)
                run = (level, alike, down)
                attributes = {"list_type": "bullet"} if name == "list" else {}
                out.append({"kind": "block", "element_type": name, "content": "", "level": level - 1 + down, "encoding": "text", "attributes": attributes, "element_order": 0})
                opened("block", name, level - 1 + down)
        out.append(e | {"level": level + (run[2] if run else 0)})
    return out


def repair_elements(blocks: list[dict]) -> list[dict]:
    """Wraps strays, brings the top level to 1, closes jumps in level and numbers orders from 0. Texts and types stay."""
    work = _wrapped([b | {"level": _level(b)} for b in blocks])
    rooted = any(e["level"] == 0 and e["kind"] == "block" and e["element_type"] == "document" for e in work)
    if work and not rooted:
        off = min(e["level"] for e in work) - 1
        for e in work:
            e["level"] -= off
    before = 0
    # a jump moves its row and all that follow at that depth or deeper; the moves that are still open are kept as (level, how far all up to it move)
    moves: list[tuple[int, int]] = []
    for e in work:
        level = e["level"]
        while moves and level < moves[-1][0]:
            moves.pop()
        shift = moves[-1][1] if moves else 0
        now = level - shift
        if now > before + 1:
            moves.append((level, shift + now - before - 1))
            now = before + 1
        e["level"] = before = now
    for i, e in enumerate(work):
        e["element_order"] = i
    return work


@F.udf(LIST, useArrow=True)
def _normalize(blocks):
    return None if blocks is None else normalize_elements([_plain(b) for b in blocks if b is not None])


@F.udf(LIST, useArrow=True)
def _repair(blocks):
    return None if blocks is None else repair_elements([_plain(b) for b in blocks if b is not None])


def _reach() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        reach_workers(spark)


def normalize(blocks: Column) -> Column:
    """A list column with each lone plain block collapsed into its container; null gives null. Idempotent."""
    _reach()
    return _normalize(blocks)


def repair(blocks: Column) -> Column:
    """A list column made structurally valid; null gives null. Idempotent."""
    _reach()
    return _repair(blocks)
