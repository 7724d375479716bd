"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only; every row is worked on where it lies, without a
shuffle. ``split`` and ``regexp_extract_all`` with the same pattern give what
lies between the matches and the matches; a fold over both keeps the place and
collects the matches that pass, in groups, so that a text's time grows with its
length and not with the square of its matches. Patterns are written so that Java's matcher
neither recurses nor rescans: repetitions are possessive, and a match may only
begin where a run of its characters begins or the last match ended, which is
where the leftmost match begins anyway.

Spans are half-open and count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import unused

#: Characters on each side of a match in which context words count.
CONTEXT = 48


def _luhn(match: Column) -> Column:
    """Whether the digits of a match, every second one from the right doubled, sum to a multiple of ten."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _mod97(match: Column) -> Column:
    """Whether a match, its first four characters moved behind and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _digits(match: Column, least: int, most: int) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(least, most)


def _octets(match: Column) -> Column:
    """Whether every number is at most 255, however many zeros lead it."""
    return F.forall(F.split(match, "\\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that any text with a match passes, the validator, the score and its context words."""

    name: str
    pattern: str
    hint: str
    score: float
    words: str
    base: bool = True

    def valid(self, match: Column) -> Column:
        if self.name == "ip":
            return _octets(match)
        if self.name == "card":
            return _digits(match, 16, 19) & _luhn(match)
        if self.name == "phone":
            return _digits(match, 8, 15)
        if self.name == "iban":
            return _mod97(match)
        return F.lit(True)


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", 0.8, "card|visa|credit|debit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 0.8, "iban|bank|account|konto|compte|cuenta", False),
)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
#: Matches that are folded at a time: a fold copies what it has found for each of them.
_GROUP = 64


def _parts(gaps: Column, hits: Column) -> Column:
    """What lies before each match, with its length; the match; what lies behind it."""
    before = F.transform(gaps, lambda gap: F.struct(F.length(gap).alias("n"), F.right(gap, F.lit(CONTEXT)).alias("end")))
    behind = F.transform(F.slice(gaps, 2, F.size(gaps)), lambda gap: F.left(gap, F.lit(CONTEXT)))
    return F.arrays_zip(before.alias("gap"), hits.alias("hit"), behind.alias("behind"))


def _found(parts: Column, kind: Kind) -> Column:
    """The passing matches of one kind, by their start, with their scores.

    A context word near a match adds 0.1. Near are up to 48 characters on each
    side that belong to no other match of the kind.
    """
    none = F.array().cast(_SPAN)
    size = lambda part: part["gap"]["n"] + F.coalesce(F.length(part["hit"]), F.lit(0))

    def step(acc: Column, part: Column) -> Column:
        start, end = acc["at"] + part["gap"]["n"], acc["at"] + size(part)
        around = F.concat_ws(" ", part["gap"]["end"], part["behind"])
        score = F.when(around.rlike(f"(?i)(?<![a-z])(?:{kind.words})"), min(1.0, round(kind.score + 0.1, 2))).otherwise(kind.score)
        span = F.struct(F.lit(kind.name).alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), part["hit"].alias("text"), score.alias("score"))
        passes = part["hit"].isNotNull() & kind.valid(part["hit"])
        return F.struct(end.alias("at"), F.when(passes, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    group = lambda first: F.slice(parts, first, _GROUP)
    firsts = F.sequence(F.lit(1), F.size(parts), F.lit(_GROUP))
    sums = F.transform(firsts, lambda first: F.aggregate(group(first), F.lit(0), lambda n, part: n + size(part)))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    # one start more than groups: that of the text's end
    grouped = F.zip_with(firsts, F.slice(starts, 1, F.size(firsts)), lambda first, at: F.aggregate(group(first), F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"]))
    return F.when(parts.isNotNull(), F.flatten(grouped)).otherwise(none)


def pii_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Adds an array of (kind, start, end, text, score), by kind as listed and then by start.

    Null and empty texts have an empty array. All rows and columns stay; a
    column named ``out_col`` is replaced. Repeated rows get equal results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gaps, parts = ([unused(f"__{c}{i}", docs) for i in range(len(KINDS))] for c in ("gaps", "parts"))
    hinted = [text.contains(k.hint) if k.hint == "@" else text.rlike(k.hint) for k in KINDS]
    # columns of their own, as each is used more than once
    split = docs.withColumns({g: F.when(h, F.split(text, k.pattern, -1)) for g, h, k in zip(gaps, hinted, KINDS, strict=True)})
    hits = [F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in KINDS]
    zipped = split.withColumns({p: F.when(F.col(g).isNotNull(), _parts(F.col(g), h)) for p, g, h in zip(parts, gaps, hits, strict=True)})
    spans = F.concat(*[_found(F.col(p), k) for p, k in zip(parts, KINDS, strict=True)])
    return zipped.withColumn(out_col, spans).drop(*gaps, *parts)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, all spans as one string, the largest score (null without spans)."""
    found = pii_spans(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", "pii")
    base = [k.name for k in KINDS if k.base]
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    return found.select(
        id_col,
        *[count(name) for name in base],
        F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("max_score"),
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in brackets; overlapping spans give way to the one that starts first, and then ends last.

    Columns stay, whatever their names; null texts stay null.
    """
    own = unused("__pii", docs)
    found = pii_spans(docs, text_col, own)
    text = F.col(text_col)

    def step(acc: Column, span: Column) -> Column:
        skip = span["start"] < acc["at"]
        grown = F.concat(acc["out"], F.coalesce(text.substr(acc["at"].cast("int") + 1, (span["start"] - acc["at"]).cast("int")), F.lit("")), F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(F.when(skip, acc["at"]).otherwise(span["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(grown).alias("out"))

    ordered = F.array_sort(own, lambda a, b: F.when(a["start"] == b["start"], b["end"] - a["end"]).otherwise(a["start"] - b["start"]).cast("int"))
    done = F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step)
    rest = F.concat(done["out"], text.substr(done["at"].cast("int") + 1, F.length(text)))
    return found.withColumn(text_col, F.when(F.size(own) > 0, rest).otherwise(text)).select(*docs.columns)
