"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of UTF-8, ``order`` of them to an n-gram, and is
made of tables that are dealt by their keys: n-gram counts are summed in each
task and then across tasks; the continuation counts of a shorter n-gram are
the number of longer ones that end with it; contexts' sums and counts of
counts come from grouping by context; and each order's probabilities are joined
to the next shorter order's by suffix and to its contexts by prefix.

Documents are scored in one pass over their texts, whatever the model's size.
The most frequent n-grams, at most ``frequent``, are broadcast with their
probabilities. What a chunk of texts holds beyond those is reduced to distinct
n-grams with the places where each stands, and written to the shared folder,
dealt to shards by n-gram. The distinct n-grams of all chunks are joined with
the model, order by order: one that an order lacks takes its context's weight
and goes on as its suffix, distinct again, so no join has a hot key. Each
shard's probabilities then meet the places of that shard, and the sums go back
to the rows by chunk. All trusted text is counted and every document is scored.

A part of the trusted documents is held out of the counts. Perplexities of
those, by language, give the quantile up to which documents are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import checkpointed, release_others, written
from folia.workers import reach_workers

#: Stands before a text's first byte and after its last.
_BEFORE, _AFTER = 2, 3

#: Bytes of texts to a chunk, and places that are worked on at a time; a longer text is a chunk of its own.
_CHUNK, _BLOCK = 4_000_000, 1_000_000

#: Rows of a model table that a task takes at least; short orders dealt to as many tasks as the texts would be little more than headers of blocks.
_TASK_ROWS = 100_000


def grams(texts: list[str], order: int, block: int = _BLOCK):
    """All n-grams of some texts as numbers, with the position of each one's text, in blocks.

    A text of n bytes has n + 1: one ends at each byte and one at its end.
    """
    pad = bytes([_BEFORE]) * (order - 1)
    data = [pad + t.encode("utf-8", "surrogatepass") + bytes([_AFTER]) for t in texts]
    ends = np.cumsum([len(d) for d in data])
    starts = ends - np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    for at in range(order - 1, len(flat), block):
        end = min(len(flat), at + block)
        part = flat[at - order + 1 : end].astype(np.int64)
        found = np.zeros(end - at, dtype=np.int64)
        for i in range(order):
            found = (found << 8) | part[i : i + len(found)]
        place = np.arange(at, end)
        owner = np.searchsorted(ends, place, "right")
        inside = place - starts[owner] >= order - 1
        yield found[inside], owner[inside]


def _chunks(column: pa.Array, chunk: int = _CHUNK):
    """Slices of a text column of some megabytes each, with their first row; null counts as empty."""
    texts, size, first = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= chunk:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def gram_counts(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """(gram, c): the n-grams of all texts, summed in each task before they are dealt out."""

    def run(batches):
        release_others(__name__)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                for found, _ in grams(texts, order):
                    keys, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["gram", "c"])

    reach_workers(docs.sparkSession)
    return docs.select(text_col).mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    row = level.agg(*[F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (x or 0 for x in row)
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5  # too little text for the estimate
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), float(i)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def model_tables(trusted: DataFrame, text_col: str = "text", order: int = 6) -> DataFrame:
    """The model as (n, key, p, c, gamma).

    For n-grams of each length n, ``p`` is the probability of their last byte
    and ``c`` their count; for contexts of length n - 1, ``gamma`` is the
    weight of the shorter context. What doesn't apply is null.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must lie between 2 and 7")
    levels = {order: checkpointed(gram_counts(trusted, text_col, order))}
    tasks = {order: math.ceil(levels[order].count() / _TASK_ROWS) or 1}
    levels[order] = levels[order].coalesce(tasks[order])
    for n in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (8 * n)) - 1)
        level = levels[n + 1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels[n] = checkpointed(level.coalesce(tasks[n + 1]))
        tasks[n] = math.ceil(levels[n].count() / _TASK_ROWS) or 1
        levels[n] = levels[n].coalesce(tasks[n])
    out = None
    below = None
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(levels[n])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        level = levels[n].withColumn("ctx", F.shiftright("gram", 8))
        contexts = level.groupBy("ctx").agg(F.sum("c").alias("tot"), (F.sum(cut) / F.sum("c")).alias("gamma")).coalesce(tasks[n])
        both = level.join(contexts, "ctx").withColumn("own", (F.col("c") - cut) / F.col("tot")).coalesce(tasks[n])
        if below is None:
            p = both.select("gram", "c", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND((1 << (8 * (n - 1))) - 1)
            p = both.withColumn("low", suffix).join(below, "low").select("gram", "c", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
        p = checkpointed(p.coalesce(tasks[n]))
        below = p.select(F.col("gram").alias("low"), F.col("p").alias("q"))
        rows = p.select(F.lit(n).alias("n"), F.col("gram").alias("key"), "p", "c", F.lit(None).cast("double").alias("gamma")).unionByName(
            contexts.select(F.lit(n).alias("n"), F.col("ctx").alias("key"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("long").alias("c"), "gamma")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _look(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is there, and its value."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.ones(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _sorted_table(table: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table["key"].to_numpy(), table[value].to_numpy()
    by = np.argsort(keys)
    return keys[by], values[by].astype(np.float64)


class LowOrders:
    """The tables of the shorter orders, small enough to be held whole."""

    def __init__(self, order: int, grams_: dict[int, tuple], contexts: dict[int, tuple]):
        self.order, self.grams, self.contexts = order, grams_, contexts

    def probabilities(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The probabilities of the last bytes of some distinct n-grams of length n."""
        if n == 0:
            return np.full(len(keys), 1 / 256)
        known, p = _look(self.grams[n], keys)
        p = np.where(known, p, 0.0)
        left = ~known
        if left.any():
            seen, weight = _look(self.contexts[n], keys[left] >> 8)
            low, back = np.unique(keys[left] & ((1 << (8 * (n - 1))) - 1), return_inverse=True)
            p[left] = np.where(seen, weight, 1.0) * self.probabilities(low, n - 1)[back]
        return p


def _low_orders(model: DataFrame, most: int) -> LowOrders:
    """As many of the shortest orders as have at most ``most`` entries together."""
    sizes = dict(model.groupBy("n").count().collect())
    order, total = 0, 0
    while order + 1 in sizes and total + sizes[order + 1] <= most:
        order += 1
        total += sizes[order]
    tables: list[dict] = [{}, {}]
    for n in range(1, order + 1):
        for out, value in zip(tables, ("p", "gamma"), strict=True):
            out[n] = _sorted_table(model.where((F.col("n") == n) & F.col(value).isNotNull()).select("key", value).toArrow(), value)
    return LowOrders(order, *tables)


def _most_frequent(model: DataFrame, order: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-grams of the largest counts, at most ``most``: keys and logarithms of probabilities.

    Counts are taken in steps of an eighth of a power of two, the whole of a step or none of it.
    """
    longest = model.where((F.col("n") == order) & F.col("p").isNotNull())
    step = F.floor(F.log2("c") * 8)
    steps = sorted(longest.groupBy(step.alias("s")).count().collect(), reverse=True)
    least, total = None, 0
    for s, n in steps:
        if total + n > most:
            break
        least, total = s, total + n
    chosen = longest.where(step >= least) if least is not None else longest.where("false")
    keys, p = _sorted_table(chosen.select("key", "p").toArrow(), "p")
    return keys, np.log(p)


def _resolved(keys: DataFrame, n: int, model: DataFrame, low) -> DataFrame:
    """(key, p) of distinct n-grams of length n, by joins with the orders that aren't held whole."""
    if n <= low.value.order:

        def run(batches):
            release_others(__name__)
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low.value.probabilities(key, n))], names=["key", "p"])

        return keys.mapInArrow(run, "key long, p double")
    own = model.where((F.col("n") == n) & F.col("p").isNotNull()).select("key", "p")
    weights = model.where((F.col("n") == n) & F.col("gamma").isNotNull()).select(F.col("key").alias("ctx"), "gamma")
    met = written(keys.join(own, "key", "left"), f"order-{n}")
    left = met.where("p is null").select("key", F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND((1 << (8 * (n - 1))) - 1).alias("low"))
    shorter = _resolved(left.select(F.col("low").alias("key")).distinct(), n - 1, model, low).select(F.col("key").alias("low"), F.col("p").alias("q"))
    rest = left.join(weights, "ctx", "left").join(shorter, "low").select("key", (F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))
    return met.where("p is not null").unionByName(rest)


_PLACES = "chunk long, shard long, head binary, keys array<long>, sizes array<int>, owners array<int>, times array<int>"


def _lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values).cast(kind))


def _places(source: DataFrame, order: int, frequent, shards: int, chunk_bytes: int) -> DataFrame:
    """For each chunk of texts: a head (ids, sums over frequent n-grams, numbers of places), and for each shard the other n-grams with their places."""
    names = source.columns[:-1]
    fields = [f.name for f in T._parse_datatype_string(_PLACES).fields]

    def run(batches):
        release_others(__name__)
        first_chunk = TaskContext.get().partitionId() << 32
        number = 0
        for batch in batches:
            for first, texts in _chunks(batch.column(len(names)), chunk_bytes):
                sums, n_places, codes, times = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), [], []
                for found, owner in grams(texts, order):
                    keys, back = np.unique(found, return_inverse=True)
                    known, value = _look(frequent.value, keys)
                    sums += np.bincount(owner, weights=np.where(known, value, 0.0)[back], minlength=len(texts))
                    n_places += np.bincount(owner, minlength=len(texts))
                    other = ~known[back]
                    pairs, n = _pairs(keys, back[other], owner[other], len(texts))
                    codes.append(pairs)
                    times.append(n)
                chunk = first_chunk + number
                number += 1
                some = batch.slice(first, len(texts))
                sink = pa.BufferOutputStream()
                head = pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(names))], pa.array(sums), pa.array(n_places)], names=[*names, "log_p", "n_places"])
                with pa.ipc.new_stream(sink, head.schema) as out:
                    out.write_batch(head)
                none = pa.nulls(1, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([chunk % shards]), pa.array([sink.getvalue().to_pybytes()]), pa.nulls(1, pa.list_(pa.int64())), none, none, none], names=fields)
                key, owner = (np.concatenate([c[i] for c in codes]) if codes else np.zeros(0, dtype=np.int64) for i in (0, 1))
                n = np.concatenate(times) if times else np.zeros(0, dtype=np.int64)
                if not len(key):
                    continue
                by = np.lexsort((key, key % shards))
                key, owner, n = key[by], owner[by], n[by]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                at = np.nonzero(new)[0]
                unique, sizes = key[at], np.diff(np.concatenate([at, [len(key)]]))
                shard = unique % shards
                cuts = np.nonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))[0]
                of_pairs = np.concatenate([at[cuts], [len(key)]])
                of_keys = np.concatenate([cuts, [len(unique)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cuts), chunk)), pa.array(shard[cuts]), pa.nulls(len(cuts), pa.binary()), _lists(unique, of_keys, pa.int64()), _lists(sizes, of_keys, pa.int32()), _lists(owner, of_pairs, pa.int32()), _lists(n, of_pairs, pa.int32())],
                    names=fields,
                )

    return source.mapInArrow(run, _PLACES)


def _pairs(keys: np.ndarray, at: np.ndarray, owner: np.ndarray, n_owners: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct pairs of an n-gram (``keys[at]``) and its text, and how often each stands there."""
    code, n = np.unique(at * np.int64(n_owners) + owner, return_counts=True)
    return (keys[code // n_owners], code % n_owners), n


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """All elements of a list column, in order."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _shard_sums(places: pa.Table, known: pa.Table) -> pa.Table:
    """For each chunk that has places in a shard: the texts, and what the shard's n-grams add to each."""
    keys, p = _sorted_table(known, "p")
    log_p = np.log(p)
    chunks, lists = places["chunk"].to_numpy(), {c: places[c].combine_chunks() for c in ("keys", "sizes", "owners", "times")}
    out: list[list] = [[], [], []]
    for i, chunk in enumerate(chunks):
        key, sizes, owner, n = (lists[c][i].values.to_numpy(zero_copy_only=False) for c in ("keys", "sizes", "owners", "times"))
        value = np.repeat(log_p[np.searchsorted(keys, key)], sizes) * n
        who, back = np.unique(owner, return_inverse=True)
        for column, x in zip(out, (chunk, who, np.bincount(back, weights=value)), strict=True):
            column.append(x)
    return pa.table({"chunk": pa.array(out[0], pa.int64()), "owners": pa.array(out[1], pa.list_(pa.int32())), "sums": pa.array(out[2], pa.list_(pa.float64())), "head": pa.nulls(len(chunks), pa.binary())})


def log_likelihoods(docs: DataFrame, model: DataFrame, id_cols: list[str], text_col: str = "text", order: int = 6, frequent: int = 1_000_000, low_entries: int = 1_000_000, shard_bytes: int = 64_000_000, chunk_bytes: int = _CHUNK) -> DataFrame:
    """Adds to ``id_cols`` of each row ``log_p`` (natural logarithm of the text's probability) and ``n_places`` (bytes and the end)."""
    spark = docs.sparkSession
    reach_workers(spark)
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(id_cols)], F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("log_p", T.DoubleType()), T.StructField("n_places", T.LongType())])
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = math.ceil(size / shard_bytes) | 1
    top = spark.sparkContext.broadcast(_most_frequent(model, order, frequent))
    low = spark.sparkContext.broadcast(_low_orders(model, low_entries))
    places = written(_places(source, order, top, shards, chunk_bytes), "places")
    wanted = places.where("keys is not null").select(F.explode("keys").alias("key")).distinct()
    known = _resolved(wanted, order, model, low).withColumn("shard", F.col("key") % shards)
    sums = places.where("keys is not null").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_shard_sums, "chunk long, owners array<int>, sums array<double>, head binary")
    none = F.lit(None)
    heads = places.where("head is not null").select("chunk", none.cast("array<int>").alias("owners"), none.cast("array<double>").alias("sums"), "head")

    def finish(group: pa.Table) -> pa.Table:
        head = next(x.as_py() for x in group["head"] if x.is_valid)
        batch = pa.ipc.open_stream(head).read_next_batch()
        total = batch.column("log_p").to_numpy().copy()
        rest = group.filter(pc.is_valid(group["owners"]))
        np.add.at(total, _flat(rest["owners"]), _flat(rest["sums"]))
        return pa.Table.from_batches([batch.set_column(batch.schema.get_field_index("log_p"), "log_p", pa.array(total))])

    done = sums.unionByName(heads).groupBy("chunk").applyInArrow(finish, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(id_cols)], "log_p", "n_places")


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 6, quantile: float = 0.98, calibration: int = 5, broadcast_rows: int = 2_000_000, **settings) -> DataFrame:
    """Each row with its perplexity, its language's threshold and whether it is kept.

    ``trusted``: ids of trusted documents in ``id_col``; one in ``calibration``
    (by a hash of the id) is held out of the counts. Columns: id, ``lang``,
    ``perplexity`` (a place), ``threshold`` and ``keep``. ``threshold`` is the
    ``quantile`` of the language's held-out perplexities; a language without
    any, null included, takes that of all of them, and without held-out text all
    documents are kept and thresholds are null. A perplexity equal to the
    threshold is kept. Null texts count as empty (one place: the end). Ids may
    be null or repeated: a row is trusted if its id is. No documents, no rows.
    """
    ids = trusted.select(F.col(id_col).alias("__trusted")).where("__trusted is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    held = F.pmod(F.xxhash64("__trusted", F.lit(3)), F.lit(calibration)) == 0
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = written(model_tables(own.join(ids.where(~held), F.col("id") == F.col("__trusted"), "left_semi"), "text", order), "kneser-ney")
    scores = written(log_likelihoods(own, model, ["id", "lang"], "text", order, **settings).withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_places"))), "perplexities")
    marks = scores.join(ids.where(held), F.col("id") == F.col("__trusted"), "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = marks.where("lang is not null").groupBy(F.col("lang").alias("__lang")).agg(at.alias("own"))
    overall = F.lit(marks.agg(at).first()[0]).cast("double")
    threshold = F.coalesce("own", overall)
    return scores.join(by_lang, F.col("lang") == F.col("__lang"), "left").select(
        F.col("id").alias(id_col), "lang", F.round("perplexity", 6).alias("perplexity"), F.round(threshold, 6).alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"),
    )
