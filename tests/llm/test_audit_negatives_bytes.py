"""Filter audit, hard negatives and byte-level BPE against brute force, on small tables with nulls, ties, repeated and very long rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.llm import byte_bpe, filter_audit, hard_negatives
from folia.llm.queries import vocabulary

RND = random.Random(11)


def same(found, wanted):
    """Equal as bags."""
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


# filter audit


def slow_audit(names, counts):
    """By removing masks step by step, for every order."""
    rows, summed = [], dict.fromkeys(range(len(names)), 0)
    for order in itertools.permutations(range(len(names))):
        left = dict(counts)
        for step, f in enumerate(order, 1):
            gone = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if not m >> f & 1}
            n = sum(c[0] for c in gone.values())
            summed[f] += n
            fail = sum(c[0] for m, c in counts.items() if m >> f & 1)
            rows.append(("".join(names[i] for i in order), step, sum(c[0] for c in left.values()), n, fail - n, counts.get(1 << f, (0,))[0], *[sum(c[i] for c in gone.values()) for i in range(1, 3)], f))
    return [(*r[:-1], summed[r[-1]]) for r in rows]


def test_swaps_lead_through_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for place in filter_audit.neighbour_swaps(n):
            order[place], order[place + 1] = order[place + 1], order[place]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) and sum(1 for _ in filter_audit.neighbour_swaps(n)) == math.factorial(n) - 1


def test_diagrams_equal_removal_step_by_step():
    for _ in range(60):
        n = RND.randint(1, 5)
        counts = {m: (RND.choice([1, 2, 2, 5]), RND.randint(0, 1), RND.randint(0, 2)) for m in range(1 << n) if RND.random() < RND.choice([0.2, 0.6, 1])} or {0: (1, 0, 0)}
        assert sorted(filter_audit.audited(list("ABCDE"[:n]), counts)) == sorted(slow_audit("ABCDE"[:n], counts))


def test_a_swap_leaves_the_other_levels_and_what_is_counted():
    counts = {m: (m + 1, 0, 0) for m in range(16)}
    diagram = filter_audit.Diagram(4, counts)
    before = [dict(level) for level in diagram._levels]
    diagram.swap(1)
    assert diagram._levels[0] == before[0] and diagram._levels[3] == before[3]
    assert diagram.order == [0, 2, 1, 3] and diagram.weight[diagram.root] == (136, 0, 0)
    # filters that no document fails, or all counts equal: one node for each level
    assert [len(x) for x in filter_audit.Diagram(4, {0: (3, 0, 0)})._levels] == [1, 1, 1, 1]
    assert [len(x) for x in filter_audit.Diagram(4, dict.fromkeys(range(16), (1, 0, 0)))._levels] == [1, 1, 1, 1]


WORDS = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", "en"), (4, WORDS, "en"), (5, WORDS, "de"), (6, WORDS + " #", "en"), (7, "A b " * 150, "en"), (8, "ÀÉ a " * 100 + WORDS, None), (9, WORDS.upper(), ""),
    (None, WORDS, "en"), (None, None, None), (4, WORDS, "en"), (4, WORDS, "de"), (10, "x" * 50_000, "fr"), (11, "Word word " * 100, "en"), (12, WORDS.replace(" ", "\x0b"), "en"), (13, WORDS.replace(" ", "\xa0"), "en"),
    (14, "A" * 3 + "b" * 97, "en"), (15, "A" * 4 + "b" * 96, "en"),
] + [(100 + i, "copied " + WORDS, "en") for i in range(40)]
LABELS = [(4, 1, 0), (4, 0, 1), (5, 1, None), (6, None, 1), (100, 1, 1), (101, 1, 0), (None, 1, 1), (999, 1, 1), (2, 0, 0), (7, 1, 0)]


def slow_documents():
    import re

    counts: dict[str, dict[int, list[int]]] = {}
    good, toxic = {d for d, q, _ in LABELS if d is not None and q == 1}, {d for d, _, t in LABELS if d is not None and t == 1}
    for doc, text, lang in DOCS:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
        fails.append(doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in DOCS))
        c = counts.setdefault(lang or "", {}).setdefault(sum(1 << i for i, f in enumerate(fails) if f), [0, 0, 0])
        for i, one in enumerate((1, doc in good, doc in toxic)):
            c[i] += one
    return [(part, *r) for part, masks in counts.items() for r in slow_audit("ABCDE", masks)]


def test_document_audit(spark):
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, lang string, part int").repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.document_audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    same(found.collect(), slow_documents())
    none = spark.createDataFrame([], docs.schema)
    assert filter_audit.document_audit(none, labels).count() == 0
    assert filter_audit.document_audit(docs, spark.createDataFrame([], labels.schema)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_filter_audit_of_other_filters(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 9, None)], "id int, x int, mask string")
    found = filter_audit.filter_audit(rows, {"p": F.col("x") > 4, "q": F.col("id") == 1}, F.col("mask"))
    same(found.collect(), [(p, *r[:6], r[8]) for p, masks in {"a": {3: (1, 0, 0), 0: (1, 0, 0)}, "": {1: (1, 0, 0)}}.items() for r in slow_audit("pq", masks)])
    with pytest.raises(ValueError, match="letter"):
        filter_audit.filter_audit(rows, {"pp": F.lit(True)}, F.col("mask"))


# hard negatives


def test_residues_give_exact_scores():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 1), (64, 150), (300, 1000), (7, 10**8), (3, 10**9), (64, 3 * 10**8)):
        a, b = rng.integers(-most, most + 1, (5, dims)), rng.integers(-most, most + 1, (9, dims))
        a[0], b[0], b[1] = most, most, -most
        field = hard_negatives.Residues(dims * most**2)
        assert field.scores(field.of(a), field.of(b)).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    with pytest.raises(ValueError, match="64-bit"):
        hard_negatives.Residues(1 << 63)


def test_best_keeps_the_first_of_ties():
    rng = np.random.default_rng(2)
    none = np.iinfo(np.int64).min
    for _ in range(150):
        k = int(rng.integers(1, 6))
        best, offered = hard_negatives.Best(3, k), [[], [], []]
        for _ in range(rng.integers(1, 5)):
            m = int(rng.integers(1, 40))
            scores, ids = rng.integers(-2, 3, (3, m)), np.sort(rng.integers(0, 50, m))
            scores[rng.random((3, m)) < 0.3] = none
            best.add(0, scores.copy(), ids)
            for i in range(3):
                offered[i] += [(-int(s), int(x)) for s, x in zip(scores[i], ids, strict=True) if s > none]
        for i in range(3):
            assert [(-int(s), int(x)) for s, x in zip(best.score[i], best.id[i], strict=True) if s > none] == sorted(offered[i])[:k]


def test_windows():
    for p in range(-25, 40):
        low, high = hard_negatives.window(p, 30, 90)
        assert [s for s in range(-60, 60) if 30 * p <= 100 * s <= 90 * p] == list(range(low, high + 1))


def slow_negatives(rows, positives=5, negatives=10):
    rows = [(i, label, v) for i, label, v in rows if None not in (i, label, v)]
    out = []
    for at, (i, label, v) in enumerate(rows):
        if i % 10:
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, other == label) for b, (j, other, w) in enumerate(rows) if b != at)
        for p, j, _ in [x for x in scored if x[2]][:positives]:
            hits = [(s, m) for s, m, alike in scored if not alike and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, rank, m, -p, -s) for rank, (s, m) in enumerate(hits, 1)]
    return out


@pytest.mark.parametrize(("row_block", "anchor_block"), [(4096, 16_384), (16, 300)])
def test_hard_negatives(spark, row_block, anchor_block):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(4), [rnd.randint(-20, 40) for _ in range(6)]) for i in range(300)]
    rows += [(rnd.randrange(300), 1, rows[7][2]) for _ in range(150)]  # a vector of a third of all rows
    rows += [rows[10]] * 3 + [(10, rows[10][1], rows[11][2]), (20, 9, [1] * 6), (30, 8, []), (40, 1, [3, 4])]  # repeated anchors, a label of one row, short vectors
    rows += [(None, 1, [1] * 6), (50, None, [1] * 6), (60, 1, None)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "id long, label long, v array<long>, key int").repartition(5)
    found = hard_negatives.hard_negatives(table.where("id is not null and label is not null and v is not null"), F.col("id") % 10 == 0, row_block=row_block, anchor_block=anchor_block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    same(found.collect(), slow_negatives(rows))


def test_many_anchors_in_blocks(spark):
    rnd = random.Random(8)
    rows = [(10 * i, rnd.randrange(3), [rnd.randint(0, 9) for _ in range(3)]) for i in range(400)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, "id long, label long, v array<long>"), F.lit(True), positives=2, negatives=3, row_block=64, anchor_block=1)
    same(found.collect(), slow_negatives(rows, 2, 3))


def test_vectors_that_take_part(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, 0, [0.5, -0.001]), (2, 1, [1.0, None]), (3, 1, [nan]), (4, 1, [inf, 0.0]), (5, None, [1.0]), (None, 1, [1.0]), (6, 1, None), (7, 3, [])]
    table = spark.createDataFrame(data, "vec_id int, label int, embedding array<float>")
    same(hard_negatives.whole_vectors(table).collect(), [(1, 0, [128, -1]), (7, 3, [])])
    none = spark.createDataFrame([], "id long, label long, v array<long>")
    assert hard_negatives.hard_negatives(none, F.col("id") >= 0).count() == 0
    huge = spark.createDataFrame([(1, 0, [1e300]), (2, 0, [1.0])], "vec_id int, label int, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        hard_negatives.hard_negatives(hard_negatives.whole_vectors(huge), F.col("id") > 0)


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def arguments():
    import public_tokenizers

    return vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


PIECES = ["x" * 90, "x" * 300, " ", "  ", "\n", "'", "'ll", "'v", "12", "é", "字", " a", ".", "🙂", "\x00", "\x85", "　"]
LONG = [
    None, "", "a", "word " * 900, "  \n " * 700, "'s" * 900, "a'll b've " * 200, "x" * 300 + " y" * 50 + "'" * 500 + "z 12 " * 99, " " * 1000 + "a", "é" * 100 + " 字" * 300, "x" * 5000, "<|endoftext|>" * 90,
] + ["".join(RND.choice(PIECES) for _ in range(RND.randint(10, 300))) for _ in range(60)]


@pytest.mark.parametrize(("chunk", "shared"), [(64, 16), (200, 50), (1000, 100), (32_768, 1_024)])
def test_chunks_are_stitched(spark, library, chunk, shared):
    rows = [(i, t, 7, "k") for i, t in enumerate(LONG)] + [(3, LONG[3], 7, "k"), (None, LONG[4], 7, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_id int, at string").repartition(3)
    found = byte_bpe.byte_bpe_encode(docs, *arguments(), chunk=chunk, shared=shared, cache_bytes=2_000)
    assert found.columns == ["doc_id", "text", "text_id", "at", "ids", "decoded"]
    same([(*r[:4], r[4], bytes(r[5])) for r in found.collect()], [(*r, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows])
    digests = byte_bpe.byte_bpe_encode(docs, *arguments(), keep=["doc_id"], digests=True, chunk=chunk, shared=shared).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r[1]: library.encode_ordinary(r[1] or "") for r in rows}
    same(digests, [(r[0], len(ids[r[1]]), sha(np.array(ids[r[1]], dtype="<u4").tobytes()), sha((r[1] or "").encode())) for r in rows])


def test_merges_equal_the_library(library):
    ranks = byte_bpe.Ranks(*arguments())
    for alphabet in ("ab", "abc the", "xyz'sll ", "é字🙂 \n\t ", "0123 .-"):
        for n in (1, 2, 8, 40, 300, 900):
            for _ in range(15):
                word = "".join(RND.choice(alphabet) for _ in range(n)).encode()
                wanted = library._core_bpe.encode_single_piece(word)
                assert ranks.merged(word) == wanted
                assert ranks._merged_by_heap(word) == wanted or word in ranks.ranks
    text = "Zöe's 12 naïve  cats"
    assert ranks.decoded(ranks.encoded(ranks.split.findall(text), 10)) == text.encode()


def test_a_long_word_takes_no_quadratic_time(library):
    import time

    ranks, word = byte_bpe.Ranks(*arguments()), ("abcdefgh" * 50_000).encode()
    start = time.process_time()
    ids = ranks.merged(word)
    assert ranks.decoded(np.array(ids, dtype="<u4").tobytes()) == word and time.process_time() - start < 20


def test_byte_bpe_decode_and_edges(spark):
    path, pattern = arguments()
    rows = spark.createDataFrame([(1, [64, 65], 5), (2, None, 5), (3, [], 5), (4, [10**6], 5)], "doc_id long, ids array<long>, decoded int")
    found = byte_bpe.byte_bpe_decode(rows, path)
    assert found.columns == ["doc_id", "ids", "decoded"]
    assert [r["decoded"] and bytes(r["decoded"]) for r in found.orderBy("doc_id").collect()] == [b"ab", None, b"", None]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.byte_bpe_encode(none, path, pattern).count() == 0
    with pytest.raises(ValueError, match="twice"):
        byte_bpe.byte_bpe_encode(none, path, pattern, chunk=100, shared=60)
