"""The pipeline's stages, one after the other, against brute force on a small table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folia.llm import secrets
from folia.llm.bpe import WordTokenizer
from folia.llm.queries import vocabulary
from test_operators import slow_components, slow_fingerprint, slow_words

RND = random.Random(9)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string"


def prose(n):
    return " ".join("".join(RND.choice(["th", "er", "an", "re", "in"]) for _ in range(3)) for _ in range(n))


PASSAGE = prose(30)
COPY = prose(200)
DATA = [(i, prose(60), "en", "s", 1, "own") for i in range(20)] + [
    (20, None, "en", None, None, None), (21, "", "en", "s", 0, None), (22, "123 ...", None, "s", 1, None), (23, COPY, "en", "s", 1, None), (24, COPY, "en", "s", 1, None),
    (24, COPY, "en", "s", 1, None), (None, COPY + " x", None, None, None, None), (25, prose(20) + " " + PASSAGE, "en", "s", 1, None), (26, "token = abcdef123456 " + prose(50), "en", "s", 1, None),
    (None, prose(40), "en", "s", 1, None), (27, prose(5000), "en", "s", 1, None),
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(DATA, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    kept = [r for r in DATA if r[1] and any(c.isalpha() for c in r[1])]
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    docs = stages[names[0]](spark, docs, sf_dir)
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and key(docs.collect()) == key(kept)

    groups = slow_components([r[0] for r in kept], [slow_fingerprint(r[1]) for r in kept])
    first = lambda g: min((kept[i][0] is None, kept[i][0] or 0, i) for i in g)[2]
    kept = [kept[i] for i in sorted({first(g) for g in groups})]
    docs = stages[names[1]](spark, docs, sf_dir).cache()
    assert key(docs.collect()) == key(kept) and len([r for r in kept if r[1] == COPY]) == 1

    wanted = slow_words(PASSAGE)

    def contaminated(text):
        w = slow_words(text)
        hit = {i + d for i in range(len(w)) for j in range(len(wanted) - 12) if w[i : i + 13] == wanted[j : j + 13] for d in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = [r for r in kept if not contaminated(r[1])]
    docs = stages[names[2]](spark, docs, sf_dir)
    assert key(docs.collect()) == key(kept) and all(r[0] != 25 for r in kept)

    kept = [(r[0], secrets.redact(r[1]), *r[2:]) for r in kept]
    docs = stages[names[3]](spark, docs, sf_dir)
    assert key(docs.collect()) == key(kept) and any(r[1].startswith("[SECRET]") for r in kept)

    words = WordTokenizer(vocabulary("word_bpe_49k.json"))
    found = stages[names[4]](spark, docs, sf_dir)
    assert key(found.select("doc_id", "ids").collect()) == key([(r[0], [i for w in words.words(r[1]) for i in words.word(w)]) for r in kept])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept)


def test_language_stage_goes_by_code_lengths(spark):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    junk = ["".join(RND.choice("bcdfgjklmpqsuvwxyz") for _ in range(300)), " ".join("".join(RND.choice("αβγδεζηθ") for _ in range(6)) for _ in range(40))]
    clean = [(i, prose(60), "en") for i in range(40)] + [(41, "the", None), (42, "token = abcdef123456 " + prose(50), None)]
    table = spark.createDataFrame(clean + [(100 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in stage(spark, table, "").collect()) == [r[0] for r in clean]


def test_language_stage_without_a_language(spark):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    data = [(1, prose(60), None), (2, "x" * 200_000, "en"), (3, None, "en"), (4, "12 !", None), (5, "qzqz", None)]
    found = stage(spark, spark.createDataFrame(data, "doc_id long, text string, lang string"), "").collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 5]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_columns_of_any_name(spark, sf_dir):
    """Names that the stages use inside, in either case."""
    names = {"__id": 1, "__h": 2, "__hash": 3, "__told": 4, "__R": 5, "__k0": 6, "fp": 7, "h": 8, "k0": 9, "i0": 10, "o0": 11, "item_id": 12, "component_id": 13, "text_hash": 14, "n": 15, "__pii": 16}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, value in names.items():
        docs = docs.withColumn(name, F.lit(value))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        assert [tuple(r) for r in docs.select(*names).distinct().collect()] == [tuple(names.values())]
    assert dict(corpus_pipeline.STAGES)["bpe_encode"](spark, docs, sf_dir).count() == docs.count() > 15


def test_stages_name_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encode"]


def test_last_stage_decodes_as_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    texts = ["", None, "Plain words, 12 of THEM!", "é字🙂 \x1f tab\tnew\nline", prose(300)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["bpe_encode"](spark, table, "").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids and found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
