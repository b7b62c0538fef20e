"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names: every operator has a defined result."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shipcast.llm import (
    chat_format,
    decontaminate,
    language_id,
    line_dedup,
    near_duplicates,
    neighbour_index,
    packing,
    pii,
    suffix_repeats,
    toxicity,
)
from shipcast.llm.queries import tokenizer_path

CLASH = (
    "row key node gone copy lines kept text_key start size phrase term pos n g_doc g_key comp chunk "
    "score lang_pred base loose q rid bucket packed class_key"
).split()
LONG = "word and another thing " * 20_000 + "end"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, None),
    (3, ""),
    (4, LONG),
    (4, LONG),
    (5, "12 34 ... \n\n\n"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, "a null id with a text of its own, eight words"),
    (None, None),
    (7, "ünï côdé 日本語 " * 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


WANT = Counter(r[0] for r in ROWS)


def test_language(docs, empty):
    model = language_id.fit_language_model(docs)
    out = language_id.identify_language(docs, model)
    assert ids(out) == WANT
    got = {(r.doc_id, r.lang_pred, r.score) for r in out.collect()}
    assert (2, "und", 0.0) in got and (3, "und", 0.0) in got and (5, "und", 0.0) in got
    assert all(0 <= s <= 1 for _, _, s in got)
    assert language_id.identify_language(empty, model).count() == 0
    assert language_id.fit_language_model(empty) is None
    assert {r.lang_pred for r in language_id.identify_language(docs, None).collect()} == {"und"}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "BETA gamma, delta"), (2, "beta gamma delta"), (2, "beta gamma delta"), (None, "mu"), (3, None), (4, "")],
        "item_id long, text string",
    ).withColumn("phrase", F.lit("x"))
    out = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.decontaminate(spark, docs, items).collect()}
    assert (1, 12, 4, ("1", "2", "null")) in out and (6, 12, 4, ("1", "2", "null")) in out
    assert (2, 0, 0, ()) in out and (3, 0, 0, ()) in out and (4, 80_001, 0, ()) in out and (5, 2, 0, ()) in out
    assert ids(decontaminate.decontaminate(spark, docs, items)) == WANT
    assert decontaminate.decontaminate(spark, empty, items).count() == 0
    clean = decontaminate.decontaminate(spark, docs, items.where("false"))
    assert clean.where("contaminated").count() == 0 and ids(clean) == WANT


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int").withColumn("term", F.lit(1))
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    assert ids(out) == WANT
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.collect())
    assert toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert ids(toxicity.drop_toxic(docs, none)) == WANT


def test_copies_of_a_long_text_leave_the_lexicon_whole(spark):
    rng = random.Random(3)

    def words(n):
        return ["".join(rng.choice("bcdfglmnprtu") for _ in range(9)) for _ in range(n)]

    common, long_text = words(80), " ".join(words(1_000))
    rows, labels = [], []
    for i in range(900):
        toxic = i < 450
        text = long_text if i < 300 else " ".join(rng.choices(common, k=30)) + (" zounds" if toxic and i % 2 else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(" zounds ".startswith(t) for t in model.lexicon)
    probe = spark.createDataFrame([(1, "zounds " + " ".join(common[:20])), (2, " ".join(common[:21]))], docs.schema)
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(probe, model).collect()} == {1: 1, 2: 0}


def test_repeats(spark, docs, empty):
    out = suffix_repeats.remove_repeats(spark, docs)
    rows = out.collect()
    assert ids(out) == WANT
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in rows}
    first = len(ROWS[0][1])
    # rows of equal doc_id leave each other alone; a null doc_id is left whole
    assert {(1, first, 0), (6, first, first), (2, 0, 0), (3, 0, 0), (4, len(LONG), 0), (None, 45, 0)} <= got
    assert suffix_repeats.remove_repeats(spark, empty).count() == 0


def test_lines(spark, docs, empty):
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == [*docs.columns, "kept_text", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0), r.n_lines, r.n_removed) for r in out.collect())
    assert got.count((4, 1, 0)) == 1 and got.count((4, 1, 1)) == 1  # one of two equal rows keeps its line
    assert (6, 1, 1) in got and (1, 1, 0) in got and (5, 4, 0) in got and (2, 1, 0) in got
    assert line_dedup.dedup_lines(spark, empty).count() == 0


def test_personal_data(spark, docs, empty):
    assert ids(pii.find_personal_data(spark, docs)) == WANT
    assert pii.find_personal_data(spark, empty).count() == 0


def test_near_duplicates(spark, docs, empty):
    out = near_duplicates.near_duplicates(spark, docs)
    assert ids(out) == WANT
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in out.collect())
    assert got[(1, 1, 1)] == 1 and got[(6, 1, 1)] == 1 and got[(4, 4, 1)] == 2
    assert got[(2, 2, 0)] == 1 and got[(3, 3, 0)] == 1 and got[(None, None, 0)] == 2
    kept = near_duplicates.one_of_each(spark, docs, out)
    assert kept.columns == docs.columns
    assert ids(kept) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, None: 2})
    assert near_duplicates.near_duplicates(spark, empty).count() == 0


def test_packing(spark, docs, empty):
    rows = packing.pack_documents(spark, docs, tokenizer_path()).collect()
    assert {r.doc_id for r in rows} == set(WANT)
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert packing.pack_documents(spark, empty, tokenizer_path()).count() == 0


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (None, 1, None, "x"), (2, None, "a\nb", "<|im_end|>\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1))
    out = {r.conv_id: r for r in chat_format.format_conversations(turns).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 3 and out[1].turns_sha256 == digest("user\n\nuser\n\nassistant\nb\n")
    assert out[None].turns_sha256 == digest("\nx\n")
    assert out[2].turns_sha256 == digest("a\nb\n<|im_end|>\\\n") and out[2].loss_chars == 0
    assert chat_format.format_conversations(turns.where("false")).count() == 0


def test_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, 0.5]) for i in range(60)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0]), (3, [3.0, 1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    out = neighbour_index.nearest(spark, table, k=5).collect()
    assert {r.query_id for r in out} == {0, 20, 40}
    by = {(r.query_id, r.rank): (r.vec_id, r.score) for r in out}
    # ties go to the smaller id
    assert [by[20, k][0] for k in range(1, 6)] == [6, 13, 27, 34, 41]
    assert neighbour_index.nearest(spark, table.where("false")).count() == 0
    few = neighbour_index.nearest(spark, table.where("vec_id < 3"), k=5).collect()
    assert [(r.vec_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(2, 1), (1, 2)] or len(few) == 2
