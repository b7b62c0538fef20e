"""Very long texts in time, rare labels, plain versions of what is fast."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from shipcast.llm import language_id, neighbour_index, pii, toxicity


def test_matches_equal_a_plain_search():
    rng = random.Random(2)
    words = ["bad", "badly", "worse", "fine", "not", "so"]
    model = toxicity.ToxicityModel({" bad ": 2.0, " bad": 1.0, " worse ": 3.0}, ["not so bad", "not worse", "so bad"])
    automaton = model.automaton()
    for _ in range(300):
        text = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        best = {}
        for term, weight in model.lexicon.items():
            for m in re.finditer(f"(?={re.escape(term)})", text):
                best[m.start()] = max(best.get(m.start(), 0), weight)
        spared = [(m.start(), m.start() + len(p) - 1) for p in map(toxicity.fold, model.exceptions) for m in re.finditer(f"(?={re.escape(p)})", text)]
        want = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        assert toxicity.matches(text, automaton) == want


def test_exceptions_in_a_long_text():
    model = toxicity.ToxicityModel({" bad ": 2.0}, ["not bad"])
    began = time.time()
    assert toxicity.matches(toxicity.fold("not bad " * 150_000 + "bad"), model.automaton()) == {1 + 8 * 150_000 - 1: 2.0}
    assert time.time() - began < 10


def test_many_addresses_in_one_text(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(20_000))
    began = time.time()
    row = pii.find_personal_data(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row.base) == 20_000
    assert all(text[s.start : s.stop].startswith("user") for s in row.base[::500])
    assert (row.base[-1].start, row.base[-1].stop) == (text.rindex(" ") + 1, len(text))
    assert time.time() - began < 60


def test_spans_apart_from_others(spark):
    rng = random.Random(6)

    def spans():
        at, out = 0, []
        while at < 60:
            at += rng.randint(0, 9)
            stop = at + rng.randint(1, 9)
            out.append((at, 0, stop, "v", "t", "n"))
            at = stop
        return out

    rows = [(spans() if i % 5 else [], spans() if i % 7 else []) for i in range(300)]
    frame = spark.createDataFrame(rows, f"base array<{pii.SPAN}>, loose array<{pii.SPAN}>")
    for r in frame.select("base", "loose", pii.apart(F.col("base"), F.col("loose")).alias("got")).collect():
        assert r.got == [c for c in r.loose if not any(b.start < c.stop and c.start < b.stop for b in r.base)]


def test_windows_in_chunks_are_the_windows(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 4 * language_id.WINDOW)
    rng = np.random.default_rng(0)
    sizes = np.array([3, 5000, 256, 1024, 1025, 700, 90_001, 40])
    data = rng.integers(97, 123, sizes.sum()).astype(np.uint8)
    stops = np.cumsum(sizes)
    whole, owner = language_id.text_windows(data, stops - sizes, stops)
    parts = list(language_id.window_chunks(data, stops - sizes, stops))
    assert len(parts) > 10
    assert (np.concatenate([w for w, _ in parts]) == whole).all()
    assert (np.concatenate([o for _, o in parts]) == owner).all()


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(1)
    taps = [rng.normal(size=(w, 256, 3)) for w in language_id.WIDTHS]
    net = language_id.ByteConvNet(["a", "b"], taps, rng.normal(size=9), rng.normal(size=(9, 2)), rng.normal(size=2))
    windows = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    length = language_id.WINDOW - max(language_id.WIDTHS) + 1
    for x, p in zip(windows, net.probabilities(windows)):
        pooled = [max(sum(tap[t, x[at + t], f] for t in range(len(tap))) for at in range(length)) for tap in taps for f in range(3)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.weight + net.offset
        assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en") for i in range(3000)]
    rows += [(10_000 + i, "żółć gęślą jaźń ćma śnieg źdźbło " * 3, "pl") for i in range(40)]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_label=200)
    assert model.labels == ["en", "pl"]
    asked = spark.createDataFrame([(1, "gęślą jaźń i źdźbło ćma śnieg żółć " * 2, None), (2, "a brown dog and the quick lazy fox " * 2, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify_language(asked, model).collect()} == {1: "pl", 2: "en"}


def test_queries_in_sparse_partitions_get_all_neighbours(spark):
    """A third of the rows equal, the others spread: every query has k rows."""
    rng = np.random.default_rng(4)
    rows = [(i, ([1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=4).tolist())) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbour_index.nearest(spark, frame, k=20, rows_per_part=60, recall=0.5)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {20}
    assert got.select("query_id").distinct().count() == 200
    assert got.where(F.col("query_id") == F.col("vec_id")).isEmpty()
