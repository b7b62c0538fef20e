"""The pipeline's stages against brute force on a small fixture."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shipcast.llm.common import staged
from shipcast.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def passed(spark):
    docs = read_table(spark, SF, "documents")
    long = read_table(spark, SF, "benchmark").where("length(text) > 150").first().text
    extra = spark.createDataFrame(
        [(10_000, f"A clean start.\n{long}\nand a clean end.", "en", "x", 1), (10_001, None, "en", "x", 0)], docs.schema
    )
    out = {"input": docs.unionByName(extra)}
    rows = out["input"]
    for name, stage in corpus_pipeline.STAGES:
        rows = staged(spark, stage(spark, rows, SF), f"test-{name}")
        out[name] = rows
    return {k: v.collect() for k, v in out.items()} | {"columns": docs.columns}


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns(passed):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(passed[name][0].__fields__) == passed["columns"]


def test_toxicity_only_drops(passed):
    before, after = by_id(passed["input"]), by_id(passed["toxicity"])
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)
    assert all(after[k] == before[k] for k in after)


def test_lines(passed):
    seen, want = set(), {}
    for r in sorted(passed["toxicity"], key=lambda r: r.doc_id):
        lines = (r.text or "").split("\n")
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(map(len, run)) >= 20:
                    if run in seen or any(tuple(lines[k : k + j - i]) == run for k in range(i)):
                        gone |= set(range(i, j))
                    break
        for j in range(len(lines)):  # least runs that end at a line
            for i in range(j, -1, -1):
                run = tuple(lines[i : j + 1])
                if sum(map(len, run)) >= 20:
                    if run in seen or any(tuple(lines[k : k + len(run)]) == run for k in range(i)):
                        gone |= set(range(i, j + 1))
                    break
        for i in range(len(lines)):
            for j in range(i + 1, min(len(lines), i + 40) + 1):
                seen.add(tuple(lines[i:j]))
        kept = [x for k, x in enumerate(lines) if k not in gone]
        if kept:
            want[r.doc_id] = "\n".join(kept) if gone else r.text
    got = {r.doc_id: r.text for r in passed["line_dedup"]}
    assert got == want


def test_near_duplicates(passed):
    rows = [(r.doc_id, words(r.text)) for r in passed["line_dedup"]]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in rows if w}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d for d in sets if find(d) == d} | {d for d, w in rows if not w}
    assert set(by_id(passed["near_duplicates"])) == want


def test_decontamination(spark, passed):
    items = [words(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}
    want = set()
    for r in passed["near_duplicates"]:
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1)):
            want.add(r.doc_id)
    got = set(by_id(passed["decontamination"]))
    assert got == want and 10_000 not in got


def test_packing(passed):
    assert {r.doc_id for r in passed["packing"]} == set(by_id(passed["decontamination"]))
    fill = {}
    for r in passed["packing"]:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.agg(F.count("*")).first()[0] > 0
