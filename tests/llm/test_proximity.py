"""Proximity matches of the inverted index against a plain search."""

import random
import re

from shipcast.llm import decontaminate


def _words(text):
    return [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _plain(docs, items, length, slop):
    """(doc_id, item) of exact and of proximity matches."""
    exact, near = set(), set()
    for doc, text in docs:
        ws = _words(text)
        for item, passage in items:
            iw = _words(passage)
            runs = [iw[i : i + length] for i in range(max(1, len(iw) - length + 1))] if iw else []
            for run in runs:
                whole = [p for p in range(len(ws)) if ws[p : p + len(run)] == run]
                exact |= {(doc, item) for _ in whole}
                for p in range(len(ws) + slop):
                    if all(w in ws[max(p + j - slop, 0) : max(p + j + slop + 1, 0)] for j, w in enumerate(run)) and not any(abs(p - q) <= slop for q in whole):
                        near.add((doc, item))
    return exact, near


def _found(spark, docs, items, length, slop):
    rows = decontaminate.decontaminate(
        spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), length, slop
    ).collect()
    assert len(rows) == len(docs)
    return {(r.doc_id, i) for r in rows for i in r.item_ids}, {(r.doc_id, i) for r in rows for i in r.near_ids}


def test_proximity_equals_a_plain_search(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 8])))) for k in range(12)]
    docs = [(0, None), (1, ""), (2, items[0][1])]
    for k in range(3, 60):
        words = rng.choices(vocabulary, k=rng.randint(1, 30))
        planted = _words(rng.choice(items)[1])
        at = rng.randint(0, len(planted) - 1)
        how = rng.randint(0, 3)
        if how == 1:
            planted.insert(at, "between")
        if how == 2 and at + 1 < len(planted):
            planted[at], planted[at + 1] = planted[at + 1], planted[at]
        if how == 3:
            planted[at] = "else"
        place = rng.randint(0, len(words))
        docs.append((k, " ".join(words[:place] + planted + words[place:])))
    for slop in (1, 2):
        exact, near = _plain(docs, items, 6, slop)
        assert exact and near
        assert _found(spark, docs, items, 6, slop) == (exact, near)


def test_two_rare_words_alone_are_no_match(spark):
    """All words of the phrase are asked for, not only its rarest."""
    phrase = "rare one two three four five six seven eight seldom"
    docs = [(1, "rare a b c d e f g h seldom"), (2, "one two three four five six seven eight " * 3), (3, phrase.replace("four", "four and"))]
    assert _found(spark, docs, [("x", phrase)], 10, 1) == (set(), {(3, "x")})
