"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shipcast.llm import chat_format, neighbour_index, packing, pii, suffix_repeats
from shipcast.llm import queries as q
from shipcast.sources.tables import read_table

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


def texts(rows, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    out = []
    for i in range(rows):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 40) :])
        out.append((i, "\n".join(parts)))
    return out


def test_repeats_match_brute_force(spark):
    rows = texts(120)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_repeats.remove_repeats(spark, frame).collect()}
    seen: set[bytes] = set()
    total = 0
    for doc, text in rows:
        data = text.encode()
        grams = [data[i : i + 50] for i in range(len(data) - 49)]
        covered = bytearray(len(data))
        for i, g in enumerate(grams):
            if g in seen:
                covered[i : i + 50] = b"\1" * 50
        seen.update(grams)
        left = bytes(b for b, c in zip(data, covered) if not c)
        total += sum(covered)
        assert got[doc].n_removed == sum(covered)
        assert got[doc].kept_sha256 == hashlib.sha256(left).hexdigest()
    assert total > 1000


def test_interval_tree_finds_maximal_repeats():
    # suffixes: two docs share "abcd", one more shares "abc"
    out = suffix_repeats.interval_tree([0, 5, 3], [4, 2, 1], [-1, -1, -1], 2)
    assert out == [(0, 1, 5, 2), (0, 2, 3, 1)]
    # equal bytes before every occurrence: part of a longer repeat, so left out
    assert suffix_repeats.interval_tree([0, 5], [4, 2], [9, 9], 2) == []


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c x@y..z _u@v.w-x.y 1.2.3.4.5.6.7.8 256.1.1.1 000.0255.1.2",
    "é 4111 1111 1111 1111, 4111-1111-1111-1112 +1 (269) 555-3296 4524132264652876",
    "x@a.b_c@d.e a@b.c@d.f +49 30 1234567 (up) 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "1" * 30_000 + " " + "a" * 30_000 + "@ 1.2.3." + " 9" * 9_000,
    "mail me at joe (at) site (dot) org or call (212) 555-0199",
    None,
    "",
]


def test_personal_data_matches_brute_force(spark):
    rows = list(enumerate(TRICKY)) + [(100 + r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(spark, frame).collect()}
    for doc, text in rows:
        assert [tuple(s) for s in got[doc].base] == base_spans(text or ""), doc
    # a span that the base rules cannot see is added by the method
    assert any(s.kind == 0 for s in got[4].added) or any(s.kind == 3 for s in got[4].added)


def test_reliabilities_follow_agreement():
    patterns = [((1, 1, 1), 500), ((-1, -1, -1), 400), ((1, 1, -1), 30), ((-1, -1, 1), 30), ((1, 0, 0), 10)]
    post = pii.estimate(patterns)
    assert post[(1, 1, 1)] > 0.95 and post[(-1, -1, -1)] < 0.05 and post[(1, 1, -1)] > 0.5


def test_failed_check_outweighs_a_likely_shape():
    names = pii.LABELERS
    # nearly all candidates are real, as in a clean table
    post = pii.estimate([((1, 1, 0, 1, 0), 900), ((1, 1, 0, -1, 0), 40), ((1, 0, 0, -1, 0), 60)], names)
    assert post[(1, 1, 0, 1, 0)] > 0.9
    assert post[(1, 1, 0, -1, 0)] < 0.5 and post[(1, 0, 0, -1, 0)] < 0.5


def test_classifier_learns_from_the_surroundings():
    # same value, voted on by what stands before it; the classifier is given looks alone
    bare, led = (1, 1, 0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 1, 0, 1, 0)
    weights = pii.learn([((1, 1, 1, 1, 0), led, 50), ((-1, 0, 0, -1, -1), bare, 50)])
    score = lambda look: weights[0] + sum(a * b for a, b in zip(weights[1:], look))
    assert score(led) > 0 > score(bare)
    assert pii.learn([]) == []


def test_added_spans_need_a_passed_check(spark):
    good, bad = "4111 1111 1111 1111", "4111 1111 1111 1112"
    rows = [(i, f"pay with card {good} now") for i in range(40)] + [(100 + i, f"number {bad} here") for i in range(5)]
    rows += [(200, "call (212) 555-0199, or write to joe [at] site [dot] org")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i].base) == 1 and not got[i].added for i in range(40))
    assert all(not got[100 + i].base and not got[100 + i].added for i in range(5))
    assert {s.kind for s in got[200].added} == {0, 3}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_path())
    docs = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    rows = q.op9(spark, SF).collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    for doc, text in docs.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(p.length for p in pieces[doc].values()) == len(ids)
        for k, p in pieces[doc].items():
            assert p.start == 4096 * k
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert len(sequences) <= -(-total // 4096) + 1


def test_word_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok, cache = Tokenizer.from_file(q.tokenizer_path()), packing.WordCache(q.tokenizer_path())
    for text in ["", " ", "A.b,c...", "it's we'll <|endoftext|>x", "ΑΣ ΑΣ. İstanbul ß ﬁ é É.", "abc \x1c\x85\xa0x", "Привет, мир. ŉ", "a., .a ,", "日本語。 \t\r\n"]:
        assert cache.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_local_search_empties_bins():
    # best fit, longest first, needs three bins; an exchange makes it two
    bins = packing.Bins(np.array([5, 4, 4, 3, 2, 2]), 10)
    bins.items = [[0, 1], [2, 3, 4], [5]]
    bins.free = [1, 1, 8]
    bins.improve()
    assert len(bins.items) == 2 and sorted(i for b in bins.items for i in b) == list(range(6))


def helping_step(bins):
    """Two bins between which a move or exchange shifts load to the fuller one."""
    loads = [[bins.sizes[i] for i in b] for b in bins.items]
    free = [bins.capacity - sum(x) for x in loads]
    open_ = [b for b, room in enumerate(free) if room]
    for x in open_:
        outs = {*loads[x], *(a + b for k, a in enumerate(loads[x]) for b in loads[x][k + 1 :])}
        for y in open_:
            if x != y and free[y] <= free[x] and any(t < o <= t + free[y] for t in {0, *loads[y]} for o in outs):
                return x, y
    return None


@pytest.mark.parametrize("copies", [0, 600])
def test_local_search_ends_only_when_no_step_helps(copies):
    # lengths that do not combine, and a group of copies whose bins are all alike
    rng = np.random.default_rng(5)
    sizes = rng.permutation(np.concatenate([rng.integers(1000, 2001, 900), np.full(copies, 2100)]))
    bins = packing.Bins(sizes, 4096)
    bins.best_fit()
    before = len(bins.items)
    bins.improve()
    assert sorted(i for b in bins.items for i in b) == list(range(len(sizes)))
    assert all(sum(bins.sizes[i] for i in b) <= 4096 for b in bins.items)
    assert len(bins.items) > bins.lower_bound() and helping_step(bins) is None
    assert copies or len(bins.items) < 0.98 * before


def test_underfull_bins_meet_in_blocks(spark, monkeypatch):
    # lengths that do not combine: most bins stay underfull
    monkeypatch.setattr(packing, "BLOCK", 300)
    rng = np.random.default_rng(6)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1300, 2001, 3000))]
    got = packing.pack_pieces(spark, spark.createDataFrame(rows, packing.PIECES)).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(r[0], r[3]) for r in rows]
    bins, blocks = {}, Counter()
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        blocks[r.sequence_id >> 26] += 1
    for spans in bins.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 4096
    assert max(blocks.values()) <= 2 * 300


def test_chat_spans_and_rewrites():
    rows = [("user", "<|im_end|>"), ("assistant", "\\<|x\n"), ("assistant", "<|im_end|>")]
    out, mask, rewrites, *_ = chat_format.format_rows(rows)
    assert not rewrites and out.count("<|im_end|>") == 3
    assert [chat_format.unescape(out[a:b]) for a, b in mask] == ["\\<|x\n", "<|im_end|>"]

    def only_last(messages):  # keeps no more than the newest answer
        last = max((i for i, m in enumerate(messages) if m[0] == "assistant"), default=-1)
        return "".join(f"[{r}]{t}" for i, (r, t) in enumerate(messages) if r != "assistant" or i == last)

    *_, rewrites = chat_format.turn_spans(rows, chat_format.ChatTemplate(only_last))
    assert rewrites


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\<|\\|", "a\\\\<|<|b", "<", "|"])
def test_escape_round_trip(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in read_table(spark, SF_LARGER, "documents").collect()}
    rows = [r for r in q.op1(spark, SF_LARGER).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97
    toxic = {r.doc_id: r.toxic for r in read_table(spark, SF_LARGER, "labels").collect()}
    scored = [(r.score, toxic[r.doc_id]) for r in q.op3(spark, SF_LARGER).collect() if r.held_out and r.doc_id in toxic]
    good = [a > b for a, x in scored if x for b, y in scored if not y]
    assert np.mean(good) > 0.75


def test_recall_of_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 4000)] + 0.6 * rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[500:540] = x[500]  # a group of equal vectors
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbour_index.nearest(spark, frame, rows_per_part=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for query in range(0, 4000, 20):
        s = x @ x[query]
        s[query] = -np.inf
        best = np.lexsort((np.arange(4000), -np.round(s, 12)))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in got[query]})
        total += 20
        ranked = sorted(got[query])
        assert [k for k, _, _ in ranked] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in ranked)
    assert hits / total >= 0.9
