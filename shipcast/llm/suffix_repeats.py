"""Repeat removal with an enhanced suffix array and its interval tree.

Any 50-byte string holds an anchor: a 16-byte string of least hash among
those of the 50 bytes.  Equal strings hold equal anchors, so

1. a scan hashes the anchors of all documents and a shuffle by hash finds
   those that two documents share;
2. each shared anchor takes its surroundings (the 50-byte strings whose least
   gram it is) to the task of its hash;
3. there an enhanced suffix array of the surroundings is built; a stack scan of
   its common prefixes yields the interval tree, and intervals whose
   occurrences differ in the byte before (left-diverse) are the maximal
   repeats, each with all its occurrences;
4. spans of occurrences that follow a smaller doc_id go back to the texts.

Rows between tasks are packed arrays: one row per task and bucket.  Numbers of
buckets follow the size of the text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm.common import ship_package

GRAM = 16
U = np.uint64
#: bytes of text per bucket of anchors, of surroundings and of documents
ANCHOR_BUCKET, CONTEXT_BUCKET, TEXT_BUCKET = 24 << 20, 4 << 20, 4 << 20
SLICE = 2 << 20


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value."""
    head = struct.pack("<I", len(arrays)) + b"".join(
        struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) for a in arrays
    )
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(body)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    (count,), at = struct.unpack_from("<I", raw), 4
    heads = [struct.unpack_from("<2sQ", raw, at + 10 * k) for k in range(count)]
    at += 10 * count
    out = []
    for kind, size in heads:
        out.append(np.frombuffer(raw, kind.decode(), size // int(kind[1:]), at))
        at += size
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 16 bytes from every place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += words[8 : 8 + n]
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(29)
    h *= U(0xFF51AFD7ED558CCD)
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of grams that are least in some ``size``-byte string."""
    h = gram_hashes(data)
    width = size - GRAM + 1
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, U)
    short = (h >> U(32)).astype(np.uint32)
    low = _sliding(short, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    high = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero(high == short)
    return at, h[at]


def _slices(texts: list[str | None], limit: int = SLICE):
    """(first row, encoded texts) of about ``limit`` bytes each."""
    at, size, group = 0, 0, []
    for k, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= limit:
            yield at, group
            at, size, group = k + 1, 0, []
    if group:
        yield at, group


def _by(bucket: np.ndarray):
    """(bucket, places) for each bucket that occurs, places in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _anchor_rows(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, raw in _slices(batch.column(1).to_pylist()):
                ends = np.cumsum([len(b) + 1 for b in raw])
                data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
                at, h = anchors(data, size)
                owner = np.searchsorted(ends, at, side="right")
                whole = at + GRAM < ends[owner]  # a gram that runs into the next text is none
                at, h, owner = at[whole], h[whole], owner[whole]
                place = (at - np.concatenate([[0], ends[:-1]])[owner]).astype(np.uint32)
                rows = [
                    (b, pack(*np.unique(owner[p], return_counts=True)[1:], rids[first + np.unique(owner[p])], (h[p] >> U(32)).astype(np.uint32), place[p]))
                    for b, p in _by((h % U(buckets)).astype(np.int64))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    ["bucket", "packed"],
                )

    return run


def _shared_rows(texts: int):
    """Anchors of a bucket that two rows share, packed by text bucket."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(v) for v in table.column("packed").to_pylist()]
        rid = np.concatenate([np.repeat(p[1], p[0]) for p in parts])
        h = np.concatenate([p[2] for p in parts])
        place = np.concatenate([p[3] for p in parts])
        order = np.argsort(h, kind="stable")
        h, rid, place = h[order], rid[order], place[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low, high = np.minimum.reduceat(rid, starts), np.maximum.reduceat(rid, starts)
        keep = np.repeat(low != high, np.diff(np.concatenate([starts, [len(h)]])))
        rid, place = rid[keep], place[keep]
        rows = [(q, pack(rid[p], place[p])) for q, p in _by(np.mod(rid, texts))]
        return pa.table(
            {"q": pa.array([r[0] for r in rows], pa.int64()), "packed": pa.array([r[1] for r in rows], pa.binary())}
        )

    return run


def _gather(parts: list[list[np.ndarray]], k: int, kind) -> np.ndarray:
    return np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)


def served(place: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the ``size``-byte strings whose least gram (the
    leftmost of equals) is each of one text's anchors; ``place`` ascends.

    Equal strings have the same least gram, so it is enough that they meet at
    that one.  An anchor left out of ``place`` only widens a range.
    """
    reach = size - GRAM
    short = h >> U(32)
    first, last = place - reach, place.copy()
    for k in range(1, len(place)):
        left, right = place[:-k], place[k:]
        near = right - left <= reach
        if not near.any():
            break
        # a gram at least as small to the left, a smaller one to the right
        lower = near & (short[:-k] <= short[k:])
        first[k:] = np.where(lower, np.maximum(first[k:], left + 1), first[k:])
        lower = near & (short[k:] < short[:-k])
        last[:-k] = np.where(lower, np.minimum(last[:-k], right - reach - 1), last[:-k])
    return first, last


def _context_rows(size: int, buckets: int):
    """Surroundings of shared anchors: packed (doc_id, rid, start, length, bytes)."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        parts = [unpack(v) for v in notes.column("packed").to_pylist()]
        rid, place = _gather(parts, 0, np.int64), _gather(parts, 1, np.uint32)
        order = np.lexsort((place, rid))
        rid, place = rid[order], place[order].astype(np.int64)
        out, seen, found = [], set(), []
        docs = texts.column("doc_id").to_pylist()
        rids = texts.column("rid").to_pylist()
        for doc, own, text in zip(docs, rids, texts.column("text").to_pylist()):
            lo, hi = np.searchsorted(rid, own), np.searchsorted(rid, own, side="right")
            if doc is None or lo == hi or own in seen:
                continue
            seen.add(own)
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            p = np.unique(place[lo:hi])
            p = p[p + GRAM <= len(data)]
            if not len(p) or len(data) < size:
                continue
            h = gram_hashes_of(np.ascontiguousarray(data[p[:, None] + np.arange(GRAM)]))
            begin, last = served(p, h, size)
            begin, last = np.maximum(begin, 0), np.minimum(last, len(data) - size)
            ok = begin <= last
            begin, length, h = begin[ok], (last - begin)[ok] + size, h[ok]
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            found.append((np.full(len(h), doc, np.int64), np.full(len(h), own, np.int64), begin.astype(np.int32), length.astype(np.uint8), h, data[at]))
        if found:
            doc, own, begin, length, h, data = (np.concatenate([f[k] for f in found]) for k in range(6))
            ends = np.cumsum(length.astype(np.int64))
            for b, p in _by((h % U(buckets)).astype(np.int64)):
                n = length[p].astype(np.int64)
                at = np.repeat(ends[p] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                out.append((b, pack(doc[p], own[p], begin[p], length[p], data[at], level=3)))
        return pa.table(
            {"bucket": pa.array([r[0] for r in out], pa.int64()), "packed": pa.array([r[1] for r in out], pa.binary())}
        )

    return run


def gram_hashes_of(grams: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of the rows of an (n, 16) matrix."""
    words = grams.view("<u8")
    h = words[:, 0] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += words[:, 1]
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(29)
    h *= U(0xFF51AFD7ED558CCD)
    return h


def interval_tree(lcp: list[int], docs: list[int], before: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Left-diverse intervals (first, last, length, smallest doc) of a suffix array.

    ``lcp[i]`` is the common prefix of suffixes i-1 and i, ``before`` the byte
    in front of a suffix (-1: none known, differs from all).  One stack scan;
    an interval hands its smallest doc and its diversity to its parent.
    """
    out = []
    # stack entries: [length, first, smallest doc, byte before or -1 if diverse]
    stack: list[list[int]] = []
    for i in range(1, len(docs) + 1):
        height = lcp[i] if i < len(docs) else 0
        first, doc, byte = i - 1, docs[i - 1], before[i - 1]
        while stack and stack[-1][0] > height:
            length, first, low, left = stack.pop()
            low = doc if doc < low else low
            left = left if left == byte else -1
            if left < 0:
                out.append((first, i - 1, length, low))
            doc, byte = low, left
        if height < least:
            continue
        if stack and stack[-1][0] == height:
            top = stack[-1]
            top[2] = doc if doc < top[2] else top[2]
            top[3] = top[3] if top[3] == byte else -1
        else:
            stack.append([height, first, doc, byte])
    return out


def maximal_repeats(matrix: np.ndarray, length: np.ndarray, doc: np.ndarray, size: int):
    """Maximal repeats of at least ``size`` bytes among the rows of ``matrix``.

    Yields (row, offset, repeat length) for every occurrence whose ``doc`` is
    above the smallest of its repeat.
    """
    n, width = matrix.shape
    # hash of every size-byte window, to leave out windows without a partner
    step = U(0x9E3779B97F4A7C15)
    h = np.zeros((n, width - size + 1), U)
    for k in range(size):
        h = h * step + matrix[:, k : k + width - size + 1].astype(U) + U(1)
    offset = np.broadcast_to(np.arange(width - size + 1), h.shape)
    inside = offset + size <= length[:, None]
    row = np.broadcast_to(np.arange(n)[:, None], h.shape)[inside]
    offset, h = offset[inside], h[inside]
    before = np.where(offset > 0, matrix[row, np.maximum(offset - 1, 0)].astype(np.int64), -1)
    order = np.argsort(h, kind="stable")
    h, row, offset, before = h[order], row[order], offset[order], before[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    # a repeat that every occurrence extends to the left is part of a longer one
    diverse = (np.minimum.reduceat(before, starts) < 0) | (
        np.minimum.reduceat(before, starts) != np.maximum.reduceat(before, starts)
    )
    several = np.minimum.reduceat(doc[row], starts) != np.maximum.reduceat(doc[row], starts)
    keep = np.repeat((sizes > 1) & diverse & several, sizes)
    row, offset, before = row[keep], offset[keep], before[keep]
    if not len(row):
        return np.zeros((0, 3), np.int64)
    # the suffix array of what is left, in byte order
    rest = length[row] - offset
    at = offset[:, None] + np.arange(width)
    suffix = np.where(np.arange(width) < rest[:, None], matrix[row[:, None], np.minimum(at, width - 1)], 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(suffix).view(f"S{width}").ravel(), kind="stable")
    suffix, row, offset, before, rest = suffix[order], row[order], offset[order], before[order], rest[order]
    same = suffix[1:] == suffix[:-1]
    run = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp = np.concatenate([[0], np.minimum(run, np.minimum(rest[1:], rest[:-1]))])
    owner = doc[row]
    found = []
    for first, last, repeat, low in interval_tree(lcp.tolist(), owner.tolist(), before.tolist(), size):
        place = np.arange(first, last + 1)
        place = place[owner[first : last + 1] > low]
        found.append(np.stack([row[place], offset[place], np.full(len(place), repeat)], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _span_rows(size: int, texts: int):
    """Spans to remove, from the surroundings of one bucket."""
    width = 2 * size - GRAM

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(v) for v in table.column("packed").to_pylist()]
        doc, rid, begin, length = (_gather(parts, k, np.int64) for k in range(4))
        length = length.astype(np.int64)
        matrix = np.zeros((len(length), width), np.uint8)
        matrix[np.arange(width) < length[:, None]] = _gather(parts, 4, np.uint8)
        # surroundings of equal bytes are one row, that of their smallest doc
        tagged = np.concatenate([length.astype(np.uint8)[:, None], matrix], 1)
        order = np.lexsort((doc, np.ascontiguousarray(tagged).view(f"S{width + 1}").ravel()))
        tagged = tagged[order]
        doc, rid, begin, length, matrix = doc[order], rid[order], begin[order], length[order], matrix[order]
        new = np.concatenate([[True], (tagged[1:] != tagged[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        low = doc[new]
        later = doc > low[group]
        spans = [np.stack([rid[later], begin[later], begin[later] + length[later]], 1)]
        hits = maximal_repeats(matrix[new], length[new], low, size)
        if len(hits):
            # to every place of that surrounding in its smallest doc
            firsts = np.flatnonzero(~later)
            owner = group[firsts]
            lo, hi = np.searchsorted(owner, hits[:, 0]), np.searchsorted(owner, hits[:, 0], side="right")
            hit = np.repeat(np.arange(len(hits)), hi - lo)
            at = firsts[np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            start = begin[at] + hits[hit, 1]
            spans.append(np.stack([rid[at], start, start + hits[hit, 2]], 1))
        found = np.concatenate(spans)
        rows = [(q, pack(found[p, 0], found[p, 1].astype(np.uint32), found[p, 2].astype(np.uint32))) for q, p in _by(np.mod(found[:, 0], texts))]
        return pa.table(
            {"q": pa.array([r[0] for r in rows], pa.int64()), "packed": pa.array([r[1] for r in rows], pa.binary())}
        )

    return run


def _removed_rows(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """Per text: its merged spans, and what is left."""
    parts = [unpack(v) for v in spans.column("packed").to_pylist()]
    rid, start, stop = _gather(parts, 0, np.int64), _gather(parts, 1, np.uint32), _gather(parts, 2, np.uint32)
    order = np.lexsort((start, rid))
    rid, start, stop = rid[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    out = []
    for doc, own, text in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "rid", "text"))):
        data = (text or "").encode("utf-8", "surrogatepass")
        lo, hi = np.searchsorted(rid, own), np.searchsorted(rid, own, side="right")
        merged: list[list[int]] = []
        if doc is not None and hi > lo:
            reach = np.maximum.accumulate(stop[lo:hi])
            cut = np.flatnonzero(np.concatenate([[True], start[lo + 1 : hi] > reach[:-1]]))
            ends = np.concatenate([cut[1:] - 1, [hi - lo - 1]])
            merged = np.stack([start[lo:hi][cut], reach[ends]], 1).tolist()
        kept, at = [], 0
        for a, b in merged:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        left = b"".join(kept)
        out.append((doc, len(data), len(data) - len(left), [{"start": a, "stop": b} for a, b in merged], hashlib.sha256(left).hexdigest()))
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds))})


def remove_repeats(spark: SparkSession, docs: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` for every row of
    ``doc_id, text``: each byte covered by a ``size``-byte string that also
    starts in a document of smaller doc_id is removed.

    Matches never cross documents and are judged on the input.  Null text is
    empty.  A null doc_id is neither smaller nor greater: such a row is
    returned whole.  Rows of equal doc_id leave each other alone.  Other
    columns are ignored; an empty table gives no rows.
    """
    if size < 2 * GRAM or 2 * size - GRAM > 255:
        raise ValueError("size must be from 32 to 135 bytes")
    ship_package(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("rid"), text.alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_anchor, n_context, n_text = (int(total // b) + 1 for b in (ANCHOR_BUCKET, CONTEXT_BUCKET, TEXT_BUCKET))
    hashed = keyed.where(F.col("doc_id").isNotNull()).select("rid", "text").mapInArrow(
        _anchor_rows(size, n_anchor), "bucket long, packed binary"
    )
    notes = hashed.groupBy("bucket").applyInArrow(_shared_rows(n_text), "q long, packed binary")
    # both uses of the texts are the same exchange, which Spark writes once
    texts = keyed.withColumn("q", F.pmod("rid", F.lit(n_text))).groupBy("q")
    contexts = texts.cogroup(notes.groupBy("q")).applyInArrow(_context_rows(size, n_context), "bucket long, packed binary")
    spans = contexts.groupBy("bucket").applyInArrow(_span_rows(size, n_text), "q long, packed binary")
    return texts.cogroup(spans.groupBy("q")).applyInArrow(
        _removed_rows, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
    )
