"""Tokenising and best-fit packing with swap-based local search.

1. Every text is tokenised; pieces longer than the capacity are cut.
2. Pieces are dealt by hash into blocks of a fixed expected size (their number
   follows the table), packed best-fit decreasing within a block, then
   improved: moves, one-for-one and two-for-one exchanges that raise the sum
   of squared fills, until bins empty or no exchange helps.
3. The bins that stay underfull meet in new blocks of about the same number of
   pieces and are packed again, level by level, until one block holds them all
   or their number no longer falls.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm.common import giving_back, ship_package, staged

#: pieces that one packing task is meant to hold
BLOCK = 16_384
#: bytes of one generation of a worker's word cache (two generations live), what
#: an entry takes beside its letters and ids, and the longest chunk kept
CACHE_BYTES, ENTRY_BYTES, LONGEST_KEPT = 24 << 20, 150, 256


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers show for each byte: printable
    bytes as they are, the others from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordCache(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit bytes.

    What the tokenizer makes of a text depends on its blank-separated chunks
    alone.  A miss is encoded once; the entries of the generation before stay
    at hand, so frequent words are kept.  The bytes are counted as entries are
    added, and long chunks are not kept.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}
        self.size = 0

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            last = chunk[-1:]
            word = chunk[:-1] if last == "." or last == "," else chunk
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                # one word of letters: lower case is all that normalising does
                if word is chunk:
                    low = word.lower()
                    found = self._word(low) if low == word else self[low]
                else:
                    found = self[word] + self[last]
            else:
                found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= LONGEST_KEPT:
            if self.size >= CACHE_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self.size += len(chunk) + len(found) + ENTRY_BYTES
            self[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            text = text.lower()  # of letters below U+0100 lower case never depends on context
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    """One per worker process, kept between tasks."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: a document's ids (then ``end_id``), cut only where
    longer than ``capacity``.  Null text counts as empty: one id."""
    ship_package(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _cache(tokenizer_path)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                raw = cache.encode(text if isinstance(text, str) else "") + end
                doc = None if pd.isna(doc) else int(doc)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(giving_back(cut), PIECES)


class Bins:
    """Bins of one task; ``sizes`` are the item lengths."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = [int(x) for x in sizes], capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Best fit, longest first; ties by position."""
        order = sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i))
        rooms: list[tuple[int, int]] = []  # (free, bin), sorted
        for i in order:
            size = self.sizes[i]
            at = bisect.bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
                self.items[b].append(i)
                room -= size
            else:
                b, room = len(self.items), self.capacity - size
                self.items.append([i])
                self.free.append(room)
            self.free[b] = room
            if room:
                bisect.insort(rooms, (room, b))

    def lower_bound(self) -> int:
        return -(-sum(self.sizes) // self.capacity)

    def improve(self) -> None:
        """Raise the sum of squared fills among underfull bins by moves and
        exchanges until no step helps or the bin count meets its lower bound.
        Every step raises a bounded integer, so this ends."""
        live = sum(map(bool, self.items))
        least, helped = self.lower_bound(), True
        while helped and live > least:
            helped = False
            index = _Partners(self.capacity)
            for b, items in enumerate(self.items):
                if items and self.free[b]:
                    index.add(b, self.free[b], self._sizes(b))
            # emptiest first: a bin gives to bins at most as empty as itself
            queue = [(-room, b) for b, room in index.rooms.items()]
            heapq.heapify(queue)
            stuck: set[tuple] = set()  # contents that found no partner since the last step
            level, passed = 0, []  # the room of the bins seen last, and these bins
            while queue and live > least:
                room, x = heapq.heappop(queue)
                if index.rooms.get(x) != -room:
                    continue  # it took something since
                if -room != level:
                    for b in passed:
                        if index.rooms.get(b) == level:
                            index.remove(b, self._sizes(b))
                    level, passed = -room, []
                index.remove(x, self._sizes(x))
                while self.items[x]:
                    content = self._content(x)
                    step = None if content in stuck else index.find(content)
                    if step is None:
                        stuck.add(content)
                        break
                    out, size, y = step
                    index.remove(y, self._sizes(y))
                    self._exchange(x, y, out, size)
                    stuck, helped = set(), True
                    if self.free[y]:
                        index.add(y, self.free[y], self._sizes(y))
                        heapq.heappush(queue, (-self.free[y], y))
                live -= not self.items[x]
                if self.free[x] == level:  # bins as empty as this one may still give to it
                    index.add(x, level, self._sizes(x))
                    passed.append(x)
        self.items = [x for x in self.items if x]

    def _exchange(self, x: int, y: int, out: tuple[int, ...], size: int) -> None:
        """Items of sizes ``out`` go from x to y, one of ``size`` (none if 0) comes back."""
        go = [self._take(x, wanted) for wanted in out]
        come = [self._take(y, size)] if size else []
        self.items[y] += go
        self.items[x] += come
        shift = sum(out) - size
        self.free[x] += shift
        self.free[y] -= shift

    def _take(self, b: int, size: int) -> int:
        at = next(k for k, i in enumerate(self.items[b]) if self.sizes[i] == size)
        return self.items[b].pop(at)

    def _sizes(self, b: int) -> set[int]:
        return {self.sizes[i] for i in self.items[b]}

    def _content(self, b: int) -> tuple[int, ...]:
        return tuple(sorted(self.sizes[i] for i in self.items[b]))


class _Partners:
    """Underfull bins by what they hold and by their room.

    Every bin also holds an item of size 0, so that a move is an exchange.
    What goes over for an item of size t must be longer than t and at most t
    and the room together; so of the bins with t the roomiest tells whether
    any can take part, and the sums of t and room tell what fills one exactly.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: dict[int, int] = {}
        self.by_size: dict[int, list[tuple[int, int]]] = {}  # t -> (room, bin), sorted
        self.by_sum: dict[int, list[tuple[int, int]]] = {}  # t + room -> (t, bin), sorted
        #: t + the most room of a bin with t, or -1
        self.reach = np.full(capacity + 1, -1, np.int64)
        self.held = np.zeros(capacity + 1, bool)  # whether by_sum has an entry
        self.each = np.arange(capacity + 1)

    def add(self, b: int, room: int, sizes: set[int]) -> None:
        self.rooms[b] = room
        for t in (0, *sizes):
            found = self.by_size.setdefault(t, [])
            bisect.insort(found, (room, b))
            self.reach[t] = t + found[-1][0]
            bisect.insort(self.by_sum.setdefault(t + room, []), (t, b))
            self.held[t + room] = True

    def remove(self, b: int, sizes: set[int]) -> None:
        room = self.rooms.pop(b)
        for t in (0, *sizes):
            found = self.by_size[t]
            del found[bisect.bisect_left(found, (room, b))]
            self.reach[t] = t + found[-1][0] if found else -1
            found = self.by_sum[t + room]
            del found[bisect.bisect_left(found, (t, b))]
            self.held[t + room] = bool(found)

    def find(self, content: tuple[int, ...]) -> tuple[tuple[int, ...], int, int] | None:
        """For a bin of ``content``: one or two of its sizes, the size to come
        back and the partner, which is left with as little room as possible;
        None if there is no improving step."""
        one = np.array(sorted(set(content)), np.int64)
        twice = np.array([v for v, w in zip(content, content[1:]) if v == w], np.int64)
        at, to = np.triu_indices(len(one), 1)
        sums = np.concatenate([one, 2 * twice, one[at] + one[to]])
        sums = sums[sums <= self.capacity]
        exact = sums[self.held[sums]]
        if len(exact):
            total = int(exact.max())
            back, y = self.by_sum[total][0]
        else:
            most = np.zeros(self.capacity + 1, np.int64)
            most[sums] = sums
            most = np.maximum.accumulate(most)  # the largest of the sums up to each value
            able = np.flatnonzero((self.reach >= 0) & (most[self.reach] > self.each))
            if not len(able):
                return None
            left = self.reach[able] - most[self.reach[able]]
            back = int(able[left.argmin()])
            total, y = int(most[self.reach[back]]), self.by_size[back][-1][1]
        return self._parts(content, total), back, y

    @staticmethod
    def _parts(content: tuple[int, ...], total: int) -> tuple[int, ...]:
        """The one or two sizes of that sum, one if possible."""
        if total in content:
            return (total,)
        low, high = 0, len(content) - 1
        while content[low] + content[high] != total:
            if content[low] + content[high] < total:
                low += 1
            else:
                high -= 1
        return content[low], content[high]


PACKED = PIECES + ", sequence_id long, offset long, fill int"


def _pack_frame(pdf: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    """Packs the pieces of one block; where they have a ``sequence_id``, in no
    more bins than that."""
    pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
    bins = Bins(pdf["length"].to_numpy(), capacity)
    bins.best_fit()
    if "sequence_id" in pdf:
        given = [list(map(int, rows)) for rows in pdf.groupby("sequence_id", sort=True).indices.values()]
        if len(given) < len(bins.items):
            bins.items = given
            bins.free = [capacity - sum(bins.sizes[i] for i in items) for items in given]
    bins.improve()
    seq, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
    lengths = pdf["length"].to_numpy()
    for k, items in enumerate(bins.items):
        at = 0
        for i in items:
            seq[i], offset[i] = base + k, at
            at += int(lengths[i])
        fill[items] = at
    out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
    out["sequence_id"], out["offset"], out["fill"] = seq, offset, fill.astype("int32")
    return out


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = 4096, underfull: float = 0.995) -> DataFrame:
    """Assign every piece a sequence and an offset.

    Full pieces are sequences by themselves.  ``pieces`` should be a stored
    table (it is read more than once).  Where one block holds all underfull
    bins at the end, no step helps between any of them.
    """
    ship_package(spark)
    key = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    blocks = max(1, -(-n // BLOCK))
    whole = pieces.where(F.col("length") >= capacity).select(
        "*",
        # ids of this kind are negative: unique per row, apart from the block ids
        (-F.monotonically_increasing_id() - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def packed(rows: DataFrame, level: int) -> DataFrame:
        def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            # up to 2^13 levels of 2^24 blocks of 2^26 bins
            return _pack_frame(pdf.drop(columns="block"), capacity, (level << 24 | int(k[0])) << 26)

        return rows.groupBy("block").applyInPandas(run, PACKED)

    low = F.col("fill") < underfull * capacity
    last = staged(spark, packed(rest.withColumn("block", F.pmod(key, F.lit(blocks))), 0), "packed-0")
    out, before, level = whole.select(*cols), None, 0
    while True:
        left = last.where(low)
        n, bins = left.agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        if blocks == 1 or n == 0 or (before is not None and bins >= before):
            return out.unionByName(last.select(*cols))
        out = out.unionByName(last.where(~low).select(*cols))
        before, level, blocks = bins, level + 1, -(-n // BLOCK)
        block = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(blocks))
        again = packed(left.select(*cols[:-1], block.alias("block")), level)
        if blocks == 1:
            return out.unionByName(again.select(*cols))
        last = staged(spark, again, f"packed-{level}")


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """Tokenise and pack ``doc_id, text`` (other columns are ignored).

    Null text is empty; an empty text is one end id; repeated rows are packed
    each; a null doc_id stays null; an empty table gives no rows.
    """
    pieces = staged(spark, token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    packed = pack_pieces(spark, pieces, capacity)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
