"""Prefix trie of conversations, with a count-min screen before the shuffle.

1. Every prefix of a conversation gets a 128-bit digest: the exclusive or of
   the hashes of (depth, turn) up to there.
2. All digests go into a count-min sketch.  It never counts too little, so an
   estimate of one proves that a prefix belongs to a single conversation.  Such
   nodes, the tails, are emitted where they lie.
3. Only prefixes that may be shared are shuffled and grouped exactly.

What a subtree adds up to needs no walk over the levels.  A conversation is
the smallest member of its nodes from some depth s on, so the words saved
below a node at depth d are, summed over its members, those of the turns from d
to s - 1, and its leaves are its members that are the smallest of a childless
node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm.common import ship_package, staged
from shipcast.llm.hashing import U, mix
from shipcast.llm.ordering import ranked, running

#: rows of the sketch, the most counters of one row (2 bits each while summed,
#: one bit each when sent out: 64 MB in all), counters handled together
HASHES, MOST_COUNTERS, SLICE = 4, 1 << 27, 1 << 20
#: digests counted before a task passes its counts on
FLUSH = 1 << 20
#: depths of a conversation that are looked up together
DEPTHS = 8192
#: bytes of ids hashed at once
CHUNK = 1 << 20
NODE = ["depth", "da", "db"]


def turn_keys(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, key, words``: 16 bytes that stand for role and text
    (null is empty) and the number of words of the text.

    A row without conv_id belongs to no conversation and is left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def with_shared_heads(spark: SparkSession, turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of c come from c - c % every,
    h being crc32 of c's decimal text modulo ``most``.

    Returns the turns and the ids of all conversations, turnless ones too.
    """
    placed = staged(spark, ranked(spark, turns, "conv_id", ["turn", "key"], "turns"), "turns-placed")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = placed.where(F.col("pos") > h).select("conv_id", F.col("pos").alias("turn"), "key", "words")
    convs = placed.where("pos = 1").select("conv_id")
    heads = placed.where((F.col("pos") < most) & (F.col("conv_id") % every == 0)).select(
        F.col("conv_id").alias("block"), "pos", "key", "words"
    )
    # a block has fewer than 2 * every conversations and a head fewer than ``most`` turns
    taken = (
        convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("block"))
        .join(heads, "block")
        .where("pos <= h")
        .select("conv_id", (F.col("pos") - most).alias("turn"), "key", "words")
    )
    return own.unionByName(taken), convs


def prefixes(spark: SparkSession, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one too: ``conv_id, depth,
    last, words`` (of its last text), ``before`` (words of the texts before),
    ``da, db`` (digest) and ``pa, pb`` (digest of the prefix one shorter)."""
    rows = turns.withColumn("mark", F.lit(1)).unionByName(
        convs.select("conv_id", F.lit(0).alias("mark")), allowMissingColumns=True
    )
    placed = ranked(spark, rows, "conv_id", ["mark", "turn", "key"], "prefix-turns")
    depth = F.col("pos") - 1

    def part(seed: int):
        return F.when(F.col("mark") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), F.col("pos"), F.col("key")))

    hashed = placed.select("conv_id", "part", "pos", "n", F.coalesce("words", F.lit(0)).alias("words"), part(1).alias("a"), part(2).alias("b"))
    hashed = staged(spark, hashed, "prefix-hashes")
    summed = running(
        hashed, "conv_id", {"da": (F.col("a"), "bit_xor"), "db": (F.col("b"), "bit_xor"), "upto": (F.col("words"), "sum")}
    )
    out = summed.select(
        "conv_id",
        depth.alias("depth"),
        (F.col("pos") == F.col("n")).alias("last"),
        "words",
        (F.col("upto") - F.col("words")).alias("before"),
        "da",
        "db",
        F.col("da").bitwiseXOR(F.col("a")).alias("pa"),
        F.col("db").bitwiseXOR(F.col("b")).alias("pb"),
    )
    return staged(spark, out, "prefixes")


def _counters(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Per row of the sketch the counter of every digest."""
    shift = U(64 - width.bit_length() + 1)
    a, b = a.view(U), b.view(U)
    return np.stack([(mix(a * U(2 * r + 1) + mix(b + U(r))) >> shift).astype(np.int64) + r * width for r in range(HASHES)])


def count_min(spark: SparkSession, rows: DataFrame, width: int) -> np.ndarray:
    """One bit per counter: whether more than one digest of ``rows`` fell on it.

    Tasks pass on the counters they met, not their whole sketch; slices of the
    sketch are added up apart and only their bits reach the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            met = _counters(table.column("da").to_numpy(), table.column("db").to_numpy(), width)
            found, n = np.unique(met, return_counts=True)
            cut = np.flatnonzero(np.diff(found // SLICE, prepend=-1))
            for lo, hi in zip(cut, np.append(cut[1:], len(found))):
                inside, many = (found[lo:hi] % SLICE).astype(np.uint32), n[lo:hi] > 1
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([int(found[lo] // SLICE)], pa.int32()), "once": [inside[~many].tobytes()], "more": [inside[many].tobytes()]}
                )

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held = counts.setdefault(row["slice"], np.zeros(SLICE, np.uint8))
                once, more = (np.frombuffer(row[c], np.uint32) for c in ("once", "more"))
                held[once] = np.minimum(held[once] + 1, 2)
                held[more] = 2
        for k, held in counts.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": [np.packbits(held >= 2).tobytes()]})

    slices = -(-HASHES * width // SLICE)
    sparse = rows.select("da", "db").mapInArrow(partial, "slice int, once binary, more binary")
    bits = np.zeros(slices * (SLICE // 8), np.uint8)
    for row in sparse.repartition(slices, "slice").mapInArrow(merged, "slice int, bits binary").collect():
        at = row.slice * (SLICE // 8)
        bits[at : at + SLICE // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def screened(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` with ``shared`` and ``parent_shared``: false where the estimate
    proves a singleton.  The empty prefix counts as shared.

    The sketch has four counters per prefix and row, up to ``MOST_COUNTERS``;
    with more prefixes than that the screen proves less and more is grouped.
    """
    ship_package(spark)
    deep = rows.where("depth > 0")
    width = min(MOST_COUNTERS, max(SLICE // HASHES, 1 << (4 * deep.count()).bit_length()))
    sent = spark.sparkContext.broadcast(count_min(spark, deep, width))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def many(a: pa.Array, b: pa.Array) -> np.ndarray:
            met = _counters(a.to_numpy(), b.to_numpy(), width)
            return ((bits[met >> 3] >> (7 - (met & 7)).astype(np.uint8)) & 1).all(0)

        for batch in batches:
            depth = batch.column("depth").to_numpy()
            own = many(batch.column("da"), batch.column("db")) | (depth == 0)
            parent = many(batch.column("pa"), batch.column("pb")) | (depth <= 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(parent)], [*batch.schema.names, "shared", "parent_shared"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return staged(spark, rows.mapInArrow(probe, f"{kinds}, shared boolean, parent_shared boolean"), "screened")


def joined_ids_sha256(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Per key the SHA-256 of its ids, ascending and comma-joined.

    Ids are sorted by range, so a hot key is spread while it is sorted and
    written as text; the digest itself reads the chunks in order, one at a time.
    """
    names = [*keys, id_col]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, seq = None, [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {**{c: pa.array([v], pa.int64()) for c, v in zip(keys, key[0])}, "part": pa.array([key[1]], pa.int32()), "seq": pa.array([seq], pa.int64()), "ids": [",".join(held)]}
            )

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*names, "part")]
            for *k, value, part in zip(*cols):
                if key is None or key[0] != k or size >= CHUNK:
                    if held:
                        yield out()
                    key, held, size, seq = (k, part), [], 0, seq + 1
                held.append(str(value))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int64()) for c, v in zip(keys, key)}, "ends_sha256": [sha.hexdigest()]})

        for batch in batches:
            for *k, ids in zip(*[batch.column(c).to_pylist() for c in (*keys, "ids")]):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield out()
                key, sha = k, hashlib.sha256(ids.encode())
        if key is not None:
            yield out()

    kinds = ", ".join(f"{c} long" for c in keys)
    dealt = rows.select(*[F.col(c).cast("long").alias(c) for c in names]).repartitionByRange(*names).sortWithinPartitions(*names)
    text = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(chunks, f"{kinds}, part int, seq long, ids string")
    order = [*keys, "part", "seq"]
    return text.repartition(*keys).sortWithinPartitions(*order).mapInArrow(digests, f"{kinds}, ends_sha256 string")


def _with_parent(spark: SparkSession, children: DataFrame, nodes: DataFrame) -> DataFrame:
    """``children`` with the conv_id of the parent node, ``pa, pb`` at depth - 1.

    The join has as many rows a key as the node has children.  Nodes of over a
    thousandth of all children are broadcast: at most a thousand rows.
    """
    total = nodes.agg(F.sum("n_children")).first()[0] or 0
    hot = F.col("n_children") > max(100, total // 1000)
    keys = ["depth", "pa", "pb"]
    above = [(F.col("depth") + 1).alias("depth"), F.col("da").alias("pa"), F.col("db").alias("pb")]
    first = children.join(F.broadcast(nodes.where(hot).select(*above, F.col("conv_id").alias("hot_parent"))), keys, "left")
    cold = nodes.where(~hot).select(*above, F.col("conv_id").alias("parent_conv_id"))
    found = first.where("hot_parent IS NOT NULL").withColumn("parent_conv_id", F.col("hot_parent"))
    return found.unionByName(first.where("hot_parent IS NULL").join(cold, keys).select(*found.columns))


def prefix_trie(spark: SparkSession, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth,
    parent_conv_id`` (null at the root), ``n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, turn, key, words``; ``convs`` lists all ids once,
    those without turns too.  Turns go by ``turn`` (null first), those of one
    number by ``key``; a repeated row is another turn.  No conversations give
    no rows.
    """
    rows = screened(spark, prefixes(spark, turns, convs))
    shared = rows.where("shared")
    heads = rows.where("NOT shared AND parent_shared")

    own_ends = F.sha2(F.when(F.col("last"), F.col("conv_id").cast("string")).otherwise(F.lit("")), 256)

    def alone(df: DataFrame, parent: str) -> DataFrame:
        return df.select(
            "conv_id",
            "depth",
            F.col(parent).alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"),
            (~F.col("last")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            own_ends.alias("ends_sha256"),
        )

    tails = alone(rows.where("NOT shared AND NOT parent_shared"), "conv_id")

    groups = staged(
        spark,
        shared.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("before").alias("before"),
            F.max("pa").alias("pa"),
            F.max("pb").alias("pb"),
            F.max("parent_shared").alias("parent_shared"),
        ),
        "groups",
    )
    child = ["depth", "pa", "pb"]
    # below a proven singleton a node is the only child, and counted there
    children = groups.where("depth > 0 AND parent_shared").select(*child).unionByName(heads.select(*child))
    below = children.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("da"), F.col("pb").alias("db")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = staged(spark, groups.join(below, NODE, "left").fillna(0, ["n_children"]), "nodes")

    # per conversation: words before the depth from which on it is the smallest member, and whether it ends a leaf
    first = nodes.select("conv_id", "depth", "before").unionByName(heads.select("conv_id", "depth", "before"))
    first = first.groupBy("conv_id").agg(F.min_by("before", "depth").alias("own_from"))
    leafs = nodes.where("n_children = 0").select("conv_id", F.lit(True).alias("ends_leaf")).distinct()
    final = rows.where("last").select(
        "conv_id", F.col("depth").alias("length"), (F.col("before") + F.col("words")).alias("total"), (~F.col("shared")).alias("alone")
    )
    said = final.join(first, "conv_id", "left").join(leafs, "conv_id", "left").select(
        "conv_id",
        F.coalesce("own_from", "total").alias("own_from"),
        (F.col("alone") | F.coalesce("ends_leaf", F.lit(False))).cast("long").alias("leaf"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / DEPTHS))).alias("stretch"),
    )
    sums = (
        shared.withColumn("stretch", F.floor(F.col("depth") / DEPTHS))
        .join(said, ["conv_id", "stretch"])
        .groupBy(*NODE)
        .agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("own_from") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    )
    ends = joined_ids_sha256(shared.where("last").select("conv_id", *NODE), NODE, "conv_id")
    full = staged(spark, nodes.join(sums, NODE).join(ends, NODE, "left"), "nodes-summed").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    )

    cols = tails.columns
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*cols)
    under_one = full.where("depth > 0 AND NOT parent_shared").withColumn("parent_conv_id", F.col("conv_id")).select(*cols)
    inner = _with_parent(spark, full.where("depth > 0 AND parent_shared"), nodes).select(*cols)
    single = alone(_with_parent(spark, heads, nodes), "parent_conv_id")
    return tails.unionByName(root).unionByName(under_one).unionByName(inner).unionByName(single)


def conversation_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conv_id, turn, role, text`` as they stand."""
    turns = staged(spark, turn_keys(conversations), "turn-keys")
    return prefix_trie(spark, turns, turns.select("conv_id").distinct())
