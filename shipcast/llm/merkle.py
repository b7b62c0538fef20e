"""Merkle manifest of a table, with inclusion proofs by pointer jumping.

1. Every row is a leaf: the hash of its fields, each written with its length.
2. The leaves of a group (``lang``), sorted by id, are folded eight by eight,
   level by level, to the group's subroot; the subroots, sorted by group, are
   folded likewise to the root.
3. Every node starts with a pointer to its parent and the siblings it needs to
   get there.  Repeated self-joins put the ancestor of the ancestor in its
   place and append that one's siblings, which doubles the distance, until
   every leaf points at the root and holds its whole proof.

Hashes are SHA-256; a parent hashes the lower-case hex digests of its
children, left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm.common import staged
from shipcast.llm.ordering import ranked

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: group of the tree over the subroots (groups of leaves are '' or '=' and their name)
TOP = "#"
#: place that marks, in a path, the step from a subroot to the tree above it
CROSS = -1
#: bytes up to which the ancestors of one round are broadcast
BROADCAST_BYTES = 16 << 20
PATH = "array<struct<i:int,s:binary>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields: ``-`` for null, else byte count, colon, value."""
    said = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*said), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _joined(hashes: Column) -> Column:
    return F.aggregate(hashes, F.unhex(F.lit("")), lambda a, x: F.concat(a, x))


def _levels(spark: SparkSession, level: DataFrame, height: int, name: str) -> tuple[DataFrame | None, list[DataFrame]]:
    """Folds ``g, p (from 0), h, n, doc`` level by level.

    Returns the pointers of all nodes to their parents and, per level, the
    tops (nodes alone on their level).
    """
    pointers, tops = None, []
    for at in range(height + 1):
        tops.append(level.where("n = 1").select("g", F.lit(at).alias("l"), "h", "doc"))
        if at == height:
            break
        runs = (
            level.where("n > 1")
            .groupBy("g", F.floor(F.col("p") / ARITY).alias("q"))
            .agg(F.sort_array(F.collect_list(F.struct("p", "h", "doc"))).alias("kids"), F.max("n").alias("n"))
        )
        runs = staged(spark, runs, f"{name}-{at}")
        hashes = F.transform("kids", lambda k: k["h"])
        steps = runs.select("g", "q", hashes.alias("hs"), F.posexplode("kids").alias("i", "kid")).select(
            "g",
            F.lit(at).alias("l"),
            F.col("kid.p").alias("p"),
            F.col("g").alias("ag"),
            F.lit(at + 1).alias("al"),
            F.col("q").alias("ap"),
            F.array(F.struct("i", _joined(F.filter("hs", lambda x, i: i != F.col("i"))).alias("s"))).cast(PATH).alias("path"),
            F.col("kid.doc").alias("doc"),
        )
        pointers = steps if pointers is None else pointers.unionByName(steps)
        level = runs.select(
            "g",
            F.col("q").alias("p"),
            F.unhex(F.sha2(F.array_join(F.transform(hashes, _hex), ""), 256)).alias("h"),
            F.ceil(F.col("n") / ARITY).alias("n"),
            F.lit(None).cast(level.schema["doc"].dataType).alias("doc"),
        )
    return pointers, tops


def _height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def merkle_manifest(
    spark: SparkSession, docs: DataFrame, group: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root`` (hex),
    ``path`` (per level the place ``i`` in its run and the siblings ``s``, 32
    bytes each, left to right; place -1 is the step across the subroot) and
    the columns of ``carry``, computed on ``docs``.

    Null fields, null ids (first in their group) and a null group (the first)
    are allowed.  Rows of one id stand by their leaf hash; equal rows are
    leaves each.  An empty table gives no rows.  Other columns are ignored.
    """
    carry = carry or {}
    leaf = leaf_hash([F.col(f) for f in fields])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(id_col).alias("id"),
        F.unhex(leaf).alias("h"),
        F.struct(F.lit(True).alias("leaf"), *[c.alias(k) for k, c in carry.items()]).alias("more"),
    )
    leaves = staged(spark, ranked(spark, rows, "g", ["id", "h"], "leaves"), "leaves-placed")
    doc = F.struct(F.col("id"), F.col("h").alias("leaf"), "more")
    most = leaves.agg(F.max("n")).first()[0]
    kept = [F.col(f"doc.more.{k}").alias(k) for k in carry]
    if most is None:
        nothing = leaves.select(F.col("id").alias(id_col), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root")], F.lit(None).cast(PATH).alias("path"), *[F.col(f"more.{k}").alias(k) for k in carry])
        return nothing.where("false")

    height = _height(most)
    low, tops = _levels(spark, leaves.select("g", (F.col("pos") - 1).alias("p"), "h", "n", doc.alias("doc")), height, "runs")
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    placed = staged(spark, ranked(spark, subroots.withColumn("one", F.lit(0)), "one", ["g"], "subroots"), "subroots-placed")
    groups = placed.count()
    high, ends = _levels(
        spark,
        placed.select(F.lit(TOP).alias("g"), (F.col("pos") - 1).alias("p"), "h", "n", F.lit(None).cast(placed.schema["doc"].dataType).alias("doc")),
        _height(groups),
        "top",
    )
    root = ends[-1].select(F.hex("h")).first()[0].lower()
    cross = placed.select(
        "g",
        "l",
        F.lit(0).cast("long").alias("p"),
        F.lit(TOP).alias("ag"),
        F.lit(0).alias("al"),
        (F.col("pos") - 1).alias("ap"),
        F.array(F.struct(F.lit(CROSS).alias("i"), F.col("h").alias("s"))).cast(PATH).alias("path"),
        "doc",
    )
    pointers = cross
    for more in (low, high):
        pointers = pointers if more is None else pointers.unionByName(more)
    done = _jump(spark, pointers, height + 1 + _height(groups), _height(groups))
    return done.select(
        F.col("doc.id").alias(id_col),
        _hex(F.col("doc.leaf")).alias("leaf"),
        _hex(F.filter("path", lambda e: e["i"] == CROSS)[0]["s"]).alias("subroot"),
        F.lit(root).alias("root"),
        "path",
        *kept,
    )


def _jump(spark: SparkSession, pointers: DataFrame, depth: int, top: int) -> DataFrame:
    """Doubles the distance of every pointer until it reaches the root; the
    rows of the leaves.

    A round looks up the ancestors at distance d.  Few of them are broadcast,
    bounded by their bytes; otherwise they are more than the bound allows, and
    since each has at most 8^d leaves below it, no key of the join is hot.
    """
    at_root = (F.col("ag") == TOP) & (F.col("al") == top)
    leaf = F.col("doc").isNotNull()
    active = staged(spark, pointers, "pointers-0")
    done, distance, r = [], 1, 0
    while distance < depth:
        done.append(active.where(at_root))
        rest = active.where(~at_root)
        known = rest
        for d in done:
            known = known.unionByName(d)
        # an ancestor at this distance is as high in its group's tree, or in the tree above
        known = known.where((F.col("l") >= distance) | (F.col("g") == TOP)).select(
            F.col("g").alias("ag"), F.col("l").alias("al"), F.col("p").alias("ap"),
            F.col("ag").alias("g2"), F.col("al").alias("l2"), F.col("ap").alias("p2"), F.col("path").alias("path2"),
        )
        if known.count() * (64 + (32 * ARITY + 16) * distance) <= BROADCAST_BYTES:
            known = F.broadcast(known)
        step = rest.join(known, ["ag", "al", "ap"]).select(
            "g", "l", "p", F.col("g2").alias("ag"), F.col("l2").alias("al"), F.col("p2").alias("ap"),
            F.concat("path", "path2").alias("path"), "doc",
        )
        distance, r = 2 * distance, r + 1
        active = staged(spark, step, f"pointers-{r}") if distance < depth else step
    out = active.where(leaf)
    for d in done:
        out = out.unionByName(d.where(leaf))
    return out


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its path lead to."""
    inner = F.filter(path, lambda e: e["i"] >= 0)
    return F.aggregate(
        inner,
        leaf,
        lambda now, e: F.sha2(
            F.concat(_hex(F.substring(e["s"], F.lit(1), e["i"] * 32)), now, _hex(F.substring(e["s"], e["i"] * 32 + 1, F.lit(32 * ARITY)))),
            256,
        ),
    )


def proof_text(path: Column) -> Column:
    """The siblings of a path as hex, level by level, left to right."""
    return F.array_join(F.transform(F.filter(path, lambda e: e["i"] >= 0), lambda e: _hex(e["s"])), "")
