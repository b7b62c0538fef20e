"""Gradient boosting of regression trees over rows that Spark holds packed.

A row's features become small codes once: the bin of a number, the level of a
category.  A block holds some ten thousand rows as arrays of codes with their
labels and margins, two columns of codes in one.  A level of a tree is one job:
every task sums the descent of the loss by node and code over its blocks, only
these sums reach the driver, which splits the nodes.  Of two siblings the
smaller is counted, the other is what its parent has besides.

The trees are those of Spark's ``DecisionTreeRegressor`` over the same rows with
one slot per level: the same thresholds (``MAX_BINS``, from about
``SPLIT_ROWS`` rows), gain of variance, least rows and order of ties.  They are
handed out as one Spark model.  A node keeps its rows, mean and gain, which is
what scores and importances need; its impurity is not counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.session import ship_code

SEED = 42
#: Bins of a number, and rows that its thresholds are taken from at least (all, if fewer).
MAX_BINS, SPLIT_ROWS = 32, 10_000
#: Rows of a block, blocks that are worth a task, and cells up to which two columns of codes
#: are held as one.
BLOCK_ROWS, TASK_BLOCKS, PAIR_CELLS = 32_768, 3, 4_096
#: Rounds without a gain that end boosting, the least gain, and the rounds after
#: which lineage is cut.
PATIENCE, LEAST_GAIN, CHECKPOINT_ROUNDS = 10, 1e-7, 10
#: Shares of a sum that are rounding: of two gains, and of a gain in all squares.
SAME, NOTHING = 1e-12, 1e-14


@dataclass(frozen=True)
class Loss:
    """What boosting needs of a loss: the constant it starts from, given rows
    and sum of the labels, the steepest descent at a margin, and the loss of a row."""

    start: Callable[[int, float], float]
    descent: Callable[[np.ndarray, np.ndarray], np.ndarray]
    of_row: Callable[[np.ndarray, np.ndarray], np.ndarray]
    model: type


def _sign(label):
    return 2 * label - 1


#: margins of the classifier are half log-odds, those of the regressor predictions
LOGISTIC = Loss(
    lambda n, late: 0.5 * float(np.log((late + 1) / (n - late + 1))),
    lambda y, m: 2 * _sign(y) / (1 + np.exp(2 * _sign(y) * m)),
    lambda y, m: 2 * np.log1p(np.exp(-2 * _sign(y) * m)),
    GBTClassificationModel,
)
SQUARED = Loss(lambda n, total: total / n, lambda y, m: y - m, lambda y, m: (y - m) * (y - m), GBTRegressionModel)


def kept_rounds(curve: Sequence[float], patience: int = PATIENCE, gain: float = LEAST_GAIN) -> tuple[int, bool]:
    """Rounds up to the least validation loss, and whether the curve has ended:
    ``patience`` rounds in a row without a gain end it."""
    best, at = float("inf"), 1
    for k, loss in enumerate(curve, 1):
        if loss < best - gain:
            best, at = loss, k
        elif k - at >= patience:
            return at, True
    return at, False


def thresholds(values: np.ndarray, most: int, expected: float) -> np.ndarray:
    """Up to ``most`` cuts midway between neighbouring values: all, or those
    nearest to equal shares of the values.  As in Spark's trees, zeros count as
    what the other values lack to the ``expected`` number of rows."""
    distinct, counts = np.unique(values[values != 0], return_counts=True)
    zeros = expected - counts.sum()
    if zeros > 1e-9 * expected:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts.astype(float), at, zeros)
    cuts = (distinct[:-1] + distinct[1:]) / 2
    if len(cuts) <= most:
        return cuts
    stride = expected / (most + 1)
    seen, target, found = np.cumsum(counts), stride, []
    for i in range(1, len(distinct)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            found.append(cuts[i - 1])
            target += stride
    return np.array(found)


@dataclass(frozen=True)
class Split:
    """Rows of ``column`` go right beyond ``code`` (a number) or at it (a level)."""

    column: int
    code: int
    slot: int
    threshold: float


@dataclass(frozen=True)
class Design:
    """The columns of codes: numbers by their cuts, then categories by their
    number of slots (a further code has none).  ``pairs`` says which are held as one."""

    cuts: tuple[np.ndarray, ...]
    levels: tuple[int, ...]
    sizes: tuple[int, ...] = field(init=False)
    pairs: tuple[tuple[int, ...], ...] = field(init=False)

    def __post_init__(self) -> None:
        sizes = [len(c) + 1 for c in self.cuts] + [n + 1 for n in self.levels]
        pairs: list[tuple[int, ...]] = []
        for c in sorted(range(len(sizes)), key=lambda c: sizes[c]):
            if pairs and len(pairs[-1]) == 1 and sizes[pairs[-1][0]] * sizes[c] <= PAIR_CELLS:
                pairs[-1] = (pairs[-1][0], c)
            else:
                pairs.append((c,))
        object.__setattr__(self, "sizes", tuple(sizes))
        object.__setattr__(self, "pairs", tuple(pairs))

    def cells(self, pair: tuple[int, ...]) -> int:
        return int(np.prod([self.sizes[c] for c in pair]))

    def codes(self, numbers: Sequence[np.ndarray], levels: Sequence[np.ndarray]) -> list[np.ndarray]:
        single = [np.searchsorted(cuts, x) for cuts, x in zip(self.cuts, numbers)]
        single += [np.minimum(x, n).astype(np.int64) for n, x in zip(self.levels, levels)]
        both = (single[p[0]] if len(p) == 1 else single[p[0]] * self.sizes[p[1]] + single[p[1]] for p in self.pairs)
        return [x.astype(np.min_scalar_type(self.cells(p) - 1)) for p, x in zip(self.pairs, both)]

    def right(self, split: Split, codes: list[np.ndarray], rows) -> np.ndarray:
        """Which of the rows go right."""
        k = next(k for k, p in enumerate(self.pairs) if split.column in p)
        code, pair = codes[k][rows], self.pairs[k]
        if len(pair) == 2:
            code = code // self.sizes[pair[1]] if split.column == pair[0] else code % self.sizes[pair[1]]
        return code > split.code if split.column < len(self.cuts) else code == split.code

    def sums(self, codes: list[np.ndarray], rows, descent: np.ndarray) -> np.ndarray:
        """Rows and descent by code, the columns one after another."""
        out: list = [None] * len(self.sizes)
        for p, held in zip(self.pairs, codes):
            at = held[rows].astype(np.intp)
            both = np.array([np.bincount(at, minlength=self.cells(p)), np.bincount(at, descent, self.cells(p))])
            if len(p) == 1:
                out[p[0]] = both
            else:
                both = both.reshape(2, self.sizes[p[0]], self.sizes[p[1]])
                out[p[0]], out[p[1]] = both.sum(2), both.sum(1)
        return np.concatenate(out, 1)

    def best(self, sums: np.ndarray, least: int) -> tuple[Split, float, np.ndarray, np.ndarray] | None:
        """The split of most gain (times the rows) of a node with both sides'
        rows and descent; ties go to the first slot and the least cut."""
        ends = np.cumsum(self.sizes)
        whole = sums[:, : ends[0]].sum(1)
        left = []
        for c, (end, size) in enumerate(zip(ends, self.sizes)):
            own = sums[:, end - size : end - 1]
            left.append(np.cumsum(own, 1) if c < len(self.cuts) else whole[:, None] - own)
        n, s = np.concatenate(left, 1)
        valid = (n >= least) & (whole[0] - n >= least)
        if not valid.any():
            return None
        n, s = np.where(valid, n, 1.0), np.where(valid, s, 0.0)
        rest = np.where(valid, whole[0] - n, 1.0)
        gain = np.where(valid, s * s / n + (whole[1] - s) ** 2 / rest - whole[1] ** 2 / whole[0], -np.inf)
        at = int(np.argmax(gain >= gain.max() - SAME * abs(gain.max())))
        c = int(np.searchsorted(np.cumsum([z - 1 for z in self.sizes]), at, side="right"))
        code = at - sum(z - 1 for z in self.sizes[:c])
        if c < len(self.cuts):
            split = Split(c, code, c, float(self.cuts[c][code]))
        else:
            split = Split(c, code, len(self.cuts) + sum(self.levels[: c - len(self.cuts)]) + code, 0.5)
        side = np.array([n[at], s[at]])
        return split, float(gain[at]), side, whole - side


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of k are 2k and 2k + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    totals: dict[int, tuple[float, float]] = field(default_factory=dict)  # rows and descent

    def value(self, node: int) -> float:
        n, total = self.totals[node]
        return total / n

    def places(self, design: Design, codes: list[np.ndarray], rows, wanted=None, node: int = 1) -> Iterator[tuple[int, object]]:
        """The wanted nodes (None: the leaves) with their rows."""
        split = self.splits.get(node)
        if node in wanted if wanted is not None else split is None:
            yield node, rows
        elif split is not None and (wanted is None or any(_within(w, node) for w in wanted)):
            places = np.arange(rows.start, rows.stop) if isinstance(rows, slice) else rows
            right = design.right(split, codes, rows)
            yield from self.places(design, codes, places[~right], wanted, 2 * node)
            yield from self.places(design, codes, places[right], wanted, 2 * node + 1)

    def added(self, design: Design, block: tuple, step: float) -> tuple:
        codes, y, margin, fitted = block
        margin = margin.copy()
        for leaf, rows in self.places(design, codes, slice(0, len(y))):
            margin[rows] += step * self.value(leaf)
        return codes, y, margin, fitted


def _within(node: int, top: int) -> bool:
    while node > top:
        node //= 2
    return node == top


def _packed(design: Design, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks ``(codes, labels, margins, rows to fit)``; the held rows come last."""
    waiting: list[pa.RecordBatch] = []

    def block() -> tuple:
        columns = [c.to_numpy() for c in pa.Table.from_batches(waiting).columns]
        *features, y, held = columns
        if np.isnan(y).any():
            raise ValueError("a label is null or not a number")
        order = np.argsort(held, kind="stable")
        codes = design.codes(features[: len(design.cuts)], features[len(design.cuts) :])
        return [c[order] for c in codes], y[order], np.zeros(len(y)), int(len(y) - held.sum())

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= BLOCK_ROWS:
            yield block()
            waiting = []
    if waiting:
        yield block()


def _blocks(rows: DataFrame, numbers: Sequence[str], levels: Sequence[str], label: str, design: Design) -> RDD:
    import pickle

    def pack(batches):
        for block in _packed(design, batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

    narrow = rows.where("__is_val IS NOT NULL").select(*[F.col(c).cast("double") for c in (*numbers, *levels, label)], F.col("__is_val").cast("double"))
    return narrow.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def design_of(rows: DataFrame, numbers: Sequence[str], levels: Sequence[int]) -> Design:
    """Cuts of the numbers from about ``SPLIT_ROWS`` of the rows (all, if fewer),
    the rows that Spark's trees of this seed draw from the same partitions."""
    few = rows.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    n = few.count()
    wanted = max(MAX_BINS * MAX_BINS, SPLIT_ROWS)
    if n > wanted:
        spark = rows.sparkSession
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(SEED).nextInt()
        drawn = few._jdf.rdd().sample(False, wanted / n, seed)
        few = DataFrame(spark._jsparkSession.createDataFrame(drawn, few._jdf.schema()), spark)
    held = few.toArrow()
    most = max(min(MAX_BINS, n) - 1, 0)
    return Design(tuple(thresholds(held.column(c).to_numpy(), most, float(min(n, wanted))) for c in numbers), tuple(levels))


def fit_boosted(
    rows: DataFrame, numbers: Sequence[str], categories: dict[str, int], label: str, loss: Loss, rounds: int, step: float, depth: int, least: int
):
    """Boosted regression trees, kept to the best prefix of rounds.

    ``rows`` has the numbers, the categories (index column -> slots), the label and
    ``__is_val``.  From the best constant on, every round fits a tree to the
    descent of the loss on the rows that are not held, and adds ``step`` times it
    to the margins of all; the mean loss of the held rows after each round is the
    validation curve.  The job that starts a round also stores the new margins and
    adds up the loss of the held rows; every ``CHECKPOINT_ROUNDS`` the blocks are
    checkpointed to cut their lineage, in place of the checkpoint before.  Without held rows all rounds are kept."""
    sc = rows.sparkSession.sparkContext
    ship_code(rows.sparkSession)
    design = design_of(rows.where(~F.col("__is_val")), numbers, list(categories.values()))
    first = _blocks(rows, numbers, list(categories), label, design).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = first.map(lambda b: (len(b[1]), b[3], float(b[1][: b[3]].sum()))).collect()  # a row per block
    parts = max(1, min(-(-sum(k for k, *_ in sizes) // (TASK_BLOCKS * BLOCK_ROWS)), sc.defaultParallelism))
    n = sum(k for _, k, _ in sizes)
    if not n:
        raise ValueError("no rows to fit")
    start = loss.start(n, float(np.sum([s for *_, s in sizes])))
    blocks = first if first.getNumPartitions() <= parts else first.coalesce(parts)
    if blocks.getNumPartitions() < parts:
        blocks = first.repartition(parts)
    state = blocks.map(lambda b: (b[0], b[1], b[2] + start, b[3])).persist(StorageLevel.MEMORY_AND_DISK)
    before, trees, curve, saved = first, [], [], None
    while True:
        squares, lost, held, sums = _level(state, design, loss, Tree(), [1])
        before.unpersist()
        if state.isCheckpointed():
            # lineage starts here now: what it started from is not read again
            _forget(sc, saved)
            saved = state.getCheckpointFile()
        if trees and held:
            curve.append(lost / held)
            if kept_rounds(curve)[1]:
                break
        if len(trees) == rounds:
            break
        tree = _grown(state, design, loss, sums[1], depth, least, NOTHING * squares)
        trees.append(tree)
        before, state = state, state.map(lambda b, tree=tree: tree.added(design, b, step)).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % CHECKPOINT_ROUNDS == 0:
            state.checkpoint()
    state.unpersist()
    _forget(sc, saved)
    keep = kept_rounds(curve)[0] if curve else len(trees)
    slots = len(design.cuts) + sum(design.levels)
    constant = Tree(totals={1: (n, n * start)})
    return _ensemble(loss.model, [constant, *trees[:keep]], [1.0] + [step] * keep, slots, label)


def _forget(sc: SparkContext, checkpoint: str | None) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    if checkpoint:
        path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _level(state: RDD, design: Design, loss: Loss, tree: Tree, wanted: Sequence[int]):
    """Of the nodes wanted their sums by code, added up per task; with the
    root, also the squares of the descent and the loss of the held rows."""
    root = 1 in wanted

    def of_task(blocks):
        squares, lost, held, sums = 0.0, 0.0, 0, {}
        for codes, y, margin, fitted in blocks:
            descent = loss.descent(y[:fitted], margin[:fitted])
            if root:
                squares += float(descent @ descent)
                lost += float(loss.of_row(y[fitted:], margin[fitted:]).sum())
                held += len(y) - fitted
            for node, rows in tree.places(design, codes, slice(0, fitted), wanted):
                own = design.sums(codes, rows, descent[rows])
                sums[node] = sums[node] + own if node in sums else own
        yield squares, lost, held, sums

    parts = state.mapPartitions(of_task).collect()  # bounded: nodes x codes a task
    zero = np.zeros((2, sum(design.sizes)))
    return (*(sum(p[i] for p in parts) for i in range(3)), {w: sum((p[3][w] for p in parts if w in p[3]), zero) for w in wanted})


def _grown(state: RDD, design: Design, loss: Loss, root: np.ndarray, depth: int, least: int, nothing: float) -> Tree:
    """One tree, level by level; a gain within rounding (``nothing``) is none."""
    tree, open_nodes = Tree(), {1: root}
    tree.totals[1] = tuple(root[:, : design.sizes[0]].sum(1))
    for level in range(depth):
        smaller = []
        for node, sums in open_nodes.items():
            found = design.best(sums, least)
            if found is None or found[1] <= nothing:
                continue
            split, gain, left, right = found
            tree.splits[node], tree.gains[node] = split, gain / tree.totals[node][0]
            tree.totals[2 * node], tree.totals[2 * node + 1] = tuple(left), tuple(right)
            smaller.append(2 * node + (left[0] > right[0]))
        if not smaller or level == depth - 1:
            break
        *_, counted = _level(state, design, loss, tree, smaller)
        below = counted | {k ^ 1: open_nodes[k // 2] - own for k, own in counted.items()}
        open_nodes = {k: below[k] for k in sorted(below)}
    return tree


def _ensemble(kind: type, trees: list[Tree], weights: list[float], slots: int, label: str):
    """The trees as one Spark model of a label, which scores, saves and explains itself as any."""
    gateway = SparkSession.active().sparkContext._gateway
    spark = gateway.jvm.org.apache.spark.ml

    def stats(n: float, total: float):
        held = gateway.new_array(gateway.jvm.double, 3)
        held[0], held[1], held[2] = float(n), float(total), float(total * total / n)
        return gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(held, int(n))

    def built(tree: Tree, node: int):
        own = stats(*tree.totals[node])
        split = tree.splits.get(node)
        if split is None:
            return spark.tree.LeafNode(tree.value(node), 0.0, own)
        cut = spark.tree.ContinuousSplit(split.slot, split.threshold)
        return spark.tree.InternalNode(tree.value(node), 0.0, tree.gains[node], built(tree, 2 * node), built(tree, 2 * node + 1), cut, own)

    one = spark.regression.DecisionTreeRegressionModel
    held, share = gateway.new_array(one, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        # with their number of features, or importances end at the last feature that a tree tests
        held[i], share[i] = one(f"tree-{uuid.uuid4().hex[:12]}", built(tree, 1), slots), weight
    package = spark.classification if kind is GBTClassificationModel else spark.regression
    whole = kind(getattr(package, kind.__name__)(f"boosted-{uuid.uuid4().hex[:12]}", held, share, slots))._set(labelCol=label)
    whole._transfer_params_to_java()
    return whole
