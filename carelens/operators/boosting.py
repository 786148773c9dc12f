"""Boosted trees (I9) that count distinct rows instead of visiting every row at every level.

``BoostedTrees`` is MLlib's GBTClassifier with its own training: the same trees on the
same candidate splits, with the same subsample, gains and leaf values (equal up to the
order in which floating-point numbers are added).  MLlib visits each row as an object at
each level of each tree, shuffles the counts of each level and stores two numbers a row
again for each tree.

Here the rows are binned once, a byte a feature, in blocks of at most ``BLOCK`` rows.
Rows of a block with the same bins and label always have the same margin and gradient,
so a block holds them once, as a cell, with the cell of every row; a tree costs a row
only the draw of its subsample, and a level costs a cell one look-up for each group of
features.  Where all rows differ, a cell is a row and everything holds as well.  Tasks
return sums for each node and bin, whatever the number of rows, and no shuffle is used.
At most ``ALONE`` rows are one task, which grows all trees by itself.

Margins are kept in the cached blocks.  They follow from the bins and the trees, so
every ``AFRESH`` trees they are computed anew from the binned rows: what is lost can be
made again from there, and no checkpoint is written.
"""

from __future__ import annotations

import copy
import math
import pickle
import struct
from functools import lru_cache, partial

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one block (about), cells of a joint count of several features, and trees between computations from the start.
BLOCK, JOINT, AFRESH = 1 << 21, 1 << 10, 20
# So few rows are one task: to count them takes no longer than a job for each level.
ALONE = 1 << 20
# Nodes that differ by less in their values are not split (MLlib's EPSILON).
EPSILON = 2.0 ** -52


# --- the subsample: Spark's XORShiftRandom, for many rows at once ---------------


def _murmur3(data: bytes, seed: int) -> int:
    """Scala's MurmurHash3.bytesHash of a multiple of 4 bytes."""
    m, h = 0xFFFFFFFF, seed & 0xFFFFFFFF
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def hash_seed(seed: int) -> int:
    """XORShiftRandom.hashSeed: the first state of a generator."""
    data = struct.pack(">q", seed)
    low = _murmur3(data, 0x3C074A61)
    return _murmur3(data, low) << 32 | low


def _next(state):
    state = state ^ (state << np.uint64(21))
    state ^= state >> np.uint64(35)
    state ^= state << np.uint64(4)
    return state


def _jump(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States after the number of steps that ``table`` stands for."""
    out = table[0][states & np.uint64(255)]
    for i in range(1, 8):
        out ^= table[i][(states >> np.uint64(8 * i)) & np.uint64(255)]
    return out


@lru_cache
def jump_tables(n: int = 40) -> list[np.ndarray]:
    """Item k: 2^k steps of the generator (a linear map of 64 bits) as a table by byte."""
    tables, images = [], _next(np.uint64(1) << np.arange(64, dtype=np.uint64))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
    for _ in range(n):
        table = np.zeros((8, 256), np.uint64)
        for i in range(8):
            for b in range(8):
                table[i][bits[:, b]] ^= images[8 * i + b]
        tables.append(table)
        images = _jump(table, images)
    return tables


def draw(first: int, start: int, n: int, share: float, jumps: list[np.ndarray]) -> np.ndarray:
    """Which of ``n`` rows from number ``start`` of a partition are in the subsample, if
    its generator starts in the state ``first`` and gives each row one nextDouble()."""
    state = np.array([first], np.uint64)
    for k in range(start.bit_length()):
        if start >> k & 1:
            state = _jump(jumps[k + 1], state)   # two steps a row
    # Row j of lane i is i * each + j.
    lanes = 1 << max(0, min(13, (n // 64).bit_length()))
    each = 1 << max(0, (-(-n // lanes) - 1).bit_length())
    shift = each.bit_length()
    while state.size < lanes:
        state = np.concatenate([state, _jump(jumps[shift], state)])
        shift += 1
    most = np.uint64(int(np.ceil(share * 2.0 ** 53)))
    out = np.empty((each, lanes), bool)
    for j in range(min(each, n)):
        high = _next(state)
        state = _next(high)
        value = ((high & np.uint64((1 << 26) - 1)) << np.uint64(27)) + (state & np.uint64((1 << 27) - 1))
        np.less(value, most, out=out[j])
    return out.T.reshape(-1)[:n]


# --- growing trees ---------------------------------------------------------------


def size(group: list[int], bins: list[int]) -> int:
    return math.prod(bins[f] for f in group)


def groups(bins: list[int]) -> list[list[int]]:
    """Features that are counted jointly."""
    out: list[list[int]] = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        home = next((g for g in out if size([f, *g], bins) <= JOINT), None)
        out.append([f]) if home is None else home.append(f)
    return [sorted(g) for g in out]


def _impurity(n, total, squares):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


def best_split(stats: list[np.ndarray], node: dict) -> tuple | None:
    """(gain, feature, bin, left, right) of the best split of a node by the counts of its
    features, (3, bins): rows, sum and sum of squares.  Of equal gains the first counts, as in MLlib."""
    best = None
    for f, s in enumerate(stats):
        if s.shape[1] < 2:
            continue
        running = np.cumsum(s, axis=1)
        left = running[:, :-1]
        right = running[:, -1:] - left
        if node.get("stats") is None:
            node["stats"] = left[:, 0] + right[:, 0]
            node["impurity"] = float(_impurity(*node["stats"]))
        n = left[0] + right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = node["impurity"] - left[0] / n * _impurity(*left) - right[0] / n * _impurity(*right)
        gain[~((left[0] >= 1) & (right[0] >= 1) & (gain >= 0))] = -np.inf
        i = int(np.argmax(gain))
        if gain[i] > -np.inf and (best is None or gain[i] > best[0]):
            best = (float(gain[i]), f, i, left[:, i].copy(), right[:, i].copy())
    if node.get("stats") is None:   # no feature has two values
        node["stats"] = stats[0].sum(axis=1)
        node["impurity"] = float(_impurity(*node["stats"]))
    return best


def _value(stats) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


class Block:
    """Binned rows of one partition: the cell of each row; of each cell its bins (joint
    numbers by group of features), label sign, rows, margin, and rows in the subsample."""

    def __init__(self, part: int, start: int, codes: np.ndarray, labels: np.ndarray, bins: list[int]):
        self.part, self.start, self.n = part, start, len(labels)
        key, most = labels.astype(np.int64), 2
        for f, k in enumerate(bins):
            if most * k >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                most = len(key)
            key, most = key * k + codes[f], most * k
        _, first, cell = np.unique(key, return_index=True, return_inverse=True)
        self.cell = cell.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32)
        self.codes = [np.ravel_multi_index([codes[f][first] for f in g], [bins[f] for f in g]).astype(np.uint16 if size(g, bins) <= 1 << 16 else np.int64)
                      for g in groups(bins)]
        self.sign = labels[first].astype(np.int8) * 2 - 1
        self.rows = np.bincount(self.cell, minlength=len(first))
        self.margin = np.zeros(len(first))
        self.drawn = None

    def followed(self, trees: list["Tree"], bins: list[int]) -> "Block":
        """This block with the margins after more trees."""
        out = copy.copy(self)
        for t in trees:
            out.margin = out.margin + t.weight * t.values[places(out.codes, t.levels, bins)]
        return out

    def sampled(self, tree: int, share: float, seed: int, jumps: list) -> "Block":
        """This block with the subsample of tree number ``tree``."""
        out = copy.copy(self)
        if share < 1:
            drawn = draw(hash_seed(seed + tree + self.part + 1), self.start, self.n, share, jumps)
            out.drawn = np.bincount(self.cell[drawn], minlength=len(self.sign)).astype(float)
        else:
            out.drawn = self.rows.astype(float)
        return out

    def loss(self) -> float:
        """The sum of the log loss over all rows."""
        m = 2.0 * self.sign * self.margin
        # log(1 + exp(-m)) without overflow, as MLUtils.log1pExp
        return float(2.0 * np.sum(self.rows * (np.log1p(np.exp(-np.abs(m))) + np.maximum(-m, 0.0))))

    def counts(self, first: bool, levels: list[dict], bins: list[int]) -> np.ndarray:
        """(3, nodes, all bins) of the subsample at the level below ``levels``: rows,
        gradients, their squares."""
        nodes = 1 << len(levels)
        y = self.sign.astype(float)
        gradient = y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * self.margin))
        x = self.drawn * gradient
        weights = (self.drawn, x, x * gradient)
        node = places(self.codes, levels, bins)
        out: list = [None] * len(bins)
        for group, codes in zip(groups(bins), self.codes):
            k = size(group, bins)
            at = node * k + codes
            s = np.stack([np.bincount(at, w, nodes * k) for w in weights]).reshape(3, nodes, *[bins[f] for f in group])
            for i, f in enumerate(group):
                out[f] = s.sum(axis=tuple(2 + j for j in range(len(group)) if j != i))
        return np.concatenate(out, axis=2)


def places(codes: list[np.ndarray], levels: list[dict], bins: list[int]) -> np.ndarray:
    """The place in the level below ``levels`` that each cell has come to; a level is
    {place: (feature, bin)}, and cells of other places go left."""
    node = np.zeros(len(codes[0]), np.int64)
    for splits in levels:
        right = np.zeros(len(node), np.uint8)
        for g, group in enumerate(groups(bins)):
            mine = {i: s for i, s in splits.items() if s[0] in group}
            if mine:
                shape = [bins[f] for f in group]
                goes = np.zeros((max(splits) + 2, *shape), np.uint8)
                for i, (f, b) in mine.items():
                    k = group.index(f)
                    goes[i] = (np.arange(shape[k]) > b).reshape([-1 if j == k else 1 for j in range(len(shape))])
                right |= goes.reshape(-1)[np.minimum(node, max(splits) + 1) * size(group, bins) + codes[g]]
        node = 2 * node + right
    return node


class Tree:
    """A tree as the blocks need it: the splits of each level, and the value of each
    place below the last."""

    def __init__(self, levels: list[dict], values: np.ndarray, weight: float):
        self.levels, self.values, self.weight = levels, values, weight


class Growth:
    """One tree while it grows: {index: node}; the children of node i are 2i and 2i + 1, the root is 1."""

    def __init__(self, depth: int):
        self.depth, self.levels = depth, []
        self.nodes: dict = {1: {}}
        self.open = {0: self.nodes[1]}   # place in the level -> node

    def split(self, counts: np.ndarray, bins: list[int]) -> None:
        """Split the open nodes of this level by the counts of all places."""
        starts = np.cumsum([0, *bins])
        splits, below = {}, {}
        for place, node in sorted(self.open.items()):
            found = best_split([counts[:, place, a:b] for a, b in zip(starts, starts[1:])], node)
            if found is None or found[0] <= 0:
                continue
            node["gain"], f, b, left, right = found
            node["split"] = splits[place] = (f, b)
            for side, stats in enumerate((left, right)):
                child = {"stats": stats, "impurity": float(_impurity(*stats))}
                self.nodes[2 * ((1 << len(self.levels)) + place) + side] = child
                if abs(child["impurity"]) >= EPSILON:
                    below[2 * place + side] = child
        self.levels.append(splits)
        self.open = below if len(self.levels) < self.depth else {}

    def tree(self, weight: float) -> Tree:
        values = np.empty(1 << len(self.levels))
        for place in range(len(values)):
            i = len(values) + place
            while i not in self.nodes:   # cells of a leaf above went left from there
                i >>= 1
            values[place] = _value(self.nodes[i]["stats"])
        return Tree(self.levels, values, weight)


# --- on Spark ----------------------------------------------------------------------


def _blocks(thresholds: list[np.ndarray]):
    """Arrow function: rows (features, label, partition) of a partition as pickled blocks."""
    bins = [len(t) + 1 for t in thresholds]

    def run(batches):
        import pyarrow as pa
        kind = np.uint8 if max(bins) <= 256 else np.int64
        codes, labels, part, held, start = [], [], 0, 0, 0

        def made():
            block = Block(part, start, np.concatenate(codes, axis=1), np.concatenate(labels), bins)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()   # a task may have several partitions of the rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(bins))
            # As MLlib: the number of thresholds below the value; NaN lies above all.
            codes.append(np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(thresholds)]).astype(kind))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8))
            held += len(x)
            if held >= BLOCK:
                yield made()
                codes, labels, held, start = [], [], 0, start + held
        if held:
            yield made()
    return run


def grow(state, bins: list[int], total: int, how: tuple) -> tuple[list[dict], list[float]]:
    """(the nodes of each tree, the mean log loss after each).  ``state`` holds the blocks:
    ``advance`` brings their margins to the trees so far, ``total`` adds up their counts."""
    rounds, depth, rate, *_ = how
    grown, trees, losses = [], [], []
    for t in range(rounds + 1):
        state.advance(trees)
        growth = Growth(depth)
        while len(growth.levels) < depth and (growth.open or not growth.levels):
            sums = state.total(first=t == 0, levels=growth.levels, last=t == rounds)
            if not growth.levels and t:
                losses.append(float(sums[0]) / total)
            if t == rounds:
                return grown, losses
            growth.split(sums[1:].reshape(3, 1 << len(growth.levels), -1), bins)
        grown.append(growth.nodes)
        trees.append(growth.tree(1.0 if t == 0 else rate))


class _Spread:
    """Blocks of an RDD.  What one step computes is cached for the next."""

    def __init__(self, base, bins: list[int], tasks: int, how: tuple):
        self.base, self.now, self.old, self.bins, self.tasks, self.how = base, base, None, bins, tasks, how

    def advance(self, trees: list[Tree]) -> None:
        from pyspark import StorageLevel
        # From the margins before the last tree or, now and then, from the start.
        t = len(trees)
        more, origin = (trees, self.base) if t % AFRESH == 0 else (trees[-1:], self.now)
        self.old = self.now
        self.now = origin.mapPartitions(partial(_advanced, trees=more, bins=self.bins, tree=t, how=self.how)) \
            .persist(StorageLevel.MEMORY_AND_DISK)

    def total(self, **level) -> np.ndarray:
        """The sum of an array of each task, in their order; of many tasks by way of some of them."""
        parts = self.now.mapPartitions(partial(_counted, bins=self.bins, **level))
        out = parts.treeReduce(np.add) if self.tasks > 200 else sum(parts.collect())
        if level["last"]:
            self.now.unpersist()
        if self.old is not None and self.old is not self.base:
            self.old.unpersist()
        self.old = None
        return out


class _Alone:
    """The blocks of few rows, all in one task."""

    def __init__(self, blocks, bins: list[int], how: tuple):
        self.blocks, self.bins, self.how = list(blocks), bins, how

    def advance(self, trees: list[Tree]) -> None:
        self.blocks = list(_advanced(self.blocks, trees[-1:], self.bins, len(trees), self.how))

    def total(self, **level) -> np.ndarray:
        return next(_counted(self.blocks, bins=self.bins, **level))


def _alone(blocks, bins: list[int], total: int, how: tuple):
    yield grow(_Alone(blocks, bins, how), bins, total, how)


def _advanced(blocks, trees: list[Tree], bins: list[int], tree: int, how: tuple):
    rounds, *_, share, seed = how
    jumps = jump_tables() if share < 1 else []
    for block in blocks:
        block = block.followed(trees, bins)
        yield block.sampled(tree, share, seed, jumps) if tree < rounds else block


def _counted(blocks, first: bool, levels: list[dict], bins: list[int], last: bool):
    """One array of a task: the loss, then the counts of the level (none after the last tree)."""
    total = np.zeros(1 + (0 if last else (3 << len(levels)) * sum(bins)))
    for block in blocks:
        if not levels:
            total[0] += block.loss()
        if not last:
            total[1:] += block.counts(first, levels, bins).ravel()
    yield total


def slots(spark) -> int:
    """Tasks that can run at once."""
    sc = spark.sparkContext
    profile = _object(sc._jvm.org.apache.spark.resource, "ResourceProfile").getOrCreateDefaultProfile(sc._jsc.sc().conf())
    return max(1, sc._jsc.sc().maxNumConcurrentTasks(profile))


class BoostedTrees(GBTClassifier):
    """GBTClassifier whose trees are grown on blocks of cells; ``loss_by_round`` of
    the fitted model is what its ``evaluateEachIteration`` gives on the training rows."""

    def _fit_java(self, dataset: DataFrame):
        from pyspark import StorageLevel

        from ..session import ship_package
        spark = dataset.sparkSession
        ship_package(spark)
        self._transfer_params_to_java()
        thresholds = self._thresholds(dataset)
        values = dataset.select(_array(self.getFeaturesCol()), F.col(self.getLabelCol()).cast("double"), F.spark_partition_id())
        tasks = slots(spark)
        base = values.mapInArrow(_blocks(thresholds), "block binary").rdd.map(lambda r: pickle.loads(r[0])) \
            .coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            how = (self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate(), self.getSeed())
            bins, total = [len(t) + 1 for t in thresholds], base.map(lambda b: b.n).sum()
            if total <= ALONE:
                grown, self._losses = base.coalesce(1).mapPartitions(partial(_alone, bins=bins, total=total, how=how)).collect()[0]
            else:
                grown, self._losses = grow(_Spread(base, bins, tasks, how), bins, total, how)
        finally:
            base.unpersist()
        return self._java_model(grown, thresholds)

    def _create_model(self, java_model):
        model = super()._create_model(java_model)
        model.loss_by_round = self._losses
        return model

    def _thresholds(self, dataset: DataFrame) -> list[np.ndarray]:
        """MLlib's own candidate splits of each feature, found as its boosting does."""
        jvm = dataset.sparkSession._jvm
        tree = jvm.org.apache.spark.mllib.tree
        two = getattr(jvm.scala, "Some")(2)
        rows = _object(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(self._java_obj, dataset._jdf, two)
        none = _object(jvm.scala.collection.immutable, "Map").empty()
        strategy = self._java_obj.getOldBoostingStrategy(none, tree.configuration.Algo.Classification()).treeStrategy().copy()
        strategy.setAlgo(tree.configuration.Algo.Regression())
        strategy.setImpurity(_object(tree.impurity, "Variance"))
        impl = jvm.org.apache.spark.ml.tree.impl
        about = _object(impl, "DecisionTreeMetadata").buildMetadata(rows, strategy, 1, self.getFeatureSubsetStrategy())
        return [np.array([s.threshold() for s in splits], float)
                for splits in _object(impl, "RandomForest").findSplits(rows, about, self.getSeed())]

    def _java_model(self, trees: list[dict], thresholds: list[np.ndarray]):
        from pyspark import SparkContext
        sc = SparkContext._active_spark_context
        jvm, gateway = sc._jvm, sc._gateway
        ml, calculator = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
        copy, parse = jvm.java.util.Arrays.copyOfRange, jvm.org.apache.spark.mllib.linalg.Vectors.parse
        kind = ml.regression.DecisionTreeRegressionModel
        models = gateway.new_array(kind, len(trees))
        for t, tree in enumerate(trees):
            order = sorted(tree)
            numbers = [float(x) for i in order for x in tree[i]["stats"]]
            stats = parse("[" + ",".join(map(repr, numbers)) + "]").toArray()
            made: dict = {}
            for i in reversed(order):
                node, k = tree[i], 3 * order.index(i)
                about = calculator(copy(stats, k, k + 3), int(node["stats"][0]))
                value, impurity = _value(node["stats"]), float(node["impurity"])
                if 2 * i in made and not _same_leaves(made[2 * i], made[2 * i + 1]):
                    f, b = node["split"]
                    made[i] = (None, ml.tree.InternalNode(
                        value, impurity, float(node["gain"]), made[2 * i][1], made[2 * i + 1][1],
                        ml.tree.ContinuousSplit(f, float(thresholds[f][b])), about))
                else:   # MLlib makes one leaf of two that say the same
                    if 2 * i in made:
                        value = made[2 * i][0]
                    made[i] = (value, ml.tree.LeafNode(value, impurity, about))
            models[t] = kind(made[1][1], len(thresholds))
        weights = gateway.new_array(jvm.double, len(trees))
        for t in range(len(trees)):
            weights[t] = 1.0 if t == 0 else float(self.getStepSize())
        model = ml.classification.GBTClassificationModel(self.uid, models, weights, len(thresholds), 2)
        return self._java_obj.copyValues(model, self._java_obj.extractParamMap()).setParent(self._java_obj)


def _object(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def _same_leaves(a: tuple, b: tuple) -> bool:
    return a[0] is not None and a[0] == b[0]


def _array(column: str):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(column)
