"""M2: random forest whose deep levels are grown where their rows are.

Spark's own trainer counts a dense table of (feature, bin, class) for every
open node in every task and adds them up by a shuffle.  Trees of depth 30 over
labels close to random have nearly as many nodes as rows, so these tables, not
the rows, are the work.  Here a row stands in one small table of bins and bag
counts, and a tree grows in two parts:

* nodes of more than ``held_rows`` rows are split as Spark does it, one pass a
  level over all rows: every task counts its rows, the counts are added up per
  node, and each node's best split is found where its counts meet;
* the rows of every node below go to one task, which grows the whole subtree
  level by level; a level sorts its rows by (node, bin), so it costs rows, not
  nodes times bins.

The rules are those of ``RandomForestClassifier``: candidate thresholds from a
sample of max(bins^2, 10,000) rows, a Poisson bag count per row and tree, a fresh
draw of features for every node, Gini gain, the first of equal splits, leaves
that are pure, without gain or at the greatest depth, and siblings of one
prediction merged.  The draws are other ones.

The model is a table of subtrees, saved as it is; its nodes are arrays (14 bytes
a node, for two classes) in each Python worker, through which whole batches of
rows go, not objects that every task unpacks.  Each worker holds them whole; the
driver does so while it sends them out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.common import workers_import
from grantlens.plans.materialize import release, written
from grantlens.session import ensure_parallelism

#: Rows of a subtree grown in one task, per MB of the estimator's ``maxMemoryInMB`` (about 256 bytes a row).
ROWS_PER_MB = 4096
#: Impurity up to which Spark takes a node as pure.
PURE = 2.220446049250313e-16
#: A subtree's nodes as arrays: feature (-1: a leaf), last bin on the left, left child (the right one is next to it; -1:
#: a leaf), counts of the classes, gain.
ARRAYS = {"feature": np.int8, "cut": np.uint8, "lo": np.int32, "counts": np.int64, "gain": np.float64}
SENT = [c for c in ARRAYS if c != "gain"]
SUBTREE = "tree int, grp long, n int, leaf boolean, prediction int, " + ", ".join(f"{c} binary" for c in ARRAYS)


def candidate_thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds of one feature: all midpoints, or those nearest to equal shares of the sample."""
    value, count = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(value) < 2:
        return np.zeros(0)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride = count.sum() / bins
    below = np.cumsum(count)
    out, target = [], stride
    for i in range(1, len(value)):  # the threshold before value i, if it is nearer to the target than the one after it
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Per column of ``counts`` (class, node)."""
    out = np.ones(counts.shape[1:])
    for c in counts:
        share = c / total
        out -= share * share
    return out


def gains(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Gain of splits whose left sides hold ``left`` of the nodes' class counts ``whole``; both sides hold rows."""
    right = whole - left
    n, a, b = whole.sum(axis=0), left.sum(axis=0), right.sum(axis=0)
    return gini(whole, n) - a / n * gini(left, a) - b / n * gini(right, b)


def drawn(rng, nodes: int, features: int, per_node: int) -> np.ndarray:
    """``per_node`` different features of each node, in the order of Spark's reservoir (the first of equal splits wins)."""
    out = np.tile(np.arange(per_node), (nodes, 1))
    for f in range(per_node, features):
        at = rng.integers(0, f + 1, nodes)
        row = np.flatnonzero(at < per_node)
        out[row, at[row]] = f
    return out


def best_splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, counts: np.ndarray, chosen: np.ndarray):
    """(gain, feature, bin, left class counts) of the best split of every node; the gain is -inf where there is none.

    ``x`` holds a row of bins per feature; ``counts`` and the left counts are (class, node).
    """
    classes, m = counts.shape
    best = np.full(m, -np.inf)
    feature, cut, left = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((classes, m))
    # One word per row: node, bin, class and bag count, so that sorting the words sorts the rows.
    tail = y.astype(np.int64) << 8 | w
    start = np.zeros(m + 1)
    np.cumsum(counts.sum(axis=0), out=start[1:])
    start_of = np.zeros((classes, m))
    np.cumsum(counts[:, :-1], axis=1, out=start_of[:, 1:])
    for j in range(chosen.shape[1]):
        f = chosen[:, j]
        word = np.sort((node << 8 | x[f[node], np.arange(len(node))]) << 16 | tail)
        place = word >> 16
        at = np.flatnonzero((place[1:] != place[:-1]) & (place[1:] >> 8 == place[:-1] >> 8))
        if not len(at):
            continue
        of, weight, label = place[at] >> 8, (word & 255).astype(np.float64), word >> 8 & 255
        sums = np.stack([np.cumsum(np.where(label == c, weight, 0.0))[at] - start_of[c, of] for c in range(classes)])
        gain = gains(sums, counts[:, of])
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        top = np.maximum.reduceat(gain, first)
        # The first of equal splits: its place is the least one that reaches the top.
        reaches = gain == np.repeat(top, np.diff(np.append(first, len(of))))
        take = np.minimum.reduceat(np.where(reaches, np.arange(len(of)), len(of)), first)
        better = top > best[of[first]]
        n, take = of[first][better], take[better]
        best[n], feature[n], cut[n], left[:, n] = gain[take], f[n], place[at[take]] & 255, sums[:, take]
    return best, feature, cut, left


class Grown:
    """Nodes of one subtree in the order of their making: the root first, children after their parents."""

    def __init__(self, counts: np.ndarray):
        self.counts = [counts]
        self.gain, self.feature, self.cut, self.lo, self.hi = [], [], [], [], []
        self.size = counts.shape[1]

    def close(self):
        self.counts = np.concatenate(self.counts, axis=1)
        n = self.size
        for name, kind, none in (("gain", float, -1.0), ("feature", np.int64, -1), ("cut", np.int64, -1), ("lo", np.int64, -1), ("hi", np.int64, -1)):
            whole = np.full(n, none, kind)
            for at, part in getattr(self, name):
                whole[at] = part
            setattr(self, name, whole)
        return self


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, per_node: int, rng) -> Grown:
    """The whole subtree over these rows, at most ``depth`` levels below its root."""
    counts = np.bincount(y, w, classes).reshape(classes, 1)
    out = Grown(counts)
    ids, node = np.zeros(1, np.int64), np.zeros(len(y), np.int64)
    if gini(counts, counts.sum(axis=0))[0] <= PURE:
        return out.close()
    for _ in range(depth):
        m = len(ids)
        chosen = drawn(rng, m, len(x), per_node)
        gain, feature, cut, left = best_splits(x, y, w, node, counts, chosen)
        split = gain > 0
        k = int(split.sum())
        if not k:
            break
        # Left and right child of the i-th split node: 2 i and 2 i + 1.
        child = np.stack([left[:, split], (counts - left)[:, split]], axis=2).reshape(classes, 2 * k)
        new = out.size + np.arange(2 * k)
        for name, part in (("gain", gain[split]), ("feature", feature[split]), ("cut", cut[split]), ("lo", new[::2]), ("hi", new[1::2])):
            getattr(out, name).append((ids[split], part))
        out.counts.append(child)
        out.size += 2 * k
        still = gini(child, child.sum(axis=0)) > PURE
        slot = np.cumsum(still) - 1
        number = np.cumsum(split) - 1
        row = np.flatnonzero(split[node])
        of = node[row]
        to = 2 * number[of] + (x[feature[of], row] > cut[of])
        stay = still[to]
        row, to = row[stay], to[stay]
        x, y, w, node = x[:, row], y[row], w[row], slot[to]
        ids, counts = new[still], child[:, still]
        if not len(ids):
            break
    return out.close()


def merged(lo: np.ndarray, hi: np.ndarray, prediction: np.ndarray) -> np.ndarray:
    """Which nodes are leaves once siblings of one prediction are merged upwards; children come after their parents."""
    leaf = lo < 0
    level = np.zeros(1, np.int64)
    levels = []
    while len(level):
        level = level[lo[level] >= 0]
        levels.append(level)
        level = np.concatenate((lo[level], hi[level]))
    for level in levels[::-1]:
        a, b = lo[level], hi[level]
        leaf[level] = leaf[a] & leaf[b] & (prediction[a] == prediction[b])
    return leaf


def subtree_row(tree: int, group: int, g: Grown) -> pa.Table:
    """The subtree's remaining nodes, numbered from 0 with children after their parents."""
    prediction = g.counts.argmax(axis=0)
    leaf = merged(g.lo, g.hi, prediction)
    keep = np.zeros(g.size, bool)
    level = np.zeros(1, np.int64)
    while len(level):
        keep[level] = True
        level = level[~leaf[level]]
        level = np.concatenate((g.lo[level], g.hi[level]))
    at = np.flatnonzero(keep)
    number = np.cumsum(keep) - 1
    inner = ~leaf[at]
    lo = np.where(inner, number[np.where(inner, g.lo[at], 0)], -1)
    return table_row(tree, group, bool(leaf[0]), int(prediction[0]), np.where(inner, g.feature[at], -1), np.where(inner, g.cut[at], 0), lo,
                     g.counts[:, at].T, np.where(inner, g.gain[at], -1.0))


def table_row(tree: int, group: int, leaf: bool, prediction: int, *arrays: np.ndarray) -> pa.Table:
    blobs = [pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary()) for a, kind in zip(arrays, ARRAYS.values())]
    fixed = [pa.array([tree], pa.int32()), pa.array([group], pa.int64()), pa.array([len(arrays[0])], pa.int32()), pa.array([leaf]), pa.array([prediction], pa.int32())]
    return pa.Table.from_arrays(fixed + blobs, ["tree", "grp", "n", "leaf", "prediction", *ARRAYS])


def unpacked(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` bytes."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    _, offsets, data = whole.buffers()
    off = np.frombuffer(offsets, np.int32)[whole.offset:whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].reshape(-1, width) if len(whole) else np.zeros((0, width), np.uint8)


def packed(rows: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """A binary value per row of bytes, or per run of ``sizes`` rows."""
    n = np.ones(len(rows), np.int64) if sizes is None else sizes
    off = np.concatenate(([0], np.cumsum(n * rows.shape[1]))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


class Top:
    """The upper nodes of one tree: those that are split in passes over all rows, and the roots of the subtrees."""

    def __init__(self):
        self.feature, self.cut, self.lo, self.hi = ([-1] for _ in range(4))
        self.gain, self.counts = [-1.0], [None]

    def arrays(self):
        return tuple(np.array(x, np.int64) for x in (self.feature, self.cut, self.lo, self.hi))

    def split(self, node: int, gain: float, feature: int, cut: int, left: np.ndarray) -> tuple[int, int]:
        a = len(self.lo)
        for counts in (left, self.counts[node] - left):
            for values, new in ((self.feature, -1), (self.cut, -1), (self.lo, -1), (self.hi, -1), (self.gain, -1.0), (self.counts, counts)):
                values.append(new)
        self.feature[node], self.cut[node], self.gain[node], self.lo[node], self.hi[node] = feature, cut, gain, a, a + 1
        return a, a + 1


def place(x: np.ndarray, top: tuple) -> np.ndarray:
    """The node of the top tree that each row (a row of bins) ends in."""
    feature, cut, lo, hi = top
    node = np.zeros(len(x), np.int64)
    row = np.arange(len(x)) if lo[0] >= 0 else np.zeros(0, np.int64)
    while len(row):
        at = node[row]
        node[row] = np.where(x[row, feature[at]] > cut[at], hi[at], lo[at])
        row = row[lo[node[row]] >= 0]
    return node


class ForestClassifier(RandomForestClassifier):
    """``RandomForestClassifier`` (bagged, unweighted, continuous features, at most 256 bins) with another growing."""

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        workers_import(spark)
        trees, bins, seed = self.getNumTrees(), self.getMaxBins(), self.getSeed()
        if bins > 256:
            raise ValueError("a bin is one byte: at most 256 bins")
        label = F.col(self.getLabelCol())
        data = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), label.cast("double").alias("y"))
        rows, low, high, bad, width = data.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), F.sum((F.col("y").isNull() | F.isnan("y") | (F.col("y") != F.floor("y"))).cast("long")),
                                               F.max(F.size("x"))).first()
        if not rows or bad or low < 0 or high > 255:
            raise ValueError(f"{rows} training rows, labels {low} to {high}, {bad or 0} without a class")
        classes, per_node = max(2, int(high) + 1), self._per_node(width)
        share = max(bins * bins, 10_000) / rows
        sample = (data if share >= 1 else data.sample(False, share, seed)).select("x").toArrow()["x"].combine_chunks()
        sample = np.asarray(sample.flatten() if not isinstance(sample, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in sample.chunks])).reshape(-1, width)
        thresholds = [candidate_thresholds(sample[:, f], bins) for f in range(width)]

        def binned(batches):
            from pyspark import TaskContext
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for b in batches:
                v = np.asarray(b.column(0).flatten(), np.float64).reshape(-1, width)
                x = binned_rows(v, thresholds)
                y = np.asarray(b.column(1)).astype(np.uint8)
                bag = np.minimum(rng.poisson(self_rate, (len(x), trees)), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([packed(np.concatenate((x, y[:, None], bag), axis=1))], ["row"])
        self_rate = self.getSubsamplingRate()
        table = written(ensure_parallelism(data).mapInArrow(binned, "row binary"), "forest-rows")
        tops, roots = _upper(table, self, width, classes, per_node, trees)
        parts = _lower(table, self, width, classes, per_node, tops, roots)
        nodes = written(_joined(parts, tops), "forest")
        release(table, parts)
        model = ForestModel(nodes, trees, classes, thresholds)
        return model._resetUid(self.uid)._set(**{c: self.getOrDefault(c) for c in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")})

    def _per_node(self, width: int) -> int:
        of = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "auto": math.ceil(math.sqrt(width)) if self.getNumTrees() > 1 else width}
        return of[self.getFeatureSubsetStrategy()]


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """``nodes`` holds the subtrees of every tree: where their root and the rest of their nodes stand in it (``root``, ``at``).

    ``grp`` -1 is the nodes above the subtrees, with their roots left open.
    """

    def __init__(self, nodes: DataFrame | None = None, trees: int = 0, classes: int = 2, thresholds=()):
        super().__init__()
        self.nodes, self.getNumTrees, self.numClasses = nodes, trees, classes
        self.thresholds, self.numFeatures = [np.asarray(t, np.float64) for t in thresholds], len(thresholds)
        self._shared = None

    def arrays(self) -> list[tuple]:
        """(feature, cut, lo, counts) of every tree."""
        rows = self.nodes.select("tree", "grp", "root", "at", "n", *SENT).orderBy("tree", "grp").toArrow()
        tree, root, at, n = (rows[c].to_numpy() for c in ("tree", "root", "at", "n"))
        out = [tuple(np.zeros((m, self.numClasses) if c == "counts" else m, ARRAYS[c]) for c in SENT)
               for m in np.maximum.reduceat(np.where(root < 0, n, at + n - 1), np.searchsorted(tree, np.arange(self.getNumTrees)))]
        for i in range(len(tree)):
            for c, whole in zip(SENT, out[tree[i]]):
                part = np.frombuffer(rows[c][i].as_buffer(), ARRAYS[c]).reshape(-1, *whole.shape[1:])
                if c == "lo" and root[i] >= 0:
                    part = np.where(part < 0, -1, part + at[i] - 1)
                if root[i] < 0:
                    whole[:len(part)] = part
                else:
                    whole[root[i]], whole[at[i]:at[i] + n[i] - 1] = part[0], part[1:]
        few = max(int(t[-1].max()) for t in out) < 1 << 31
        return [(*t[:-1], t[-1].astype(np.int32) if few else t[-1]) for t in out]

    @property
    def totalNumNodes(self) -> int:
        inner = F.when(F.col("grp") < 0, 0).otherwise(F.col("n"))
        return int(self.nodes.agg(F.sum(inner) + F.sum(F.when(F.col("grp") < 0, F.col("at")).otherwise(0))).first()[0])

    @property
    def featureImportances(self) -> DenseVector:
        """The gains of every tree by feature, weighted by rows, in shares of the tree; their mean."""
        of = np.zeros((self.getNumTrees, self.numFeatures))
        for r in self.nodes.select("tree", "feature", "counts", "gain").toArrow().to_pylist():
            feature, gain = np.frombuffer(r["feature"], np.int8), np.frombuffer(r["gain"], np.float64)
            weight = np.frombuffer(r["counts"], np.int64).reshape(-1, self.numClasses).sum(axis=1)
            inner = feature >= 0
            of[r["tree"]] += np.bincount(feature[inner], (gain * weight)[inner], self.numFeatures)
        whole = of.sum(axis=1, keepdims=True)
        total = np.divide(of, whole, out=np.zeros_like(of), where=whole > 0).sum(axis=0)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        workers_import(spark)
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast((self.thresholds, self.arrays()))
        shared, classes, width = self._shared, self.numClasses, self.numFeatures

        @F.arrow_udf("array<double>")
        def votes(x: pa.Array) -> pa.Array:
            thresholds, trees = shared.value
            v = binned_rows(np.asarray(x.flatten(), np.float64).reshape(-1, width), thresholds)
            out = np.zeros((len(v), classes))
            for tree in trees:
                counts = tree[-1][leaves(v, tree)].astype(np.float64)
                out += counts / counts.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(np.arange(0, out.size + 1, classes, dtype=np.int32), out.ravel())
        raw, share = F.col("__votes"), F.col("__share")
        total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
        out = dataset.withColumn("__votes", votes(vector_to_array(self.getFeaturesCol()))).withColumn("__share", F.transform(raw, lambda v: v / total))
        out = out.withColumn(self.getRawPredictionCol(), array_to_vector(raw)).withColumn(self.getProbabilityCol(), array_to_vector(share))
        return out.withColumn(self.getPredictionCol(), (F.array_position(share, F.array_max(share)) - 1).cast("double")).drop("__votes", "__share")

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"numTrees": m.getNumTrees, "numClasses": m.numClasses, "thresholds": [t.tolist() for t in m.thresholds]})
        m.nodes.write.parquet(f"{path}/data")


class ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(self.sparkSession.read.parquet(f"{path}/data"), meta["numTrees"], meta["numClasses"], meta["thresholds"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def binned_rows(v: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: the number of thresholds below it."""
    return np.stack([np.searchsorted(t, v[:, f]) for f, t in enumerate(thresholds)], axis=1).astype(np.uint8)


def leaves(x: np.ndarray, tree: tuple) -> np.ndarray:
    """The leaf of every row of bins."""
    feature, cut, lo, _ = tree
    node = np.zeros(len(x), np.int64)
    row = np.arange(len(x)) if lo[0] >= 0 else np.zeros(0, np.int64)
    while len(row):
        at = node[row]
        to = lo[at] + (x[row, feature[at]] > cut[at])
        node[row] = to
        row = row[lo[to] >= 0]
    return node


def _joined(parts: DataFrame, tops: list[Top]) -> DataFrame:
    """The subtrees with their places in their tree, and the nodes above them as one more."""
    spark = parts.sparkSession
    of = {(r["tree"], r["grp"]): r for r in parts.select("tree", "grp", "n", "leaf", "prediction").collect()}  # one row per subtree
    places, upper = [], []
    for t, top in enumerate(tops):
        feature, cut, lo, hi = top.arrays()
        leaf, prediction = lo < 0, np.zeros(len(lo), np.int64)
        for i in range(len(lo) - 1, -1, -1):  # children first
            if lo[i] < 0:
                leaf[i], prediction[i] = of[t, i]["leaf"], of[t, i]["prediction"]
            else:
                prediction[i] = np.argmax(top.counts[i])
                leaf[i] = leaf[lo[i]] and leaf[hi[i]] and prediction[lo[i]] == prediction[hi[i]]
        reached, level = [], [0]
        while level:
            reached += level
            level = [int(c) for i in level if lo[i] >= 0 and not leaf[i] for c in (lo[i], hi[i])]
        number, size = {i: k for k, i in enumerate(reached)}, len(reached)
        for i in reached:
            if lo[i] < 0:
                places.append((t, i, number[i], size))
                size += of[t, i]["n"] - 1
        inner = [lo[i] >= 0 and not leaf[i] for i in reached]
        if lo[0] >= 0:
            upper.append(table_row(t, -1, False, 0, *(np.array([x(i) if k else none for k, i in zip(inner, reached)]) for x, none in (
                (lambda i: feature[i], -1), (lambda i: cut[i], 0), (lambda i: number[lo[i]], -1))),
                np.array([top.counts[i] for i in reached]), np.array([top.gain[i] if k else -1.0 for k, i in zip(inner, reached)])))
            # What the nodes above the subtrees are without the subtrees' roots.
            places.append((t, -1, -1, sum(bool(lo[i] >= 0) for i in reached)))
    if upper:
        parts = parts.unionByName(spark.createDataFrame(pa.concat_tables(upper), SUBTREE))
    return parts.join(F.broadcast(spark.createDataFrame(places, "tree int, grp long, root int, at int")), ["tree", "grp"])  # one row per subtree


def _held_rows(est: ForestClassifier) -> int:
    return est.getMaxMemoryInMB() * ROWS_PER_MB


def _upper(table: DataFrame, est: ForestClassifier, width: int, classes: int, per_node: int, trees: int) -> tuple[list[Top], dict]:
    """Split the nodes of more rows than one task should hold; returns the top trees and the depth of each subtree's root."""
    tops, held, bins = [Top() for _ in range(trees)], _held_rows(est), est.getMaxBins()

    def sizes(batches):
        total = np.zeros((trees, classes))
        for b in batches:
            r = unpacked(b.column(0), width + 1 + trees)
            for c in range(classes):
                total[:, c] += r[r[:, width] == c, width + 1:].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees), classes)), pa.array(np.tile(np.arange(classes), trees)), pa.array(total.ravel())], ["t", "c", "n"])
    whole = np.zeros((trees, classes))
    for r in table.mapInArrow(sizes, "t long, c long, n double").groupBy("t", "c").agg(F.sum("n").alias("n")).collect():  # trees * classes rows
        whole[r["t"], r["c"]] = r["n"]
    roots, open_now = {}, []

    def sort_out(t, i, depth):
        c = tops[t].counts[i]
        if c.sum() > held and depth < est.getMaxDepth() and gini(c.reshape(-1, 1), c.sum().reshape(1))[0] > PURE:
            open_now.append((t, i, depth))
        else:
            roots[t, i] = depth
    for t in range(trees):
        tops[t].counts[0] = whole[t]
        sort_out(t, 0, 0)
    at_once = max(1, (est.getMaxMemoryInMB() << 20) // (per_node * bins * classes * 8))
    rng = np.random.default_rng([est.getSeed(), 1 << 20])
    while open_now:
        now, later = open_now[:at_once], open_now[at_once:]
        open_now = []
        chosen = drawn(rng, len(now), width, per_node)
        for k, gain, feature, cut, left in _pass(table, tops, now, chosen, width, classes, bins, trees):
            t, i, depth = now[k]
            if gain > 0:
                for child in tops[t].split(i, gain, feature, cut, left):
                    sort_out(t, child, depth + 1)
            else:  # a leaf, as Spark makes it: grown to depth 0
                roots[t, i] = est.getMaxDepth()
        open_now += later
    return tops, roots


def _pass(table: DataFrame, tops: list[Top], now: list[tuple], chosen: np.ndarray, width: int, classes: int, bins: int, trees: int):
    """(number in ``now``, gain, feature, bin, left class counts) of each node's best split, over all rows."""
    per_node = chosen.shape[1]
    shape = (per_node, bins, classes)
    cells = per_node * bins * classes
    arrays = {t: tops[t].arrays() for t in {t for t, _, _ in now}}
    number = {t: np.full(len(tops[t].lo), -1, np.int64) for t in arrays}
    for k, (t, i, _) in enumerate(now):
        number[t][i] = k

    def counted(batches):
        total = np.zeros((len(now), cells), np.int64)
        for b in batches:
            r = unpacked(b.column(0), width + 1 + trees)
            for t, top in arrays.items():
                row = np.flatnonzero(r[:, width + 1 + t])
                k = number[t][place(r[row, :width], top)]
                row, k = row[k >= 0], k[k >= 0]
                if not len(row):
                    continue
                few, of = np.unique(k, return_inverse=True)
                w, y = r[row, width + 1 + t].astype(np.float64), r[row, width].astype(np.int64)
                for j in range(per_node):
                    key = (of * bins + r[row, chosen[k, j]]) * classes + y
                    part = np.bincount(key, w, len(few) * bins * classes).reshape(len(few), -1)
                    total[few, j * bins * classes:(j + 1) * bins * classes] += part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), packed(total.view(np.uint8).reshape(len(now), -1))], ["k", "n"])

    def best(group):
        k = group["k"][0].as_py()
        n = np.frombuffer(unpacked(group["n"], cells * 8).tobytes(), np.int64).reshape(-1, cells).sum(axis=0).reshape(shape).astype(np.float64)
        found = (-math.inf, -1, -1, [0.0] * classes)
        for j in range(per_node):
            filled = np.flatnonzero(n[j].sum(axis=1))[:-1]  # a split behind the last filled bin leaves the right side empty
            if len(filled):
                left = np.cumsum(n[j], axis=0)[filled].T
                g = gains(left, n[j].sum(axis=0)[:, None])
                i = int(np.argmax(g))
                if g[i] > found[0]:
                    found = float(g[i]), int(chosen[k, j]), int(filled[i]), left[:, i].tolist()
        return pa.table({"k": [k], "gain": [found[0]], "feature": [found[1]], "cut": [found[2]], "left": pa.array([found[3]], pa.list_(pa.float64()))})
    out = table.mapInArrow(counted, "k long, n binary").groupBy("k").applyInArrow(best, "k long, gain double, feature long, cut long, left array<double>")
    return [(r["k"], r["gain"], r["feature"], r["cut"], np.array(r["left"])) for r in out.orderBy("k").collect()]  # one row per open node


def _lower(table: DataFrame, est: ForestClassifier, width: int, classes: int, per_node: int, tops: list[Top], roots: dict) -> DataFrame:
    """Grow every subtree in one task: (tree, grp) and its nodes, numbered from 0 within it."""
    trees, most, seed = len(tops), est.getMaxDepth(), est.getSeed()
    arrays = [top.arrays() for top in tops]

    def dealt(batches):
        for b in batches:
            r = unpacked(b.column(0), width + 1 + trees)
            for t, top in enumerate(arrays):
                row = np.flatnonzero(r[:, width + 1 + t])
                if not len(row):
                    continue
                node = place(r[row, :width], top)
                order = np.argsort(node, kind="stable")
                few, size = np.unique(node, return_counts=True)
                part = np.concatenate((r[row, :width + 1], r[row, width + 1 + t][:, None]), axis=1)[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), t, np.int32)), pa.array(few), packed(part, size)], ["tree", "grp", "rows"])

    def grown(key, group):
        t, i = (k.as_py() for k in key)
        r = unpacked(group["rows"], width + 2)
        # The order in which the parts arrive must not matter.
        r = r[np.lexsort(r.T[::-1])]
        x = np.ascontiguousarray(r[:, :width].T).astype(np.int64)
        g = grow(x, r[:, width].astype(np.int64), r[:, width + 1].astype(np.int64), classes, most - roots[t, i], per_node, np.random.default_rng([seed, t, i]))
        return subtree_row(t, i, g)
    spark = table.sparkSession
    parts = min(len(roots) * 2, 16 * spark.sparkContext.defaultParallelism)
    rows = table.mapInArrow(dealt, "tree int, grp long, rows binary").repartition(parts, "tree", "grp")
    return written(rows.groupBy("tree", "grp").applyInArrow(grown, SUBTREE), "forest-nodes")
