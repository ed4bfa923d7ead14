"""Deep random forests over many small nodes.

Spark's own forest counts (feature, bin, class) tables of every open node in every partition and shuffles them level by
level, though most nodes of a deep forest hold a handful of rows. Here that is done for large nodes only. Once a node
holds at most ``LOCAL_ROWS`` rows, its rows are brought together and one task grows what lies below it, so the work
follows rows times depth and a shuffle carries each drawn row of a tree once. Bootstrap, feature subsets, gains,
stopping rules and the merging of equal leaves follow Spark's classifier, and the result is its model; bounds of bins may differ in detail.

Spark's model keeps every node in the driver and in a broadcast. A forest of more than ``HELD_NODES`` nodes stays written:
``WrittenForest`` deals blocks of rows and a few trees at a time to tasks, adds up their votes, and holds no tree itself.
"""

import uuid

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from ..session import copy_folder, cut_lineage, delete_on_exit, release, shared_dir

LOCAL_ROWS = 50_000
SAMPLED = 10_000  # rows from which the bins are taken, as many as in Spark's forest
OPEN_NODES = 4_000  # tables of one pass
TABLE_MB = 1024  # tables of a level that are left to Spark's trainer
HELD_NODES = 100_000  # nodes of a forest that the driver may hold
CHUNK_MB = 16  # trees that vote in one task
GROUP_ROWS = 200_000  # rows that they vote on there
TOGETHER = 32  # small nodes whose tables are made in one step
NODES = ("tree int, node long, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
         "feature int, cut int")
TREES = "tree int, feature binary, cut binary, left binary, right binary, votes binary, nodes long, importances array<double>"
POISSON = np.cumsum([np.exp(-1)] + [np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(1, 17)])


def bin_bounds(rows: DataFrame, bins: int, seed: int) -> list:
    """Ascending thresholds per feature, fewer than ``bins``: between the distinct values if they are few, else of equal shares."""
    drawn = rows.orderBy(F.rand(seed)).limit(SAMPLED).select(vector_to_array("_features").alias("x")).toPandas()["x"]
    out = []
    for column in np.stack(drawn.to_numpy()).T:
        values, counts = np.unique(column, return_counts=True)
        middles = (values[:-1] + values[1:]) / 2
        if len(middles) >= bins:
            ends = np.cumsum(counts)[:-1]
            middles = np.unique(middles[np.minimum(np.searchsorted(ends, np.arange(1, bins) * len(column) / bins), len(ends) - 1)])
        out.append(middles)
    return out


def _draws(ids, tree: int, seed: int):
    """How often each row is drawn into a tree, Poisson with mean 1."""
    x = _mixed(ids.astype(np.uint64) + np.uint64((tree * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % 2**64))
    return np.searchsorted(POISSON, x / 2.0**64, side="right")


def _mixed(x):
    """64-bit digests of whole numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _route(codes, splits: dict):
    """The node of each row in a tree of ``{node: (feature, cut)}``. Children of node i are 2i and 2i + 1, the root is 1."""
    at, last = np.ones(len(codes), dtype=np.int64), None
    inner = np.array(sorted(splits), dtype=np.int64)
    while len(inner) and not np.array_equal(at, last):
        last, place = at, np.minimum(np.searchsorted(inner, at), len(inner) - 1)
        feature, cut = np.array([splits[n] for n in inner]).T
        right = codes[np.arange(len(codes)), feature[place]] > cut[place]
        at = np.where(inner[place] == at, 2 * at + right, at)
    return at


class Shape:
    """What fixes a forest besides its rows."""

    def __init__(self, features, classes, bins, trees, depth, min_leaf, seed):
        self.features, self.classes, self.bins, self.trees, self.depth, self.min_leaf, self.seed = features, classes, bins, trees, depth, min_leaf, seed
        self.tried = int(np.ceil(np.sqrt(features))) if trees > 1 else features

    def subset(self, tree, nodes):
        """The features tried at each node, one row a node."""
        salt = np.uint64((tree * 0xD6E8FEB86659FD93 + self.seed * 0xA0761D6478BD642F) % 2**64)
        draws = _mixed((np.asarray(nodes, dtype=np.uint64)[:, None] * np.uint64(self.features) + np.arange(self.features, dtype=np.uint64)) ^ salt)
        return np.sort(np.argsort(draws, axis=1)[:, :self.tried], axis=1)

    def tables(self, codes, place, label, weight, drawn, subsets):
        """Class weights and drawn rows by (node, tried feature, bin); ``place`` is the row's node as a row of ``subsets``."""
        k = len(subsets)
        tried = np.take_along_axis(codes, subsets[place], axis=1)
        at = (place[:, None] * self.tried + np.arange(self.tried)) * self.bins + tried
        spread = lambda x: np.repeat(x, self.tried)
        cells = np.bincount((at * self.classes + label[:, None]).ravel(), spread(weight), k * self.tried * self.bins * self.classes)
        rows = np.bincount(at.ravel(), spread(drawn), k * self.tried * self.bins)
        return cells.reshape(k, self.tried, self.bins, self.classes), rows.reshape(k, self.tried, self.bins)

    def ends(self, nodes, stats, n):
        """Nodes that cannot be split whatever their rows hold."""
        deep = np.array([int(x).bit_length() > self.depth for x in nodes])
        return deep | (_gini(stats) < 1e-12) | (n < 2 * self.min_leaf)

    def best(self, cells, rows, subsets, stats, n):
        """(gain, feature, cut) of each node; feature -1 where no split is allowed or gains."""
        left, left_n = cells.cumsum(2)[:, :, :-1], rows.cumsum(2)[:, :, :-1]
        right, weight = stats[:, None, None] - left, stats.sum(1)[:, None, None]
        left_w = left.sum(3)
        kept = lambda x, w: np.einsum("ktbc,ktbc->ktb", x, x) / np.where(w > 0, w, 1)
        gain = _gini(stats)[:, None, None] - 1 + (kept(left, left_w) + kept(right, weight - left_w)) / weight
        n = n[:, None, None]
        gain[(left_n < self.min_leaf - 0.5) | (n - left_n < self.min_leaf - 0.5)] = -1
        flat = gain.reshape(len(gain), -1)
        at = flat.argmax(1)
        gain = flat[np.arange(len(flat)), at]
        split = gain > 1e-12
        feature = subsets[np.arange(len(at)), at // (self.bins - 1)]
        return np.where(split, gain, -1.0), np.where(split, feature, -1), np.where(split, at % (self.bins - 1), -1)


def _gini(stats):
    total = stats.sum(-1, keepdims=True)
    return 1 - ((stats / np.where(total > 0, total, 1)) ** 2).sum(-1)


def _rows(tree, nodes, stats, n, gain, feature, cut):
    return pd.DataFrame({"tree": tree, "node": nodes, "prediction": stats.argmax(1).astype(float), "impurity": _gini(stats), "impurityStats": list(stats),
                         "rawCount": np.rint(n).astype(np.int64), "gain": gain, "feature": feature, "cut": cut})


def _grow(shape: Shape, tree: int, top: int, codes, label, weight, drawn):
    """The subtree below ``top`` over its rows, level by level."""
    nodes, place, mine = np.array([top]), np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while len(nodes):
        order = np.argsort(place, kind="stable")
        place, mine = place[order], mine[order]
        stats = np.bincount(place * shape.classes + label[mine], weight[mine], len(nodes) * shape.classes).reshape(-1, shape.classes)
        n = np.bincount(place, drawn[mine], len(nodes))
        gain, feature, cut = np.full(len(nodes), -1.0), np.full(len(nodes), -1), np.full(len(nodes), -1)
        tried = np.flatnonzero(~shape.ends(nodes, stats, n))
        starts = np.searchsorted(place, np.arange(len(nodes) + 1))
        for i in range(0, len(tried), TOGETHER):
            some = tried[i:i + TOGETHER]
            sizes = starts[some + 1] - starts[some]
            rows = mine[np.concatenate([np.arange(starts[x], starts[x + 1]) for x in some])]
            subsets = shape.subset(tree, nodes[some])
            cells, counts = shape.tables(codes[rows], np.repeat(np.arange(len(some)), sizes), label[rows], weight[rows], drawn[rows], subsets)
            gain[some], feature[some], cut[some] = shape.best(cells, counts, subsets, stats[some], n[some])
        yield _rows(tree, nodes, stats, n, gain, feature, cut)
        split = feature >= 0
        below = split[place]
        place, mine = place[below], mine[below]
        right = codes[mine, feature[place]] > cut[place]
        place = 2 * (np.cumsum(split) - 1)[place] + right
        nodes = (2 * nodes[split][:, None] + np.arange(2)).ravel()


def _codes(column, features):
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, features)


def _digits(column, bounds):
    """The bins of each row: as many as there are thresholds below its value."""
    x = np.stack(column.to_numpy()) if len(column) else np.empty((0, len(bounds)))
    return np.stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(bounds)], 1).astype(np.uint8)


def _binned(rows: DataFrame, bounds) -> DataFrame:
    """(id, label, weight, codes): each row with its bins as bytes."""
    def digitize(batches):
        for b in batches:
            yield b[["id", "label", "weight"]].assign(codes=[c.tobytes() for c in _digits(b["x"], bounds)])
    named = rows.select(F.monotonically_increasing_id().alias("id"), F.col("_label").cast("int").alias("label"), "weight", vector_to_array("_features").alias("x"))
    return cut_lineage(named.mapInPandas(digitize, "id long, label int, weight double, codes binary"))


def _count(rows: DataFrame, shape: Shape, splits, wanted) -> list:
    """The rows of the wanted (tree, node) pairs, from tables that are added up over the partitions."""
    by_tree = {}
    for t, n in wanted:
        by_tree.setdefault(t, []).append(n)

    def partial(batches):
        sums = {}
        for b in batches:
            codes, ids, label, weight = _codes(b["codes"], shape.features), b["id"].to_numpy(), b["label"].to_numpy(), b["weight"].to_numpy()
            for t, nodes in by_tree.items():
                drawn, at = _draws(ids, t, shape.seed), _route(codes, splits[t])
                for n in nodes:
                    mine = np.flatnonzero((at == n) & (drawn > 0))
                    if len(mine):
                        tables = shape.tables(codes[mine], np.zeros(len(mine), dtype=np.int64), label[mine], weight[mine] * drawn[mine], drawn[mine], shape.subset(t, [n]))
                        found = np.concatenate([x.ravel() for x in tables])
                        sums[t, n] = sums[t, n] + found if (t, n) in sums else found
        yield pd.DataFrame([(t, n, x.tobytes()) for (t, n), x in sums.items()], columns=["tree", "node", "tables"])

    def chosen(key, group):
        t, n = (int(k) for k in key)
        flat, per = sum(np.frombuffer(x) for x in group["tables"]), shape.tried * shape.bins
        cells, rows = flat[:-per].reshape(1, shape.tried, shape.bins, shape.classes), flat[-per:].reshape(1, shape.tried, shape.bins)
        stats, count, subsets = cells[:, 0].sum(1), rows[:, 0].sum(1), shape.subset(t, [n])
        split = [np.array([-1])] * 3 if shape.ends([n], stats, count)[0] else shape.best(cells, rows, subsets, stats, count)
        return _rows(t, [n], stats, count, *split)

    return rows.mapInPandas(partial, "tree int, node long, tables binary").groupBy("tree", "node").applyInPandas(chosen, NODES).collect()


def _below(rows: DataFrame, shape: Shape, splits, done) -> DataFrame:
    """All nodes from the small ones downwards, one task a subtree."""
    def dealt(batches):
        for b in batches:
            codes, ids = _codes(b["codes"], shape.features), b["id"].to_numpy()
            for t in range(shape.trees):
                drawn, at = _draws(ids, t, shape.seed), _route(codes, splits[t])
                mine = np.flatnonzero((drawn > 0) & ~np.isin(at, done[t]))
                some = b.iloc[mine]
                yield pd.DataFrame({"tree": t, "top": at[mine], "id": ids[mine], "label": some["label"], "weight": some["weight"] * drawn[mine], "drawn": drawn[mine], "codes": some["codes"]})

    def grown(key, group):
        t, group = int(key[0]), group.sort_values("id")
        codes, label, weight, drawn = _codes(group["codes"], shape.features), group["label"].to_numpy(), group["weight"].to_numpy(), group["drawn"].to_numpy()
        return pd.concat(_grow(shape, t, int(key[1]), codes, label, weight, drawn))

    spread = rows.mapInPandas(dealt, "tree int, top long, id long, label int, weight double, drawn long, codes binary")
    return spread.groupBy("tree", "top").applyInPandas(grown, NODES)


def _pruned(group):
    """The nodes of a tree in order, with their places from 0: (nodes, feature, kept, place, left, right). Sibling leaves of
    one class are merged; ``feature`` and ``left`` and ``right``, the places of the children, are -1 at leaves."""
    group = group.sort_values("node", ignore_index=True)
    node, feature, prediction = group["node"].to_numpy(), group["feature"].to_numpy().copy(), group["prediction"].to_numpy()
    kept = np.ones(len(group), dtype=bool)
    a = np.minimum(np.searchsorted(node, 2 * node), len(node) - 1)  # children stand side by side
    b = np.minimum(a + 1, len(node) - 1)
    for i in reversed(np.flatnonzero(feature >= 0)):
        if feature[a[i]] < 0 and feature[b[i]] < 0 and prediction[a[i]] == prediction[b[i]]:
            feature[i], kept[a[i]], kept[b[i]] = -1, False, False
    place = np.cumsum(kept) - 1
    return group, feature, kept, place, np.where(feature >= 0, place[a], -1), np.where(feature >= 0, place[b], -1)


def _numbered(nodes: DataFrame, bounds) -> DataFrame:
    """``treeID, nodeData`` as Spark saves a forest: nodes from 0 in each tree, sibling leaves of one class merged."""
    def tree(group):
        group, feature, kept, place, left, right = _pruned(group)
        cuts = [[float(bounds[f][c])] if f >= 0 else [] for f, c in zip(feature, group["cut"])]
        out = group[["tree", "prediction", "impurity", "impurityStats", "rawCount"]].assign(
            id=place, gain=np.where(feature >= 0, group["gain"], -1.0), left=left, right=right, feature=feature, cuts=cuts)
        return out[kept]
    flat = nodes.groupBy("tree").applyInPandas(tree, "tree int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
                                               "id int, gain double, left int, right int, feature int, cuts array<double>")
    split = F.struct(F.col("feature").alias("featureIndex"), F.col("cuts").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    return flat.select(F.col("tree").alias("treeID"), data.alias("nodeData"))


def _packed(nodes: DataFrame, features: int) -> DataFrame:
    """A row per tree: its pruned nodes as bytes (feature, cut, children; a leaf's left child is its row of ``votes``), the
    class shares of its leaves, how many nodes it has, and its feature importances, which add up to 1 if it splits."""
    def tree(group):
        group, feature, kept, _, left, right = _pruned(group)
        stats = np.stack(group["impurityStats"].to_numpy())
        gain = np.bincount(feature[feature >= 0], (group["gain"].to_numpy() * stats.sum(1))[feature >= 0], features)
        feature, left, right, cut, stats = feature[kept], left[kept], right[kept], group["cut"].to_numpy()[kept], stats[kept]
        leaf = feature < 0
        left = np.where(leaf, np.cumsum(leaf) - 1, left)
        total = stats[leaf].sum(1, keepdims=True)
        votes = stats[leaf] / np.where(total > 0, total, 1)
        flat = [x.astype(np.int32).tobytes() for x in (feature, cut, left, right)]
        return pd.DataFrame([(int(group["tree"].iloc[0]), *flat, votes.tobytes(), len(feature), gain / (gain.sum() or 1))],
                            columns=["tree", "feature", "cut", "left", "right", "votes", "nodes", "importances"])
    return nodes.groupBy("tree").applyInPandas(tree, TREES)


def _votes(codes, tree, classes: int):
    """The class shares of the leaf that each row falls into."""
    feature, cut, left, right = (np.frombuffer(tree[c], dtype=np.int32) for c in ("feature", "cut", "left", "right"))
    at, going = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while len(going := going[feature[at[going]] >= 0]):
        here = at[going]
        at[going] = np.where(codes[going, feature[here]] > cut[here], right[here], left[here])
    return np.frombuffer(tree["votes"]).reshape(-1, classes)[left[at]]


class WrittenForest(Model, MLWritable, MLReadable):
    """A forest that stays in its folder, which holds it as Spark saves one and, under ``packed``, tree by tree.

    It scores and weighs features like Spark's model of the same nodes; the votes are added up in parts of trees, so sums
    may differ from Spark's in the last digit. ``in_driver`` loads Spark's model for whoever has the memory."""

    def __init__(self, path: str, facts: dict):
        super().__init__()
        self.path, self.facts = path, facts

    def _trees(self) -> DataFrame:
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession().read.schema(TREES).parquet(f"{self.path}/packed")

    def in_driver(self) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(self.path)

    @property
    def totalNumNodes(self) -> int:
        return self.facts["nodes"]

    @property
    def featureImportances(self):
        rows = self._trees().select("tree", "importances").orderBy("tree").collect()
        total = np.sum([r.importances for r in rows], axis=0)
        return Vectors.dense(total / (total.sum() or 1))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, bounds, columns = self.facts["classes"], [np.array(b) for b in self.facts["bounds"]], self.facts["columns"]
        rows = cut_lineage(dataset.withColumn("_row", F.monotonically_increasing_id()))
        groups, parts = max(1, -(-rows.count() // GROUP_ROWS)), min(self.facts["trees"], max(1, int(self.facts["mb"] // CHUNK_MB) + 1))

        def block(batches):
            for b in batches:
                if len(b):
                    yield pd.DataFrame([(b["_row"].iloc[0], b["_row"].to_numpy().tobytes(), _digits(b["x"], bounds).tobytes())], columns=["block", "ids", "codes"])

        def vote(blocks, trees):
            trees = trees.sort_values("tree")
            out = []
            for b in blocks.itertuples():
                codes = np.frombuffer(b.codes, dtype=np.uint8).reshape(-1, len(bounds))
                total = np.zeros((len(codes), classes))
                for _, t in trees.iterrows():
                    total += _votes(codes, t, classes)
                out.append((b.block, b.part, b.ids, total.tobytes()))
            return pd.DataFrame(out, columns=["block", "part", "ids", "raw"])

        def total(group):
            group = group.sort_values("part")
            raw = sum(np.frombuffer(x).reshape(-1, classes) for x in group["raw"])
            return pd.DataFrame({"_row": np.frombuffer(group["ids"].iloc[0], dtype=np.int64), "raw": list(raw), "prediction": raw.argmax(1).astype(float)})

        blocks = rows.select("_row", vector_to_array(columns["features"]).alias("x")).mapInPandas(block, "block long, ids binary, codes binary")
        blocks = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        # neighbouring trees stand together, so that votes are added up in their order
        part = F.floor(F.col("tree") * parts / self.facts["trees"]).cast("int")
        trees = self._trees().drop("importances", "nodes").select("*", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
        voted = blocks.groupBy("group", "part").cogroup(trees.groupBy("group", "part")).applyInPandas(vote, "block long, part int, ids binary, raw binary")
        found = voted.groupBy("block").applyInPandas(total, "_row long, raw array<double>, prediction double")
        share = F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda s, y: s + y))
        found = found.select("_row", array_to_vector("raw").alias(columns["raw"]), array_to_vector(share).alias(columns["probability"]),
                             F.col("prediction").alias(columns["prediction"]))
        return rows.join(found, "_row").drop("_row")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, forest: WrittenForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.forest, path, self.sparkSession, extraMetadata={"facts": self.forest.facts})
        copy_folder(self.sparkSession, self.forest.path, f"{path}/forest")


class _ForestReader(MLReader):
    def load(self, path: str) -> WrittenForest:
        forest = WrittenForest(f"{path}/forest", (metadata := DefaultParamsReader.loadMetadata(path, self.sparkSession))["facts"])
        return forest._resetUid(metadata["uid"])


def table_mb(rows: DataFrame, estimator: RandomForestClassifier, classes: int) -> float:
    """Tables of the widest level that Spark's trainer may meet: at most a node per ``minInstancesPerNode`` rows."""
    get, features = estimator.getOrDefault, len((rows.select("_features").first() or [[]])[0])
    nodes = get("numTrees") * min(2.0 ** get("maxDepth"), rows.count() / get("minInstancesPerNode"))
    return nodes * np.ceil(np.sqrt(features)) * get("maxBins") * classes * 8 / 1e6


def fit(rows: DataFrame, estimator: RandomForestClassifier, classes: int):
    """Spark's own trainer while a level of its tables fits its memory, ``fit_forest`` for more."""
    small = table_mb(rows, estimator, classes) <= min(TABLE_MB, estimator.getMaxMemoryInMB())
    return estimator.fit(rows) if small else fit_forest(rows, estimator, classes)


def fit_forest(rows: DataFrame, estimator: RandomForestClassifier, classes: int):
    """What ``estimator.fit`` means, for rows ``(_features, _label, weight)``; its trees are drawn with other random numbers.
    A forest too large for the driver is a ``WrittenForest``."""
    spark, get = rows.sparkSession, estimator.getOrDefault
    bounds = bin_bounds(rows, get("maxBins"), get("seed"))
    shape = Shape(len(bounds), classes, get("maxBins"), get("numTrees"), get("maxDepth"), get("minInstancesPerNode"), get("seed"))
    binned = _binned(rows, bounds)
    splits, done, top = [{} for _ in range(shape.trees)], [[] for _ in range(shape.trees)], []
    open_ = [(t, 1) for t in range(shape.trees)] if binned.count() > LOCAL_ROWS else []
    while open_:
        found = [r for i in range(0, len(open_), OPEN_NODES) for r in _count(binned, shape, splits, open_[i:i + OPEN_NODES])]
        top += found
        large = {(r.tree, r.node): r.rawCount for r in found}
        open_ = []
        for r in found:
            if r.feature < 0:
                done[r.tree].append(r.node)
            else:
                splits[r.tree][r.node] = (r.feature, r.cut)
                # a child may hold all rows but a few, so both go on being counted until they are known to be small
                if large[r.tree, r.node] > LOCAL_ROWS:
                    open_ += [(r.tree, 2 * r.node), (r.tree, 2 * r.node + 1)]
    nodes = _below(binned, shape, splits, done)
    nodes = cut_lineage(nodes.unionByName(spark.createDataFrame(top, NODES)) if top else nodes)
    # the frame of a saved model with its parameters, from a few rows; then the nodes take the place of its own
    frame = estimator.copy({estimator.maxDepth: 0}).fit(rows.limit(100))
    frame._set(maxDepth=shape.depth)
    path = f"{shared_dir(spark)}/forests/{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    frame.write().overwrite().save(path)
    _numbered(nodes, bounds).write.mode("overwrite").parquet(f"{path}/data")
    if nodes.count() <= HELD_NODES:
        model = RandomForestClassificationModel.load(path)
    else:
        _packed(nodes, shape.features).write.parquet(f"{path}/packed")
        size = spark.read.parquet(f"{path}/packed").agg(F.sum("nodes"), F.sum(F.length("votes") + 4 * F.length("cut"))).first()
        columns = {k: get(f"{c}Col") for k, c in (("features", "features"), ("raw", "rawPrediction"), ("probability", "probability"), ("prediction", "prediction"))}
        model = WrittenForest(path, {"classes": classes, "bounds": [[float(x) for x in b] for b in bounds], "columns": columns, "trees": shape.trees, "nodes": size[0], "mb": size[1] / 1e6})
    release(binned, nodes)
    return model
