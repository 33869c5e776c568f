"""Classifiers per node: folds, tuning, refit, scoring, sweeps."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from ..sources.registry import load_model, save_model
from ..sources.sinks import append_report
from .boosting import fit_stumps, voting_model
from .cluster import first_best
from .metrics import balanced_accuracy, pair_counts
from .network import NetworkModel, fit_networks
from .probabilities import softmax
from .profile import large_classes, null_gate
from .quantiles import union_all
from .sampling import (
    ordered_folds, oversample_smallest, stratified_folds, stratified_split, weights_of_sizes,
    with_class_weight)
from .storage import bounded_rows, settle
from .trees import KINDS as TREE_KINDS, TreeModel, fit_trees, score_nodes

MAX_CLASSES = 10_000
# Kinds whose models of all nodes, folds and values are fitted in the same passes.
TOGETHER = (*TREE_KINDS, "network")


def fit_together(rows, kind, target, features, grid, classes, **options):
    """{node: (model, mean scores of the grid)} of all nodes at once."""
    if kind == "network":
        return fit_networks(rows, target, features, grid, classes, **options)
    if min(int(v) for v in grid) < 1:
        raise ValueError(f"depths {list(grid)}: a tree has one level at least")
    return fit_trees(rows, kind, target, features, grid, classes, **options)


def depth_grid(n_features, step):
    """Depths 1, 1+step, ... below the number of features."""
    return list(range(1, n_features, step))


def default_grid(kind, n_features, max_depth=None):
    """Values tried for the one tuned parameter of a kind; depths up to ``max_depth`` if it is given."""
    if kind in TREE_KINDS:
        depths = depth_grid(n_features, 10 if kind == "boosted" else 2)
        return [d for d in depths if max_depth is None or d <= max_depth]
    if kind == "stumps":
        return list(range(1, 201, 20))
    if kind == "network":
        return [0.1, 0.01, 0.001, 0.0001]
    return [0.0]


def class_names(df, target, limit=MAX_CLASSES):
    """Sorted classes of a node; more than ``limit`` of them stop the job."""
    rows = bounded_rows(df.where(F.col(target).isNotNull()).select(target).distinct(), limit, "classes")
    return sorted(r[0] for r in rows)


def gated(df, features, key="id"):
    """(rows with every feature, rejects): rejects are (key, reason)."""
    whole, broken = null_gate(df, list(features))
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in features]))
    reason = F.concat(F.lit("null in "), F.array_join(names, ", "))
    return whole, broken.select(key, reason.alias("reason"))


def front(target, features, classes):
    """Label numbering (names are known, so no pass over the data) and assembly."""
    numbering = StringIndexerModel.from_labels(list(classes), inputCol=target, outputCol="label_index")
    return Pipeline(stages=[numbering, VectorAssembler(inputCols=list(features), outputCol="features")])


def learner(value, iterations=None):
    """The linear estimator of Spark ML with its penalty."""
    return LogisticRegression(regParam=float(value), weightCol="weight", family="multinomial",
                              maxIter=iterations or 50, featuresCol="features", labelCol="label_index")


class NodeModel:
    """A fitted pipeline together with its class names in alphabetical order."""

    def __init__(self, pipeline, classes, kind):
        self.pipeline, self.classes, self.kind = pipeline, list(classes), kind

    @property
    def features(self):
        """Names of the columns that a row needs to be scored."""
        return self.pipeline.stages[1].getInputCols()

    def transform(self, df):
        """Add ``classes``, ``p`` (probabilities in class order) and ``predicted``."""
        kept = [c for c in df.columns if c not in ("classes", "p", "predicted")]
        # The first stage only numbers the labels of training rows.
        out = PipelineModel(self.pipeline.stages[1:]).transform(df)
        types = {f.name: f.dataType for f in out.schema.fields}
        if "probability" in types:
            p = F.col("probability")
            p = vector_to_array(p) if isinstance(types["probability"], VectorUDT) else p
        else:
            p = softmax(vector_to_array("rawPrediction"))
        names = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn("p", p)
        return out.select(*kept, names.alias("classes"), "p",
                          F.get(names, F.col("prediction").cast("int")).alias("predicted"))

    def save(self, spark, root, node, level=""):
        return save_model(spark, self.pipeline, root, node, self.kind, level)

    @classmethod
    def load(cls, spark, root, node, kind, level=""):
        """The saved model of a node: rows of trees or of a network, else a pipeline."""
        if kind == "network":
            return NetworkModel.load(spark, root, node, level)
        if kind in TREE_KINDS:
            return TreeModel.load(spark, root, node, kind, level)
        pipeline = load_model(spark, root, node, kind, level)
        return cls(pipeline, pipeline.stages[0].labels, kind)


def training_sets(cut, target, k):
    """The balanced training rows of each fold, as filters on one written table.

    Class weights of all folds come from one count per (fold, class).
    """
    rest = [cut.where(F.col("fold") != f).drop("fold") for f in range(k)]
    counts = settle(cut.groupBy("fold", target).agg(F.count(F.lit(1)).alias("n")), "fold-sizes")
    sets = []
    for f, rows in enumerate(rest):
        sizes = counts.where(F.col("fold") != f).groupBy(target).agg(F.sum("n").alias("n"))
        weights = weights_of_sizes(sizes, target).select(target, "weight")
        sets.append(rows.join(settle(weights, "weights"), target))
    return sets


def fit_node(df, kind, target, features, value, key="id", classes=None, seed=0, balance=True, **options):
    """Fit one model of a kind with one parameter value."""
    classes = classes or class_names(df, target)
    if kind in TOGETHER:
        rows = df.where(F.col(target).isNotNull()).withColumn("_node", F.lit(""))
        return fit_together(rows, kind, target, features, [value], {"": classes}, key=key, seed=seed, balance=balance,
                            **options)[""][0]
    if kind not in ("stumps", "linear"):
        raise ValueError(f"unknown kind {kind}")
    if balance:
        df = with_class_weight(df, target)
    before = front(target, features, classes).fit(df)
    if kind == "stumps":
        fitted = fit_stumps(before.transform(df), int(value), len(classes), list(features), "weight", **options)
        tail = voting_model(fitted, len(classes)).stages
        return NodeModel(PipelineModel(before.stages + tail), classes, kind)
    model = learner(value, **options).fit(before.transform(df))
    return NodeModel(PipelineModel(before.stages + [model]), classes, kind)


def node_score(model, df, target):
    """Balanced accuracy of a model on labelled rows."""
    row = balanced_accuracy(pair_counts(model.transform(df), target, "predicted")).first()
    return float(row["accuracy"]) if row["accuracy"] is not None else 0.0


def tune(df, kind, target, features, grid=None, key="id", k=5, seed=0, stratified=True,
         oversample_first=False, parallelism=4, max_depth=None, max_classes=MAX_CLASSES, **options):
    """Mean balanced accuracy per parameter value over k folds, then a refit.

    Folds are cut once and written; balancing happens inside the training folds
    (``oversample_first`` repeats rows before cutting, which leaks copies). Trees
    and networks of all folds and values are fitted in the same passes; other fits
    are independent Spark jobs run a few at a time. Returns (model, scores,
    rejects) with the first best value fitted on all rows. Rows with a null
    feature or without a label are not trained on; ``rejects`` (key, reason)
    holds them. Without a ``grid`` depths go up to ``max_depth``, which the
    scores name, or to the number of features.
    """
    spark = df.sparkSession
    grid = list(grid or default_grid(kind, len(features), max_depth))
    labelled = df.where(F.col(target).isNotNull()).select(key, target, *features)
    unlabelled = df.where(F.col(target).isNull()).select(key, F.lit("no label").alias("reason"))
    rows, rejects = gated(labelled, features, key)
    rejects = rejects.unionByName(unlabelled)
    if oversample_first:
        rows = oversample_smallest(rows, target, key).withColumn(
            key, F.concat_ws("#", F.col(key), F.col("copy"))).drop("copy")
    cut = stratified_folds(rows, target, key, k, seed) if stratified else ordered_folds(rows, [key], k)
    cut = settle(cut, "folds")
    classes = class_names(cut, target, max_classes)
    if kind in TOGETHER:
        final, means = fit_together(cut.withColumn("_node", F.lit("")), kind, target, features, grid, {"": classes},
                                 key=key, k=k, seed=seed, **options)[""]
        return final, score_table(spark, kind, grid, means, max_depth), rejects
    train = training_sets(cut, target, k)
    check = [cut.where(F.col("fold") == f).drop("fold") for f in range(k)]

    def one(task):
        value, f = task
        if kind == "stumps":
            before = front(target, features, classes).fit(train[f])
            fitted = fit_stumps(before.transform(train[f]), max(grid), len(classes), list(features),
                                "weight", **options)
            models = [(v, NodeModel(PipelineModel(
                before.stages + voting_model(fitted, len(classes), v).stages), classes, kind))
                for v in grid]
        else:
            models = [(value, fit_node(train[f], kind, target, features, value, key, classes,
                                       seed, balance=False, **options))]
        return [(float(v), f, node_score(m, check[f], target)) for v, m in models]

    tasks = [(None, f) for f in range(k)] if kind == "stumps" else \
        [(v, f) for v in grid for f in range(k)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        folds = [row for part in pool.map(one, tasks) for row in part]
    means = [sum(s for x, _, s in folds if x == float(v)) / k for v in grid]
    scores = score_table(spark, kind, grid, means, max_depth)
    best = first_best(scores, "mean_score", "value", grid).first()["value"]
    best = next(v for v in grid if float(v) == best)
    final = fit_node(cut.drop("fold"), kind, target, features, best, key, classes, seed, **options)
    return final, scores, rejects


def score_table(spark, kind, grid, means, max_depth=None):
    """(kind, value, mean_score, max_depth): one row for each value tried."""
    return spark.createDataFrame([(kind, float(v), float(m), max_depth) for v, m in zip(grid, means)],
                                 "kind string, value double, mean_score double, max_depth int")


def node_table(df, levels, min_size=5, limit=40000, counted="common_name",
               accuracy="public_positional_accuracy"):
    """(level, parent, target, classes): parents with two child classes or more.

    One aggregation over all levels. A class counts when enough well-located
    rows carry it; a parent must come from rows that name every level above.
    """
    entries, unbroken = [], F.lit(True)
    for upper, lower in zip(levels, levels[1:]):
        unbroken = unbroken & F.col(upper).isNotNull()
        good = F.col(lower).isNotNull() & (F.col(accuracy) <= limit) & F.col(counted).isNotNull()
        entries.append(F.when(F.col(upper).isNotNull(), F.struct(
            F.lit(upper).alias("level"), F.lit(lower).alias("target"),
            F.col(upper).alias("parent"), F.col(lower).alias("child"),
            F.coalesce(good, F.lit(False)).cast("int").alias("good"),
            unbroken.alias("named"))))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    children = rows.groupBy("level", "target", "parent", "child").agg(
        F.sum("good").alias("n"), F.bool_or("named").alias("named"))
    nodes = children.groupBy("level", "target", "parent").agg(
        F.count_if((F.col("n") >= min_size) & F.col("child").isNotNull()).alias("classes"),
        F.bool_or("named").alias("named"))
    return nodes.where("named AND classes >= 2").select("level", "parent", "target", "classes")


def node_rows(df, level, parent, target, min_size=5, limit=40000, counted="common_name",
              accuracy="public_positional_accuracy"):
    """Rows one node is trained on."""
    if level is not None:
        df = df.where(F.col(level) == parent)
    df = df.na.drop(subset=[target, accuracy]).where(F.col(accuracy) <= limit)
    return large_classes(df, target, min_size, counted)


def level_rows(df, level, parent_level, key, target, holdout, min_size=5, limit=40000,
               counted="common_name", accuracy="public_positional_accuracy"):
    """Rows of all nodes of a level with their holdout mark, written by node.

    The same rows as ``node_rows`` gives node by node: classes are counted, and
    the holdout is cut, per (parent, class) in one pass over the level.
    """
    parent = F.lit("base") if parent_level is None else F.col(parent_level).cast("string")
    rows = df.withColumn("_node", parent).where(F.col("_node").isNotNull())
    rows = rows.na.drop(subset=[target, accuracy]).where(F.col(accuracy) <= limit)
    rows = rows.withColumn("_stratum", F.to_json(F.struct("_node", F.col(target).alias("_class"))))
    rows = large_classes(rows, "_stratum", min_size, counted)
    split = stratified_split(settle(rows, "level"), "_stratum", key, holdout).drop("_stratum")
    return settle(split, "level-split", partition_by=["_node"])


def _level_together(split, kind, target, features, key, k, grid, classes, tags, seed=0, max_depth=None, **options):
    """Models, scores, holdout predictions and rejects of one such kind for all nodes of a level at once."""
    spark = split.sparkSession
    grid = list(grid or default_grid(kind, len(features), max_depth))
    split = split.withColumn("node", F.col("_node").cast("string"))
    rows, broken = gated(split.where("not is_holdout"), features, "_reject")
    cut = rows.withColumn("_stratum", F.to_json(F.struct("_node", F.col(target).alias("_class"))))
    cut = settle(stratified_folds(cut, "_stratum", key, k, seed), "folds")
    fitted = fit_together(cut, kind, target, features, grid, classes, key=key, k=k, seed=seed, **options)
    models = {n: m for n, (m, _) in fitted.items()}
    scores = {n: score_table(spark, kind, grid, means, max_depth) for n, (_, means) in fitted.items()}
    whole, unscored = gated(split.where("is_holdout"), features, "_reject")
    scored = score_nodes(whole.where(F.col("node").isin(*models)), models, F.col("node")).select(
        *tags, key, F.col(target).alias("true_label"), F.col("predicted").alias("prediction"))
    lost = broken.unionByName(unscored).select("_reject.node", *tags[1:], f"_reject.{key}", "reason")
    return models, scores, settle(scored, "predictions"), lost


def sweep(df, levels, features, kinds, key="id", grids=None, k=5, holdout=0.2, parallelism=2,
          root_target=None, save_to=None, **options):
    """One model per (node, kind) and the holdout predictions of all of them.

    Returns (models, predictions, rejects). ``models`` maps (target level, node,
    kind) to a model; predictions is one long table (node, kind, level, id,
    true_label, prediction), ready for grouped reports; rejects (node, kind,
    level, id, reason) holds the rows of each node, of training or holdout, that
    have a null feature. ``root_target`` adds the model above the first level.
    Each level is read and cut once. Trees and networks are trained for all nodes of a
    level together, so the number of jobs does not grow with the nodes; for
    other kinds a node reads only its own files.
    """
    df = settle(df, "sweep")
    table = settle(node_table(df, levels), "nodes") if len(levels) > 1 else None
    steps = [(None, root_target)] if root_target else []
    steps += list(zip(levels, levels[1:]))
    models, predictions, rejects = {}, [], []
    max_classes = options.pop("max_classes", MAX_CLASSES)

    def keep(name, model, scores):
        models[name] = model
        if save_to:  # one writer only: two appends to a folder disturb each other
            model.save(df.sparkSession, save_to, name[1], name[0])
            append_report(scores.coalesce(1), f"{save_to}/scores", node=name[1], level=name[0])

    def one(task):
        split, parent, target, kind = task
        rows = split.where(F.col("_node") == parent).drop("_node")
        tags = [F.lit(parent).alias("node"), F.lit(kind).alias("kind"), F.lit(target).alias("level")]
        grid = (grids or {}).get(kind)
        model, scores, broken = tune(rows.where("not is_holdout"), kind, target, features, grid, key, k,
                                     max_classes=max_classes, **options)
        whole, unscored = gated(rows.where("is_holdout"), features, key)
        scored = model.transform(whole).select(
            *tags, key, F.col(target).alias("true_label"), F.col("predicted").alias("prediction"))
        broken = broken.unionByName(unscored).select(*tags, key, "reason")
        return (target, parent, kind), model, scores, settle(scored, "predictions"), broken

    for level, target in steps:
        split = level_rows(df, target, level, key, target, holdout)
        if level is None:
            nodes = ["base"]
        else:
            here = table.where((F.col("level") == level) & (F.col("target") == target)).orderBy("parent")
            nodes = [str(r["parent"]) for r in here.toLocalIterator()]  # one model is kept for each
        together = [kind for kind in kinds if kind in TOGETHER]
        classes = node_classes(split.where("not is_holdout"), target, max_classes, nodes) if together else {}
        for kind in together if classes else []:
            tags = [F.col("node"), F.lit(kind).alias("kind"), F.lit(target).alias("level")]
            own = split.where(F.col("_node").isin(*classes)).withColumn("_reject", F.struct(F.col("_node").cast("string").alias("node"), key))
            found, scores, scored, broken = _level_together(own, kind, target, features, key, k, (grids or {}).get(kind),
                                                            classes, tags, **options)
            predictions.append(scored)
            rejects.append(broken)
            for node in nodes:
                if node in found:
                    keep((target, node, kind), found[node], scores[node])
        tasks = [(split, node, target, kind) for node in nodes for kind in kinds if kind not in TOGETHER]
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for name, model, scores, scored, broken in pool.map(one, tasks):
                keep(name, model, scores)
                predictions.append(scored)
                rejects.append(broken)
    return models, union_all(predictions), union_all(rejects)


def node_classes(rows, target, limit, nodes):
    """{node: sorted classes} of the given nodes; a node with more than ``limit`` classes stops the job."""
    pairs = rows.where(F.col(target).isNotNull() & F.col("_node").isin(*nodes)).select(
        F.col("_node").cast("string").alias("n"), F.col(target).alias("c")).distinct()
    found = {}
    for r in pairs.collect():  # a name for each class of each model
        found.setdefault(r["n"], []).append(r["c"])
        if len(found[r["n"]]) > limit:
            raise ValueError(f"more than {limit} classes; this step needs a bounded list")
    return {n: sorted(c) for n, c in found.items()}
