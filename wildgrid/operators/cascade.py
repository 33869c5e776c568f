"""Level-by-level decisions over whole tables.

All observations go down one level per step instead of one observation going
down all levels. With given probabilities every observation's decisions are
gathered once, one entry per node of the hierarchy, and the descent is a chain
of expressions. With models each level is one round of scoring.
"""

from pyspark.sql import Window, functions as F

from ..functions import vectors
from ..schemas import LEVEL_WEIGHTS
from .probabilities import level_weight
from .profile import null_gate
from .quantiles import union_all
from .storage import settle

ROOT = "base"


def hierarchy_edges(df, levels):
    """(level, parent, child, ordinal) from the labels in the data.

    Children are numbered alphabetically. Only distinct label pairs are sorted.
    """
    entries, upper = [], F.lit(ROOT)
    for level in levels:
        lower = F.col(level).cast("string")
        entries.append(F.when(upper.isNotNull() & lower.isNotNull(), F.struct(
            F.lit(level).alias("level"), upper.alias("parent"), lower.alias("child"))))
        upper = lower
    pairs = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*").distinct()
    order = Window.partitionBy("level", "parent").orderBy("child")
    return pairs.withColumn("ordinal", F.row_number().over(order) - 1)


def node_children(edges):
    """(level, parent, children): the ordered child names of each node."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "child")))
    return edges.groupBy("level", "parent").agg(
        F.transform(ordered, lambda e: e["child"]).alias("children"))


def source_vectors(probabilities, key="id"):
    """Long probabilities (id, source, suffix, level, node, class, ordinal, p) ->
    one row per (id, level, node) with classes, meta and image vectors.

    The image vector is the mean over the sub-images. Rows are brought together
    by id once; the groupings here and in ``descend`` need no further shuffle.
    """
    means = probabilities.repartition(key).groupBy(key, "level", "node", "ordinal", "class").agg(
        F.avg(F.when(F.col("source") == "meta", F.col("p"))).alias("m"),
        F.avg(F.when(F.col("source") == "image", F.col("p"))).alias("i"))
    cells = F.array_sort(F.collect_list(F.struct("ordinal", "class", "m", "i")))
    return means.groupBy(key, "level", "node").agg(cells.alias("_v")).select(
        key, "level", "node", F.col("_v.class").alias("classes"), F.col("_v.m").alias("meta"),
        vectors.normalise("_v.i").alias("image"))


def node_decisions(scores, weights=LEVEL_WEIGHTS):
    """Three decisions per (id, level, node); vectors with nulls decide nothing."""
    usable = F.lit(True)
    for source in ("meta", "image"):
        usable = usable & F.forall(source, lambda x: x.isNotNull() & ~F.isnan(x))
    joint = vectors.blend("meta", "image", level_weight("level", weights))
    return scores.where(usable).withColumn("_j", joint).select(
        *[c for c in scores.columns if c not in ("meta", "image", "classes")],
        vectors.pick("classes", "_j").alias("joint_prediction"),
        vectors.pick("classes", "image").alias("image_prediction"),
        vectors.pick("classes", "meta").alias("meta_prediction"))


def descend(decisions, truth, edges, levels, key="id", stop_on_miss=True):
    """Rows (id, taxonomic_level, joint/image/meta prediction, true_label).

    A node with one child passes it on without a row. An observation stops at a
    leaf, without a decision, without a true label, or (``stop_on_miss``) after
    a wrong joint decision. ``truth`` has one column per level.
    """
    children = settle(node_children(edges), "children")
    picks = F.struct("joint_prediction", "image_prediction", "meta_prediction")
    gathered = decisions.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("|", "level", "node"), picks))).alias("_d"))
    state = truth.select(key, *[F.col(c).cast("string").alias(c) for c in levels]) \
                 .join(gathered, key, "left").withColumn("_at", F.lit(ROOT))
    emitted = []
    for number, level in enumerate(levels):
        here = children.where(F.col("level") == level).select(
            F.col("parent").alias("_at"), F.col("children").alias("_c"))
        if number == 0:
            # Everything starts at the root: one value instead of a join.
            root = here.where(F.col("_at") == ROOT).select("_c")
            state = state.withColumn("_c", root.scalar())
        else:
            state = state.join(here, "_at", "left")
        made = F.try_element_at("_d", F.concat_ws("|", F.lit(level), F.col("_at")))
        state = state.withColumn("_m", F.when(F.size("_c") >= 2, made))
        chosen = F.col("_m.joint_prediction")
        row = F.when(chosen.isNotNull() & F.col(level).isNotNull(), F.struct(
            F.lit(level).alias("taxonomic_level"), chosen.alias("joint_prediction"),
            F.col("_m.image_prediction").alias("image_prediction"),
            F.col("_m.meta_prediction").alias("meta_prediction"),
            F.col(level).alias("true_label")))
        onward = F.col(level).isNotNull()
        if stop_on_miss:
            onward = onward & (chosen == F.col(level))
        following = F.when(F.size("_c") == 1, F.get("_c", F.lit(0))).when(onward, chosen)
        state = state.withColumn(f"_row{number}", row).withColumn("_at", following).drop("_c", "_m")
        emitted.append(f"_row{number}")
    rows = F.explode(F.array_compact(F.array(*emitted))).alias("r")
    return state.select(key, rows).select(key, "r.*")


def cascade(probabilities, truth, edges, levels, weights=LEVEL_WEIGHTS, key="id", stop_on_miss=True):
    """Cascade over a table of class probabilities."""
    return descend(node_decisions(source_vectors(probabilities, key), weights), truth, edges,
                   levels, key, stop_on_miss)


def _at_level(models, level, node):
    """The model of a node, named by (level, node) or by the node alone."""
    return models.get((level, node), models.get(node))


def _pairs(meta_models, image_models, level, nodes):
    """(node, meta, image) for nodes whose two models have the same classes."""
    for node in nodes:
        meta, image = _at_level(meta_models, level, node), _at_level(image_models, level, node)
        if meta and image and sorted(meta.classes) == sorted(image.classes):
            yield node, meta, image


def cascade_with_models(df, edges, levels, meta_models, image_models, weights=LEVEL_WEIGHTS,
                        key="id", labelled=True, stop_on_miss=True):
    """Cascade that scores with fitted models, one round per level.

    ``meta_models`` and ``image_models`` map a node, or (level, node), to a
    NodeModel. Returns (results, unresolved): every observation that leaves the
    cascade without a decision at its node is in ``unresolved`` (key, level,
    node, reason): null feature, no model, no label, or no node with a choice.
    Without labels every other observation goes on to a leaf.

    Between levels only (row, node) is carried. The rows of a level are written
    once, by node, and each model reads the files of its own node.
    """
    children = settle(node_children(edges), "children")
    rows = settle(df.withColumn("_row", F.monotonically_increasing_id()), "observations")
    state = rows.select("_row", F.lit(ROOT).alias("_at"), F.lit(False).alias("_seen"))
    named = {n[1] if isinstance(n, tuple) else n for n in {*meta_models, *image_models}}
    results, unresolved = [], []

    def lost(some, level, reason):
        unresolved.append(some.select(key, F.lit(level).alias("level"), F.col("_at").alias("node"),
                                      F.lit(reason).alias("reason")))

    for number, level in enumerate(levels):
        here = children.where(F.col("level") == level).select(
            F.col("parent").alias("_at"), F.col("children").alias("_c"))
        if number == 0:
            # Everything starts at the root: one value instead of a join on one key.
            root = here.where(F.col("_at") == ROOT).select("_c")
            placed = state.withColumn("_c", root.scalar())
        else:
            placed = state.join(here, "_at", "left")
        placed = settle(placed, "places")
        ended = placed.where("_c is null and not _seen")
        lost(rows.join(ended, "_row"), level, "no node with a choice")
        passing = placed.where("size(_c) = 1").select("_row", F.get("_c", F.lit(0)).alias("_at"), "_seen")
        choosing = placed.where("size(_c) >= 2").select("_row", "_at")
        # Of the nodes only those that have models: no more than there are models.
        nodes = [r["_at"] for r in here.where((F.size("_c") >= 2) & F.col("_at").isin(*named)).collect()] if named else []
        pairs = list(_pairs(meta_models, image_models, level, sorted(nodes)))
        known = [node for node, _, _ in pairs]
        if known:
            lost(rows.join(choosing.where(~F.col("_at").isin(*known)), "_row"), level, "no model")
        else:
            lost(rows.join(choosing, "_row"), level, "no model")
            state = passing
            continue
        frontier = rows.join(choosing.where(F.col("_at").isin(*known)), "_row").withColumn("_node", F.col("_at"))
        frontier = settle(frontier, "frontier", partition_by=["_node"])
        if labelled:
            lost(frontier.where(F.col(level).isNull()), level, "no label")
            frontier = frontier.where(F.col(level).isNotNull())
        kept = ["_row", "_at", key, *([level] if labelled and level != key else [])]
        scored = []
        for node, meta, image in pairs:
            own = frontier.where(F.col("_node") == node)
            needed = list(dict.fromkeys([*meta.features, *image.features]))
            own, broken = null_gate(own, needed)
            lost(broken, level, "null feature")
            own = own.select(*dict.fromkeys([*kept, *needed]))
            own = meta.transform(own).withColumnRenamed("p", "_meta").drop("predicted")
            own = image.transform(own).withColumnRenamed("p", "_image").drop("predicted")
            scored.append(own.select(*kept, "classes", "_meta", "_image"))
        both = union_all(scored).withColumn(
            "_joint", vectors.blend("_meta", "_image", F.lit(float(weights[level]))))
        true = F.col(level).cast("string") if labelled else F.lit(None).cast("string")
        decided = settle(both.select(
            "_row", key, F.lit(level).alias("taxonomic_level"),
            vectors.pick("classes", "_joint").alias("joint_prediction"),
            vectors.pick("classes", "_image").alias("image_prediction"),
            vectors.pick("classes", "_meta").alias("meta_prediction"),
            true.alias("true_label")), "decided")
        results.append(decided.drop("_row"))
        onward = decided.where("joint_prediction = true_label") if labelled and stop_on_miss else decided
        state = passing.unionByName(onward.select(
            "_row", F.col("joint_prediction").alias("_at"), F.lit(True).alias("_seen")))
    lost(rows.join(state.where("not _seen"), "_row"), "", "no node with a choice")
    if not results:
        names = ["taxonomic_level", "joint_prediction", "image_prediction", "meta_prediction", "true_label"]
        results = [rows.where("false").select(key, *[F.lit(None).cast("string").alias(n) for n in names])]
    return union_all(results), union_all(unresolved)
