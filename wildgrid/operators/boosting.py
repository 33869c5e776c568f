"""Multi-class boosting of stumps: rounds on Spark, row weights as a column.

A fitted stump is one feature, one threshold and a score vector for each side,
so both the weight update and the final vote are column expressions.
"""

import math
from collections import namedtuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from .storage import settle

Stump = namedtuple("Stump", "feature threshold left right vote")
TINY = 2.220446049250313e-16


def _shares(node):
    """Class shares of a tree node."""
    stats = list(node.impurityStats().stats())
    whole = sum(stats) or 1.0
    return [max(s / whole, TINY) for s in stats]


def _split(model, names):
    """(feature, threshold, shares left, shares right) of a tree of depth one."""
    root = model._call_java("rootNode")
    if model.numNodes == 1:
        shares = _shares(root)
        return names[0], math.inf, shares, shares
    split = root.split()
    return (names[split.featureIndex()], split.threshold(),
            _shares(root.leftChild()), _shares(root.rightChild()))


def _real_scores(shares):
    """Score of each class: (K-1) * (log p - mean log p)."""
    logs = [math.log(p) for p in shares]
    mean = sum(logs) / len(logs)
    return [(len(shares) - 1) * (x - mean) for x in logs]


def _per_label(values, label):
    """The entry of a short list that belongs to the row's label number."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(label).cast("int"))


def fit_stumps(df, rounds, classes, names, weight=None, features="features", label="label_index",
               method="real", settle_every=10):
    """Boost stumps; each round raises the weight of rows the last one got wrong.

    ``method``: ``real`` uses class shares (the usual default elsewhere),
    ``discrete`` only the predicted class. Weights live in a settled table that
    is rewritten every few rounds: short plans, and a lost executor costs only
    the rounds since then.
    """
    start = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = [features, label, *names]
    data = settle(df.select(*used, start.alias("_w")), "boosting")
    fitted = []
    for number in range(rounds):
        model = DecisionTreeClassifier(
            maxDepth=1, featuresCol=features, labelCol=label, weightCol="_w", seed=number).fit(data)
        feature, threshold, left, right = _split(model, names)
        is_left = F.col(feature) <= F.lit(threshold)
        sides = [(max(range(len(s)), key=s.__getitem__), s) for s in (left, right)]
        guess = F.when(is_left, sides[0][0]).otherwise(sides[1][0])
        miss = (guess != F.col(label)).cast("double")
        row = data.agg(F.sum(F.col("_w") * miss).alias("bad"), F.sum("_w").alias("whole")).first()
        error = row["bad"] / row["whole"]
        if method == "real":
            scores, vote = [_real_scores(s) for s in (left, right)], 1.0
            # log share of the true class against the mean of the others
            gains = [[-(classes - 1) / classes * (math.log(s[c]) - sum(
                math.log(s[k]) for k in range(classes) if k != c) / (classes - 1))
                for c in range(classes)] for s in (left, right)]
            change = F.when(is_left, _per_label(gains[0], label)).otherwise(_per_label(gains[1], label))
        else:
            vote = math.inf if error <= 0 else math.log((1 - error) / error) + math.log(classes - 1)
            if vote <= 0:
                break
            vote = min(vote, max([v.vote for v in fitted], default=1.0)) if error <= 0 else vote
            scores = [[vote if c == best else 0.0 for c in range(classes)] for best, _ in sides]
            change = F.lit(vote) * miss
        fitted.append(Stump(feature, threshold, scores[0], scores[1], vote))
        if error <= 0:
            break
        data = data.select(*used, (F.col("_w") * F.exp(change) / F.lit(row["whole"])).alias("_w"))
        if (number + 1) % settle_every == 0:
            data = settle(data, "boosting")
    return fitted


def _number(x):
    return "double('Infinity')" if math.isinf(x) else f"{x!r}D"


def voting_model(fitted, classes, rounds=None):
    """The first ``rounds`` stumps as a fitted pipeline that adds ``probability``
    and ``prediction``; it is saved and loaded like any other."""
    fitted = fitted[:rounds]
    total = sum(s.vote for s in fitted) or 1.0
    list_of = lambda v: "array(" + ", ".join(_number(x) for x in v) + ")"
    votes = ", ".join(f"if(`{s.feature}` <= {_number(s.threshold)}, {list_of(s.left)}, {list_of(s.right)})"
                      for s in fitted) or list_of([0.0] * classes)
    decision = (f"transform(aggregate(array({votes}), {list_of([0.0] * classes)}, "
                f"(acc, s) -> zip_with(acc, s, (a, b) -> a + b)), x -> exp(x / {total * (classes - 1)!r}D))")
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, {decision} AS _decision FROM __THIS__"),
        SQLTransformer(statement=(
            "SELECT *, transform(_decision, x -> x / aggregate(_decision, 0D, (a, b) -> a + b)) "
            "AS probability FROM __THIS__")),
        SQLTransformer(statement=(
            "SELECT *, CAST(array_position(probability, array_max(probability)) - 1 AS DOUBLE) "
            "AS prediction FROM __THIS__"))])
