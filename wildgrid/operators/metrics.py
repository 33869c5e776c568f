"""Quality reports. All start from counts of (truth, prediction) pairs, one
aggregation over the predictions; everything after it is as small as the
number of classes. Column names say which side is the truth."""

from pyspark.sql import functions as F

from .storage import settle


def pair_counts(df, truth="true_label", pred="prediction", by=()):
    """Rows per (by..., truth, pred)."""
    by = [by] if isinstance(by, str) else list(by)
    known = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    return df.where(known).groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")) \
             .agg(F.count(F.lit(1)).alias("n"))


def swapped(pairs):
    """The same counts with truth and prediction exchanged."""
    other = [c for c in pairs.columns if c not in ("truth", "pred")]
    return pairs.select(*other, F.col("pred").alias("truth"), F.col("truth").alias("pred"))


def confusion_matrix(pairs, labels):
    """One row per true label, one column per predicted label, in sorted order."""
    labels = sorted(labels)
    cells = [F.coalesce(F.sum(F.when(F.col("pred") == x, F.col("n"))), F.lit(0)).alias(str(x))
             for x in labels]
    return pairs.groupBy("truth").agg(*cells).orderBy("truth")


def class_report(pairs, by=(), zero_division=0.0, with_unseen=True):
    """precision, recall, f1_score and support per class.

    Each pair counts once for its true and once for its predicted class, so one
    aggregation covers classes that occur on one side only. ``with_unseen=False``
    leaves out classes without support.
    """
    by = [by] if isinstance(by, str) else list(by)
    n, zero = F.col("n"), F.lit(0).cast("long")
    right = F.when(F.col("truth") == F.col("pred"), n).otherwise(zero)
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("label"), n.alias("s"), zero.alias("p"), right.alias("tp")),
        F.struct(F.col("pred").alias("label"), zero.alias("s"), n.alias("p"), zero.alias("tp"))))
    sums = pairs.select(*by, sides.alias("x")).groupBy(*by, "x.label").agg(
        F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.tp").alias("tp"))
    zd = F.lit(float(zero_division))
    out = sums.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zd)) \
              .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zd))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1_score", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    out = out.select(*by, "label", "precision", "recall", "f1_score", "support")
    return out if with_unseen else out.where("support <> 0")


def report_summary(pairs, by=(), zero_division=0.0):
    """accuracy, macro avg and weighted avg rows, in a table of their own."""
    by = [by] if isinstance(by, str) else list(by)
    report = class_report(pairs, by, zero_division)
    s, measures = F.col("support"), ["precision", "recall", "f1_score"]
    means = report.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * s) / F.sum(s)).alias(f"weighted_{m}") for m in measures],
        F.sum(s).alias("support"))
    # Recall weighted by support is the share of right rows: the accuracy.
    share = F.col("weighted_recall")
    rows = [F.struct(F.lit("accuracy").alias("row"), *[share.alias(m) for m in measures], s.alias("support"))]
    rows += [F.struct(F.lit(f"{kind} avg").alias("row"),
                      *[F.col(f"{kind}_{m}").alias(m) for m in measures], s.alias("support"))
             for kind in ("macro", "weighted")]
    return means.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def balanced_accuracy(pairs, by=()):
    """Mean recall over the classes that occur as truth."""
    by = [by] if isinstance(by, str) else list(by)
    right = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    recalls = pairs.groupBy(*by, "truth").agg((F.sum(right) / F.sum("n")).alias("recall"))
    return recalls.groupBy(*by).agg(F.avg("recall").alias("accuracy"))


def accuracy(pairs, by=()):
    """Share of right predictions."""
    by = [by] if isinstance(by, str) else list(by)
    right = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    return pairs.groupBy(*by).agg((F.sum(right) / F.sum("n")).alias("accuracy"))


def long_methods(results, methods, level="taxonomic_level", truth="true_label"):
    """One row per (observation, method); ``methods`` maps column to method name."""
    rows = results.select(level, truth, *[F.col(c).alias(m) for c, m in methods.items()])
    return rows.unpivot([level, truth], list(methods.values()), "method", "prediction")


def method_accuracy(results, methods, level="taxonomic_level", truth="true_label", swap=False):
    """Balanced accuracy per (level, method), all from one aggregation.

    ``swap`` scores the truth against the prediction, as some published figures
    did; the result is then the mean precision.
    """
    pairs = pair_counts(long_methods(results, methods, level, truth), truth, "prediction",
                        [level, "method"])
    return balanced_accuracy(swapped(pairs) if swap else pairs, [level, "method"])


def report_difference(left, right, by=()):
    """left minus right, class by class; a class missing on one side counts 0."""
    by = [by] if isinstance(by, str) else list(by)
    key = [*by, "label"]
    measures = ["precision", "recall", "f1_score", "support"]
    a = left.select(*key, *[F.col(m).alias(f"a_{m}") for m in measures])
    b = right.select(*key, *[F.col(m).alias(f"b_{m}") for m in measures])
    diff = [(F.coalesce(F.col(f"a_{m}"), F.lit(0)) - F.coalesce(F.col(f"b_{m}"), F.lit(0))).alias(m)
            for m in measures]
    return a.join(b, key, "full_outer").select(*key, *diff)


def method_difference(results, left, right, by="taxonomic_level", truth="true_label",
                      zero_division=0.0, swap=False):
    """Report of one prediction column minus that of another, per level and class.

    Both come from one pass over the predictions; classes without support are
    left out on each side before the subtraction.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = results.select(*by, truth, F.col(left).alias("left"), F.col(right).alias("right"))
    rows = rows.unpivot([*by, truth], ["left", "right"], "side", "prediction")
    pairs = pair_counts(rows, truth, "prediction", [*by, "side"])
    pairs = settle(swapped(pairs) if swap else pairs, "pairs")
    report = class_report(pairs, [*by, "side"], zero_division, with_unseen=False)
    return report_difference(report.where("side = 'left'").drop("side"),
                             report.where("side = 'right'").drop("side"), by)


def beside_counts(report, df, label, report_label="label"):
    """Report rows next to the number of observations of their class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias(report_label)) \
               .agg(F.count(F.lit(1)).alias("observations"))
    return report.join(counts, report_label, "left")


def mean_scores(report, measures, by):
    """Mean of report measures by level, model or both."""
    return report.groupBy(*([by] if isinstance(by, str) else by)) \
                 .agg(*[F.avg(m).alias(m) for m in measures])


def cascade_error_rate(results, without_level=None, key="id"):
    """Wrong rows / distinct observations; optionally without one level."""
    rows = results if without_level is None else results.where(
        F.col("taxonomic_level") != without_level)
    wrong = F.count_if(F.col("joint_prediction") != F.col("true_label"))
    return rows.agg(wrong.alias("errors"), F.count_distinct(key).alias("observations")) \
               .withColumn("error_rate", F.try_divide("errors", "observations"))
