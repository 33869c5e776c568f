from wildgrid.operators import metrics

PAIRS = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("c", "a"), ("d", "d"), (None, "a"), ("a", None)]


def frame(spark):
    return spark.createDataFrame(PAIRS, "true_label string, prediction string")


def test_report_by_hand(spark):
    pairs = metrics.pair_counts(frame(spark))
    got = {r["label"]: r for r in metrics.class_report(pairs).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (2 / 3, 2 / 3, 3)
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1_score"]) == (0.0, 0.0, 0.0)
    assert sum(r["support"] for r in got.values()) == 7
    assert abs(metrics.balanced_accuracy(pairs).first()[0] - (2 / 3 + 1 / 2 + 0 + 1) / 4) < 1e-12
    assert abs(metrics.accuracy(pairs).first()[0] - 4 / 7) < 1e-12


def test_matrix_rows_add_up_to_support(spark):
    pairs = metrics.pair_counts(frame(spark))
    rows = metrics.confusion_matrix(pairs, ["d", "c", "b", "a"]).collect()
    assert [r["truth"] for r in rows] == ["a", "b", "c", "d"]
    assert [sum(list(r)[1:]) for r in rows] == [3, 2, 1, 1]


def test_zero_division_and_unseen(spark):
    pairs = metrics.pair_counts(spark.createDataFrame([("a", "x"), ("b", "b")], "true_label string, prediction string"))
    one = {r["label"]: r for r in metrics.class_report(pairs, zero_division=1.0).collect()}
    assert (one["a"]["precision"], one["x"]["recall"], one["x"]["f1_score"]) == (1.0, 1.0, 0.0)
    assert {r["label"] for r in metrics.class_report(pairs, with_unseen=False).collect()} == {"a", "b"}


def test_swapped_accuracy_is_mean_precision(spark):
    pairs = metrics.pair_counts(frame(spark))
    report = metrics.class_report(pairs).collect()
    predicted = {p for t, p in PAIRS if t and p}
    mean = sum(r["precision"] for r in report if r["label"] in predicted) / len(predicted)
    assert abs(metrics.balanced_accuracy(metrics.swapped(pairs)).first()[0] - mean) < 1e-12
