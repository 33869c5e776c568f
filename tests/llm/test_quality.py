import random
import re

import numpy as np
from pyspark.sql import functions as F

from wildgrid.llm.quality import host_rates, host_verdicts, judge, measures


def brute(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_measures_against_brute_force(spark, odd):
    random.seed(2)
    texts = [" ".join(random.choices(["a", "b", "é#", "d\n", "\te"], k=random.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for docs in (rows, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        want = {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert {r["doc_id"]: tuple(r[n] for n in names) for r in measures(docs).collect()} == want


def hosts(spark, plan):
    good = "each of these many words stands here only once and all is well today"
    rows = [(host, good if i < fine else "bad") for host, count, fine in plan for i in range(count)]
    rows = [(i, t, h) for i, (h, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_hosts_are_shrunk_and_joined_back(spark):
    docs = hosts(spark, [("bad", 40, 4), ("one", 1, 0), ("a", 50, 49), ("b", 60, 60), ("c", 55, 54), (None, 20, 20)])
    verdicts = {r["host"]: r["host_rejected"] for r in host_verdicts(measures(docs)).collect()}
    assert verdicts == {"bad": True, "one": verdicts["one"], "a": False, "b": False, "c": False, "": False}
    rates = {r["host"]: r["rate"] for r in host_rates(measures(docs)).where("rule = 'short'").collect()}
    assert 0.5 < rates["bad"] < 0.9 and rates["one"] < 1 and 0 < rates["b"] < 0.05
    kept = judge(docs).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in kept}[True] == 49 + 60 + 54 + 20


def test_certainty_is_below_the_posterior_and_grows_with_the_rows(spark):
    docs = hosts(spark, [(f"g{i}", 50, 49) for i in range(20)] + [("few", 4, 1), ("more", 20, 5), ("many", 200, 50),
                                                                  ("fair", 200, 170)])
    found = {r["host"]: r for r in host_rates(measures(docs)).where("rule = 'short'").collect()}
    draws = np.random.default_rng(5)
    for r in found.values():
        posterior = draws.beta(r["alpha"] + r["n_failed"], r["beta"] + r["n_docs"] - r["n_failed"], 100_000)
        assert r["certain"] <= (posterior > r["limit"]).mean() + 0.01
    assert 0 < found["few"]["certain"] < found["more"]["certain"] < found["many"]["certain"]
    rejected = {r["host"] for r in host_verdicts(measures(docs)).where("host_rejected").collect()}
    assert rejected == {"many"} | ({"more"} if found["more"]["certain"] >= 0.95 else set())
    # A seventh of poor documents, or three times the usual odds alone, condemn no host.
    assert found["fair"]["rate"] > 3 * found["g0"]["rate"] and found["fair"]["certain"] == 0


def test_odd_rows(odd, empty):
    rows = judge(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (3, 4, 5, 11))
    assert judge(empty).count() == 0
