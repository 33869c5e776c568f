import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wildgrid.llm.divergence import Shares, audit_sources, leading_terms, source_distances, term_counts

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def naive(docs, least, top):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        here = [d for d in docs if d[1] == lang]
        seen = Counter(w for t, _, _ in here for w in set(words(t)))
        kept = [w for w, n in seen.items() if n >= least]

        def shares(rows):
            n = Counter(w for t, _, _ in rows for w in words(t) if w in set(kept))
            total = sum(n.values()) + 5 * len(kept)
            return n, {w: 1 + 10 ** 9 * (n[w] + 5) // total for w in kept}

        _, q = shares(here)
        groups = {s: shares([d for d in here if d[2] == s]) for s in {d[2] for d in here}}
        for s, (n, p) in groups.items():
            pair = [(sum(abs(p[w] - other[w]) for w in kept), o) for o, (_, other) in groups.items() if o != s]
            term = [(p[w] - q[w], w) for w in kept if n[w] and p[w] > q[w]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                order = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(order, 1)]
    return sorted(out)


def found(docs, least, top):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"])
                  for r in audit_sources(docs, least, top).collect())


def plain(docs):
    return [(r["text"], r["lang"], r["source"]) for r in docs.select("text", "lang", "source").collect()]


@pytest.mark.parametrize("least,top", [(1, 50), (2, 3), (30, 50)])
def test_against_counting(spark, small, least, top):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(docs, least, top) == naive(plain(docs), least, top)


def test_ties_are_cut_in_utf8_order(spark):
    """A hundred terms with one value: only the first few in UTF-8 order are reported."""
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(100)] + ["é", "😀", "ﬀ", "z"]
    rows = [(" ".join(names), "x", "a"), ("q q q", "x", "b"), ("", "x", "c"), (None, None, None), ("", "y", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = found(docs, 1, 7)
    assert got == naive(rows, 1, 7)
    assert [r[3] for r in got if r[1] == "a" and r[2] == "term"] == sorted(names)[:7]
    assert ("", "", "pair") not in {r[:3] for r in got}


def test_odd_rows(odd, empty):
    assert found(odd, 1, 50) == naive(plain(odd), 1, 50)
    assert found(odd, 2, 2) == naive(plain(odd), 2, 2)
    assert found(odd, 999, 5) == naive(plain(odd), 999, 5)  # no kept terms: pairs of value 0
    assert audit_sources(empty).count() == 0


def test_small_tiles_and_blocks(spark, small, monkeypatch):
    import wildgrid.llm.divergence as divergence

    docs = spark.read.parquet(f"{small}/documents.parquet")
    shares = Shares(docs, 2)
    whole = sorted(map(tuple, source_distances(shares).collect()))
    assert whole == sorted(map(tuple, source_distances(shares, block_terms=7).collect()))
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    counts = lambda: sorted(map(tuple, divergence.term_counts(docs).collect()))
    few = counts()
    monkeypatch.undo()
    assert few == counts()
    assert leading_terms(shares, 1).groupBy("lang", "source").count().where("count > 1").count() == 0


def test_tiles_of_sources(spark):
    """More sources than one tile holds."""
    rows = [(f"w{'abcdefg'[i % 7]} " * (i % 5 + 1) + f"v{'hijkl'[i % 5]}", "x", f"s{i:04d}") for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {(r["source"], r["item"]): r["value"] for r in source_distances(Shares(docs, 1)).collect()}
    wanted = {(r[1], r[3]): r[4] for r in naive(rows, 1, 1) if r[2] == "pair"}
    assert got == wanted


def test_groups_without_terms_are_listed(spark):
    docs = spark.createDataFrame([("123", "x", "a"), (None, "x", "b")], "text string, lang string, source string")
    assert {(r["lang"], r["source"], r["n"]) for r in term_counts(docs.withColumn("n", F.lit(4))).collect()} == {
        ("x", "a", 0), ("x", "b", 0)}
