"""How the word use of sources differs from each other and from their language's.

Every language keeps the terms that enough of its documents have. A source's
smoothed share of a term is a whole number, so all values are exact.

The terms of a source are ranked by cells: all terms with the same count in the
source and in the language have the same value, so the value is worked out once
for each cell. Equal values are merged, and values are ranked by the number of
terms above them; only the cells that reach the report are expanded to terms,
in UTF-8 order. Sources are compared in tiles: a block of terms by a tile of
sources is a small matrix, whose partial sums are added up.
"""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..operators.storage import settle

# Letters A-Z in lower case, and all code points from 128 on.
WORD = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
UNIT, ADDED = 1_000_000_000, 5
# Distinct terms that a worker counts before it hands them on.
HELD_TERMS = 200_000
BLOCK_TERMS, TILE_SOURCES = 4096, 256


def term_counts(docs, text="text", lang="lang", source="source"):
    """(lang, source, term, n, docs): occurrences of each term and documents that have it.

    Null texts, languages and sources are ''. Each (lang, source) that occurs
    also has a row of the empty term with zeros. Workers count before the
    shuffle, so a frequent term or a hot source sends few rows.
    """
    def run(batches):
        held, seen, size = defaultdict(lambda: (Counter(), Counter())), set(), 0

        def rows():
            for (lang_, source_), (n, documents) in held.items():
                names = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * len(names), pa.string()), pa.array([source_] * len(names), pa.string()),
                     pa.array(names, pa.binary()), pa.array([n[t] for t in names], pa.int64()),
                     pa.array([documents[t] for t in names], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang_, source_, raw in zip(*(batch.column(c) for c in range(3))):
                group = (lang_.as_py(), source_.as_py())
                n, documents = held[group]
                if group not in seen:
                    seen.add(group)
                    n[b""] = documents[b""] = 0
                words = Counter(WORD.findall(raw.as_py().lower()))
                size -= len(n)
                n.update(words)
                documents.update(words.keys())
                size += len(n)
                if size > HELD_TERMS:
                    yield from rows()
                    size = 0
        yield from rows()

    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                          for c, a in ((lang, "lang"), (source, "source"))],
                        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = whole.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n, total, terms):
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact; null without terms."""
    whole = lambda x: f"cast({x} as decimal(27,0))"
    return F.expr(f"1 + ({UNIT} * ({whole(n)} + {ADDED})) div nullif({whole(total)} + {ADDED} * {whole(terms)}, 0)")


class Shares:
    """Kept terms and groups of a table of documents, each written once.

    ``members``: (lang, source, term, n, all_n, p, q), the kept terms that occur
    in a source with its share and the language's; ``groups``: (lang, source, at,
    terms, p0), every source with its place in its language, the number of kept
    terms and the share of a term that it does not have.
    """

    def __init__(self, docs, least=LEAST_DOCUMENTS, **columns):
        counts = settle(term_counts(docs, **columns), "terms")
        kept = settle(counts.where("term <> ''").groupBy("lang", "term").agg(
            F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
        inside = settle(counts.drop("docs").where("n > 0").join(kept, ["lang", "term"]), "members")
        languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
        totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = counts.where("term = ''").select("lang", "source").join(languages, "lang", "left").join(
            totals, ["lang", "source"], "left").na.fill(0).withColumn("at", at)
        self.groups = settle(groups.select(
            "lang", "source", "at", "terms", "total", "all_total", _share("0", "total", "terms").alias("p0")), "groups")
        self.members = inside.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "at", "term", "terms", "n", "all_n", _share("n", "total", "terms").alias("p"),
            _share("all_n", "all_total", "terms").alias("q"))


def leading_terms(shares, top=TOP_TERMS):
    """(lang, source, item, value, rank): terms that a source uses more than its language, widest first.

    Values are worked out for cells of terms with equal counts; a group's
    ``top`` highest values are found before any term is looked at.
    """
    group = ["lang", "source"]
    cells = shares.members.groupBy(*group, "n", "all_n").agg(
        F.count(F.lit(1)).alias("many"), F.first(F.col("p") - F.col("q")).alias("value")).where("value > 0")
    values = settle(cells.groupBy(*group, "value").agg(F.sum("many").alias("many")), "values")
    down = Window.partitionBy(*group).orderBy(F.desc("value"))
    best = values.withColumn("place", F.row_number().over(down)).where(F.col("place") <= top)
    above = F.coalesce(F.sum("many").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = settle(best.withColumn("above", above).where(F.col("above") < top).select(*group, "value", "above"), "reached")
    terms = shares.members.select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.where("value > 0").join(reached, [*group, "value"])
    inside = Window.partitionBy(*group, "value").orderBy("item")
    ranked = terms.withColumn("_place", F.row_number().over(inside)).where(F.col("_place") <= top)
    return ranked.withColumn("rank", F.col("above") + F.col("_place")).where(F.col("rank") <= top).select(
        *group, "item", "value", F.col("rank").cast("int").alias("rank"))


def _tile_sums(key, table):
    """Sums of |p - q| over the terms of one block, for all pairs of sources of two tiles."""
    lang, a_tile, b_tile = key[0].as_py(), key[2].as_py(), key[3].as_py()
    at, p, term = (table.column(c).combine_chunks() for c in ("at", "p", "term"))
    at, p = at.to_numpy(), p.to_numpy(zero_copy_only=False)
    codes = pa.compute.dictionary_encode(term)
    here = np.asarray(term.is_valid())
    column = np.asarray(codes.indices.fill_null(0))
    sources, absent = at[~here], p[~here]
    order = np.argsort(sources)
    sources, absent = sources[order], absent[order]
    matrix = np.repeat(absent[:, None], len(codes.dictionary), axis=1)
    matrix[np.searchsorted(sources, at[here]), column[here]] = p[here]
    first = np.flatnonzero(sources // TILE_SOURCES == a_tile)
    second = np.flatnonzero(sources // TILE_SOURCES == b_tile)
    out = []
    for i in first:
        later = second[second > i]
        if len(later):
            sums = np.abs(matrix[later] - matrix[i]).sum(axis=1)
            out.append((np.full(len(later), sources[i]), sources[later], sums))
    a, b, value = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [[]] * 3))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()),
                     "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})


def source_distances(shares, block_terms=BLOCK_TERMS):
    """(lang, source, item, value, rank): all other sources of a source's language, the farthest first.

    ``value`` is the sum of |p - q| over all kept terms, those that neither has
    included. A task holds one block of terms and two tiles of sources, however
    many there are of either.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).cast("int")
    marks = shares.groups.select("lang", "at", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                                 F.lit(None).cast("string").alias("term"), F.coalesce("p0", F.lit(0)).alias("p"))
    block = F.pmod(F.xxhash64("term"), blocks).cast("int")
    rows = marks.unionByName(shares.members.select("lang", "at", block.alias("block"), "term", "p"))
    most = shares.groups.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    tile = F.floor(F.col("at") / TILE_SOURCES).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(most // TILE_SOURCES))).alias("other")
    tiled = rows.select("*", other).select(
        "lang", "block", F.least(tile, "other").alias("a_tile"), F.greatest(tile, "other").alias("b_tile"),
        "at", "term", F.col("p").cast("long").alias("p"))
    sums = tiled.groupBy("lang", "block", "a_tile", "b_tile").applyInArrow(
        _tile_sums, "lang string, a int, b int, value long")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("at"), F.col("b").alias("to")),
        F.struct(F.col("b").alias("at"), F.col("a").alias("to")))).alias("_p")).select("lang", "value", "_p.*")
    named = shares.groups.select("lang", "source", "at")
    items = named.select("lang", F.col("source").alias("item"), F.col("at").alias("to"))
    found = both.join(named, ["lang", "at"]).join(items, ["lang", "to"])
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", "item", "value", F.row_number().over(down).cast("int").alias("rank"))


def audit_sources(docs, least=LEAST_DOCUMENTS, top=TOP_TERMS, **columns):
    """(lang, source, part, item, value, rank): both reports, ``pair`` and ``term``.

    A source without kept terms has no terms to report, and takes part in
    pairs; in a language without kept terms all pairs have the value 0. No rows
    give none; repeated rows count as often as they stand.
    """
    shares = Shares(docs, least, **columns)
    parts = [source_distances(shares).withColumn("part", F.lit("pair")),
             leading_terms(shares, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
