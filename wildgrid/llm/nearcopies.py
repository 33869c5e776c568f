"""Near-duplicates by the share of common word shingles.

Two texts are near copies if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more; groups are the components of these links.
SimHash only proposes: sets whose sizes allow the similarity are compared by
256-bit fingerprints in tiles, and what lies within the radius is joined into
candidate groups. Inside these the sets themselves decide each link.

At a similarity of 0.8 about 39 of 256 bits differ, with a deviation of 6; at
most 48 do, for four shingles of five. The radius lies four deviations or more
above. Equal sets, the empty one too, are one node and need no comparison.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..operators.storage import settle
from .common import bounded_batches, raw_text
from .components import connected_components
from .simhash import shingle_hashes, tile_links

WORDS, LEAST, RADIUS, SEED = 5, 0.8, 76, 42
PRINTS = ["f0", "f1", "f2", "f3"]
# Shingles in a tile of sets: two tiles are compared at once, a batch may have 256 pairs.
TILE_SHINGLES = 1 << 16
_SALTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(text, words=WORDS):
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, words, SEED), np.uint64))


def node_of(shingles):
    """One signed 64-bit number for each distinct set."""
    return xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes()) - (1 << 63)


def wide_fingerprint(shingles):
    """SimHash of a set in four words; of bits that are even every second one is set."""
    set_bits = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        mixed = shingles[at:at + (1 << 12), None] ^ _SALTS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    chosen = 2 * set_bits + np.arange(256) % 2 > len(shingles)
    return np.packbits(chosen, bitorder="little").view("<u8")


def band_of(size, least=LEAST):
    """Sets of similar size lie in one band or in two next to each other; -1 if no other set can be near."""
    return math.floor(math.log(size) / -math.log(least)) if size and size / (size + 1) >= least else -1


def similar_links(a, b, least=LEAST, radius=RADIUS):
    """Edges that connect what is similar between two tiles of (nodes, prints, sets, labels).

    Nodes of one label are linked already; pairs of them are left out, also
    those that get one label here, so a group of near copies takes few steps.
    """
    nodes, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    a_at, b_at = place[:len(a[0])], place[len(a[0]):]
    label = np.empty(len(nodes), np.int64)
    label[place] = np.unique(np.concatenate([a[3], b[3]]), return_inverse=True)[1]
    b_size = np.array([len(s) for s in b[2]])
    u, v = [], []
    for i, own in enumerate(a[2]):
        apart = sum(np.bitwise_count(a[1][i, w] ^ b[1][:, w]).astype(np.uint16) for w in range(4))
        least_size = np.minimum(b_size, len(own)) / np.maximum(b_size, len(own)) >= least
        open_at = np.nonzero((apart <= radius) & least_size & (label[b_at] != label[a_at[i]]))[0]
        if not len(open_at):
            continue
        flat = np.concatenate([b[2][j] for j in open_at])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        starts = np.cumsum(b_size[open_at]) - b_size[open_at]
        common = np.add.reduceat(hit, starts, dtype=np.int64)
        linked = open_at[common / (len(own) + b_size[open_at] - common) >= least]
        if not len(linked):
            continue
        # One edge for each group that is new to this one.
        others, first = np.unique(label[b_at[linked]], return_index=True)
        u += [a[0][i]] * len(first)
        v += b[0][linked[first]].tolist()
        label[np.isin(label, others)] = label[a_at[i]]
    return u, v


def _row_keys(docs):
    """Two hashes that tell a row's content, nulls included; maps are hashed as JSON."""
    content = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
               for f in docs.schema.fields]
    content += [c.isNull() for c in content]
    return F.xxhash64(*content).alias("_k1"), F.hash(*content).alias("_k2")


def _with_nodes(docs, doc_id, text):
    """(k1, k2, doc_id, node, n, band, f0 to f3) of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*_row_keys(docs), F.col(doc_id).cast("long").alias("doc_id"), raw_text(text).alias("_raw"))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(3).to_pylist()]
            prints = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([node_of(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([band_of(len(s)) for s in sets], pa.int32()),
                 *[pa.array(prints[:, w].copy(), pa.int64()) for w in range(4)]],
                names=["k1", "k2", "doc_id", "node", "n", "band", *PRINTS])

    return rows.mapInArrow(run, "k1 long, k2 int, doc_id long, node long, n long, band int, "
                                "f0 long, f1 long, f2 long, f3 long")


def _sets_of(docs, text, wanted):
    """(grp, node, label, n, f0 to f3, sh): the shingle sets of the rows that ``wanted`` names."""
    columns = wanted.columns[2:]
    rows = docs.select(*_row_keys(docs), raw_text(text).alias("_raw")).join(
        wanted, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select(*columns, "_raw")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.list_(pa.int64()))],
                                             names=[*columns, "sh"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{schema}, sh array<long>").dropDuplicates(["node"])


def _decided(sets, tile_shingles, pairs):
    """Edges (u, v) of similar sets; ``pairs`` says which tiles of one group meet.

    ``sets`` has grp, side, node, label, n, prints and shingles.
    """
    key = ["grp", "side"]
    sizes = sets.groupBy(*key).agg(F.ceil(F.sum("n") / tile_shingles).cast("int").alias("n_tiles"))
    sizes = settle(sizes, "set_tiles")
    tile = F.pmod(F.xxhash64("node", F.lit("tile")), F.col("n_tiles")).cast("int")
    row = F.struct("node", "label", *PRINTS, "sh")
    tiles = settle(sets.join(sizes, key).groupBy(*key, tile.alias("tile")).agg(
        F.collect_list(row).alias("rows")), "sets")
    left = (tiles.select("grp", F.col("side").alias("side_a"), F.col("tile").alias("tile_a"), F.col("rows").alias("a"))
            .join(sizes, "grp").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
            .where(pairs).drop("n_tiles"))
    met = left.join(tiles.withColumnRenamed("rows", "b"), ["grp", "side", "tile"]).select("a", "b")

    def tile_of(rows):
        sh = rows.field("sh")
        prints = np.stack([np.asarray(rows.field(f)).view(np.uint64) for f in PRINTS], axis=1)
        flat, ends = np.asarray(sh.flatten()).view(np.uint64), np.cumsum(sh.value_lengths().to_numpy())
        return (np.asarray(rows.field("node")), prints, np.split(flat, ends[:-1]), np.asarray(rows.field("label")))

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                u, v = similar_links(tile_of(batch.column(0)[at].values), tile_of(batch.column(1)[at].values))
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                                     names=["u", "v"])

    bounded_batches(sets.sparkSession)
    return settle(met.mapInArrow(compare, "u long, v long"), "similar")


def _groups(docs, text, rows, tile_shingles):
    """(node, component) of the distinct sets that have a near copy with another set."""
    distinct = settle(rows.where("band >= 0").groupBy("node").agg(
        F.min(F.struct("k1", "k2", "n", "band", *PRINTS)).alias("r")).select("node", "r.*"), "distinct_sets")
    cells = distinct.select("node", *PRINTS, F.array("band").alias("cell"))
    near = connected_components(tile_links(cells, "node", PRINTS, [(0,), (1,)], RADIUS), name="candidates")
    near = near.union(near.select(F.col("component").alias("node"), "component").distinct())
    wanted = distinct.join(near, "node").select(
        "k1", "k2", F.col("component").alias("grp"), "node", "n", *PRINTS)
    sets = settle(_sets_of(docs, text, settle(wanted, "wanted")), "candidate_sets")

    # First each tile within itself and with the first one: that joins most of a large group.
    edges = _decided(sets.withColumn("side", F.lit(0)).withColumn("label", F.col("node")), tile_shingles,
                     "side_a = side and (tile_a = tile or tile_a = 0)")
    # Then, in groups of several tiles, all that is not in the largest part with everything.
    large = sets.groupBy("grp").agg(F.sum("n").alias("size")).where(F.col("size") > tile_shingles).select("grp")
    large = settle(large, "large_groups")
    if not large.isEmpty():
        found = connected_components(edges, name="parts")
        open_sets = settle(sets.join(large, "grp").join(found, "node", "left").withColumn(
            "label", F.coalesce("component", "node")).drop("component"), "open_sets")
        parts = settle(open_sets.groupBy("grp", "label").count(), "part_sizes")
        most = settle(parts.groupBy("grp").agg(
            F.max_by("label", F.struct("count", "label")).alias("most"), F.count(F.lit(1)).alias("n_parts")), "largest")
        open_sets = open_sets.join(most.where("n_parts > 1"), "grp").withColumn(
            "side", (F.col("label") == F.col("most")).cast("int")).drop("most", "n_parts")
        edges = edges.union(_decided(settle(open_sets, "open_sets"), tile_shingles,
                                     "side_a = 0 and (side = 1 or tile_a <= tile)"))
    return connected_components(edges, name="near_copies")


def keep_one_of_each(docs, doc_id="doc_id", text="text", tile_shingles=TILE_SHINGLES):
    """One row of each group of near copies, with all of its columns.

    Rows are told apart by their content, so an id on several texts or none at
    all loses no text: the row with the least id of a group stays, rows without
    an id after all others. A null text is an empty one; empty texts are copies
    of each other. The rows to drop are joined to the documents.
    """
    names = docs.columns
    rows = settle(_with_nodes(docs, doc_id, text), "doc_sets")
    groups = settle(_groups(docs, text, rows, tile_shingles), "groups")
    keys = settle(rows.groupBy("k1", "k2", "doc_id", "node").count(), "row_keys")
    grouped = settle(keys.join(groups, "node", "left").select(
        "k1", "k2", "doc_id", "count", F.coalesce("component", "node").alias("component")), "members")
    first = settle(grouped.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r"), F.sum("count").alias("size"))
        .where("size > 1").select("component", F.col("r.k1").alias("f1"), F.col("r.k2").alias("f2")), "first_rows")
    members = grouped.join(first, "component").withColumn("stays", F.expr("k1 = f1 and k2 = f2"))
    dropped = settle(members.where("not stays or count > 1").select("k1", "k2"), "dropped")
    twice = settle(members.where("stays and count > 1").select("k1", "k2"), "twice")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_row_keys(docs))
    same = (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))
    kept = keyed.join(dropped, same, "left_anti").select("_row.*")
    if twice.isEmpty():
        return kept
    # Rows repeated whole: one of them.
    one = keyed.join(twice, same, "left_semi").groupBy("_k1", "_k2").agg(F.any_value("_row").alias("_row"))
    return kept.unionByName(one.select("_row.*"))
