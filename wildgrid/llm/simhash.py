"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are cut into cells by the population counts of equal
parts of their bits. Two fingerprints within the radius differ by at most the
radius in the sum over the parts of the difference of counts, so cells further
apart are never compared. Cells are cut into tiles of bounded size; every pair
of tiles that is left is compared whole with numpy exclusive-or and bit counts.
No cap is set on buckets, partners or links: within a pair of tiles all links
are found, and a spanning forest of them leaves the task.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F, types as T

from ..operators.storage import settle
from .common import bounded_batches, raw_text
from .components import connected_components

BITS = 64
TILE_ROWS = 4096
# Lower-cases A-Z and makes white space (0x20, 0x09-0x0D) a blank.
FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Numbers of distinct fingerprints from which the bits are cut into more parts.
PARTS = ((2, 0), (4, 1 << 21), (8, 1 << 28))


def shingle_hashes(text, words=3, seed=42):
    """64-bit hashes of a text's word shingles in their order; none without words."""
    tokens = text.translate(FOLD).split(b" ")
    tokens = [t for t in tokens if t] if b"" in tokens else tokens
    if not tokens:
        return []
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[words - 1:].tolist()
    first = [0] + (ends[:len(tokens) - words] + 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(first, last)]


def fingerprint(text, words=3, seed=42):
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, words, seed)
    if not hashes:
        return 0
    array = np.array(hashes, dtype="<u8")
    # unpackbits takes at most 64 bytes a hash; long texts go in slices.
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(array), 1 << 16):
        part = array[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * set_bits > len(array), bitorder="little")
    return int(chosen.view("<u8")[0])


def _with_prints(rows, text, keep, words, seed):
    """``keep`` columns and fp, the fingerprint as a signed 64-bit integer."""
    bounded_batches(rows.sparkSession)
    columns = rows.select(*keep, raw_text(text).alias("_raw"))

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, words, seed) for t in batch.column(len(keep)).to_pylist()]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*keep, "fp"])

    return columns.mapInArrow(run, T.StructType([
        *[columns.schema[c] for c in keep], T.StructField("fp", T.LongType())]))


def with_fingerprints(docs, doc_id="doc_id", text="text", words=3, seed=42):
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _with_prints(rows, "text", ("doc_id",), words, seed)


def as_text(fp):
    """16 hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _offsets(parts, radius):
    """Differences of counts within the radius, one of each pair of opposites."""
    reach = range(-radius, radius + 1)
    return [o for o in itertools.product(reach, repeat=parts)
            if sum(map(abs, o)) <= radius and o >= (0,) * parts]


def _links(a_id, b_id, prints, radius):
    """Edges (id, smaller id) that connect all that is linked between two tiles.

    ``prints`` are pairs of the tiles' words of 64 bits, one pair for each word
    of the fingerprints. A spanning forest in place of all links: a group of
    near copies would give as many links as the square of its size.
    """
    ids, place = np.unique(np.concatenate([a_id, b_id]), return_inverse=True)
    a_at, b_at = place[:len(a_id)], place[len(a_id):]
    label = np.arange(len(ids))
    for at in range(0, len(a_id), 256):
        apart = 0
        for a, b in prints:
            bits = np.bitwise_count(a[at:at + 256, None] ^ b[None, :])
            apart = bits if len(prints) == 1 else apart + bits.astype(np.uint16)
        left, right = np.nonzero(apart <= radius)
        if not len(left):
            continue
        x, y = a_at[at + left], b_at[right]
        while True:
            least = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, label[x], least)
            np.minimum.at(label, label[y], least)
            label = label[label]
            if (label == before).all():
                break
    while (label[label] != label).any():
        label = label[label]
    moved = np.nonzero(label != np.arange(len(ids)))[0]
    return ids[moved], ids[label[moved]]


def tile_links(cells, node, prints, offsets, radius, tile_rows=TILE_ROWS):
    """Edges (u, v) between the ``node`` of rows whose fingerprints lie within the radius.

    ``cells`` has the node, the 64-bit words ``prints`` of the fingerprint, and
    ``cell``, an array of whole numbers; ``offsets`` lists the differences of
    cells that are compared, one of each pair of opposites.
    """
    spark = cells.sparkSession
    words = len(prints)
    sizes = settle(cells.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("n_tiles")), "cells")
    tile = F.pmod(F.xxhash64(prints[0], F.lit("tile")), F.col("n_tiles")).cast("int")
    row = F.struct(F.col(node).alias("node"), *[F.col(p).alias(f"w{i}") for i, p in enumerate(prints)])
    fields = ["node", *[f"w{i}" for i in range(words)]]
    tiles = settle(cells.join(sizes, "cell").groupBy("cell", tile.alias("tile")).agg(
        F.collect_list(row).alias("rows"))
        .select("cell", "tile", *[F.col("rows")[f].alias(f) for f in fields]), "tiles")

    deltas = F.array(*[F.array(*map(F.lit, o)) for o in offsets])
    near = F.transform(deltas, lambda o: F.zip_with("cell", o, lambda x, y: x + y))
    reach = sizes.select(F.col("cell").alias("cell_b"), "n_tiles")
    left = (tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), *fields,
                         F.explode(near).alias("cell_b"))
            .join(reach, "cell_b")
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
            .where("cell_a <> cell_b or tile_a <= tile")
            .select(F.col("cell_b").alias("cell"), "tile", *[F.col(f).alias(f"a_{f}") for f in fields]))
    pairs = left.join(tiles, ["cell", "tile"])

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                held = [np.asarray(batch.column(c)[row].values) for c in range(2 * words + 2)]
                a, b = held[:words + 1], held[words + 1:]
                u, v = _links(a[0], b[0], [(x.view(np.uint64), y.view(np.uint64)) for x, y in zip(a[1:], b[1:])],
                              radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                                     names=["u", "v"])

    bounded_batches(spark)
    return pairs.select(*[f"a_{f}" for f in fields], *fields).mapInArrow(compare, "u long, v long")


def linked(fingerprints, radius=3, parts=None, tile_rows=TILE_ROWS):
    """(fp, component, group): the smallest doc_id reachable from each distinct fingerprint.

    ``group`` is the smallest fingerprint reachable: two groups in which one id
    is the smallest have one component and stay two groups. A group of rows
    without ids has a null component.

    ``parts`` cuts the bits into so many parts for the comparison of population
    counts; more parts skip more pairs and make more cells. It is taken from
    the number of distinct fingerprints if not given and never changes results.
    """
    spark = fingerprints.sparkSession
    distinct = settle(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    if parts is None:
        count = distinct.count()
        parts = max(p for p, least in PARTS if count >= least)
    width = BITS // parts
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask)))
              for i in range(parts)] if parts > 1 else [F.bit_count("fp")]
    cells = distinct.select("fp", F.array(*counts).alias("cell"))
    edges = tile_links(cells, "fp", ["fp"], _offsets(parts, radius), radius, tile_rows)
    # The fingerprint is the node: one id may stand on several texts, or a row may have none.
    groups = connected_components(edges, name="simhash")
    grouped = settle(distinct.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("group")), "grouped")
    least = settle(grouped.groupBy("group").agg(F.min("rep").alias("component")), "least")
    return grouped.join(least, "group").select("fp", "component", "group")


def simhash_components(docs, doc_id="doc_id", text="text", words=3, radius=3, seed=42, **more):
    """(doc_id, fingerprint, component_id) of every row.

    Texts are lower-cased (A-Z), cut at ASCII white space, and shingled; a null
    text is empty and an empty one has fingerprint zero, linked like any other.
    Repeated rows keep their rows. A null doc_id takes part in the links and
    gets the component of its group but names none. No rows give no rows.
    """
    prints = settle(with_fingerprints(docs, doc_id, text, words, seed), "doc_fingerprints")
    groups = settle(linked(prints, radius, **more), "groups")
    return prints.join(groups, "fp").select(
        "doc_id", as_text("fp").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_representatives(docs, doc_id="doc_id", text="text", words=3, radius=3, seed=42, **more):
    """One row of each group of near-duplicates, with all of its columns.

    The row whose doc_id names the group stays (one of them, if several rows of
    the group have that id). A row with a null doc_id cannot name a group and
    stays as it is. The rows to drop are joined to the documents by id and
    fingerprint, the shorter of the two lists.
    """
    names = docs.columns
    with_id = docs.where(F.col(doc_id).isNotNull())
    prints = settle(with_fingerprints(with_id, doc_id, text, words, seed), "doc_fingerprints")
    groups = settle(linked(prints, radius, **more), "groups")
    found = settle(prints.groupBy("doc_id", "fp").count().join(groups, "fp"), "members")
    # The row that stays: its id is that of the group, and its fingerprint the least with that id.
    heads = settle(found.where("doc_id = component").groupBy("group").agg(
        F.min("fp").alias("head")), "heads")
    marked = found.join(heads, "group").withColumn("stays", F.expr("doc_id = component and fp = head"))
    marked = settle(marked.select("doc_id", "fp", "count", "stays"), "marked")
    dropped = marked.where("not stays or count > 1")
    twice = settle(marked.where("stays and count > 1").select("doc_id", "fp"), "twice")
    # Only ids on several rows need their fingerprints again.
    several = settle(marked.groupBy("doc_id").agg(F.sum("count").alias("rows"))
                     .where("rows > 1").select("doc_id"), "several")
    key = docs[doc_id].cast("long")
    single = settle(dropped.select("doc_id").union(several).distinct().withColumnRenamed("doc_id", "_dropped"), "dropped")
    kept = docs.join(single, key == single["_dropped"], "left_anti")
    if several.isEmpty():
        return kept
    rows = docs.join(several, key == several["doc_id"], "left_semi").select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(doc_id).cast("long").alias("_id"),
        F.col(text).alias("_text"))
    rows = settle(_with_prints(rows, "_text", ("_row", "_id"), words, seed), "several_rows")
    alone = marked.where("stays and count = 1").select("doc_id", F.col("fp").alias("fp_"))
    chosen = rows.join(alone, (F.col("_id") == F.col("doc_id")) & (F.col("fp") == F.col("fp_")), "left_semi").select("_row.*")
    twice = twice.withColumnRenamed("fp", "fp_")
    one = (rows.join(twice, (F.col("_id") == F.col("doc_id")) & (F.col("fp") == F.col("fp_")), "left_semi")
           .groupBy("_id", "fp").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")))
    return kept.unionByName(chosen).unionByName(one.select("_row.*"))
