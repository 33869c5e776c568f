"""Packing of tokenised documents into sequences of a fixed length.

Each document is cut into pieces of at most the sequence length; only its last
piece can be shorter. Pieces are dealt at random into groups of bounded size,
and every group is packed for itself by first-fit decreasing: a tournament tree
over the free room of the bins finds the first bin that still has room in
logarithmic time. Groups of thousands of pieces lose next to nothing against
one packing of everything, and no task ever holds more than a group.
"""

import base64
import json
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..operators.storage import settle
from .common import bounded_batches, raw_text

LENGTH = 1024
GROUP_PIECES = 8192
# How byte-level BPE cuts a text before merging; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def default_tokenizer():
    """The rank file of the byte-level vocabulary (the ids of byte_bpe_50k.json)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_specials():
    """The tokenizer file that names the added tokens of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path):
    """{text: id} of the tokens that a tokenizer file adds to its vocabulary."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def text_encoder(path, pattern=PATTERN, specials=None):
    """A function from a text to its token ids as little-endian unsigned 32-bit bytes.

    An added token that stands in a text is one id, as the tokenizer file has it.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    specials = dict(specials or {})
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens=specials,
                                 mergeable_ranks={t: i for t, i in ranks.items() if i not in specials.values()})
    return lambda text: array("I", encoding.encode(text, allowed_special="all")).tobytes()


def pieces_of(docs, doc_id="doc_id", text="text", length=LENGTH, tokenizer=None, end_id=0, specials=None):
    """Pieces of every row; ``deal`` is a random number for the choice of a group.

    It is a hash of the piece, so it does not depend on partitions; only the
    second and later of rows that repeat an id and a text are dealt by their place.
    """
    path = tokenizer or default_tokenizer()
    specials = added_tokens(default_specials()) if specials is None else specials
    bounded_batches(docs.sparkSession)

    def run(batches):
        encode = text_encoder(path, specials=specials)
        end = np.array([end_id], dtype="<u4").tobytes()
        for number, batch in enumerate(batches):
            out, before = [], Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text.decode("utf-8", "replace")) + end
                tokens = len(ids) // 4
                for at in range(0, tokens, length):
                    part = ids[4 * at:4 * (at + length)]
                    row = (key, at, len(part) // 4, zlib.crc32(part), tokens)
                    place = f"{number}|{before[row]}" if before[row] else ""
                    before[row] += 1
                    out.append((*row, xxhash.xxh64_intdigest(f"{row}{place}") >> 2))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECE.split(", ")])

    rows = docs.select(F.col(doc_id).cast("long"), raw_text(text))
    return rows.mapInArrow(run, PIECE)


def first_fit_decreasing(lengths, room):
    """(bin, offset) of each length: longest first, each into the first bin with room.

    ``tree[1]`` is the largest free room of all bins; node i has the children 2i
    and 2i + 1, and the leaves are the bins in the order in which they open.
    """
    count = len(lengths)
    leaves = 1 << max(0, (count - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for piece in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[piece])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[piece], offsets[piece] = node - leaves, room - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left > right else right
            node //= 2
    return bins, offsets


def pack(docs, doc_id="doc_id", text="text", length=LENGTH, tokenizer=None, group_pieces=GROUP_PIECES):
    """Pieces of all documents with the sequence and the offset of each.

    A null or empty text is the single end token; repeated rows are packed once
    per row; a null doc_id stays null; no rows give no rows. Sequence numbers
    are unique, not consecutive: group times 2^32 plus the bin of the group.
    """
    pieces = settle(pieces_of(docs, doc_id, text, length, tokenizer), "pieces")
    groups = -(-pieces.count() // group_pieces) or 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(whole):
        # A fixed order, so that a repeated task gives the same sequences.
        whole = whole.sort_by([("deal", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(whole.column("length").to_numpy(), length)
        numbers = bins + (whole.column("group")[0].as_py() << 32)
        return pa.table([*[whole.column(c) for c in names], pa.array(numbers), pa.array(offsets)],
                        names=[*names, "sequence_id", "offset"])

    grouped = pieces.withColumn("group", F.pmod("deal", F.lit(groups)).cast("long")).groupBy("group")
    schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])
    return grouped.applyInArrow(run, schema)
