"""Language identification by the nearest centroid of TF-IDF letter n-grams.

Texts become normalised TF-IDF vectors of hashed byte trigrams of their words.
Each language has a few centroids, found by spherical k-means over a bounded
sample of its texts. A text gets the language of the centroid with the largest
cosine, and is rejected if it lies further from it than almost any text that
the language was learned from.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..operators.storage import settle
from .common import bounded_batches, raw_text

DIMENSIONS = 4096
SAMPLE_ROWS = 2_000  # learned from, per language, at most
CENTROIDS = 3
UNKNOWN = "und"
# A text is rejected below this part of the lowest cosine (one percent left out)
# among the texts that its language was learned from.
REJECT_PART = 0.35
# Texts with fewer trigrams have too wide a spread of cosines to be rejected.
LEAST_GRAMS = 60

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(raw):
    """Whether a text holds a letter of any script."""
    left = raw.translate(_WORDS).replace(b" ", b"")
    if not left:
        return False
    return min(left) < 128 or any(map(str.isalpha, left.decode("utf-8", "replace")))


def gram_counts(raw, dimensions=DIMENSIONS):
    """Counts of hashed trigrams over the text's words, each word between blanks."""
    words = raw.translate(_WORDS).split()
    if not words:
        return np.zeros(dimensions, np.float32)
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    # One letter of a script beyond Latin takes two or three bytes; its grams are shorter.
    key = (joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]) * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(32 - dimensions.bit_length() + 1), minlength=dimensions).astype(np.float32)


def _vectors(counts, idf):
    found = np.log1p(counts) * idf
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norms > 0, norms, 1)


def _clusters(vectors, k, rounds=12):
    """Spherical k-means from farthest points; fewer centroids if vectors repeat."""
    centroids = [vectors.mean(axis=0)]
    centroids[0] = vectors[np.argmax(vectors @ centroids[0])]
    while len(centroids) < k:
        nearest = np.max(vectors @ np.array(centroids).T, axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centroids.append(vectors[np.argmin(nearest)])
    centroids = np.array(centroids)
    for _ in range(rounds):
        of = np.argmax(vectors @ centroids.T, axis=1)
        moved = np.array([vectors[of == c].mean(axis=0) if (of == c).any() else centroids[c]
                          for c in range(len(centroids))])
        centroids = moved / np.linalg.norm(moved, axis=1, keepdims=True)
    return centroids


def fit(rows, doc_id="doc_id", text="text", lang="lang", sample_rows=SAMPLE_ROWS,
        centroids=CENTROIDS, dimensions=DIMENSIONS):
    """Model (idf, names, centroids, lowest): one row of each array per centroid.

    Learns from about ``sample_rows`` rows of each language with a letter in
    their text, picked by a hash of id and text. Rows without a language are
    not learned from; no rows give a model that answers ``und``.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.where(F.col(lang).isNotNull()).select(
        F.col(doc_id).cast("string").alias("key"), F.col(lang).alias("lang"), raw_text(text).alias("raw"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return np.zeros(dimensions, np.float32), [], np.zeros((0, dimensions), np.float32), np.zeros(0)
    # The share of each language that gives it about 90 % of the bound, as a hash range.
    share = F.coalesce(*[F.when(F.col("lang") == name, int((1 << 30) * min(1, 0.9 * sample_rows / size)))
                         for name, size in sorted(sizes.items())])
    key = F.pmod(F.xxhash64(F.lit("language"), "key", "raw"), F.lit(1 << 30))
    sample = settle(rows.where(key < share), "language_sample")

    def frequencies(batches):
        held, texts = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held += gram_counts(raw, dimensions) > 0
                texts += 1
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(np.arange(dimensions + 1), pa.int32()),
            "n": pa.array(np.append(held, texts), pa.int64())})

    counted = sample.select("raw").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    held = np.zeros(dimensions + 1, np.int64)
    for r in counted.collect():  # one row per dimension
        held[r["slot"]] = r["n"]
    idf = (np.log((1 + held[-1]) / (1 + held[:-1])) + 1).astype(np.float32)

    def learn(group):
        keys = [k or "" for k in group.column("key").to_pylist()]
        # A fixed order, whatever the order in which rows arrive.
        counts = [gram_counts(raw, dimensions) for _, raw in sorted(zip(keys, group.column("raw").to_pylist()))]
        counts = [c for c in counts if c.any()]
        vectors = _vectors(np.array(counts), idf) if counts else np.zeros((0, dimensions), np.float32)
        found = _clusters(vectors, centroids) if counts else vectors
        lowest = float(np.quantile(np.max(vectors @ found.T, axis=1), 0.01)) if counts else 0.0
        return pa.table({
            "lang": pa.array(group.column("lang")[:1].to_pylist() * len(found), pa.string()),
            "at": pa.array(range(len(found)), pa.int32()),
            "centroid": pa.array([c.astype("<f4").tobytes() for c in found], pa.binary()),
            "lowest": pa.array([lowest] * len(found), pa.float64())})

    models = (sample.groupBy("lang").applyInArrow(learn, "lang string, at int, centroid binary, lowest double")
              .orderBy("lang", "at").collect())  # a few rows per language
    spread = np.array([np.frombuffer(m["centroid"], "<f4") for m in models]).reshape(len(models), dimensions)
    return idf, [m["lang"] for m in models], spread, np.array([m["lowest"] for m in models])


def identify(docs, model, text="text", keep=("doc_id",)):
    """``keep`` columns, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text and one without any letter are ``und`` with score 0, and
    rejected. Other texts get a learned language; ``rejected`` says that they
    lie too far from it. Every row gives one row.
    """
    idf, names, centroids, lowest = model
    bounded_batches(docs.sparkSession)
    spread = np.ascontiguousarray(centroids.T, dtype=np.float32)
    least = REJECT_PART * lowest

    def run(batches):
        for batch in batches:
            raws = batch.column(len(keep)).to_pylist()
            langs, scores = [UNKNOWN] * len(raws), np.zeros(len(raws))
            rejected = np.ones(len(raws), bool)
            rows = [i for i, raw in enumerate(raws) if names and has_letter(raw)]
            if rows:
                counts = np.array([gram_counts(raws[i], len(idf)) for i in rows])
                cosines = _vectors(counts, idf) @ spread
                best = np.argmax(cosines, axis=1)
                top = cosines[np.arange(len(rows)), best].astype(float)
                scores[rows] = np.clip(top, 0, 1)
                rejected[rows] = (top < least[best]) & (counts.sum(axis=1) >= LEAST_GRAMS)
                for i, c in zip(rows, best):
                    langs[i] = names[c]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs), pa.array(scores), pa.array(rejected)],
                names=[*keep, "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, raw_text(text).alias("_raw"))
    return rows.mapInArrow(run, T.StructType([
        *[rows.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
