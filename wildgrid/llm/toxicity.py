"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Words and word beginnings that tell toxic texts apart are learned from the
labelled rows; the trees see each half of these rows through the lexicon of the
other half, so the densities they learn from are honest. Labels come only from the rows that the caller names;
language, source and id are never inputs of a score.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F, types as T

from ..operators.storage import settle
from .common import bounded_batches, pick_bounded, raw_text

# Labelled rows that a model learns from, at most; a sample by hash beyond that.
SAMPLE_ROWS = 20_000
LEXICON_SIZE = 4_000
STRONG, WEAK = 0.9, 0.6
PREFIXES = (4, 5)
# A few plain insults and words of address, the same whatever the rows teach.
INSULTS = frozenset(b"idiot moron stupid scum trash loser worthless pathetic disgusting clown dumb jerk "
                    b"hate filthy vermin garbage fool imbecile".split())
SECOND_PERSON = frozenset(w.encode() for w in (
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre "
    "usted ustedes tú tus vosotros").split())
REACH = 5  # words between an insult and a word of address that belong together

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# As above, with digits and signs that stand for letters read as those letters.
_STANDS_FOR = dict(zip(b"0134578@$!", b"oieastbasi"))
_READ = bytes(_STANDS_FOR.get(b, _LOWER[b]) for b in range(256))
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FEATURES = ("strong_density strong_distinct weak_density weak_distinct weight_max weight_mean insult_density "
            "hidden_density near_second second_density capitals shouted exclamations questions signs digits "
            "signs_inside stretched log_words strong_share").split()


def grams_of(word):
    """The word itself and its first bytes."""
    return [b"=" + word, *[b"%d" % n + word[:n] for n in PREFIXES if len(word) > n]]


def fit_lexicons(rows, half, text="text", label="toxic", size=LEXICON_SIZE):
    """Lexicons of the rows of one half, of the other half, and of all of them.

    A lexicon is {gram: share of toxic texts among those that hold it} with at
    most ``size`` grams. It counts texts, not places; the share is smoothed, and
    grams held by fewer than three toxic texts or under half a percent of them
    do not enter. Rows are read once.
    """
    bounded_batches(rows.sparkSession)
    kinds = ["one0", "one1", "two0", "two1"]  # half, then label

    def count(batches):
        for batch in batches:
            found = {}
            for raw, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for gram in {g for w in set(raw.translate(_LOWER).split()) for g in grams_of(w)}:
                    found.setdefault(gram, [0, 0, 0, 0])[kind] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), *[pa.array([n[k] for n in found.values()], pa.int64())
                                                 for k in range(4)]], names=["gram", *kinds])

    kind = 2 * half.cast("int") + (F.col(label) == 1).cast("int")
    counts = (rows.select(raw_text(text), kind)
              .mapInArrow(count, "gram binary, one0 long, one1 long, two0 long, two1 long")
              .groupBy("gram").agg(*[F.sum(k).alias(k) for k in kinds]))
    sizes = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy(
        half.alias("half"), (F.col(label) == 1).alias("toxic")).count().collect()}
    lexicons = []
    for halves, names in (([False], ["one"]), ([True], ["two"]), ([False, True], ["one", "two"])):
        toxic = sum(sizes.get((h, True), 0) for h in halves)
        n1 = sum((F.col(n + "1") for n in names[1:]), F.col(names[0] + "1"))
        n0 = sum((F.col(n + "0") for n in names[1:]), F.col(names[0] + "0"))
        lexicons.append((max(3, math.ceil(toxic / 200)), n1, n1 / (n1 + n0 + 1)))
    keep = [(n1 >= least) & (share >= WEAK) for least, n1, share in lexicons]
    # Kept grams are few: each is held by at least so many of the sampled texts.
    counts = settle(counts.where(keep[0] | keep[1] | keep[2]), "toxic_grams")
    return [{bytes(r["gram"]): r["share"] for r in
             counts.where(wanted).select("gram", n1.alias("n1"), share.alias("share"))
             .orderBy(F.desc("n1"), "gram").limit(size).collect()}
            for wanted, (_, n1, share) in zip(keep, lexicons)]


class _Weights(dict):
    """Largest share of a word's grams, 0 if it has none; forgets when it grows long."""

    def __init__(self, lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        found = self[word] = max(self.lexicon.get(g, 0.0) for g in grams_of(word))
        return found


def features_of(raw, weights):
    """Dense features of one text; zeros for an empty one."""
    size = len(raw)
    words = raw.translate(_LOWER).split()
    count = len(words)
    if not count:
        return [0.0] * len(FEATURES)
    shares = list(map(weights.__getitem__, words))
    strong = [i for i, s in enumerate(shares) if s >= STRONG]
    weak = sum(1 for s in shares if WEAK <= s < STRONG) if max(shares) else 0
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    address = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    marked = sorted({*strong, *insults})
    near = 0
    if address and marked:
        at = np.searchsorted(address, marked)
        before = np.array(address)[np.maximum(at - 1, 0)]
        after = np.array(address)[np.minimum(at, len(address) - 1)]
        near = int((np.minimum(abs(before - marked), abs(after - marked)) <= REACH).sum())
    # Words that only read as insults once digits and signs are taken for letters.
    hidden = 0
    if len(raw.translate(None, _LETTERS + b" \n,.")):
        hidden = sum(1 for w in raw.translate(_READ).split() if weights[w] >= STRONG or w in INSULTS) - len(marked)
    letters = size - len(raw.translate(None, _LETTERS))
    tokens = raw.split()
    inside = sum(1 for t in tokens if len(t) > 2 and len(t[1:-1].translate(None, _LETTERS + _DIGITS + b"'-")))
    shouted = sum(1 for t in tokens if len(t) > 2 and t.isupper())
    present = len(set(marked)) and len({words[i] for i in strong})
    mass = sum(shares)
    return [100 * len(strong) / count, math.log1p(present), 100 * weak / count,
            math.log1p(len({words[i] for i, s in enumerate(shares) if WEAK <= s < STRONG}) if weak else 0),
            max(shares), 100 * mass / count, 100 * len(insults) / count,
            100 * max(hidden, 0) / count, near / max(1, len(marked)), 100 * len(address) / count,
            (size - len(raw.translate(None, _UPPER))) / max(1, letters), shouted / len(tokens),
            100 * raw.count(b"!") / size, 100 * raw.count(b"?") / size,
            (size - len(raw.translate(None, _SIGNS))) / size, (size - len(raw.translate(None, _DIGITS))) / size,
            inside / len(tokens), sum(raw.count(c * 3) for c in (b"!", b"?", b"a", b"o", b"e")) / len(tokens),
            math.log(count), len(strong) / max(1, len(strong) + weak)]


def with_features(rows, lexicon, text="text", keep=("doc_id",)):
    """``keep`` columns beside ``features`` (array of doubles)."""
    bounded_batches(rows.sparkSession)
    columns = rows.select(*keep, raw_text(text).alias("_raw"))

    def run(batches):
        weights = _Weights(lexicon)
        for batch in batches:
            found = [features_of(t, weights) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    return columns.mapInArrow(run, T.StructType([
        *[columns.schema[c] for c in keep], T.StructField("features", T.ArrayType(T.DoubleType()))]))


def fit(rows, doc_id="doc_id", text="text", label="toxic", sample_rows=SAMPLE_ROWS):
    """A model from labelled rows: (lexicon, trees, calibration, prior).

    At most about ``sample_rows`` rows are learned from. Each half of them is
    described with the lexicon of the other half, so the trees see honest
    densities; four fifths of the rows grow the trees and all of them calibrate.
    Rows of one class only, or none, give a model without trees that scores
    their share.
    """
    rows = rows.where(F.col(label).isin(0, 1)).select(doc_id, text, F.col(label).cast("int").alias(label))
    sample = settle(pick_bounded(rows, rows.select(label).count(), sample_rows, [doc_id], "toxic"), "toxic_sample")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(doc_id).cast("string")), F.lit(10))
    half = part % 2 == 1
    sizes = {(r["half"], r[label]): r["count"]
             for r in sample.groupBy(half.alias("half"), label).count().collect()}
    total = sum(sizes.values())
    prior = (sizes.get((True, 1), 0) + sizes.get((False, 1), 0)) / total if total else 0.0
    if not all(sizes.get((h, value)) for h in (True, False) for value in (0, 1)):
        return {}, None, None, prior
    one, two, lexicon = fit_lexicons(sample, half, text, label)
    rest = (with_features(sample.where(half), one, text, keep=(doc_id, label)).unionByName(
        with_features(sample.where(~half), two, text, keep=(doc_id, label))))
    # A small table that the trees read many times: few files.
    rest = settle(rest.withColumn("_part", part).coalesce(4), "toxic_features")
    rest = rest.select("_part", F.col(label).cast("double").alias("label"),
                       array_to_vector("features").alias("features"))
    trees = GBTClassifier(maxIter=16, maxDepth=3, stepSize=0.25, seed=7).fit(rest.where("_part < 8"))
    margins = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("p"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(margins)
    return lexicon, trees, calibration, prior


def is_trained(model):
    """Whether a model can tell texts apart; otherwise it scores the share of toxic rows."""
    return model[1] is not None


def score(docs, model, doc_id="doc_id", text="text"):
    """(doc_id, score): probability that a text is toxic.

    One row per row; ``doc_id`` can be any column, a struct of a row too. A null
    text is an empty one. Empty texts score like texts without any sign of
    toxicity.
    """
    lexicon, trees, calibration, prior = model
    if trees is None:
        return docs.select(doc_id, F.lit(float(prior)).alias("score"))
    rows = with_features(docs, lexicon, text, keep=(doc_id,))
    rows = rows.select(doc_id, array_to_vector("features").alias("features"))
    raw = trees.transform(rows).select(doc_id, vector_to_array("probability")[1].alias("p"))
    found = calibration.transform(raw).select(doc_id, "prediction")
    return found.select(doc_id, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("score"))


def learn(docs, labels, learnable, doc_id="doc_id", text="text", label="toxic", sample_rows=SAMPLE_ROWS):
    """Fit on the labelled rows of ``docs`` for which ``learnable`` holds.

    An id with several labels counts as toxic if one of them says so; rows with
    a null id or label are not learned from.
    """
    marks = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label")))
    # The sample is picked among the ids, so only its texts meet their labels.
    marks = settle(marks, "toxic_labels")
    known = docs.where(learnable).select(F.col(doc_id).alias("_key"))
    size = known.join(marks, F.col("_key") == F.col("_id")).count()
    picked = settle(pick_bounded(marks, size, sample_rows, ["_id"], "toxic"), "toxic_picked")
    rows = docs.where(learnable).select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    rows = rows.join(picked, F.col("_key") == F.col("_id"))
    return fit(rows.select("_key", "_text", "_label"), "_key", "_text", "_label", sample_rows)
