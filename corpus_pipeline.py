"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. A stage's result is written and read again before the next one.
Null ids, texts, languages and sources, empty texts, repeated rows and empty
tables pass through every stage as its operator states.
"""

from functools import wraps

from pyspark.sql import functions as F

from wildgrid.llm import language, mixing, nearcopies, packing, toxicity
from wildgrid.llm.common import held_out, table
from wildgrid.operators.storage import settle
from wildgrid.session import with_scratch

TOXIC_FROM = 0.3


def _stage(function):
    """A stage names a checkpoint folder of its own only in a local session without one."""
    @wraps(function)
    def run_stage(spark, docs, sf_dir):
        return function(with_scratch(spark), docs, sf_dir)
    return run_stage


def _boxed(docs):
    """Whole rows as one column, so that no name of theirs meets one of a verdict."""
    return docs.select(F.struct("*").alias("_doc"), "text")


@_stage
def drop_toxic(spark, docs, sf_dir):
    """Documents whose calibrated toxicity stays below the limit.

    All stay if the labels are too few to learn from.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    if not toxicity.is_trained(model):
        return docs
    scored = toxicity.score(_boxed(docs), model, "_doc")
    return scored.where(F.col("score") < TOXIC_FROM).select("_doc.*")


@_stage
def drop_unknown_languages(spark, docs, sf_dir):
    """Documents that lie near enough to the language that they are taken for."""
    model = language.fit(docs.where(~held_out()))
    found = language.identify(_boxed(docs), model, keep=("_doc",))
    return found.where(~F.col("rejected")).select("_doc.*")


@_stage
def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates: five words, similarity 0.8 or more."""
    return nearcopies.keep_one_of_each(docs)


@_stage
def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix of sources to target weights uses them."""
    return mixing.mixed_documents(docs)


@_stage
def pack_sequences(spark, docs, sf_dir):
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models, fingerprints and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to the documents, each written and read again."""
    docs = table(with_scratch(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
