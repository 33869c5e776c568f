"""Quality rules of documents and of the hosts that they come from.

Each text is measured and held against a few rules. Per host and rule the
failures are counted (before the shuffle, so a hot host is a handful of rows),
and the share of failures is shrunk towards that of all hosts with a beta
prior fitted to the hosts themselves. A host is rejected with all of its
documents if its own share of a rule is, almost surely by this posterior, far
above that of all hosts. DataFrame operations only.
"""

from pyspark.sql import functions as F

from ..operators.storage import settle
from .common import bind

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
# A host is bad at a rule if its odds of failing are above this multiple of the odds of all hosts, and its
# rate above this share: few clean documents must not go with the others of a host.
ODDS, LEAST_SHARE = 3.0, 0.25
# A host is rejected if it is bad at some rule with at least this probability.
CERTAIN = 0.95


def _repeated_words(windows):
    """Words covered by windows whose hash occurs twice or more in the array."""
    def covered(rows):
        # Rows are sorted by hash, so equal windows stand side by side.
        twice = F.filter(rows, lambda row, i: (
            ((i > 0) & (F.get(rows, i - 1)["h"] == row["h"])) |
            F.coalesce(F.get(rows, i + 1)["h"] == row["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda row: row["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")), lambda acc: acc["n"])

    def count(hashes):
        rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(rows, covered))

    return bind(windows, count)


def measures(docs, text="text", keep=("doc_id", "source")):
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows are told apart by a 64-bit hash of their words. A null text has no
    words and no lines.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, whole.alias("_text"))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    rows = rows.withColumn("_words", words)
    windows = F.when(F.size("_words") >= WINDOW, bind(F.col("_words"), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - F.lit(WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(WINDOW)]))))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    tidy = F.translate("_text", SPACES, "")
    return rows.select(
        *keep, F.size("_words").cast("long").alias("n_words"), F.length(tidy).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated_words(windows), F.lit(0)).cast("long").alias("n_repeat_words"))


def rules():
    """Name and failure of each rule, over the measures of a text."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "short": F.col("n_words") < LEAST_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
        "same_lines": 10 * F.col("n_dup_lines") > words,
    }


def host_rates(measured, host="source"):
    """One row per host and rule: n_docs, n_failed, alpha, beta, the shrunk rate, its limit and ``certain``.

    The prior has the mean of the hosts' rates and, by their variance beyond
    what chance gives, the weight of alpha + beta documents: between 1 (hosts
    differ as much as they can) and 10^6 (not at all). A null host is a host of
    its own, written ''. ``certain`` is what the posterior gives at least for the
    rate to be above the limit: by Cantelli's inequality z^2 / (1 + z^2), if its
    mean lies z deviations above, and 0 if it lies below.
    """
    failed = rules()
    counts = measured.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(f.cast("long")).alias(name) for name, f in failed.items()])
    long = settle(counts.select("host", "n_docs", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_failed")) for name in failed])).alias("r"))
        .select("host", "n_docs", "r.rule", "r.n_failed"), "host_failures")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = long.groupBy("rule").agg(
        F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("each"))
    chance = F.col("m") * (1 - F.col("m"))
    # Of the variance of the rates, chance alone explains m (1 - m) / n.
    beyond = F.col("v") - chance * F.col("each")
    weight = F.when(beyond <= 0, 1e6).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), chance / beyond - 1)))
    prior = settle(prior.select("rule", (F.col("m") * weight).alias("alpha"),
                                ((1 - F.col("m")) * weight).alias("beta")), "host_prior")
    whole = F.col("alpha") + F.col("beta") + F.col("n_docs")
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    limit = F.greatest(F.lit(LEAST_SHARE), ODDS * mean / (1 + (ODDS - 1) * mean))
    found = long.join(prior, "rule").withColumn("rate", (F.col("alpha") + F.col("n_failed")) / whole)
    above, variance = F.col("rate") - F.col("limit"), F.col("rate") * (1 - F.col("rate")) / (whole + 1)
    return found.withColumn("limit", limit).withColumn(
        "certain", F.when(above > 0, above * above / (variance + above * above)).otherwise(0.0))


def host_verdicts(measured, host="source", certain=CERTAIN):
    """(host, host_rejected): whether the host is bad at some rule with probability ``certain`` or more."""
    return host_rates(measured, host).groupBy("host").agg(F.max("certain").alias("worst")).select(
        "host", (F.col("worst") >= certain).alias("host_rejected"))


def judge(docs, text="text", host="source", keep=("doc_id",), certain=CERTAIN):
    """Measures of every document with base_failed and kept.

    base_failed is by the text alone (too few words, or too many of them in
    repeated windows); kept is false for it and for documents of a rejected
    host. Rows and repeated rows stay; no rows give no rows.
    """
    names = list(dict.fromkeys([*keep, host]))
    measured = settle(measures(docs, text, names), "measures")
    verdicts = settle(host_verdicts(measured, host, certain), "host_verdicts")
    failed = rules()
    found = measured.join(verdicts, F.coalesce(F.col(host), F.lit("")) == F.col("host"))
    base = failed["short"] | failed["repeated"]
    return found.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base.alias("base_failed"), (~base & ~F.col("host_rejected")).alias("kept"),
                        "host_rejected")
