"""String rules as column expressions."""

import re

from pyspark.sql import functions as F

# Words whose presence in a description marks a poor photograph.
POOR_QUALITY_WORDS = [
    "dead", "road kill", "road", "scat", "poo", "killed", "spoor", "road-kill",
    "remains", "body", "deceased", "prey", "fatality", "tracks", "trapped",
    "bad", "roadkilled", "poop", "crushed", "kill", "squashed", "terrible",
    "caught", "pool", "blurry", "destroyed", "sidewalk", "grounded",
]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def mentions(column, words, whole_words=False):
    """True where any of ``words`` occurs, ignoring case; null text gives false.

    Words match inside longer words unless ``whole_words`` is set.
    """
    pattern = "|".join(re.escape(w) for w in words)
    if whole_words:
        pattern = rf"(?U)\b(?:{pattern})\b"
    return F.coalesce(_col(column).rlike(f"(?iu){pattern}"), F.lit(False))


def word_count(column):
    """Number of whitespace-separated words; null for null."""
    return F.size(F.filter(F.split(_col(column), r"\s+"), lambda w: w != ""))


def trinomial(column, exclude_hybrids=False):
    """The name itself when it has three words or more, else null."""
    c = _col(column)
    rule = word_count(c) >= 3
    if exclude_hybrids:
        rule = rule & ~c.contains("×")
    return F.when(rule, c)


def node_key(column):
    """Name of a node as used for artefacts: spaces to underscores, lower case."""
    return F.lower(F.replace(_col(column), F.lit(" "), F.lit("_")))


def capitalise(column, underscores=True):
    """First letter upper, all others lower; underscores become spaces."""
    c = _col(column)
    if underscores:
        c = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def drop_tail(column, n):
    """Text without its last ``n`` characters (empty when shorter)."""
    c = _col(column)
    return F.substr(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def coordinate_text(latitude, longitude):
    """``lat, lon`` as one string."""
    return F.concat_ws(", ", _col(latitude).cast("string"), _col(longitude).cast("string"))


def columns_matching(df, pattern):
    """Names of the columns that match a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def recode(column, mapping):
    """Replace values by a small dictionary; values outside it stay."""
    c = _col(column)
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)
