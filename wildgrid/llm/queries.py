"""Named queries of this subpackage with the SQL that checks them."""

from pyspark.sql import functions as F

from ..operators.storage import settle
from . import language, licenses, mixing, neighbours, packing, pages, quality, sharding, simhash, toxicity
from .common import held_out, table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame, with SQL where SQL can say it."""
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return keep


def _license_sql():
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    starts = " || ".join(
        "list_filter(range(len(w)), lambda i: " + " AND ".join(
            f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1)) + ")"
        for phrase, _ in licenses.BASE)
    base = ", ".join(f"CASE WHEN contains(joined, ' {phrase} ') THEN '{label}' END" for phrase, label in licenses.BASE)
    more = ", ".join(f"CASE WHEN regexp_matches(joined, '{licenses.pattern_of(template)}') THEN '{label}' END"
                     for label, template in licenses.TEMPLATES)
    tidy = "list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL)))"
    return f"""
  WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  joined AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {starts} AS starts FROM words),
  labelled AS (SELECT doc_id, w, starts, {tidy.format(f'[{base}]')} AS b, {tidy.format(f'[{more}]')} AS m FROM joined)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
    list_min(starts) AS first_word, list_max(starts) AS last_word, array_to_string(b, ',') AS base_labels,
    array_to_string(list_sort(list_distinct(b || m)), ',') AS labels,
    1 - pow(CAST(0.5 AS DOUBLE), least(50, len(starts) + len(m))) AS score FROM labelled"""


@query("op1_licenses", _license_sql())
def license_scan(spark, folder):
    """Licence phrases and labels of every document."""
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


@query("op2_toxicity")
def toxicity_scores(spark, folder):
    """Score of every document by a model of the labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"), ~held_out())
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_packing")
def packed_pieces(spark, folder):
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, folder, "documents"))


_SPACE = r"\x20\x09-\x0D"
_FAILED = {
    "short": "n_words < 10",
    "repeated": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > greatest(n_words, 1)",
    "word_length": "word_chars < 2 * greatest(n_words, 1) OR word_chars > 20 * greatest(n_words, 1)",
    "same_lines": "10 * n_dup_lines > greatest(n_words, 1)",
}


_MEASURED_SQL = f"""
  WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rowno FROM documents),
  words AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS w FROM texts),
  windows AS (SELECT rowno, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
  named AS (SELECT rowno, i, array_to_string(w[i:i + 4], ' ') AS g FROM windows),
  twice AS (SELECT rowno, i FROM named QUALIFY count(*) OVER (PARTITION BY rowno, g) > 1),
  repeated AS (SELECT rowno, count(DISTINCT p) AS n FROM (SELECT rowno, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rowno),
  lines AS (SELECT rowno, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM texts),
  measured AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM words JOIN lines USING (rowno) LEFT JOIN repeated USING (rowno))"""


def _rates_sql(host, rows):
    """CTEs up to ``rates``, one row per host and rule, of the rows of ``rows`` by their host."""
    return f"""
  counts AS (SELECT {host} AS host, count(*) AS n_docs,
    {', '.join(f'count(*) FILTER ({sql}) AS {name}' for name, sql in _FAILED.items())} FROM {rows} GROUP BY 1),
  per_rule AS ({' UNION ALL '.join(f"SELECT host, n_docs, '{name}' AS rule, {name} AS n_failed FROM counts" for name in _FAILED)}),
  prior AS (SELECT rule, avg(n_failed / n_docs) AS m, var_pop(n_failed / n_docs) AS v, avg(1 / n_docs) AS inv
    FROM per_rule GROUP BY rule),
  weighed AS (SELECT rule, m, CASE WHEN v - m * (1 - m) * inv <= 0 THEN 1e6
    ELSE least(1e6, greatest(1, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) END AS weight FROM prior),
  shrunk AS (SELECT *, (m * weight + n_failed) / (weight + n_docs) AS rate, greatest({quality.LEAST_SHARE},
    {quality.ODDS} * m / (1 + {quality.ODDS - 1} * m)) AS bound FROM per_rule JOIN weighed USING (rule)),
  rates AS (SELECT *, CASE WHEN rate > bound THEN (rate - bound) ** 2
    / (rate * (1 - rate) / (weight + n_docs + 1) + (rate - bound) ** 2) ELSE 0 END AS certain FROM shrunk)"""


@query("op4_quality", f"""{_MEASURED_SQL}, {_rates_sql("coalesce(source, '')", "measured")},
  verdicts AS (SELECT host, max(certain) >= {quality.CERTAIN} AS host_rejected FROM rates GROUP BY host)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ({_FAILED['short']} OR {_FAILED['repeated']}) AS base_failed,
    NOT ({_FAILED['short']} OR {_FAILED['repeated']}) AND NOT host_rejected AS kept, host_rejected
  FROM measured JOIN verdicts ON coalesce(source, '') = host""")
def quality_rules(spark, folder):
    """Measures of every document and whether it is kept."""
    return quality.judge(table(spark, folder, "documents"))


_MIRROR_SQL = """CASE WHEN doc_id % 3 > 0 AND ({fails}) OR doc_id % 100 = 7
  THEN 'mirror' || (doc_id % 2) ELSE coalesce(source, '') END"""


@query("op4_hosts", f"""{_MEASURED_SQL},
  placed AS (SELECT *, {_MIRROR_SQL.format(fails=f"{_FAILED['short']} OR {_FAILED['repeated']}")} AS host FROM measured),
  {_rates_sql("host", "placed")}
  SELECT host, rule, n_docs, n_failed, round(rate + 1e-9, 6) AS rate, round(certain + 1e-9, 6) AS certain,
    max(certain) OVER (PARTITION BY host) >= {quality.CERTAIN} AS host_rejected FROM rates""")
def quality_of_hosts(spark, folder):
    """Every host and rule, where two more hosts took most of the poor documents and a few good ones."""
    measured = quality.measures(table(spark, folder, "documents"))
    fails = quality.rules()
    moved = (F.col("doc_id") % 3 > 0) & (fails["short"] | fails["repeated"]) | (F.col("doc_id") % 100 == 7)
    host = F.when(moved, F.concat(F.lit("mirror"), (F.col("doc_id") % 2).cast("string"))).otherwise(
        F.coalesce("source", F.lit("")))
    measured = settle(measured.withColumn("host", host), "measures")
    rates = settle(quality.host_rates(measured, "host"), "host_rates")
    worst = rates.groupBy("host").agg((F.max("certain") >= quality.CERTAIN).alias("host_rejected"))
    return rates.join(worst, "host").select(
        "host", "rule", "n_docs", "n_failed", F.round(F.col("rate") + 1e-9, 6).alias("rate"),
        F.round(F.col("certain") + 1e-9, 6).alias("certain"), "host_rejected")


@query("op5_pages")
def page_texts(spark, folder):
    """Main text of every page."""
    return pages.extract(table(spark, folder, "pages"))


@query("op6_simhash")
def simhash_groups(spark, folder):
    """Fingerprint and group of near-duplicates of every document."""
    return simhash.simhash_components(table(spark, folder, "documents"))


@query("op7_language")
def languages(spark, folder):
    """Language of every document by centroids of the rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_neighbours")
def nearest_vectors(spark, folder):
    """The 20 nearest vectors of every twentieth one by inner product."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def _crc_step(value):
    for _ in range(4):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


_SHARD_HEAD = rf"""
  WITH RECURSIVE sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
    string_split(regexp_replace(lower(hex(encode(coalesce(text, '')))), '(.)(.)', '\2\1', 'g'), '') AS h,
    left(md5(coalesce(text, '')), 4) AS part FROM documents),
  checked AS (SELECT doc_id, size, part, xor(list_reduce(
      list_filter(list_transform(h, lambda x: CAST(strpos('0123456789abcdef', x) - 1 AS BIGINT)), lambda x: x >= 0),
      lambda acc, b: xor(list_extract({[_crc_step(i) for i in range(16)]}, 1 + (xor(acc, b) & 15)), acc >> 4),
      CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM sized),"""


@query("op9_sharding", _SHARD_HEAD + r"""
  ranges AS (SELECT part, CAST(sum(size) AS BIGINT) AS bytes FROM sized GROUP BY part),
  list_of AS (SELECT list(bytes ORDER BY part) AS sizes, max(bytes) AS most,
    CAST(ceil(sum(bytes) / 40.0) AS BIGINT) AS mean FROM ranges),
  search(step, low, high) AS (
    SELECT 0, greatest(mean, most), mean + most FROM list_of
    UNION ALL
    SELECT step + 1, CASE WHEN enough THEN low ELSE mid + 1 END, CASE WHEN enough THEN mid ELSE high END
    FROM (SELECT step, low, high, (low + high) // 2 AS mid,
      list_reduce(sizes, lambda acc, s: CASE WHEN acc % 1099511627776 + s <= (low + high) // 2 THEN acc + s
        ELSE (acc // 1099511627776 + 1) * 1099511627776 + s END, 1099511627776) // 1099511627776 <= 40 AS enough
      FROM search, list_of WHERE low < high)),
  capacity AS (SELECT min(high) AS cap FROM search),
  totals AS (SELECT part, CAST(sum(bytes) OVER (ORDER BY part) AS BIGINT) AS upto FROM ranges),
  prefixes AS (SELECT list(upto ORDER BY part) AS upto FROM totals),
  ends(shard, held, most) AS (
    SELECT -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
    UNION ALL
    SELECT shard + 1, most, list_max(list_filter(upto, lambda x: x <= most + cap))
    FROM ends, prefixes, capacity WHERE most < list_max(upto)),
  filled AS (SELECT part, min(shard) AS shard FROM totals JOIN ends ON upto > held AND upto <= most GROUP BY part)
  SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY part, text_crc32, doc_id, size) - 1 AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
  FROM checked JOIN filled USING (part)""")
def sharded(spark, folder):
    """Shard and slot of every document, under the law of near equal bytes."""
    found = sharding.shard_documents(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


_SIZES = r"""
  SELECT doc_id, coalesce(source, '') AS source,
    CAST(greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS BIGINT) AS n_tokens
  FROM documents"""
_KEY = "md5('mix0|' || CAST(epoch AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), ''))"


@query("op10_mixing", f"""
  WITH RECURSIVE sizes AS ({_SIZES}),
  sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sizes GROUP BY source),
  facts AS (SELECT count(*) AS n, CAST(sum(tokens) AS DOUBLE) AS total, CAST(max(tokens) AS DOUBLE) AS largest,
    min(tokens) AS least, list(CAST(tokens AS DOUBLE) ORDER BY source) AS all_tokens FROM sources),
  even(step, low, high) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT step + 1, CASE WHEN fits THEN mid ELSE low END, CASE WHEN fits THEN high ELSE mid END
    FROM (SELECT step, low, high, mid, ln(mass) - mid * logs / mass >= 0.9 * ln(n) AS fits FROM (
      SELECT step, low, high, (low + high) / 2 AS mid, n,
        list_sum(list_transform(all_tokens, lambda t: pow(t / total, (low + high) / 2))) AS mass,
        list_sum(list_transform(all_tokens, lambda t: pow(t / total, (low + high) / 2) * ln(t / total))) AS logs
      FROM even, facts WHERE step < 20))),
  rare(step, low, high) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT step + 1, CASE WHEN often THEN mid ELSE low END, CASE WHEN often THEN high ELSE mid END
    FROM (SELECT step, low, high, (low + high) / 2 AS mid,
        pow(largest / least, 1 - (low + high) / 2) > 4 AS often
      FROM rare, facts WHERE step < 20)),
  exponent AS (SELECT greatest(
      CASE WHEN list_sum(list_transform(all_tokens, lambda t: -t / total * ln(t / total))) >= 0.9 * ln(n) THEN 1
        ELSE (SELECT low FROM even WHERE step = 20) END,
      CASE WHEN largest / least > 4 THEN (SELECT high FROM rare WHERE step = 20) ELSE 0 END) AS e FROM facts),
  quotas AS (SELECT source, tokens, CAST(floor(tokens * pow(largest / tokens, 1 - e) + 0.5) AS BIGINT) AS quota
    FROM sources, facts, exponent),
  blocks AS (SELECT greatest(1, ceil(sum(quota) / 1048576.0)) AS n_blocks FROM quotas),
  uses AS (SELECT doc_id, source, n_tokens, tokens, quota, unnest(range(quota // tokens + 1)) AS epoch
    FROM sizes JOIN quotas USING (source)),
  keyed AS (SELECT *, {_KEY} AS k FROM uses WHERE epoch * tokens < quota),
  starts AS (SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY k)
      - sum(n_tokens) OVER (PARTITION BY source, epoch, k) AS begins FROM keyed),
  placed AS (SELECT *, CAST(floor(begins / CAST(quota AS DOUBLE) * n_blocks) AS BIGINT) AS block
    FROM starts, blocks WHERE begins < quota)
  SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, block,
    row_number() OVER (PARTITION BY block ORDER BY k, doc_id, source, n_tokens) - 1 AS slot FROM placed""")
def mixed_stream(spark, folder):
    """Every use of every document in a stream of blocks with tempered source weights."""
    return mixing.mix(table(spark, folder, "documents"))


def load():
    """Import the other module that registers queries; returns (queries, oracles)."""
    from . import queries_structure  # noqa: F401
    return dict(QUERIES), dict(ORACLES)
