"""Named queries on clusters, sources and document trees, with the SQL that checks them."""

from pyspark.sql import functions as F

from . import clustering, divergence, fingerprints
from .common import table
from .queries import query

_MEAN = "CAST(floor(sum(v) / count(*)) AS BIGINT)"


def _cluster_sql():
    k, rounds = clustering.CLUSTERS, clustering.ROUNDS

    def assign(i):
        return f"""a{i} AS MATERIALIZED (SELECT rid, min(d * {k} + k) % {k} AS k, min(d * {k} + k) // {k} AS d FROM (
      SELECT rid, k, CAST(list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - c.v[j]) * (x.v[j] - c.v[j]))) AS BIGINT) AS d
      FROM x, c{i} AS c) GROUP BY rid)"""

    def move(i):
        return f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN (
      SELECT k, list(v ORDER BY j) AS v FROM (
        SELECT k, j, {_MEAN} AS v FROM (SELECT a.k, unnest(range(1, 65)) AS j, unnest(x.v) AS v FROM x JOIN a{i} AS a USING (rid))
        GROUP BY k, j) GROUP BY k) AS m USING (k))"""

    steps = ",\n  ".join(f"{assign(i)},\n  {move(i)}" for i in range(rounds))
    return f"""
  WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, sha256('{clustering.SEED}:' || vec_id) AS h,
    list_transform(embedding, lambda e: CAST(floor({clustering.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM x ORDER BY h, v LIMIT {k}),
  {steps},
  {assign(rounds)}
  SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
  FROM x JOIN a{rounds} AS a USING (rid) JOIN c{rounds} AS c ON a.k = c.k"""


@query("op11_clustering", _cluster_sql())
def clustered_vectors(spark, folder):
    """Cluster and exact squared distance of every vector after ten rounds."""
    return clustering.cluster_vectors(table(spark, folder, "embeddings"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op12_divergence", rf"""
  WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  tf AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
  kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
  langs AS (SELECT lang, count(DISTINCT term) AS v, sum(n) AS total FROM tf JOIN kept USING (lang, term) GROUP BY lang),
  q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
    FROM tf JOIN kept USING (lang, term) JOIN langs USING (lang) GROUP BY lang, term),
  groups AS (SELECT DISTINCT lang, source FROM d),
  dense AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM groups AS g JOIN kept USING (lang)
    LEFT JOIN tf ON tf.lang = g.lang AND tf.source = g.source AND tf.term = kept.term),
  p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
    FROM dense JOIN langs USING (lang)),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS value
      FROM p AS x JOIN p AS y USING (lang, term) GROUP BY ALL) AS s ON s.lang = a.lang AND s.s = a.source AND s.t = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
  FROM ranked WHERE part = 'pair' OR rank <= 50""")
def audited_sources(spark, folder):
    """Distances between the sources of each language, and the terms that set each source apart."""
    return divergence.audit_sources(table(spark, folder, "documents"))


def _tree_sql():
    leaf = (f"list_transform(regexp_extract_all(p, '{fingerprints.PIECE}'), lambda x: "
            f"left(sha256(x), {fingerprints.NAME_DIGITS}) || CAST(length(x) AS VARCHAR))")
    paragraphs = f"regexp_extract_all(s, '{fingerprints.PARAGRAPH}')"
    sections = f"regexp_extract_all(t, '{fingerprints.SECTION}')"
    root = (f"sha256('r' || array_to_string(list_transform({sections}, lambda s: sha256('s' || array_to_string("
            f"list_transform({paragraphs}, lambda p: sha256('p' || array_to_string({leaf}, ''))), ''))), ''))")
    pieces = f"flatten(list_transform({sections}, lambda s: flatten(list_transform({paragraphs}, lambda p: {leaf}))))"
    weight = lambda names: (f"coalesce(list_sum(list_transform({names}, "
                            f"lambda x: CAST(substr(x, {fingerprints.NAME_DIGITS + 1}) AS BIGINT))), 0)")
    near = lambda root_, pieces_: (
        f"CASE WHEN a.root = {root_} THEN 1.0::DOUBLE ELSE CAST(2 * {weight(f'list_intersect(a.pieces, {pieces_})')} AS DOUBLE) / "
        f"CAST({weight('list_distinct(a.pieces)')} + {weight(f'list_distinct({pieces_})')} AS DOUBLE) END")
    return f"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER () AS rid FROM documents),
  o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS pos, count(*) OVER () AS many FROM d),
  e AS (SELECT o.doc_id, o.rid, z.rid AS next_rid, o.n, left(o.t, o.n - o.n // 2) || left(z.t, o.n // 2) AS t
    FROM o JOIN o AS z ON z.pos = o.pos % o.many + 1),
  a AS MATERIALIZED (SELECT rid, {root} AS root, {pieces} AS pieces FROM d),
  b AS MATERIALIZED (SELECT rid, {root} AS root, {pieces} AS pieces FROM e)
  SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, a.root AS fingerprint,
    b.root AS edited_fingerprint, {near('b.root', 'b.pieces')} AS near_edited, {near('c.root', 'c.pieces')} AS near_next
  FROM e JOIN a ON a.rid = e.rid JOIN b ON b.rid = e.rid JOIN a AS c ON c.rid = e.next_rid"""


@query("op13_fingerprints", _tree_sql())
def document_fingerprints(spark, folder):
    """Merkle roots of every text and its edited text, with the likeness of the trees."""
    found = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")
