"""Merkle trees of documents: sections, their paragraphs, and pieces of these.

A text is cut into sections (after blank lines), sections into paragraphs
(lines), paragraphs into pieces (sentences, long ones every ``PIECE_CHARS``
code points). Nothing is left out: the pieces joined are the text. A piece is
named by its hash and length, a paragraph by the hash of its pieces' names, a
section by that of its paragraphs, the root by that of its sections. Equal
roots are equal texts; where roots differ, only branches whose hashes differ
are opened to find the edits. DataFrame operations only.

Null texts are empty; the empty text has a root of its own without branches.
"""

from pyspark.sql import Window, functions as F

from ..operators.storage import settle
from .common import bind

PIECE_CHARS = 64
SECTION = r"(?s).+?(?:\n\n+|\z)"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
PIECE = rf"(?s).{{1,{PIECE_CHARS}}}?(?:[.!?][ \t\n\r]+|\z)|.{{{PIECE_CHARS}}}"
NAME_DIGITS = 32  # 128 bits name a piece; its length follows

# Documents of a run of neighbouring ids that one task puts in order.
RUN_ROWS = 2048
MOST_RUNS = 16384


def whole_text(text="text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _node(kind, children):
    """Name of a node over its children's names; kinds keep levels apart."""
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def tree(text):
    """struct(root, sections array<struct(name, paragraphs array<struct(name, pieces array<string>)>)>)."""
    def pieces(paragraph):
        return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)), lambda x: F.concat(
            F.left(F.sha2(x, 256), F.lit(NAME_DIGITS)), F.length(x).cast("string")))

    def paragraphs(section):
        return F.transform(F.regexp_extract_all(section, F.lit(PARAGRAPH), F.lit(0)), lambda p: bind(
            pieces(p), lambda names: F.struct(_node("p", names).alias("name"), names.alias("pieces"))))

    sections = F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)), lambda s: bind(
        paragraphs(s), lambda parts: F.struct(_node("s", parts["name"]).alias("name"), parts.alias("paragraphs"))))
    return bind(sections, lambda parts: F.struct(
        _node("r", parts["name"]).alias("root"), parts.alias("sections")))


def pieces_of(node):
    """Names of all pieces below a root, in the order of the text."""
    return F.flatten(F.flatten(F.transform(node["sections"], lambda s: s["paragraphs"]["pieces"])))


def _weight(names):
    """Code points in pieces."""
    return F.aggregate(names, F.lit(0).cast("long"), lambda acc, x: acc + F.substring(
        x, NAME_DIGITS + 1, 10).cast("long"))


def likeness(root, pieces, other_root, other_pieces):
    """Share of the code points in pieces that two trees have in common, from 0 to 1.

    1 for equal roots; else twice the weight of the common pieces by the weight
    of both sides. A piece counts once, however often and wherever it stands.
    """
    both = _weight(F.array_distinct(pieces)) + _weight(F.array_distinct(other_pieces))
    return F.when(root == other_root, F.lit(1.0)).otherwise(
        2 * _weight(F.array_intersect(pieces, other_pieces)) / both)


def document_trees(docs, doc_id="doc_id", text="text"):
    """(doc_id, n_chars, root, sections) of every row."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("_text"))
    return whole.select("doc_id", F.length("_text").cast("long").alias("n_chars"),
                        tree(F.col("_text")).alias("_tree")).select("doc_id", "n_chars", "_tree.*")


def edited_branches(before, after, key="doc_id"):
    """(key, section, paragraph, edit): paragraphs in which two versions of a document differ.

    Both sides are tables of ``document_trees`` with one row per key. Documents
    with equal roots drop out before anything is opened, then sections with
    equal names, then paragraphs; numbers count from 0, and a paragraph that
    one side lacks is ``added`` or ``removed``, else ``changed``. Keys on one
    side only are left out; null keys match each other.
    """
    left = before.select(F.col(key).alias("_key"), F.col("root").alias("_r"), F.col("sections").alias("_a"))
    right = after.select(F.col(key).alias("_other"), F.col("root").alias("_q"), F.col("sections").alias("_b"))
    met = left.join(right, F.col("_key").eqNullSafe(F.col("_other"))).where("_r <> _q")
    sections = met.select("_key", F.posexplode(F.arrays_zip("_a", "_b")).alias("section", "_pair"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    opened = sections.where(~same("_pair._a.name", "_pair._b.name")).select(
        "_key", "section", F.coalesce("_pair._a.paragraphs", F.array()).alias("_a"),
        F.coalesce("_pair._b.paragraphs", F.array()).alias("_b"))
    paragraphs = opened.select("_key", "section", F.posexplode(F.arrays_zip("_a", "_b")).alias("paragraph", "_pair"))
    edit = F.when(F.col("_pair._a").isNull(), "added").when(F.col("_pair._b").isNull(), "removed").otherwise("changed")
    return paragraphs.where(~same("_pair._a.name", "_pair._b.name")).select(
        F.col("_key").alias(key), "section", "paragraph", edit.alias("edit"))


def _run_number(key, tie, cuts):
    """Number of the run a row belongs to: the cuts below it, found in two steps.

    An id that fills more than one run is several equal cuts; its rows are
    dealt over them by the hash that orders them.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = F.lit(cuts[::step]), F.lit(cuts)

    def below(or_equal):
        less = (lambda c: c <= key) if or_equal else (lambda c: c < key)
        block = F.greatest(F.size(F.filter(coarse, less)) - 1, F.lit(0))
        return block * step + F.size(F.filter(F.slice(fine, block * step + 1, F.lit(step)), less))

    part = F.shiftright(tie, 32) / F.lit(float(2 ** 32)) + F.lit(0.5)
    return F.coalesce(below(False) + F.floor(part * (below(True) - below(False))), F.lit(0)).cast("int")


def with_next(docs, doc_id="doc_id", text="text", also=lambda text: F.lit(True), run_rows=RUN_ROWS):
    """(doc_id, _text, _also, _next): each text and that of the next row, descending ids.

    ``also`` is computed once for each text; ``_next`` has the text and the
    ``_also`` of the next row. After the last row comes the first; a single row
    is its own next one. Null ids come last, rows with one id in the order of a
    hash of their texts. Rows are dealt to runs of neighbouring ids: texts move
    once, and the first row of a run also goes to the run before it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    keys = settle(rows.select("doc_id", "_tie"), "keys")
    count = keys.count()
    runs = min(MOST_RUNS, -(-count // run_rows))
    cuts = []
    if runs > 1:
        shares = F.array(*[F.lit(i / runs) for i in range(1, runs)])
        cuts = keys.agg(F.percentile_approx("doc_id", shares, 16 * runs)).first()[0] or []
    number = lambda: _run_number(F.col("doc_id"), F.col("_tie"), cuts)
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie").desc()]
    # One key per run, a list of bounded length: the row that the run begins with.
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "_tie")
    heads = sorted((r["run"], r["head"]["doc_id"], r["head"]["_tie"]) for r in keys.groupBy(
        number().alias("run")).agg(F.max(place).alias("head")).collect())
    own = F.struct(number().alias("run"), F.lit(False).alias("guest"))
    # Runs go up with the ids: the first row of a run is the next one of the last row in the run above.
    hosts = {f"{d}|{t}": heads[(i + 1) % len(heads)][0] for i, (_, d, t) in enumerate(heads)}
    guest_run = F.lit(None).cast("int")
    if hosts:
        name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.col("_tie").cast("string"))
        run_of = F.create_map(*[F.lit(x) for entry in hosts.items() for x in entry])
        guest_run = F.when(F.col("_tie").isin([t for _, _, t in heads]), run_of[name])
    places = F.array_compact(F.array(own, F.when(guest_run.isNotNull(), F.struct(
        guest_run.alias("run"), F.lit(True).alias("guest")))))
    dealt = rows.select("*", F.explode(places).alias("_at")).select("doc_id", "_text", "_tie", "_at.*")
    # One copy of each text and what comes with it is sorted.
    dealt = dealt.repartition("run").select("doc_id", "_tie", "run", "guest", F.struct(
        "_text", also(F.col("_text")).alias("_also")).alias("_own"))
    run = Window.partitionBy("run").orderBy("guest", *order)
    found = dealt.withColumn("_next", F.lead("_own").over(run))
    return found.where("not guest").select("doc_id", "_own.*", "_next")


def edited_fingerprints(docs, doc_id="doc_id", text="text", run_rows=RUN_ROWS):
    """Fingerprints of every text and of the text edited with the start of the next one.

    (doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next): the last floor(n_chars / 2) code points are replaced by the
    first as many, or all, of the next text (``with_next``). Repeated rows give
    one row each. No rows give none.
    """
    branches = lambda t: bind(tree(t), lambda node: F.struct(node["root"].alias("root"), pieces_of(node).alias("pieces")))
    rows = with_next(docs, doc_id, text, branches, run_rows)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("_text", n - half), F.left("_next._text", half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "_also", F.col("_next._also").alias("_other"),
                       edited.alias("edited_text"))
    rows = rows.withColumn("_edited", branches(F.col("edited_text")))
    return rows.select(
        "doc_id", "n_chars", "edited_text", F.col("_also.root").alias("fingerprint"),
        F.col("_edited.root").alias("edited_fingerprint"),
        likeness(F.col("_also.root"), F.col("_also.pieces"), F.col("_edited.root"), F.col("_edited.pieces"))
        .alias("near_edited"),
        likeness(F.col("_also.root"), F.col("_also.pieces"), F.col("_other.root"), F.col("_other.pieces"))
        .alias("near_next"))
