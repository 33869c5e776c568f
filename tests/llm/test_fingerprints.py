import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wildgrid.llm import fingerprints
from wildgrid.llm.fingerprints import document_trees, edited_branches, edited_fingerprints, with_next


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_tree(text):
    """(root, names of pieces) by walking the text."""
    pieces, sections = [], []
    for section in re.findall(r".+?(?:\n\n+|\Z)", text, re.S):
        paragraphs = []
        for paragraph in re.findall(r"[^\n]*\n+|[^\n]+", section):
            names = []
            while paragraph:
                end = re.match(rf".{{1,{fingerprints.PIECE_CHARS}}}?[.!?][ \t\n\r]+", paragraph, re.S)
                size = end.end() if end else min(len(paragraph), fingerprints.PIECE_CHARS)
                names.append(sha(paragraph[:size])[:32] + str(size))
                paragraph = paragraph[size:]
            pieces += names
            paragraphs.append(sha("p" + "".join(names)))
        sections.append(sha("s" + "".join(paragraphs)))
    return sha("r" + "".join(sections)), pieces


def naive_near(a, b):
    if a[0] == b[0]:
        return 1.0
    weight = lambda names: sum(int(n[32:]) for n in set(names))
    return 2 * weight(set(a[1]) & set(b[1])) / (weight(a[1]) + weight(b[1]))


def naive(rows):
    """Rows of (doc_id, text) with unique ids."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in rows]
    out = {}
    for at, (i, _) in enumerate(rows):
        text, after = texts[at], texts[(at + 1) % len(rows)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = naive_tree(text), naive_tree(edited), naive_tree(after)
        out[i] = (len(text), edited, a[0], b[0], naive_near(a, b), naive_near(a, c))
    return out


def found(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_text"], r["fingerprint"], r["edited_fingerprint"],
                          r["near_edited"], r["near_next"]) for r in df.collect()}


@pytest.mark.parametrize("run_rows", [7, 64, 10_000])
def test_against_walking_the_texts(spark, small, run_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(edited_fingerprints(docs, run_rows=run_rows)) == naive(rows)


def test_sections_and_odd_texts(spark):
    texts = ["", None, "\n", "\n\n\na", "One.\nTwo.\n\nThree", "One.\nTwo.\n\nThree", "x" * 500, "é😀. " * 99, "a\r\n\r\nb",
             "Ends with a stop.\n\n", "  \t\n"]
    rows = [(i * 3 - 4, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("_text", F.lit(2))
    for run_rows in (2, 100):
        assert found(edited_fingerprints(docs, run_rows=run_rows)) == naive(rows)
    whole = {r["doc_id"]: r for r in document_trees(docs).collect()}
    assert whole[8]["root"] == whole[11]["root"] and len(whole[8]["sections"]) == 2
    assert len({r["root"] for r in whole.values()}) == len(texts) - 1  # '' and null, and the repeated text


def test_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(5, "A text. And more.")], "doc_id long, text string")
    row = edited_fingerprints(one).first()
    assert row["near_next"] == 1.0 and row["edited_text"] == "A text. A" + "A text. "
    assert edited_fingerprints(empty).count() == 0


def test_hot_id_and_repeated_rows(spark, odd):
    """An id with a third of all rows is cut into several runs; each row meets the next one in order."""
    rows = [(i if i % 3 else 100, f"text {i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = with_next(docs, run_rows=10_000)
    many = with_next(docs, run_rows=16)
    plain = lambda df: sorted((r["doc_id"], r["_text"], r["_next"]["_text"]) for r in df.collect())
    assert plain(one) == plain(many) and len(plain(one)) == 300
    runs = with_next(docs, run_rows=16).where("doc_id = 100")
    assert runs.count() == 101
    assert edited_fingerprints(odd, run_rows=3).count() == odd.count()


def test_edits_are_located(spark):
    before = spark.createDataFrame([
        (1, "Head\n\nFirst line.\nSecond line.\n\nTail"), (2, "same"), (3, "a\nb\n"), (None, "x")], "doc_id long, text string")
    after = spark.createDataFrame([
        (1, "Head\n\nFirst line.\nSecond word.\n\nTail"), (2, "same"), (3, "a\nb\nc\n\nd"), (None, "y"), (9, "new")],
        "doc_id long, text string")
    edits = edited_branches(document_trees(before), document_trees(after)).collect()
    assert sorted(((r["doc_id"] or 0), r["section"], r["paragraph"], r["edit"]) for r in edits) == [
        (0, 0, 0, "changed"), (1, 1, 1, "changed"), (3, 0, 2, "added"), (3, 1, 0, "added")]
