"""Scans: observation files, keyed files, payloads, landed records, file listings."""

from pyspark.sql import functions as F, types as T

from ..operators.quantiles import union_all
from ..operators.ranks import exact_rank
from ..operators.storage import input_order


def read_csv(spark, paths, schema, multi_line=None, keep_order=False, corrupt=None):
    """CSV files with a header, appended, under a declared schema.

    Quoted line breaks are honoured, which takes one task per file. If it is not
    said whether there are any, one pass over the lines looks for one, and files
    without any are split between tasks. ``corrupt`` names a column for rows that do
    not fit; ``keep_order`` adds ``input_order`` (files in the order given).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if multi_line is None:
        multi_line = has_quoted_line_breaks(spark, paths)
    declared = schema
    if corrupt:
        declared = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType(), True)])
    reader = (spark.read.schema(declared).option("header", True).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"').option("enforceSchema", not corrupt)
              .option("mode", "PERMISSIVE"))
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt).option("enforceSchema", True)
    df = reader.csv(paths)
    return input_order(df, paths) if keep_order else df


def has_quoted_line_breaks(spark, paths):
    """Whether some line holds an odd number of quotes: its record goes on in the next."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(paths).where(quotes % 2 == 1).isEmpty()


def read_keyed_csv(spark, paths, schema, key="id", **options):
    """CSV whose first column is the row key, whatever its header says."""
    first = schema.fields[0]
    return read_csv(spark, paths, schema, **options).withColumnRenamed(first.name, key)


def read_many(spark, groups, **options):
    """Append files of different schemas by column name; missing ones are null.

    ``groups`` is a list of (paths, schema).
    """
    return union_all([read_csv(spark, paths, schema, **options) for paths, schema in groups])


def read_json(spark, paths, schema):
    """One JSON document per line under a declared schema; bad lines become null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(paths)


def parse_payload(df, column, schema, name="payload"):
    """JSON text column -> struct; text that is not JSON gives null fields."""
    return df.withColumn(name, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))


def read_landed(spark, path, schema, start=None, end=None):
    """Landed enrichment records: one ``index<TAB>record`` per line.

    Keeps records with an index between start and end, both included, removes
    literal line breaks and splits the record at commas into the columns of
    ``schema``; a value that does not fit its type becomes null.
    """
    lines = spark.read.text(path)
    cut = F.split("value", "\t", 2)
    records = lines.select(F.expr("try_cast(split(value, '\t', 2)[0] AS BIGINT)").alias("index"),
                           F.get(cut, F.lit(1)).alias("record"))
    return split_records(records, "record", schema, "index", start, end)


def split_records(df, column, schema, index=None, start=None, end=None):
    """Comma-separated record column -> typed columns, for an index range."""
    if index and start is not None:
        df = df.where(F.col(index) >= start)
    if index and end is not None:
        df = df.where(F.col(index) <= end)
    clean = F.regexp_replace(column, r"\\n|\n", "")
    parts = df.select(*([index] if index else []), F.split(clean, ",").alias("_p"))
    typed = [F.get("_p", F.lit(i)).try_cast(f.dataType).alias(f.name)
             for i, f in enumerate(schema.fields)]
    return parts.select(*([index] if index else []), *typed)


def list_files(spark, root, pattern="*"):
    """All files below a folder: path, name, folder. File contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root).select("path"))
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"),
        F.element_at(F.split("path", "/"), -2).alias("folder"))


def labelled_files(listing):
    """Label = parent folder, class number = alphabetical position of the label."""
    classes = listing.select("folder").distinct()
    numbered = exact_rank(classes, "folder", name="_rank").select(
        "folder", (F.col("_rank") - 1).alias("class_index"))
    return listing.join(numbered, "folder").select(
        "path", "name", F.col("folder").alias("label"), F.col("class_index").cast("int"))


def file_ids(listing, tail=6):
    """Observation id = name without its last ``tail`` characters."""
    stem = F.expr(f"substring(name, 1, length(name) - {int(tail)})")
    return listing.select("path", stem.try_cast("long").alias("id")).where("id is not null")


def sub_images(listing, consecutive=True):
    """Parts ``<id>_<letter>.<ext>`` of an image, in letter order.

    With ``consecutive`` an image's parts stop at the first missing letter. An
    id has one part per letter, so the set of its letters is a bounded group.
    """
    stem = r"^(\d+)_([a-z])\.\w+$"
    named = listing.where(F.col("name").rlike(stem)).select(
        "path", F.regexp_extract("name", stem, 1).cast("long").alias("id"),
        F.regexp_extract("name", stem, 2).alias("suffix"))
    return consecutive_parts(named) if consecutive else named


def consecutive_parts(df, key="id", suffix="suffix"):
    """Rows whose suffix belongs to an unbroken run a, b, c, ... of their key.

    Letters are combined to one bit set per key before the shuffle, however
    often a letter repeats.
    """
    number = F.ascii(suffix) - F.ascii(F.lit("a"))
    bits = df.groupBy(key).agg(F.expr(
        f"bit_or(shiftleft(1, ascii({suffix}) - ascii('a')))").alias("_bits"))
    below = (F.lit(2) * F.expr(f"shiftleft(1, ascii({suffix}) - ascii('a'))") - 1)
    joined = df.join(bits, key)
    return joined.where(F.col("_bits").bitwiseAND(below.cast("int")) == below) \
                 .where(number >= 0).drop("_bits")


def from_rows(spark, rows, schema):
    """In-memory table, for tests and small lookups."""
    return spark.createDataFrame(rows, schema)
