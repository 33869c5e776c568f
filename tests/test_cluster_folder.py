"""On a cluster whose folder for steps has no scheme, queries write there and give the SQL's rows."""

import os
import sys
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from check_queries import TABLES, compare, connect  # noqa: E402

from wildgrid.operators import storage  # noqa: E402
from wildgrid.plans import catalogue  # noqa: E402
from wildgrid.session import with_scratch  # noqa: E402

# Own rows: count and columns of each table that the queries below read.
ROWS = {
    "region": (5, ["cast(id AS int) r_regionkey", "concat('R', id) r_name"]),
    "nation": (25, ["cast(id AS int) n_nationkey", "concat('N', id) n_name", "cast(id % 5 AS int) n_regionkey"]),
    "customer": (300, ["id c_custkey", "concat('C', id) c_name", "cast(id * 7 % 25 AS int) c_nationkey",
                       "id * 3.25D c_acctbal", "elt(1 + id % 3, 'A', 'B', 'C') c_mktsegment"]),
    "supplier": (4, ["id s_suppkey", "concat('S', id) s_name", "cast(id AS int) s_nationkey", "id * 1D s_acctbal"]),
    "part": (50, ["id p_partkey", "concat('P', id) p_name", "'b' p_brand", "'t' p_type", "cast(id % 9 AS int) p_size",
                  "id * 2D p_retailprice"]),
    "orders": (600, ["id o_orderkey", "id * 11 % 300 o_custkey", "'F' o_orderstatus", "id * 37 % 911 * 1.5D o_totalprice",
                     "timestamp_ntz'1997-01-01' + make_interval(0, 0, 0, cast(id % 700 AS int)) o_orderdate",
                     "elt(1 + id % 4, '1', '2', '3', '4') o_orderpriority"]),
    "lineitem": (3000, ["id * 7 % 600 l_orderkey", "id % 50 l_partkey", "least(id % 5, 3) l_suppkey",
                        "cast(id % 4 AS int) l_linenumber", "1D + id % 50 l_quantity", "id * 53 % 997 * 1.5D l_extendedprice",
                        "id % 11 / 100D l_discount", "id % 9 / 100D l_tax", "elt(1 + id % 3, 'A', 'N', 'R') l_returnflag",
                        "'O' l_linestatus",
                        "timestamp_ntz'1997-02-01' + make_interval(0, 0, 0, cast(id % 700 AS int)) l_shipdate"]),
    "events": (400, ["id event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 613.25) ts",
                     "id * 7 % 40 user_id", "elt(1 + id * 13 % 5, 'click', 'error', 'purchase', 'signup', 'view') event_type",
                     "id * 29 % 401 + 0.25D value", "'{}' props"]),
    "documents": (120, ["id doc_id", "concat('text ', id % 70) text", "elt(1 + id % 2, 'de', 'en') lang",
                        "concat('s', id % 3) source", "length(concat('text ', id % 70)) n_chars"]),
    "labels": (90, ["id doc_id", "cast(id % 3 = 0 AS int) quality", "cast(id % 7 = 0 AS int) toxic"]),
    "embeddings": (200, ["id vec_id", "transform(sequence(0, 63), k -> cast(sin(id * 64 + k) AS float)) embedding",
                         "cast(id % 10 AS int) label"]),
}


@pytest.fixture(scope="module")
def folder(spark):
    made = tempfile.mkdtemp(prefix="run-")
    for name in TABLES:
        number, columns = ROWS.get(name, (1, ["id"]))
        pq.write_table(spark.range(0, number, 1, 1).selectExpr(*columns).toArrow(), f"{made}/{name}.parquet")
    return made


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as the code sees it below a master of its own."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark


def test_folder_without_a_scheme_lies_on_the_default_file_system(cluster):
    named = cluster.conf.get("spark.checkpoint.dir")
    assert ":" not in named
    assert storage.shared_folder(cluster) == f"file:{named}"
    assert storage.settle(cluster.range(9)).agg(F.sum("id")).first()[0] == 36
    assert not [f for f in os.listdir(named) if f.startswith("probe-")]


def test_folder_that_executors_do_not_share_stops_the_job(cluster, monkeypatch):
    """Each has a disk of its own: the driver finds none of the rows that they wrote."""
    monkeypatch.setattr(storage, "_shared", set())
    monkeypatch.setattr(storage, "returns_rows", lambda *_: False)
    with pytest.raises(RuntimeError, match="do not share"):
        storage.settle(cluster.range(9))


class Unnamed:
    """A session with executors of their own that names a warehouse and no other folder."""

    def __init__(self, spark, warehouse, master):
        self.named, self.master, self.folder = {"spark.sql.warehouse.dir": warehouse}, master, None
        self.spark, self.conf, self.sparkContext = spark, self, Unnamed.Context(self)

    def get(self, key, default=None):
        return self.named.get(key, default)

    def __getattr__(self, name):
        return getattr(self.spark, name)

    class Context:
        def __init__(self, session):
            self.session, self.master = session, session.master

        def getCheckpointDir(self):
            return self.session.folder

        def setCheckpointDir(self, folder):
            self.session.folder = folder

        def __getattr__(self, name):
            return getattr(self.session.spark.sparkContext, name)


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077"])
def test_steps_go_to_the_warehouse_if_no_folder_is_named(spark, tmp_path, master):
    session = with_scratch(Unnamed(spark, f"file:{tmp_path}", master))
    assert storage.shared_folder(session).startswith(f"file:{tmp_path}/")


@pytest.mark.parametrize("fault", ["lost", "refused"])
def test_warehouse_that_executors_do_not_share_is_not_taken(spark, tmp_path, monkeypatch, fault):
    """Rows that vanish, and folders that cannot be made (here below a file), give an error, not empty results."""
    (tmp_path / "file").write_text("")
    if fault == "lost":
        monkeypatch.setattr(storage, "returns_rows", lambda *_: False)
    session = with_scratch(Unnamed(spark, f"file:{tmp_path}/file", "local-cluster[3,2,1024]"))
    with pytest.raises(RuntimeError, match="set spark.checkpoint.dir"):
        storage.shared_folder(session)


@pytest.mark.parametrize("name", [
    "append_metrics",
    "append_twice",
    "balanced_weights",
    "batch_numbers",
    "cascade_accuracy",
    "cascade_error_rate",
    "cascade_error_rate_upper",
    "cascade_rejects",
    "cascade_results",
    "class_size_filter",
    "class_size_quantiles",
    "cleaning_files",
    "cleaning_flow_bad",
    "cleaning_flow_good",
    "country_of_point",
    "dedupe_keep_first",
    "dedupe_tied_order",
    "describe_numeric",
    "elbow_curve",
    "elbow_one_cluster",
    "enrich_stream",
    "embedding_head",
    "exact_quantiles",
    "enrichment_errors",
])
def test_same_as_sql_on_a_cluster(cluster, folder, name):
    queries, oracles = catalogue.load()
    assert compare(cluster, connect(folder), folder, queries[name], oracles[name])[0] == "ok"
