"""Tables that hold no tumour cells, one habitat, near ties: results as of the SQL, or empty ones, and no errors."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridwright.jobs import catalog, presets
from gridwright.operators import metrics, mixture

from .test_oracles import SF, same

NO_ROWS = ("m12_chosen_k", "m13_gap_statistic", "q6_atlas_verdicts", "m11_spectral_k", "m22_atlas_choice", "m25_atlas_stability", "m4_method_sizes", "q1_classic_sizes", "q3_joint_two_passes", "q5_discovery_cells", "r15_boundary_axes")
BY_SQL = ("a21_group_verdicts", "a31_descriptors", "a37_certainty", "a37_run_summary", "f25_classification_entropy", "g4_kernel_statistic", "k1_result_cells", "k9_cells_by_subject", "m23_frozen_shares", "m33_projection", "p15_confidence", "q12_scheme_sweep", "m33_explained", "e4_per_class")


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """(folder, DuckDB): every line is filled and returned, so that all cells are reference tissue of one habitat."""
    path = tmp_path_factory.mktemp("bare")
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumns({"l_linestatus": F.lit("F"), "l_returnflag": F.lit("A")}).write.parquet(str(path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", NO_ROWS)
def test_no_tumour_cells_give_no_rows(spark, bare, name):
    assert not catalog.QUERIES[name](spark, bare[0]).collect()


@pytest.mark.parametrize("name", BY_SQL)
def test_no_tumour_cells_by_sql(spark, bare, name):
    same(catalog.QUERIES[name](spark, bare[0]).toPandas(), bare[1].execute(catalog.SQL[name]).df())


def test_kernel_test_without_groups(spark, bare):
    (row,) = catalog.QUERIES["g4_kernel_test"](spark, bare[0]).collect()
    assert row.f is None and row.p is None and row.n_perm == 499


def test_score_without_components(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    (row,) = mixture.score(df, mixture.nothing()).collect()
    assert row.proba == [] and row.label is None and row.confidence is None


def test_classes_without_a_hit_are_null_on_demand(spark):
    table = spark.createDataFrame([(0, 0, 3), (1, 0, 1), (1, 2, 1)], "t int, p int, n long")
    found = {r.cls: (r.precision, r.recall, r.f1) for r in metrics.per_class(table, without=None).collect()}
    assert found[0][:2] == (0.75, 1.0) and found[1] == (None, None, None) and 2 not in found
    assert {r.cls: r.f1 for r in metrics.per_class(table).collect()}[1] == 0.0


def test_presets_hold_no_arrays_of_seeds(spark):
    """Weights of a cell are columns: a plan with functions over arrays took minutes for thousands of subjects."""
    s = presets.placed(spark.createDataFrame([(i, n) for i, n in enumerate(presets.PRESETS)], "subject int, preset string"))
    plan = presets.tumour_cells(s)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    seen = {r.preset: set(r.t) for r in presets.tumour_cells(s).groupBy("preset").agg(F.collect_set("truth").alias("t")).collect()}
    assert all(seen[n] <= {z[0] for z in seeds} for n, (_, _, _, seeds) in presets.PRESETS.items()) and len(seen) == 7


def test_joint_results_of_runs_without_cells(spark, bare):
    found, wanted = catalog.QUERIES["s12_joint_results"](spark, bare[0]), bare[1].execute(catalog.SQL["s12_joint_results"]).df()
    assert found.columns == list(wanted.columns) and not len(wanted) and not found.collect()
