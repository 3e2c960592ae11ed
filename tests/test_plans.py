from axisloom import cli, queries
from axisloom.plans import routing
from axisloom.sources import measures, shared, store

from .test_measures import moved, stages
from .test_model import sample

SF = "/root/testdata/sf0.001"


def test_routing(spark):
    ds, _ = sample(spark)
    ds.axes["umap"].induced_by = None
    ds.add_field("loadings", spark.createDataFrame([(j, [0.1, 0.2]) for j in range(20)], "i long, vec array<double>"), role="loading")
    ds.add_field("odd", spark.createDataFrame([(0, 0, 0, 1.0)], "i long, j long, k long, v double"), span=("cells", "genes", "umap"), role="measure", state="raw")
    got = {r["field"]: r["slot"] for r in routing.routed(ds).collect()}
    assert got == {"counts": "X", "umap": "obsm/X_umap", "leiden": "obs/leiden", "loadings": "varm/loadings", "odd": None}
    assert ds.dropped == ["fields/odd"]
    assert [tuple(r) for r in routing.facets(ds).collect()] == [("umap", "loadings", "umap")]


def test_command_line(spark, tmp_path, capsys):
    ds, _ = sample(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store.write(ds, a)
    assert cli.main(["validate", a], spark) == 0 and cli.main(["convert", a, b, "--codec", "gzip"], spark) == 0
    assert cli.main(["navigators", b], spark) == 0 and cli.main(["inspect", b], spark) == 0
    assert "od_score" in store.read(spark, b).fields and '"lossless": true' in capsys.readouterr().out


def ran(df):
    df.write.format("noop").mode("overwrite").save()


def test_navigators_move_each_entry_twice(spark):
    """Once as a line to its row and once to its column, however many groupings there are."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert moved(spark, lambda: ran(queries.navigators_two_groupings(spark, SF))) < 2.6 * lines


def test_columns_over_their_share_are_summed_by_parts(spark, monkeypatch):
    want = queries.navigators_two_groupings(spark, SF).localCheckpoint()
    monkeypatch.setattr(measures, "HOT", 1e-9)  # now each column is
    got = queries.navigators_two_groupings(spark, SF).localCheckpoint()
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_tasks_of_navigators_do_not_grow_with_the_tables(spark, monkeypatch):
    for module in (shared, queries):
        monkeypatch.setattr(module, "TASK_ROWS", 500)
    before = stages(spark)
    ran(queries.navigators_built(spark, SF))
    large = [s for k, s in stages(spark).items() if k not in before and s.shuffleReadRecords() > 4000]
    assert large and all(s.numTasks() >= 12 for s in large)  # 6,000 lines
