"""Places where a query once did less than its whole job."""

from cairn.plans import entities, kernels
from cairn.terrain import sight

HILLS = sight.Surface(kernels._hills)
TOWER = "id string, region string, location struct<lat double, lon double>, elevation_m double"


def _towers(spark, folder, *places):
    spark.createDataFrame([(f"t{i}", "R", p, 0.0) for i, p in enumerate(places)], TOWER).write.parquet(f"{folder}/tower.parquet")
    return str(folder)


def test_panoramas_have_every_bearing_and_reach_60_km(spark, tmp_path):
    got = kernels.panoramas(spark, _towers(spark, tmp_path, (45.0, -116.0))).toPandas()
    assert sorted(got["az"].unique()) == [float(a) for a in range(360)]
    assert got["crest_m"].max() > 15_000 and got["layer"].max() == 3


def test_sight_overlay_sees_40_km_in_one_grid(spark, tmp_path):
    places = [(45.08, -116.0), (45.17, -116.0)]  # 10 km apart
    got = kernels.sight_overlay(spark, _towers(spark, tmp_path, *places)).toPandas()
    each = [sight.viewshed(HILLS, *p, 10.0, most=40_000.0, cell_m=75.0, grid_lat=45.125) for p in places]
    cells = [set(zip(v["ix"], v["iy"], strict=True)) for v in each]
    assert cells[0] & cells[1]
    assert {(r.ix, r.iy) for r in got[got["seen_by"] == 2].itertuples()} == cells[0] & cells[1]
    assert {(r.ix, r.iy) for r in got.itertuples()} == cells[0] | cells[1]
    y, x = (got["iy"] - got["iy"].median()) * 75.0, (got["ix"] - got["ix"].median()) * 75.0
    assert (x**2 + y**2).max() ** 0.5 > 10_000


def test_viewshed_reaches_its_edge_on_all_sides():
    flat = sight.Surface(lambda a, o: 0.0 * a)
    v = sight.viewshed(flat, 60.0, 10.0, above=2000.0, most=40_000.0, cell_m=250.0, grid_lat=45.0)
    assert abs(v["cell_m2"].sum() / (3.14159265 * 40_000.0**2) - 1) < 0.001


def test_shared_points_chain_at_500_m_and_count_own_names(spark, tmp_path):
    step = 400 / 111_195  # degrees of latitude
    rows = [(i, n, 45.0 + i * step, -116.0) for i, n in enumerate(["Lindsay Lookout", "Tweed Fire Tower", "Pembroke"])]
    rows += [(10 + i, n, 50.0 + i * step / 4, -116.0) for i, n in enumerate(["Rye Lookout", "Rye Fire Tower", "rye", "Kitty  Lake", None])]
    rows += [(20 + i, n, 55.0 + i * step * 1.5, -116.0) for i, n in enumerate(["A", "B", "C"])]  # 600 m apart
    spark.createDataFrame(rows, "record_id long, name string, lat double, lon double").write.parquet(f"{tmp_path}/source_record.parquet")
    assert [tuple(r) for r in entities.shared_points(spark, str(tmp_path)).collect()] == [(0, 3, 3)]
