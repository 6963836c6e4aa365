"""Loads of files into bronze and silver tables, reads by key range, and lookups of the store."""

import json
import uuid

import pytest
from geobucket.functions import store as S
from geobucket.functions.geometry import with_geometry
from geobucket.operators import bucketing as B
from geobucket.plans import pipeline, tables, versions
from geobucket.plans.tables import TableSpec
from geobucket.sources import formats
from geobucket.streaming import ingest


@pytest.fixture
def specs(spark):
    tag = uuid.uuid4().hex[:8]
    return TableSpec("default", f"bronze_{tag}"), TableSpec("default", f"silver_{tag}")


def feature_file(folder, points, name="a.geojson", bad=()):
    lines = [json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": list(p)}, "properties": {"id": str(i)}}) for i, p in enumerate(points)]
    path = folder / name
    path.write_text("\n".join([*lines, *bad]))
    return str(path)


def spread(n, shift=0.0):
    return [((i * 37 % 3600) / 10 - 180 + shift, (i * 53 % 1800) / 10 - 90) for i in range(n)]


def counts(spark, silver):
    return {r[0]: r[1] for r in B.bucket_counts(spark.table(silver.name), "bucket_min").collect()}


def test_initial_load(spark, specs, tmp_path):
    bronze, silver = specs
    bad = ['{"type": "Feature", "geometry": null, "properties": {}}', '{"type": "Feature", "geometry": {"type": "Poi"}, "properties": {}}']
    assert pipeline.initial_load(spark, feature_file(tmp_path, spread(500), bad=bad), bronze, silver, properties=["id"]) == 2
    assert spark.table(bronze.name).count() == 502
    rows = spark.table(silver.name).collect()
    assert {r["id"] for r in rows} == {str(i) for i in range(500)} and all(r.geohash_numeric >= r.bucket_min for r in rows)
    sizes = counts(spark, silver)
    assert len(sizes) == 8 and max(sizes.values()) <= 80
    assert {r[0] for r in pipeline.bucket_labels(spark, silver).collect()} == set(sizes)


def partitions(spark, silver):
    return spark.sql(f"SHOW PARTITIONS {versions.data_table(silver).name}").count()


def test_buckets_share_partitions(spark, specs, tmp_path, monkeypatch):
    """Partitions and files follow rows, not buckets; replaced buckets beside live ones are not seen, and vacuum parts them."""
    bronze, silver = specs
    monkeypatch.setattr(versions, "ROWS", 100)
    pipeline.initial_load(spark, feature_file(tmp_path, spread(500)), bronze, silver, properties=["id"], target=2)
    keys = sorted(r[0] for r in spark.table(silver.name).select("geohash_numeric").collect())
    assert len(counts(spark, silver)) > 200 and 2 <= partitions(spark, silver) <= 8
    for a, b in ((keys[0] - 5, keys[30]), (keys[100], keys[200]), (keys[-1] + 1, keys[-1] + 9)):
        assert sorted(r.geohash_numeric for r in pipeline.in_key_range(spark, silver, a, b).collect()) == [k for k in keys if a <= k <= b]
    one = spark.table(silver.name).orderBy("geohash_numeric").offset(250).first()
    x, y = one.geometry.part[0].coordinate[0]
    pipeline.incremental_load(spark, feature_file(tmp_path, [(x, y)] * 3, "b.geojson"), bronze, silver, properties=["id"])
    before, whole = counts(spark, silver), sorted(r.geohash_numeric for r in spark.table(silver.name).collect())
    assert len(whole) == 503 and spark.table(versions.data_table(silver).name).count() > 503
    assert versions.vacuum(spark, silver) == 1 and versions.vacuum(spark, silver) == 0
    assert spark.table(versions.data_table(silver).name).count() == 503
    assert counts(spark, silver) == before and sorted(r.geohash_numeric for r in spark.table(silver.name).collect()) == whole


def test_a_geometry_is_parsed_once(spark, tmp_path):
    raw = formats.read_geojson_lines(spark, feature_file(tmp_path, spread(3)))
    uses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("GeometryCollection")
    assert uses(pipeline.refined(raw)) == uses(with_geometry(raw, "geometry", "geojson", ["geohash"]))


def test_type_is_checked_before_anything_is_written(spark, specs, tmp_path):
    bronze, silver = specs
    with pytest.raises(ValueError):
        pipeline.initial_load(spark, feature_file(tmp_path, spread(3)), bronze, silver, fmt="wkb")
    assert not spark.catalog.tableExists(bronze.name)


def test_incremental_load_touches_only_its_buckets(spark, specs, tmp_path):
    bronze, silver = specs
    pipeline.initial_load(spark, feature_file(tmp_path, spread(500)), bronze, silver, properties=["id"])
    before = counts(spark, silver)
    files = lambda: {r.bucket_min: r.load for r in versions.parts(spark, silver, versions.current(spark, silver)).collect()}
    old = files()
    one = spark.table(silver.name).orderBy("geohash_numeric").offset(250).first()
    x, y = one.geometry.part[0].coordinate[0]
    added = [(x + k * 1e-2, y) for k in range(150)]
    found = {r.bucket_min: r.record_count for r in pipeline.incremental_load(spark, feature_file(tmp_path, added, "b.geojson"), bronze, silver, properties=["id"]).collect()}
    assert sum(found.values()) == 650 == spark.table(silver.name).count() and spark.table(bronze.name).count() == 650
    assert max(found.values()) <= B.MOST
    same = {b for b in before if found.get(b) == before[b]}
    assert len(same) >= 5 and all(files()[b] == old[b] for b in same)
    assert all(r.geohash_numeric >= r.bucket_min for r in spark.table(silver.name).collect())


def test_rows_below_all_buckets(spark, specs, tmp_path):
    """They are clamped into the lowest bucket; once it is split, its label follows its least key."""
    bronze, silver = specs
    pipeline.initial_load(spark, feature_file(tmp_path, [(100 + i / 100, 50) for i in range(100)]), bronze, silver)
    pipeline.incremental_load(spark, feature_file(tmp_path, [(-170 + i / 10, -80) for i in range(200)], "b.geojson"), bronze, silver)
    assert spark.table(silver.name).count() == 300 and max(counts(spark, silver).values()) <= B.MOST


def test_key_range(spark, specs, tmp_path):
    bronze, silver = specs
    pipeline.initial_load(spark, feature_file(tmp_path, spread(500)), bronze, silver)
    keys = sorted(r[0] for r in spark.table(silver.name).select("geohash_numeric").collect())
    for a, b in ((keys[0] - 5, keys[30]), (keys[100], keys[200]), (keys[-1] + 1, keys[-1] + 9), (keys[7] + 1, keys[-1])):
        got = pipeline.in_key_range(spark, silver, a, b)
        assert sorted(r.geohash_numeric for r in got.collect()) == [k for k in keys if a <= k <= b]
    plan = pipeline.in_key_range(spark, silver, keys[100], keys[101])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket_min" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_equal_keys_cannot_be_split(spark):
    df = spark.createDataFrame([(7, 7)] * 200 + [(i, 100) for i in range(100, 229)] + [(i, 1000) for i in range(1000, 1128)], "k long, bucket_min long")
    got = {r[0]: r[1] for r in B.bucket_counts(B.split_oversize(df, "k")).collect()}
    assert got[7] == 200 and got[1000] == 128 and sorted(v for k, v in got.items() if 100 <= k < 229) == [64, 65]
    assert B.unsplittable(df, "k").collect() == [(7, 200)]


def test_stream_appends_to_buckets(spark, specs, tmp_path):
    _, silver = specs
    (tmp_path / "in").mkdir()
    feature_file(tmp_path / "in", spread(50))
    rows = pipeline.refined(ingest.stream_features(spark, str(tmp_path / "in")))
    assert rows.isStreaming
    batch = formats.read_geojson_lines(spark, str(tmp_path / "in"))
    assert batch.count() == 50
    for k in range(2):  # the second run finds no new file
        ingest.ingest(ingest.stream_features(spark, str(tmp_path / "in")), silver, str(tmp_path / "check")).awaitTermination()
        assert spark.table(silver.name).count() == 50
    feature_file(tmp_path / "in", spread(400, 0.01), "b.geojson")
    ingest.ingest(ingest.stream_features(spark, str(tmp_path / "in")), silver, str(tmp_path / "check")).awaitTermination()
    assert spark.table(silver.name).count() == 450 and max(counts(spark, silver).values()) <= B.MOST
    pipeline.merged(pipeline.refined(batch), silver, ingest.load_id(str(tmp_path / "check"), 0))  # a batch that is tried again
    assert spark.table(silver.name).count() == 450


#: Where a load breaks off, whether after that step or before it, and whether it is the table's first.
BREAKS = [("tables.create_table", True, True), ("versions.commit", False, True), ("versions.write_load", False, False), ("versions.write_load", True, False), ("versions.renamed", False, False), ("versions.commit", True, False), ("versions.shown", True, False)]


@pytest.mark.parametrize(("step", "after", "first"), BREAKS)
def test_a_load_that_breaks_off(spark, specs, tmp_path, monkeypatch, step, after, first):
    """Readers see all of a load or nothing of it, and a second run leaves each row once."""
    bronze, silver = specs
    files = [feature_file(tmp_path, spread(100), "a.geojson"), feature_file(tmp_path, spread(150, 0.05), "b.geojson")]
    if not first:
        pipeline.initial_load(spark, files[0], bronze, silver, properties=["id"], load="one")
    run = (lambda: pipeline.initial_load(spark, files[0], bronze, silver, properties=["id"], load="one")) if first else (lambda: pipeline.incremental_load(spark, files[1], bronze, silver, properties=["id"], load="two"))
    module, name = step.split(".")
    module = {"tables": tables, "versions": versions}[module]

    def broken(*a, f=getattr(module, name), **b):
        if after:
            f(*a, **b)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(module, name, broken)
        with pytest.raises(OSError):
            run()
    seen = spark.table(silver.name).count() if spark.catalog.tableExists(silver.name) else 0
    assert seen in ((0, 100) if first else (100, 250))
    for _ in range(2):
        run()
        rows = spark.table(silver.name).select("id", "bucket_min", "geohash_numeric").collect()
        want = [str(i) for i in range(100)] + ([] if first else [str(i) for i in range(150)])
        assert sorted(r.id for r in rows) == sorted(want) and spark.table(bronze.name).count() == len(want)
        assert all(r.geohash_numeric >= r.bucket_min for r in rows)


def test_two_loads_at_once(spark, specs, tmp_path, monkeypatch):
    """The one that commits second starts again from the other's version."""
    bronze, silver = specs
    pipeline.initial_load(spark, feature_file(tmp_path, spread(100)), bronze, silver, properties=["id"], load="one")
    real, runs = versions.commit, []

    def commit(*a, **b):
        if not runs:
            runs.append(1)
            pipeline.incremental_load(spark, feature_file(tmp_path, spread(90, 0.02), "b.geojson"), bronze, silver, properties=["id"], load="between")
        return real(*a, **b)

    monkeypatch.setattr(versions, "commit", commit)
    pipeline.incremental_load(spark, feature_file(tmp_path, spread(120, 0.04), "c.geojson"), bronze, silver, properties=["id"], load="outer")
    assert versions.current(spark, silver) == 3 and spark.table(silver.name).count() == 310 == spark.table(bronze.name).count()
    assert versions.vacuum(spark, silver) > 0 and spark.table(silver.name).count() == 310
    assert versions.live(spark, silver, 3).count() == 310 and versions.vacuum(spark, silver) == 0
    with pytest.raises(ValueError):
        pipeline.initial_load(spark, feature_file(tmp_path, spread(3), "d.geojson"), bronze, silver, properties=["id"])
    with pytest.raises(ValueError):
        pipeline.incremental_load(spark, feature_file(tmp_path, spread(3), "d.geojson"), bronze, silver, load="a'b")


def test_files_of_lines(spark, tmp_path):
    for name, n in (("a", 3), ("b", 0), ("c", 2)):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None, "properties": {"k": i}} for i in range(n)]}))
    formats.collection_to_lines(spark, str(tmp_path / "a.geojson"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3
    got = formats.collections_to_lines(spark, str(tmp_path), str(tmp_path / "all"))
    assert {(r.lines_file, r.features) for r in got.collect()} == {("a_ndjson.json", 3), ("c_ndjson.json", 2)}
    assert formats.geometry_column(spark.createDataFrame([(1, 2)], "id int, GeoMetry int")) == "GeoMetry"
    with pytest.raises(ValueError):
        formats.geometry_column(spark.range(1))


def test_geometry_types(spark):
    from geobucket.functions.geometry import with_geometry

    shapes = {
        "GEOMETRYCOLLECTION (POINT (1 2))": 0, "POINT (1 2)": 1, "LINESTRING (0 0, 4 0)": 2, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))": 3,
        "MULTIPOINT ((1 2), (3 4))": 4, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))": 5, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))": 6,
    }
    df = spark.createDataFrame([(w,) for w in shapes], "geometry string").selectExpr("geometry", "geometry AS wkt")
    got = {r.wkt: r.geometry for r in with_geometry(df, "geometry", "wkt", ["area", "center"], "double").collect()}
    assert {w: g.type for w, g in got.items()} == shapes
    assert [len(got[w].part) for w in shapes] == [0, 1, 1, 2, 2, 2, 2] and got[list(shapes)[3]].area == 99
    assert (got["LINESTRING (0 0, 4 0)"].center.x, got["LINESTRING (0 0, 4 0)"].center.y) == (2, 0)
    assert (got["GEOMETRYCOLLECTION (POINT (1 2))"].center.x, got["GEOMETRYCOLLECTION (POINT (1 2))"].center.y) == (1, 2)


def test_store(spark):
    items = spark.createDataFrame([(1, 199), (2, 5), (3, -199)], "id int, price int")
    from pyspark.sql import functions as F

    assert [r[0] for r in items.orderBy("id").select(S.discounted(F.col("price"), F.lit(15))).collect()] == [169, 4, -169]
    big = spark.createDataFrame([(2**53 + 1,)], "price long")
    assert big.select(S.discounted(F.col("price"), F.lit(0))).first()[0] == 2**53 + 1
    assert S.item_by_index(items, "id", 1).collect() == [(1, '{"id":2,"price":5}')] and not S.item_by_index(items, "id", 9).collect()
    views = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "id int, review_text string")
    assert {r.review_text for r in S.views_of(views, items, 1).collect()} == {"x", "y"} and not S.views_of(views, items, 9).collect()
    assert S.exists(items, id=2, price=5).first()[0] and not S.exists(items, id=2, price=6).first()[0]
    carts = spark.createDataFrame([([1], 5, 2), ([2], 6, 1)], "items array<int>, totalprice int, at int")
    got = S.receipts(carts, "at").orderBy("id").collect()
    assert [(r.id, r.totalprice, r.orderStatus) for r in got] == [(1, 6, "Pending"), (2, 5, "Pending")] and all(r.timeofshopping for r in got)
    dates = spark.createDataFrame([("2024-02-29",), ("x",)], "t string").filter("t != 'x'")
    assert dates.select(S.date_text(S.text_date(F.col("t")))).first()[0] == "2024-02-29"
