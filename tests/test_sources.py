"""Points codec, image sources, text formats, checkpoints and procedures."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from posegrid import registry, schemas
from posegrid.functions import synthetic
from posegrid.operators import procedures as proc
from posegrid.operators import rules, storage
from posegrid.plans.graph_queries import _even_verifier, _index_matcher
from posegrid.sources import images, points, trajectories
from posegrid.streaming.checks import stream_violations


def blob(n=2, magic=points.MAGIC, version=1, count=None):
    head = struct.pack("<8sIQffffff", magic, version, n if count is None else count, 0, 0, 0, 1, 1, 1)
    return head + b"".join(struct.pack("<fffBBBBHQ", 1.5 * k, 0, -1, 255, k, 0, 7, 65535, 2**63 + k) for k in range(n))


def test_layout_and_errors():
    assert len(blob()) == 44 + 2 * 26 and points.RECORD.itemsize == points.RECORD_SIZE
    got = points.records(blob() + b"trailing")
    assert got["point3d_id"].tolist() == [2**63, 2**63 + 1] and got["track_len"].tolist() == [65535] * 2
    for bad, rule in ((blob()[:10], "short_header"), (blob(magic=b"XXXXXXXX"), "magic"), (blob(version=2), "version"), (blob(count=3), "too_small_records")):
        with pytest.raises(points.PointsError, match=rule):
            points.records(bad)
    assert len(points.records(blob(0))) == 0


def test_data_source_round_trip(spark, tmp_path):
    spark.dataSource.register(points.PointsDataSource)
    (tmp_path / "a.points").write_bytes(blob(5))
    df = spark.read.format("points_v1").option("recordsPerPartition", 2).load(str(tmp_path / "a.points"))
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("point3d_id").collect()
    assert [int(r["point3d_id"]) for r in rows] == [2**63 + k for k in range(5)] and rows[1]["x"] == 1.5 and rows[4]["g"] == 4
    df.repartition(2).write.format("points_v1").mode("overwrite").save(str(tmp_path / "out"))
    again = spark.read.format("points_v1").load(str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    (tmp_path / "bad.points").write_bytes(blob(magic=b"XXXXXXXX"))
    with pytest.raises(Exception, match="bad magic"):
        spark.read.format("points_v1").load(str(tmp_path / "bad.points")).collect()


def test_decode_column(spark):
    df = spark.createDataFrame([(1, bytearray(blob(3))), (2, bytearray(blob(0)))], "k int, content binary")
    got = points.decode(df, "content", "k").orderBy("pos").collect()
    assert [(r["k"], r["pos"], r["x"]) for r in got] == [(1, 0, 0.0), (1, 1, 1.5), (1, 2, 3.0)]


def test_image_source(spark, tmp_path):
    for name, data in (("a.jpg", b"x"), ("b.jpg", b"yy"), ("c.txt", b"z")):
        (tmp_path / name).write_bytes(data)
    found = images.materialize(spark, str(tmp_path), "*.jpg")
    assert sorted((r["name"], r["size"]) for r in found.collect()) == [("a.jpg", 1), ("b.jpg", 2)]
    one, two = (images.source_fingerprint(df).first()[0] for df in (found, found.repartition(5)))
    assert one == two and len(one) == 64


def test_trajectories(spark, tmp_path):
    (tmp_path / "tum.txt").write_text("# t x y z qx qy qz qw\n1.5 1 2 3 0 0 0 1\n")
    (tmp_path / "kitti.txt").write_text("1 0 0 4 0 1 0 5 0 0 1 6\n")
    (tmp_path / "cameras.txt").write_text("# id model w h params\n1 PINHOLE 640 480 500 500 320 240\n")
    (tmp_path / "euroc.csv").write_text("#timestamp,px\n10,1,2,3,1,0,0,0\n")
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    tum = trajectories.read_tum(spark, str(tmp_path / "tum.txt")).first()
    assert tum["r"] == eye and tum["t"] == [1.0, 2.0, 3.0] and tum["timestamp"] == 1.5
    assert trajectories.read_kitti(spark, str(tmp_path / "kitti.txt")).first()["t"] == [4.0, 5.0, 6.0]
    cameras = trajectories.read_cameras_text(spark, str(tmp_path / "cameras.txt"))
    assert rules.violations(cameras, rules.camera_rules(), "camera_id").count() == 0
    assert trajectories.read_euroc(spark, str(tmp_path / "euroc.csv")).first()["r"] == eye


def test_checkpoints(spark):
    c = spark.createDataFrame([("j", k) for k in (*range(1, 7), 99_999_999, 100_000_000)], "job string, seq long")
    kept = sorted(r["seq"] for r in storage.collectable(c, 3).collect())
    assert kept == [1, 2, 3, 4, 5]
    assert [r["seq"] for r in storage.collectable(c, 1).where("seq > 10").collect()] == [100_000_000]  # by name it comes before 99999999
    assert storage.collectable(c, 0).count() == 0
    assert storage.latest(c).first()["seq"] == 99_999_999
    files = spark.createDataFrame([("j", "/j/checkpoints/00000001.pcmapin"), ("j", "/j/checkpoints/x.pcmapin"), ("j", "/j/checkpoints/00000002.pcmapin")], "job string, path string")
    notes = spark.createDataFrame([("j", 1, '{"a": 1}'), ("j", 2, "{bad")], "job string, seq long, summary string")
    assert sorted((r["seq"], r["summary"]) for r in storage.list_checkpoints(files, notes).collect()) == [(1, '{"a": 1}'), (2, "{}")]
    assert storage.duplicate_sequences(c, spark.createDataFrame([("j", 3), ("k", 3)], "job string, seq long")).count() == 1


def test_blobs(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, "")], "k int, content string")
    store = storage.with_sha(df.where("k = 3"), "content").select("sha")
    assert sorted(r["size"] for r in storage.new_blobs(df, store).collect()) == [0, 2]
    wanted = storage.with_sha(df, "content").select("sha")
    assert storage.exists(wanted, store).count() == 1 and storage.missing(wanted, store).count() == 3 and storage.delete(store, store).count() == 0
    assert [(r["k"], r["chunk"], bytes(r["data"])) for r in storage.chunks(df, "content", 1, "k").orderBy("k", "chunk").collect()] == [(1, 0, b"a"), (1, 1, b"a"), (2, 0, b"a"), (2, 1, b"a"), (3, 0, b"b")]


def test_registries(spark):
    assert len(schemas.TABLES) == 16 and sum(len(c) for _, c in schemas.TABLES) == 89
    assert schemas.version_number(*schemas.DATABASE_VERSION) == 3140002
    with pytest.raises(ValueError):
        schemas.version_number(3, 100, 0, 0)
    assert schemas.table_schema("images").simpleString() == "struct<image_id:bigint,name:string,camera_id:bigint,time_id:bigint>"
    assert schemas.extension_columns("images") == ["time_id"] and schemas.column_type("images", "nothing") is None
    assert registry.unserved_types(spark).count() == 0
    assert [len(p.split()) for _, p in registry.CAMERA_MODELS] == [3, 4, 4, 5, 8, 8, 12, 5, 4, 5, 12]


def test_traits_and_options():
    for bad in (lambda: proc.MapperTraits(emits_dense=1), lambda: proc.MatcherTraits(detector_free=0), lambda: proc.Options(max_views=0), lambda: proc.Options(seed=True), lambda: proc.Options(extra=3)):
        with pytest.raises(proc.ContractViolation):
            bad()
    assert proc.Options(max_views=2, seed=1, extra={}).max_views == 2


def test_matcher_report_catches_a_growing_verifier(spark):
    import pyarrow as pa

    points_ = synthetic.keypoints(spark)
    pairs = spark.createDataFrame([("view000", "view001")], "image_a string, image_b string")
    matches = proc.match(pairs, points_.select("image_id", "idx"), _index_matcher)
    verdict = lambda v: {r["rule_id"]: r["holds"] for r in proc.matcher_report(matches, points_, proc.MatcherTraits(), v).collect()}
    assert all(verdict(proc.verify(matches, _even_verifier)).values())
    grown = verdict(proc.verify(matches, lambda t: pa.concat_tables([t, t])))
    assert not grown["KIT.verifier_never_grows"] and grown["KIT.verifier_mode"]
    assert not proc.matcher_report(matches, points_, proc.MatcherTraits(detector_free=True)).where("rule_id = 'KIT.mode' AND holds").count()


def test_mapper_report(spark):
    views = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "scene string, view_idx int")
    made = views.select("scene", "view_idx", F.array(F.lit(1.0)).alias("r"), F.array(F.lit(0.0)).alias("t"), F.lit("opencv_cam2world").alias("convention"), F.lit(False).alias("dense"), F.lit("metric").alias("scale"))
    got = {(r["scene"], r["rule_id"]): r["holds"] for r in proc.mapper_report(views, made.where("scene = 's'"), proc.MapperTraits(emits_dense=True)).collect()}
    assert got["s", "KIT.poses_align"] and not got["s", "KIT.emits_dense"] and not got["s", "KIT.metric_capable"]
    assert not got["t", "KIT.two_views"] and not got["t", "KIT.poses_align"]


def test_synthetic(spark):
    assert synthetic.images(spark).select(F.octet_length("pixels")).first()[0] == 8 * 8 * 3
    points_ = synthetic.keypoints(spark)
    assert points_.count() == 18 and points_.where("x < 0 OR x >= 8 OR score < 0 OR score >= 1").count() == 0
    assert synthetic.chain_matches(points_).count() == 12


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0.5), (2, 2.0)], "k int, conf double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, conf double").parquet(str(tmp_path / "in"))
    query = stream_violations(stream, rules.confidence_rules(), "k").writeStream.format("memory").queryName("breaches").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["k"], r["rule_id"]) for r in spark.table("breaches").collect()] == [(2, "CONF.range")]


def test_euroc_camera(spark, tmp_path):
    """The camera's pose is the body's, times the camera's place on the body."""
    (tmp_path / "euroc.csv").write_text("10,1,2,3,0.7071067811865476,0,0,0.7071067811865476\n")  # a quarter turn about z
    mount = [0, -1, 0, 0.5, 1, 0, 0, 0.25, 0, 0, 1, 0, 0, 0, 0, 1]
    got = trajectories.read_euroc(spark, str(tmp_path / "euroc.csv"), mount).first()
    assert got["r"] == pytest.approx([-1, 0, 0, 0, -1, 0, 0, 0, 1], abs=1e-12) and got["t"] == pytest.approx([0.75, 2.5, 3.0], abs=1e-12)


def test_points_uri_and_overwrite(spark, tmp_path):
    spark.dataSource.register(points.PointsDataSource)
    make = lambda n: spark.range(n, numPartitions=2).selectExpr("CAST(id AS DECIMAL(20,0)) AS point3d_id", "CAST(id AS FLOAT) AS x", "0f AS y", "0f AS z", "CAST(1 AS SHORT) AS r", "CAST(1 AS SHORT) AS g", "CAST(1 AS SHORT) AS b", "1 AS track_len")
    where = f"file://{tmp_path}/out"
    for n in (9, 4):
        make(n).write.format("points_v1").mode("overwrite").save(where)
        assert spark.read.format("points_v1").load(where).count() == n
    assert all(f.name.startswith("part-") for f in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="already holds points"):
        make(1).write.format("points_v1").mode("append").save(where)
    failing = make(4).selectExpr("point3d_id", "IF(x = 3, CAST(raise_error('stop') AS FLOAT), x) AS x", "y", "z", "r", "g", "b", "track_len")
    with pytest.raises(Exception, match="stop"):
        failing.write.format("points_v1").mode("overwrite").save(where)
    assert spark.read.format("points_v1").load(where).count() == 4  # the old files go with a commit only


def test_checkpoint_append_and_blob_open(spark):
    old = spark.createDataFrame([("j", 1), ("k", 1)], "job string, seq long")
    fresh = spark.createDataFrame([("j", 2), ("l", 1)], "job string, seq long")
    assert sorted(r["path"] for r in storage.append_checkpoints(old, fresh).collect()) == ["/j/checkpoints/00000002.pcmapin", "/l/checkpoints/00000001.pcmapin"]
    for bad in (old.where("job = 'k'"), fresh.unionByName(fresh)):
        with pytest.raises(Exception, match="CKPT.duplicate_seq"):
            storage.append_checkpoints(old, bad).collect()
    store = storage.with_sha(spark.createDataFrame([("a",), ("b",)], "content string"))
    wanted = store.where("content = 'a'").select("sha")
    got = storage.open_blobs(wanted.unionByName(wanted), store).select("content", storage.local_path(F.lit("/s"), F.col("sha")).alias("p"), "sha").collect()
    assert [(r["content"], r["p"]) for r in got] == [("a", f"/s/{got[0]['sha'][:2]}/{got[0]['sha']}")]


def test_mapper_arguments(spark):
    views = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "scene string, view_idx int")
    seen = views.select("scene").distinct().where("scene = 's'").selectExpr("scene", "1 AS a")

    def mapper(t, matches=None, options=None):
        if matches is None:
            raise proc.ContractViolation("matches are needed")
        n = t.num_rows
        rows = [{"scene": s, "view_idx": v, "r": None, "t": None, "convention": str(matches.num_rows), "dense": False, "scale": str(options.seed if options else None)} for s, v in zip(t.column("scene").to_pylist(), t.column("view_idx").to_pylist())]
        return proc._no_results().schema.empty_table() if not n else proc.pa.Table.from_pylist(rows, proc._no_results().schema)

    got = {(r["scene"], r["view_idx"]): (r["convention"], r["scale"]) for r in proc.map_views(views, mapper, seen, proc.Options(seed=7)).collect()}
    assert got == {("s", 0): ("1", "7"), ("s", 1): ("1", "7"), ("t", 0): ("0", "7")}
    assert {r["scene"]: r["refused"] for r in proc.refusals(views, mapper).collect()} == {"s": True, "t": True}
    with pytest.raises(Exception, match="OPT.max_views"):
        proc.map_views(views, mapper, seen, proc.Options(max_views=1)).collect()
    with pytest.raises(Exception, match="matches are needed"):
        proc.map_views(views, mapper).collect()


def test_extractor_report(spark):
    images_ = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    rows = [("a", 0, 1.0, 2.0, [1.0, 2.0]), ("a", 1, 1.0, 3.0, [1.0, 2.0]), ("b", 1, float("nan"), 2.0, [1.0]), ("b", 1, 1.0, 2.0, [1.0, 2.0])]
    points_ = spark.createDataFrame(rows, "image_id string, idx long, x float, y float, descriptor array<float>")
    got = {(r["image_id"], r["rule_id"]): r["holds"] for r in proc.extractor_report(images_, points_).collect()}
    assert all(got[i, f"KIT.extractor_{k}"] == (i != "b") for i in "abc" for k in ("places", "descriptors", "indices"))


def test_nearest_in_blocks(spark):
    """Blocks of any size give the same, also where one kind holds nearly all rows, with ties and single rows."""
    from posegrid.operators import graph

    rows = [(k, "hot" if k % 20 else "rare", [float((k * 7 + d * k) % 11) for d in range(5)]) for k in range(1, 200)] + [(900, "alone", [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, kind string, v array<float>")
    want = set()
    for a, kind, u in rows:
        found = [(round(sum(x * y for x, y in zip(u, w)), 9), -b) for b, k, w in rows if k == kind and b != a]
        if found:
            want.add((a, -max(found)[1], max(found)[0]))
    for block in (1024, 16):
        assert {tuple(r) for r in graph.nearest(df, df, "kind", "id", "v", block).collect()} == want
    assert graph.nearest(df.limit(0), df, "kind", "id", "v").count() == 0
