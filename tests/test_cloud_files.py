"""Cloud files by byte ranges, and tasks that commit or abort."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pointloom.sources import ranges, readers, sinks


def vertices(n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({**{c: rng.uniform(-5, 5, n) for c in "xyz"}, **{c: rng.integers(0, 256, n) for c in ("red", "green", "blue")}, "semantic": rng.integers(0, 3, n), "instance": rng.integers(0, 9, n)})


def ply(table, form, faces=0):
    kinds = {"x": ("double", "f8"), "y": ("double", "f8"), "z": ("double", "f8"), "red": ("uchar", "u1"), "green": ("uchar", "u1"), "blue": ("uchar", "u1"), "semantic": ("int", "i4"), "instance": ("short", "i2")}
    head = ["ply", f"format {form} 1.0", f"element vertex {len(table)}", *(f"property {k[0]} {c}" for c, k in kinds.items())]
    head += [f"element face {faces}", "property list uchar int vertex_indices"] if faces else []
    head = "\n".join([*head, "end_header", ""]).encode()
    if form == "ascii":
        rows = [" ".join(repr(v) for v in r) for r in table.itertuples(index=False, name=None)]
        return head + "\n".join([*rows, *["7 900 900 900 900 900 900 900"] * faces]).encode() + b"\n"
    order = ">" if "big" in form else "<"
    out = np.empty(len(table), [(c, order + k[1]) for c, k in kinds.items()])
    for c in kinds:
        out[c] = table[c]
    return head + out.tobytes() + b"\x03" * 13 * faces


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("faces", [0, 40])
def test_ranges_equal_the_whole_file(spark, tmp_path, form, faces):
    for k, n in enumerate((0, 1, 700)):
        (tmp_path / f"s{k}.ply").write_bytes(ply(vertices(n, k), form, faces))
    dim = vertices(50, 9)
    dim[["red", "green", "blue"]] //= 255  # colours of 0 and 1 are not scaled, whatever the faces hold
    (tmp_path / "dim.ply").write_bytes(ply(dim, form, faces))
    (tmp_path / "none.ply").write_bytes(b"")
    expected = []
    for f in sorted(os.listdir(tmp_path)):
        t = readers.parse_cloud(f, (tmp_path / f).read_bytes())
        expected += [(f[:-4], i, *map(float, r)) for i, r in enumerate(t.itertuples(index=False, name=None))]
    for span in (97, 4096, 1 << 26):
        found = ranges.clouds(spark, str(tmp_path), span=span).collect()
        assert sorted((r[0], r[1], *map(float, r[2:])) for r in found) == sorted(expected)


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "large.ply").write_bytes(ply(vertices(20_000), "binary_little_endian"))
    told = ranges.ranges(spark, str(tmp_path), "ply$", 1 << 16).collect()
    assert len(told) > 8 and sum(r["stop"] - r["start"] for r in told) == 20_000
    read = ranges.clouds(spark, str(tmp_path), columns=("z", "inst"), span=1 << 16)
    assert read.columns == ["scene_id", "point_id", "z", "inst"]
    assert read.select(F.spark_partition_id()).distinct().count() > 4
    assert read.select("point_id").distinct().count() == 20_000


def test_arrays_by_rows_and_columns_and_pcd(spark, tmp_path):
    a = np.random.default_rng(3).uniform(0, 1, (300, 6))
    np.save(tmp_path / "rows.npy", a)
    np.save(tmp_path / "columns.npy", np.asfortranarray(a))
    packed = (np.arange(300, dtype="<u4") % 256 * 0x010101).view("<f4")
    table = np.empty(300, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<f4")])
    for c, v in zip("xyz", a.T):
        table[c] = v
    table["rgb"] = packed
    (tmp_path / "p.pcd").write_bytes(b"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 300\nHEIGHT 1\nPOINTS 300\nDATA binary\n" + table.tobytes())
    found = ranges.clouds(spark, str(tmp_path), span=500).toPandas().sort_values(["scene_id", "point_id"])
    for name in ("rows", "columns"):
        assert np.array_equal(found.loc[found["scene_id"] == name, list("xyzrgb")].to_numpy(), a)
    p = found[found["scene_id"] == "p"]
    assert np.allclose(p[list("xyz")], a[:, :3]) and np.allclose(p["g"] * 255, np.arange(300) % 256)


def test_other_and_cut_files_raise(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"not a cloud at all\n")
    with pytest.raises(PySparkException, match="is no PLY"):
        ranges.clouds(spark, str(tmp_path)).collect()
    (tmp_path / "a.ply").write_bytes(ply(vertices(50), "binary_little_endian")[:-3])
    with pytest.raises(PySparkException, match="shorter than its header"):
        ranges.clouds(spark, str(tmp_path)).collect()
    with pytest.raises(PySparkException):
        ranges.clouds(spark, str(tmp_path / "missing")).collect()


def points(spark, n=1000):
    return spark.range(n).select((F.col("id") % 3).alias("scene_id"), F.col("id").alias("point_id"), *[(F.col("id") * k).cast("double").alias(c) for k, c in enumerate("xyz", 1)], F.col("id").cast("int").alias("inst"))


def test_written_files_are_read_again_and_overwritten(spark, tmp_path):
    folder = str(tmp_path / "out")
    for form in ("ply_little", "ply_big", "ply_ascii"):
        sinks.cloud_files(spark, points(spark), folder, form, rows=70, mode="overwrite")
        read = ranges.clouds(spark, folder, columns=("x", "z", "inst"), scene=r"/scene=([^/]+)/", span=333)
        rows = read.select(F.col("scene_id").cast("long"), "x", "z", "inst").collect()
        assert sorted(tuple(r) for r in rows) == sorted((i % 3, float(i), 3.0 * i, i) for i in range(1000))
        assert sorted(os.listdir(folder)) == ["scene=0", "scene=1", "scene=2"]
    sinks.cloud_files(spark, points(spark, 0), str(tmp_path / "empty"))
    assert os.listdir(tmp_path / "empty") == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    sinks.cloud_files(spark, points(spark), folder)
    before = sorted(f for _, _, fs in os.walk(folder) for f in fs)
    broken = points(spark).withColumn("inst", F.when(F.col("point_id") != 777, F.col("inst")))
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException, match="can't be null"):
            sinks.cloud_files(spark, broken, folder, rows=50, mode=mode)
        assert sorted(f for _, _, fs in os.walk(folder) for f in fs) == before
        assert not [f for f in os.listdir(folder) if f.startswith("_")]


def test_names_with_signs_are_kept(spark, tmp_path):
    folder = str(tmp_path / "with space")
    named = points(spark, 30).withColumn("scene_id", F.element_at(F.array(*[F.lit(n) for n in ("a b", "50%", "x/y")]), F.col("scene_id").cast("int") + 1))
    sinks.cloud_files(spark, named, folder)
    assert sorted(os.listdir(folder)) == ["scene=50%25", "scene=a%20b", "scene=x%2Fy"]
    assert sorted(r["inst"] for r in ranges.clouds(spark, folder).collect()) == list(range(30))
    assert ranges.file_system("file:/a/b%20c")[1] == ranges.file_system("/a/b%20c")[1] == ranges.file_system("file:///a/b%20c")[1] == "/a/b%20c"
