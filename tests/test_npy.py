import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvista.operators import embed
from sparkvista.sources.npy import MANIFEST, files, read_npy, write_npy


def vectors(spark, n, dim=3, kind="float"):
    values = ", ".join(f"cast(id * {dim} + {k} as {kind})" for k in range(dim))
    return spark.range(n).selectExpr("id position", f"array({values}) embedding")


def rows(df):
    return [(r.position, list(r.embedding)) for r in df.orderBy("position").collect()]


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i2", "<f2"])
def test_a_file_that_numpy_saved(spark, tmp_path, kind):
    table = np.arange(70, dtype=kind).reshape(10, 7)
    np.save(tmp_path / "v.npy", table)
    for size in (1, 60, 1_000):
        found = read_npy(spark, str(tmp_path / "v.npy"), rangeBytes=size)
        assert rows(found) == list(enumerate(table.tolist()))
    assert found.schema["embedding"].dataType.elementType.simpleString() == ("double" if kind == "<f8" else "float")
    assert read_npy(spark, str(tmp_path / "v.npy"), rangeBytes=60).rdd.getNumPartitions() > 1


def test_a_folder_in_the_order_of_names(spark, tmp_path):
    for k, n in enumerate([3, 0, 5]):
        np.save(tmp_path / f"{k}.npy", np.full((n, 2), k, np.float32))
    (tmp_path / "other.txt").write_text("no array")
    assert [v[0] for _, v in rows(read_npy(spark, str(tmp_path)))] == [0, 0, 0, 2, 2, 2, 2, 2]


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, tmp_path, parts):
    df, path = vectors(spark, 101), str(tmp_path / "v")
    write_npy(df.repartition(parts), path, partBytes=120)
    assert rows(read_npy(spark, path)) == rows(df) and all(f.rows <= 10 for f in files(path))
    whole = np.concatenate([np.load(f.name) for f in files(path)])
    assert whole.dtype == np.float32 and (whole == np.arange(303).reshape(101, 3)).all()
    write_npy(vectors(spark, 110).filter("position > 100"), path, "append")
    assert rows(read_npy(spark, path)) == rows(vectors(spark, 110))
    write_npy(vectors(spark, 2, 4, "double"), path)
    assert rows(read_npy(spark, path)) == rows(vectors(spark, 2, 4)) and read_npy(spark, path).dtypes[1][1] == "array<double>"
    left = [f for _, _, found in os.walk(path) for f in found if f.endswith(".npy")]
    assert len(left) == len(files(path))


def test_no_rows_and_special_numbers(spark, tmp_path):
    write_npy(vectors(spark, 0), str(tmp_path / "none"))
    assert rows(read_npy(spark, str(tmp_path / "none"))) == []
    os.mkdir(tmp_path / "bare")
    assert rows(read_npy(spark, str(tmp_path / "bare"))) == []
    odd = spark.sql("SELECT 0L position, array(float('NaN'), float('-Infinity')) embedding")
    write_npy(odd, str(tmp_path / "odd"))
    found = rows(read_npy(spark, str(tmp_path / "odd")))[0][1]
    assert np.isnan(found[0]) and found[1] == -np.inf


@pytest.mark.parametrize("wrong", ["position <> 40", "position > 0"])
def test_a_missing_row_is_an_error_and_the_old_table_stays(spark, tmp_path, wrong):
    path = str(tmp_path / "v")
    write_npy(vectors(spark, 5), path)
    with pytest.raises(Exception, match="a row is missing"):
        write_npy(vectors(spark, 100).filter(wrong).repartition(3), path)
    assert rows(read_npy(spark, path)) == rows(vectors(spark, 5)) and len(os.listdir(path)) == 2


@pytest.mark.parametrize(
    "change, message",
    [("if(position = 3, null, embedding)", "null"), ("if(position = 3, array(float(1)), embedding)", "several lengths"), ("transform(embedding, x -> if(position = 3, null, x))", "null")],
)
def test_vectors_that_do_not_fit(spark, tmp_path, change, message):
    for parts in (1, 4):
        with pytest.raises(Exception, match=message):
            write_npy(vectors(spark, 8).repartition(parts).selectExpr("position", f"{change} embedding"), str(tmp_path / "v"))
    with pytest.raises(Exception, match="a row is missing, or there twice"):
        write_npy(vectors(spark, 8).union(vectors(spark, 1)), str(tmp_path / "v"))


def test_files_that_are_not_rows_of_numbers(spark, tmp_path):
    for k, table in enumerate([np.zeros(3), np.zeros((2, 2, 2)), np.array([["a", "b"]]), np.asfortranarray(np.zeros((3, 2)))]):
        np.save(tmp_path / f"{k}.npy", table)
        with pytest.raises(ValueError, match="rows of numbers"):
            read_npy(spark, str(tmp_path / f"{k}.npy"))
    np.save(tmp_path / "cut.npy", np.zeros((3, 2)))
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-1])
    with pytest.raises(ValueError, match="bytes"):
        read_npy(spark, str(tmp_path / "cut.npy"))
    (tmp_path / "cut.npy").write_bytes(b"no array")
    with pytest.raises(ValueError, match="no .npy file"):
        read_npy(spark, str(tmp_path / "cut.npy"))
    with pytest.raises(FileNotFoundError):
        read_npy(spark, str(tmp_path / "missing"))


def test_a_file_cut_after_its_commit(spark, tmp_path):
    write_npy(vectors(spark, 20), str(tmp_path))
    name = files(str(tmp_path))[0].name
    with open(name, "r+b") as f:
        f.truncate(os.path.getsize(name) - 4)
    with pytest.raises(Exception, match="ends before row"):
        read_npy(spark, str(tmp_path)).collect()
    assert json.loads((tmp_path / MANIFEST).read_text())["dtype"] == "<f4"


def test_vectors_and_metadata_by_position(spark, tmp_path):
    df = spark.range(60).selectExpr("if(id % 7 = 0, null, 59 - id) key", "concat('r', id) name", "array(float(id), float(1)) embedding", "'old' position")
    for parts in (1, 5):
        path = str(tmp_path / f"a{parts}")
        embed.save_aligned(df.repartition(parts), path, ["key", "name"])
        found = embed.load_aligned(spark, f"{path}/vectors", f"{path}/metadata").orderBy("position").collect()
        assert [r.position for r in found] == list(range(60)) and all(r.name == f"r{int(r.embedding[0])}" for r in found)
        assert [(r.key is not None, r.key, r.name) for r in found] == sorted((r.key is not None, r.key, r.name) for r in found)
        meta = spark.read.parquet(f"{path}/metadata")
        meta.drop("position").repartitionByRange(4, "key", "name").sortWithinPartitions("key", "name").write.parquet(f"{path}/plain")
        assert sorted((r.name, r.embedding[0]) for r in embed.load_aligned(spark, f"{path}/vectors", f"{path}/plain").collect()) == sorted((f"r{k}", float(k)) for k in range(60))
        for wrong in ("position <> 30", "position < 59"):
            meta.filter(wrong).write.mode("overwrite").parquet(f"{path}/wrong")
            with pytest.raises(ValueError, match="60 vectors"):
                embed.load_aligned(spark, f"{path}/vectors", f"{path}/wrong")
        meta.withColumn("position", F.col("position") % 59).write.mode("overwrite").parquet(f"{path}/wrong")
        with pytest.raises(ValueError, match="59 positions"):
            embed.load_aligned(spark, f"{path}/vectors", f"{path}/wrong")
