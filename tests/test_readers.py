"""Readers of JSON: arrays in splits, lines, files that are neither."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvista.operators import ingest
from sparkvista.sources import json_array, readers, schema

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
TRICKY = ['a,b', '","', '\\', '\\\\",', '[{', '}]', '"', 'x\\"],[', "é漢\n\t", "", "{\"a\": [1, 2]}", "\\\\", ",", "]", "[", " , \"id\": "]


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, so that every kind of cut occurs."""
    old = {}

    def set_(n):
        for k, v in (("spark.sql.files.maxPartitionBytes", n), ("spark.sql.files.openCostInBytes", 1)):
            old.setdefault(k, spark.conf.get(k))
            spark.conf.set(k, v)

    yield set_
    for k, v in old.items():
        spark.conf.set(k, v)


def records(n, seed):
    rng = random.Random(seed)
    return [{"id": str(k), "text": "".join(rng.choice(TRICKY) for _ in range(rng.randrange(4))), "tags": [rng.choice(TRICKY) for _ in range(rng.randrange(3))]} for k in range(n)]


def got_of(df):
    return [{"id": r.id, "text": r.text, "tags": r.tags} for r in df.orderBy("_ordinal").collect()]


@pytest.mark.parametrize(("size", "indent"), [(17, None), (40, None), (301, 1), (1 << 20, 1)])
def test_array_equals_json_load(spark, tmp_path, tiny_splits, size, indent):
    rows = records(12 if size < 30 else 30 if size < 100 else 120, size)
    text = json.dumps(rows, indent=indent, ensure_ascii=size % 2 == 0)
    (tmp_path / "a.json").write_text(f" \n{text}\n ")
    tiny_splits(size)
    assert json.loads(text) == rows == got_of(readers.read_records(spark, str(tmp_path / "a.json"), RECORD))
    if size < 1_000:
        assert json_array.fragments(spark, str(tmp_path / "a.json")).select("block").distinct().count() > 10


def test_one_element_and_none(spark, tmp_path, tiny_splits):
    tiny_splits(9)
    for k, text in enumerate(('[]', ' [ ] ', '[{"id": "1"}]', '[{"id": "x, y, z, and a long text, with commas"}]', '[1, {"id": "2"}, null]')):
        (tmp_path / f"{k}.json").write_text(text)
        got = [r.id for r in readers.read_records(spark, str(tmp_path / f"{k}.json"), RECORD, "array").orderBy("_ordinal").collect()]
        assert got == [r.get("id") if isinstance(r, dict) else None for r in json.loads(text)]


def test_files_that_are_no_array_fall_back_to_lines(spark, tmp_path):
    line = '{"id": "%s", "text": "t"}'
    cases = {
        "truncated": ("[" + line % 1 + ",\n" + line % 2 + ",\n" + line % 3, ["3"]),
        "truncated_lines": ("[\n" + line % 1 + "\n" + line % 2, ["1", "2"]),
        "broken_first": ("[broken\n" + line % 1 + "\n" + line % 2, ["1", "2"]),
        "trailing_comma": ("[\n" + line % 1 + ",\n]\n" + line % 2, ["2"]),
        "two_arrays": ('[{"id": "1"}]\n' + line % 2, None),
        "lines": (line % 1 + "\n\n not json\n" + line % 2, ["1", "2"]),
    }
    for name, (text, want) in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = [r.id for r in readers.read_records(spark, str(tmp_path / f"{name}.json"), RECORD).orderBy("_ordinal").collect()]
        assert want is None and "2" in got or got == want, (name, got)
        with pytest.raises(ValueError, match="no JSON array"):
            readers.read_records(spark, str(tmp_path / f"{name}.json"), RECORD, "array")


def test_a_folder_of_both(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"f {k}%[x].json").write_text(json.dumps([{"id": f"{k}a"}, {"id": f"{k}b"}]) if k % 2 else f'{{"id": "{k}a"}}\n{{"id": "{k}b"}}\n')
    rows = readers.read_records(spark, str(tmp_path), RECORD)
    assert sorted(r.id for r in rows.collect()) == sorted(f"{k}{x}" for k in range(12) for x in "ab")
    assert rows.select("_ordinal").distinct().count() == 24
    with pytest.raises(FileNotFoundError):
        readers.read_records(spark, str(tmp_path / "none.json"), RECORD, "lines")


def test_first_of_equal_keys_over_many_array_files(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02}.json").write_text(json.dumps([{"photo_id": "same", "business_id": "a", "label": f"{k}"}, {"photo_id": f"p{k}", "business_id": "a"}]))
    raw = readers.read_records(spark, str(tmp_path), schema.PHOTO)
    kept = ingest.accepted(ingest.ingest_photos(raw, spark.createDataFrame([("a",)], "business_id string")))
    assert kept.count() == 13 and kept.filter("photo_id = 'same'").select("label").collect() == [("0",)]


def test_no_task_reads_a_whole_array(spark, tmp_path, tiny_splits):
    (tmp_path / "a.json").write_text(json.dumps(records(400, 3)))
    tiny_splits(1_000)
    rows = json_array.fragments(spark, str(tmp_path / "a.json"))
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("value") + 1)).select("sum((octet_length(value) + 1))").collect()]
    assert len(sizes) > 8 and max(sizes) < 2_000


def test_elements_are_cut_once(spark, tmp_path):
    """Records come from the elements that were checked: no scan of them cuts the files again."""
    (tmp_path / "a.json").write_text(json.dumps([{"a": k} for k in range(20)]))
    rows = readers.read_records(spark, str(tmp_path), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r.a for r in rows.collect()) == list(range(20))
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
