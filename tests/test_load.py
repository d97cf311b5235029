"""The load over three tables: order, counts, reruns, crashes between its writes."""

import json

import pytest

from sparkvista.operators import ingest, load
from sparkvista.sources import readers, schema

SHOPS = [{"business_id": k, "name": "n", "city": "c", "state": "s", "latitude": 1.0, "longitude": 2.0} for k in "ab"] + [{"business_id": "bad", "name": "n"}]
PHOTOS = [{"photo_id": "1", "business_id": "a"}, {"photo_id": "2", "business_id": "zzz"}, {"photo_id": "1", "business_id": "b"}]
REVIEWS = [{"review_id": "1", "business_id": "a", "date": "2024-01-05 10:00:00"}, {"review_id": "2", "business_id": "b", "date": "never"}, {"review_id": "3", "business_id": "zzz", "date": "2024-01-05"}]


@pytest.fixture
def files(tmp_path):
    for name, rows in (("b", SHOPS), ("p", PHOTOS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, REVIEWS)) + "\n\nno json\n")
    return [str(tmp_path / f"{n}.json") for n in "bpr"]


def test_order_counts_and_rerun(spark, files, tmp_path):
    house = load.Warehouse(spark, str(tmp_path / "w"))
    assert house.state().version == 0 and house.counts() == {"businesses": 0, "photos": 0, "reviews": 0}
    state = house.load_files(*files)
    assert state.counts == {
        "businesses": {"inserted": 2, "skipped": 0, "orphaned": 0, "error": 1}, "photos": {"inserted": 1, "skipped": 1, "orphaned": 1, "error": 0}, "reviews": {"inserted": 1, "skipped": 0, "orphaned": 1, "error": 1},
    }
    assert house.counts() == {"businesses": 2, "photos": 1, "reviews": 1} and house.table("photos").first().label == "unknown"
    raw = readers.read_records(spark, files[2], schema.REVIEW)
    want = {r.outcome: r.records for r in ingest.report(ingest.ingest_reviews(raw, house.table("businesses"))).collect()}
    assert {k: v for k, v in state.counts["reviews"].items() if v} == want
    again = house.load_files(*files)
    assert again.version == 2 and [c["inserted"] for c in again.counts.values()] == [0, 0, 0] and house.counts() == {"businesses": 2, "photos": 1, "reviews": 1}
    assert load.outcome_rows(spark, again).count() == 12


@pytest.mark.parametrize("step", ["businesses", "photos", "reviews"])
def test_a_crash_leaves_the_old_state(spark, files, tmp_path, step):
    house = load.Warehouse(spark, str(tmp_path / "w"))
    house.load_files(files[0])

    def dies(at):
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        house.load_files(*files, after=dies)
    assert house.state().version == 1 and house.counts() == {"businesses": 2, "photos": 0, "reviews": 0}
    assert house.vacuum() == ["businesses", "photos", "reviews"].index(step) + 1
    assert house.load_files(*files).version == 2 and house.counts() == {"businesses": 2, "photos": 1, "reviews": 1} and house.vacuum() == 0


def test_unfinished_records_and_conflicts(spark, files, tmp_path):
    house = load.Warehouse(spark, str(tmp_path / "w"))
    house.load_files(files[0])
    (tmp_path / "w/_commits/000000000002.json").write_text('{"folders": {"busi')
    assert house.state().version == 1
    old = house.state()
    assert house.load_files(None, files[1]).version == 3 and house.counts()["photos"] == 1
    with pytest.raises(load.LoadConflict):
        house._commit(old, old.folders, {})
    with pytest.raises(FileNotFoundError):
        house.load_files(files[0], str(tmp_path / "none.json"))
    assert load.main(["x"]) == 2 and load.main([*files[:2], str(tmp_path / "none.json"), str(tmp_path / "v")]) == 1


def test_counts_come_from_the_writing_job(spark, files, tmp_path):
    """Records are counted as they pass to the writer: a source that is read twice would give other counts."""
    seen = spark.sparkContext.accumulator(0)

    def reads(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    house = load.Warehouse(spark, str(tmp_path / "w"))
    raw = readers.read_records(spark, files[2], schema.REVIEW, "lines").drop("_ordinal").coalesce(1)
    raw = raw.mapInArrow(reads, raw.schema).selectExpr("*", "monotonically_increasing_id() _ordinal")
    known = spark.createDataFrame([("a",), ("b",)], "business_id string")
    folder, counts = house._stage("reviews", ingest.ingest_reviews(raw, known))
    assert sum(counts.values()) == 3 and spark.read.parquet(folder).count() == counts["inserted"] == 1
    once = seen.value
    ingest.report(ingest.ingest_reviews(raw, known)).collect()
    assert seen.value == 2 * once
