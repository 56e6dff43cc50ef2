"""Ingestion against a filter of seen ids: nothing lost, nothing doubled, and no look at the table for new ids."""

import pytest

from gable.streaming import ingest as m


def rows(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")


def ids_of(spark, where):
    return sorted((r.id is not None, r.id or 0) for r in spark.read.parquet(where).select("id").collect())


def pairs(ids):
    return sorted((i is not None, i or 0) for i in ids)


@pytest.mark.parametrize("expected", [4, 10_000])  # a filter far too small says maybe to all and loses nothing
def test_batches_and_replay(spark, tmp_path, expected):
    where = str(tmp_path / "table")
    assert m.append_unseen(rows(spark, [*range(300), *range(50), None, None]), where, expected=expected) == []
    fresh = m.append_unseen(rows(spark, range(300, 340)), where, expected=expected)
    assert ids_of(spark, where) == pairs([*range(340), None])
    if expected > 4:
        assert fresh == []  # all new: the stored table is not read
    again = m.append_unseen(rows(spark, [*range(280, 400), None]), where, expected=expected)
    assert again and ids_of(spark, where) == pairs([*range(400), None])
    m.append_unseen(rows(spark, []), where, expected=expected)
    m.append_unseen(rows(spark, [*range(280, 400), None]), where, expected=expected)
    assert ids_of(spark, where) == pairs([*range(400), None])


def test_lost_between_filter_and_table(spark, tmp_path):
    where = str(tmp_path / "table")
    m.append_unseen(rows(spark, range(20)), where, expected=1000)
    seen = m.SeenIds(spark, f"{where}.seen", 1000)
    seen.add(rows(spark, range(20, 30)), "id")  # the filter was written, the rows were not
    m.append_unseen(rows(spark, range(15, 30)), where, expected=1000)
    assert ids_of(spark, where) == pairs(range(30))
    assert len(seen.versions()) == 2  # the last and the one before


def test_unfinished_version_and_table_without_filter(spark, tmp_path):
    where = str(tmp_path / "table")
    m.append_unseen(rows(spark, range(20)), where, expected=1000)
    seen = m.SeenIds(spark, f"{where}.seen", 1000)
    (tmp_path / "table.seen" / "for=1000" / "v9").mkdir()  # a version that was never finished
    assert seen.versions() == [1]
    m.append_unseen(rows(spark, range(10, 25)), where, expected=2000)  # laid out anew, from the table
    m.append_unseen(rows(spark, range(20, 27)), where, expected=1000)  # and back: the old filter would not know 20 to 24
    assert ids_of(spark, where) == pairs(range(27))


def test_filter_is_bounded_and_seldom_wrong(spark, tmp_path):
    seen = m.SeenIds(spark, str(tmp_path / "f.seen"), 20_000)
    seen.add(spark.range(20_000), "id")
    assert seen.current().count() <= 20_000 * m.BITS_EACH // 64
    assert seen.asked(spark.range(20_000), "id").where("not maybe").count() == 0
    assert seen.asked(spark.range(20_000, 60_000), "id").where("maybe").count() < 0.02 * 40_000
