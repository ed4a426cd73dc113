"""A master table kept up to date: equal to a full build, only touched folders rewritten, a lost run leaves the old table."""

import pytest

from paceline.operators.master import master_table
from paceline.sources.versioned import VersionedMaster

SCHEMA = "dataset string, system string, entity_id string, window_start timestamp_ntz, n_records long"


def table(spark, ids, n):
    return spark.createDataFrame([("d", None if i % 5 else "s", f"e{i}", None, n) for i in ids], SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def test_deliveries_add_up_to_a_full_build(spark, tmp_path):
    t = VersionedMaster(spark, str(tmp_path / "m"), buckets=16)
    assert t.read() is None and t.deliver(table(spark, [], 0), 0) == []
    daily, hourly = table(spark, range(40), 1), table(spark, range(20, 60), 2)
    t.deliver(daily, 1)
    before = t.folders()
    few = table(spark, [20, 21], 2)
    touched = t.deliver(few, 0)
    after = t.folders()
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    t.deliver(hourly, 0)
    assert rows(t.read()) == rows(master_table([hourly, daily])) and t.clean() > 0
    assert rows(t.read()) == rows(master_table([hourly, daily]))
    t.deliver(daily, 1)  # a repeated delivery changes nothing
    assert rows(t.read()) == rows(master_table([hourly, daily]))


def test_a_lost_run_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = VersionedMaster(spark, str(tmp_path / "m"), buckets=4)
    t.deliver(table(spark, range(10), 1), 1)
    old = rows(t.read())

    def lost(folders):
        raise OSError("the driver is gone")

    monkeypatch.setattr(t, "_publish", lost)
    with pytest.raises(OSError):
        t.deliver(table(spark, range(10), 2), 0)
    again = VersionedMaster(spark, str(tmp_path / "m"), buckets=4)
    assert rows(again.read()) == old
    again.deliver(table(spark, range(10), 2), 0)
    assert {r["n_records"] for r in again.read().collect()} == {2}


def test_new_columns_are_null_in_older_rows(spark, tmp_path):
    t = VersionedMaster(spark, str(tmp_path / "m"), buckets=4)
    t.deliver(table(spark, range(6), 1), 0)
    t.deliver(table(spark, range(6, 8), 1).selectExpr("*", "2.5D AS extra"), 0)
    assert sorted(str(r["extra"]) for r in t.read().collect()) == ["2.5", "2.5"] + ["None"] * 6
