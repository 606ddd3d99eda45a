"""Versions: interleaved writers, crashes at each step, compaction, upserts, vacuum."""

import threading

import pytest
from pyspark.sql import functions as F

from fieldsieve.sources import files, versions
from fieldsieve.sources.versions import VersionedTable


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), "k string, v int", "k")


def held(table, version=None):
    return sorted((r.k, r.v) for r in table.read(version).collect())


def test_two_appends_that_began_together(spark, table):
    assert held(table) == [] and table.latest() == 0
    one, two = table.begin(rows(spark, ("a", 1), ("b", 1), ("b", 2), (None, 1))), table.begin(rows(spark, ("b", 9), ("c", 9), (None, 9)))
    assert held(table) == []  # what isn't committed isn't seen
    assert two.commit() == 3 and one.commit() == 1  # the first to commit wins, the other leaves out what is there
    assert table.append(rows(spark, ("a", 5), ("c", 5))) == 0 and table.latest() == 2
    assert sorted((r.k or "", r.v) for r in table.read().collect()) == [("", 9), ("a", 1), ("b", 9), ("c", 9)] and table.read(1).count() == 3
    assert sorted((r.version, r.since, r.k or "") for r in table.history().collect()) == [(1, 1, ""), (1, 1, "b"), (1, 1, "c"), (2, 1, ""), (2, 1, "b"), (2, 1, "c"), (2, 2, "a")]


def test_a_commit_between_the_check_and_the_manifest(spark, table):
    """Another run commits while this one is about to: the manifest isn't taken, and the rows are looked up again."""
    mine, once = table.begin(rows(spark, ("a", 1), ("b", 1))), []

    def other():
        if not once:
            once.append(table.append(rows(spark, ("b", 2), ("c", 2))))

    assert mine.commit(other) == 1 and held(table) == [("a", 1), ("b", 2), ("c", 2)] and table.latest() == 2


def test_a_crash_leaves_the_old_version(spark, table, monkeypatch):
    table.append(rows(spark, ("a", 1)))

    def dies(*_):
        raise KeyboardInterrupt

    draft = table.begin(rows(spark, ("b", 2)))  # data is stored, then nothing
    with pytest.raises(KeyboardInterrupt):
        draft.commit(dies)
    monkeypatch.setattr(versions.os, "link", dies)  # the manifest is written beside, and never put in place
    with pytest.raises(KeyboardInterrupt):
        table.begin(rows(spark, ("c", 3))).commit()
    monkeypatch.undo()
    assert held(table) == [("a", 1)] and table.latest() == 1
    assert table.append(rows(spark, ("b", 4))) == 1 and held(table) == [("a", 1), ("b", 4)]
    assert len(table.vacuum(older_than=10_000)) == 0 and len(table.vacuum(older_than=0)) == 2 and held(table) == [("a", 1), ("b", 4)]


def test_one_manifest_of_many(spark, tmp_path):
    folder, won = versions.Folder(spark, str(tmp_path / "f")), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if folder.put_new("_versions/x.json", str(k)) else None) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and folder.read("_versions/x.json") == str(won[0]) and folder.names("_tmp") == []


def test_upserts_and_folders_laid_together(spark, table, monkeypatch):
    monkeypatch.setattr(versions, "FOLDERS", 3)
    want = {}
    for n in range(6):
        part = {f"k{n}": n, "same": n, f"k{n - 1}": -n}
        want |= part
        table.upsert(rows(spark, *part.items()))
        assert held(table) == sorted(want.items()) and len(table.manifest().folders) <= 3
    one, two = table.begin(rows(spark, ("same", 100)), True), table.begin(rows(spark, ("same", 200), ("z", 1)), True)
    two.commit()
    one.commit()
    assert dict(held(table)) == want | {"same": 100, "z": 1} and dict(held(table, 3))["same"] == 2
    assert table.upsert(rows(spark, ("x", 1)).limit(0)) == 0 and table.vacuum(0, versions=1) and dict(held(table))["z"] == 1


def test_states_of_json_files_go_on_in_versions(spark, tmp_path):
    path = tmp_path / "state"
    state = lambda s, v: spark.sql(f"SELECT '{s}' AS source_id, TIMESTAMP'{v}' AS last_successful_check_at")
    state("a", "2026-01-01 00:00:00").union(state("b", "2026-01-02 00:00:00")).write.json(str(path))
    files.upsert_state(spark, str(path), state("b", "2026-02-02 00:00:00"))
    files.upsert_state(spark, str(path), state("c", "2026-03-03 00:00:00"))
    assert sorted((r[0], str(r[1])[:10]) for r in files.read_state(spark, str(path)).collect()) == [("a", "2026-01-01"), ("b", "2026-02-02"), ("c", "2026-03-03")]
    assert versions.is_versioned(spark, str(path)) and not (tmp_path / "state.old").exists() and not (tmp_path / "state.new").exists()


def test_many_rows_and_other_kinds(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id long, w array<string>, number int", "id")
    df = spark.range(5000).select("id", F.array(F.lit("x")).alias("w"), F.lit(1).alias("number"))
    assert table.append(df) == 5000 and table.append(df.filter("id % 2 = 0").union(df.select(F.col("id") + 4000, "w", "number"))) == 4000
    assert table.read().count() == 9000 == table.read().select("id").distinct().count() and table.read().columns == ["id", "w", "number"]
