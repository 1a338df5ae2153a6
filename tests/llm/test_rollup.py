from __future__ import annotations

from threading import Thread

from corridor_jobs.llm import token_counts

KIND = "source string, lang string, version string, tokens long"


def totals(roll):
    return sorted(map(tuple, roll.totals().collect()), key=str)


def test_a_lost_race_is_run_again(spark, tmp_path, monkeypatch):
    """Another writer puts its state in place while this one writes: both batches count, once each."""
    root = str(tmp_path / "r")
    mine, other = token_counts.Rollup(spark, root), token_counts.Rollup(spark, root)
    rows = spark.createDataFrame([("a", "en", "v", 5), (None, None, "v", 2)], KIND)
    put, tries = mine._put, []

    def slow(folder, state):
        if not tries:
            assert other.commit("theirs", token_counts.inserted(rows))
        tries.append(state)
        return put(folder, state)

    monkeypatch.setattr(mine, "_put", slow)
    assert mine.commit("mine", token_counts.inserted(rows)) and tries == [1, 2]
    assert not mine.commit("theirs", token_counts.inserted(rows)) and not other.commit("mine", token_counts.inserted(rows))
    assert totals(mine) == totals(other) == [("a", "en", "v", 2, 10), (None, None, "v", 2, 4)]


def test_many_writers_at_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v", 1)], KIND)
    done = []
    writers = [Thread(target=lambda k=k: done.append(token_counts.Rollup(spark, str(tmp_path / "r")).commit(str(k % 3), token_counts.inserted(rows)))) for k in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == [False] * 3 + [True] * 3
    assert totals(token_counts.Rollup(spark, str(tmp_path / "r"))) == [("a", "en", "v", 3, 3)]


def test_reading_opens_one_table(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "en", "v", 1)], KIND)
    for k in range(5):
        assert roll.commit(str(k), token_counts.inserted(rows))
    assert len(roll.totals().inputFiles()) == 1 and len(list((tmp_path / "r").glob("folder-*"))) == 2
    assert roll.commit("gone", token_counts.deleted(spark.createDataFrame([("a", "en", "v", 1)] * 5, KIND))) and totals(roll) == []
    assert not roll.commit("0", token_counts.inserted(rows))
