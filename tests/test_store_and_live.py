import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from codelode.plans.index_flow import IndexConfig
from codelode.service import open_session
from codelode.session import work_folder
from codelode.sources import store as storage
from codelode.sources.files import stream_root
from codelode.streaming import live


def rows_of(kept):
    return sorted((r.source_name, r.filename, r.location, r.code) for r in kept.table().collect())


def files(spark, texts, source="s"):
    return spark.createDataFrame([(f, t, source) for f, t in texts.items()], "filename string, content string, source_name string")


def test_update_replaces_and_removes(spark, tmp_path):
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))
    assert kept.table().count() == 0 and kept.runs() == []
    live.update(kept, files(spark, {"a.md": "one", "b.md": "two", "c.md": "\n".join(f"l{i}" for i in range(400))}))
    assert len(rows_of(kept)) == 5
    live.update(kept, files(spark, {"a.md": "one", "b.md": "TWO", "c.md": "short", "d.md": "new"}))
    assert [(r[1], r[3]) for r in rows_of(kept)] == [("a.md", "one"), ("b.md", "TWO"), ("c.md", "short"), ("d.md", "new")]
    before = rows_of(kept)
    live.update(kept, files(spark, {"a.md": "one", "b.md": "TWO", "c.md": "short", "d.md": "new"}))
    assert rows_of(kept) == before and kept.runs() == [0, 1]  # nothing changed: no run
    live.update(kept, files(spark, {"a.md": "one"}))
    assert [r[1] for r in rows_of(kept)] == ["a.md"]
    live.update(kept, files(spark, {"a.md": "one", "b.md": "back"}))
    assert [(r[1], r[3]) for r in rows_of(kept)] == [("a.md", "one"), ("b.md", "back")]
    compacted = storage.ChunkStore(spark, str(tmp_path / "small"))
    kept.compact(compacted)
    assert rows_of(compacted) == rows_of(kept) and compacted.runs() == [0]
    info = compacted.info()
    assert info["row_count"] == 2 and info["missing_columns"] == []
    assert open_session(spark, compacted.folder).keyword("filename:b.md").first().code == "back"
    live.update(kept, files(spark, {"z.md": "only"}), IndexConfig(rescan=True))
    assert [r[1] for r in rows_of(kept)] == ["z.md"] and kept.runs() == [0]


def test_repeated_and_unfinished_runs(spark, tmp_path, monkeypatch):
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))
    live.update(kept, files(spark, {"a.md": "one"}))
    # An attempt that writes all its rows and dies before its commit.
    monkeypatch.setattr(storage.ChunkStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        live.update(kept, files(spark, {"a.md": "CHANGED", "g.py": "x = 1"}))
    monkeypatch.undo()
    assert [r[3] for r in rows_of(kept)] == ["one"] and kept.next_run() == 1
    # The next attempt writes other files under the same run number.
    live.update(kept, files(spark, {"a.md": "one", "b.rs": "fn main() {}"}))
    assert [(r[1], r[3]) for r in rows_of(kept)] == [("a.md", "one"), ("b.rs", "fn main() {}")]
    batch = files(spark, {"a.md": "one"})
    with pytest.raises(ValueError):
        kept.write_run(1, live.index_files(batch), storage.snapshot(batch))


def test_compaction_in_place(spark, tmp_path):
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))
    live.update(kept, files(spark, {"a.md": "one", "b.md": "two"}))
    live.update(kept, files(spark, {"a.md": "ONE"}))
    before = rows_of(kept)
    kept.compact()
    assert rows_of(kept) == before and len(kept.runs()) == 1
    live.update(kept, files(spark, {"a.md": "ONE", "c.md": "three"}))
    assert [(r[1], r[3]) for r in rows_of(kept)] == [("a.md", "ONE"), ("c.md", "three")]


def test_streams_add_and_replays_do_not(spark, tmp_path):
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))

    def feed(name, texts):
        folder = tmp_path / name
        files(spark, texts).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("filename string, content string, source_name string").parquet(str(folder))
        live.index_stream(stream, kept, str(tmp_path / f"{name}-progress")).awaitTermination()

    feed("one", {"a.md": "one"})
    feed("two", {"b.md": "two"})  # another stream with a fresh checkpoint
    assert [r[1] for r in rows_of(kept)] == ["a.md", "b.md"]
    # Forget that the last batch was finished: it is replayed and changes nothing.
    for commit in (tmp_path / "two-progress" / "commits").iterdir():
        commit.unlink()
    feed("two", {"b.md": "later"})
    assert len(kept.commits()) == len({token for _, _, token in kept.commits()})
    assert [r[1] for r in rows_of(kept)] == ["a.md", "b.md"]


def test_same_name_in_two_sources(spark, tmp_path):
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))
    both = files(spark, {"a.md": "x"}, "s1").unionByName(files(spark, {"a.md": "y"}, "s2"))
    live.update(kept, both)
    live.update(kept, both.filter("source_name = 's2'"))
    assert [(r[0], r[3]) for r in rows_of(kept)] == [("s2", "y")]


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", "1", "s", "x"), ("a", "2", "s", "y"), ("b", "1", "s", "z")], "filename string, location string, source_name string, v string")
    new = spark.createDataFrame([("a", "1", "s", "X")], old.schema)
    assert sorted(r.v for r in storage.upsert(old, new).collect()) == ["X", "y", "z"]
    gone = spark.createDataFrame([("b", "s")], "filename string, source_name string")
    assert sorted(r.v for r in storage.replace_files(old, new, gone).collect()) == ["X"]


def _put(root, name, text, when):
    path = root / name
    path.write_text(text)
    os.utime(path, (when, when))


def test_update_from_folders(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    now = time.time() - 1000
    _put(root, "a.py", "x = 1", now)
    _put(root, "b.py", "y = 1", now)
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))
    config = IndexConfig(paths=[str(root)])
    live.update_paths(spark, kept, config)
    _put(root, "a.py", "x = 22", now + 5)
    _put(root, "c.py", "z = 1", now - 50)  # older than everything known
    (root / "b.py").unlink()
    live.update_paths(spark, kept, config)
    assert [(r[1], r[3]) for r in rows_of(kept)] == [("a.py", "x = 22"), ("c.py", "z = 1")]


def test_follow_retries_and_stops(spark, tmp_path, monkeypatch):
    calls, waits = [], []

    def once(*_):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("not now")

    monkeypatch.setattr(live, "update_paths", once)
    done = live.follow(spark, None, IndexConfig(poll_seconds=7), lambda: len(calls) >= 3, wait=waits.append)
    assert done == 2 and waits == [10.0, 7]


def test_stream_takes_new_files(spark, tmp_path):
    inbox, kept = tmp_path / "in", storage.ChunkStore(spark, str(tmp_path / "store"))
    inbox.mkdir()

    def arrive(n, **texts):
        rows = [(f"{k}.md", v, "s", n) for k, v in texts.items()]
        frame = spark.createDataFrame(rows, "filename string, content string, source_name string, n bigint").coalesce(1)
        frame.write.mode("append").parquet(str(inbox))

    def run():
        stream = spark.readStream.schema("filename string, content string, source_name string, n bigint").parquet(str(inbox))
        rows = stream.withColumn("modified", F.timestamp_seconds("n")).withColumn("n_bytes", F.length("content").cast("bigint")).drop("n")
        query = live.index_stream(rows, kept, str(tmp_path / "progress"))
        query.awaitTermination()
        assert query.exception() is None

    arrive(1, a="one", b="two")
    run()
    assert [r[3] for r in rows_of(kept)] == ["one", "two"]
    arrive(2, a="older")
    arrive(3, a="newest", c="three")
    run()
    assert [r[3] for r in rows_of(kept)] == ["newest", "two", "three"]
    run()  # nothing new
    assert len(rows_of(kept)) == 3


def test_reading_prunes(spark, tmp_path):
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))
    live.update(kept, files(spark, {"a.md": "one", "b.py": "x = 1"}))
    live.update(kept, files(spark, {"a.md": "two", "b.py": "x = 1"}))
    plan = kept.table().filter("language = 'Python'").select("filename")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,Python)" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "embedding:" not in plan.split("ReadSchema:")[1]


class _Cluster:
    """What the function reads of a session that runs on a cluster."""

    def __init__(self, **settings):
        self.conf, self.sparkContext = settings, type("C", (), {"master": "yarn"})


def test_work_folder_uses_the_shared_setting(spark):
    assert work_folder(spark, "x") != work_folder(spark, "x")
    assert work_folder(_Cluster(**{"spark.checkpoint.dir": "hdfs:///shared/"}), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(_Cluster(), "x")


def test_config_defaults():
    assert IndexConfig().poll_seconds == 60 and IndexConfig().chunk_factor_percent == 100


def test_stream_of_real_files(spark, tmp_path):
    root = tmp_path / "src"
    (root / "target").mkdir(parents=True)
    _put(root, "a.py", "x = 1", time.time())
    _put(root, "target/b.py", "no", time.time())
    kept = storage.ChunkStore(spark, str(tmp_path / "store"))

    def run():
        live.index_stream(stream_root(spark, str(root)), kept, str(tmp_path / "progress")).awaitTermination()

    run()
    _put(root, "c.rs", "fn main() {}", time.time())
    run()
    assert [(r[1], r[3]) for r in rows_of(kept)] == [("a.py", "x = 1"), ("c.rs", "fn main() {}")]
    assert len(kept.runs()) == 2


def test_merging_levels_is_logarithmic():
    rng = random.Random(1)
    for shape in (lambda k: 1, lambda k: rng.randrange(50), lambda k: 1_000_000 if k == 0 else 3, lambda k: 0, lambda k: k):
        held, merged, total = [], 0, 0
        for k in range(1000):
            rows = shape(k)
            held.append(rows)
            total += rows
            while count := storage.to_merge(held):
                merged += sum(held[-count:])
                held[-count:] = [sum(held[-count:])]
            assert len(held) <= 3 * (1 + math.log(max(4, total), 4))
        assert merged <= total * (2 + math.log(max(4, total), 4))


def _state(spark, names, version):
    return spark.createDataFrame([("s", n, version) for n in names], "source_name string, filename string, version string")


def test_levels_of_states(spark, tmp_path):
    kept, want = storage.ChunkStore(spark, str(tmp_path / "store")), {}
    none = spark.createDataFrame([], storage.CHUNK_SCHEMA).drop("run")
    for k in range(18):
        names, gone = [f"f{k % 7}", f"g{k}"], [f"g{k - 3}"] if k % 4 == 3 else []
        kept.write_run(k, none, _state(spark, names, str(k)), _state(spark, gone, ""))
        want = {n: v for n, v in want.items() if n not in gone} | {n: (str(k), k) for n in names}
        if k == 10:
            middle = dict(want)
    now = lambda rows: {r.filename: (r.version, r.run) for r in rows.filter("NOT removed").collect()}
    assert now(kept.manifest()) == want
    assert now(kept.manifest(before=11)) == middle
    assert now(kept.manifest(_state(spark, ["f1", "none"], ""))) == {"f1": want["f1"]}
    places = kept.segments()
    assert len(places) <= 6 and places[0][0] == 0 and places[-1][1] == 17 and any("/merged/" in p for *_, p in places)
    assert [a[1] + 1 for a in places[:-1]] == [b[0] for b in places[1:]]
    # an attempt to merge that did not get to its marker is not seen, and made up for by the next
    for marker in (tmp_path / "store" / "levels").iterdir():
        marker.unlink()
    assert len(kept.segments()) == 18 and now(kept.manifest()) == want
    kept.merge_levels()
    assert len(kept.segments()) < 6 and now(kept.manifest()) == want
    kept.compact()
    assert len(kept.segments()) == 1 and now(kept.manifest()).keys() == want.keys()
    kept.clear()
    assert kept.segments() == [] and kept.manifest().count() == 0


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in range(6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = entry_point.queries()["stream_index"](spark, str(tmp_path))
    assert sorted(r.filename for r in found.collect()) == [f"doc_{k}.en" for k in range(6)]
