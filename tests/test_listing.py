"""Listing by levels in tasks."""

import os

import pytest
from pyspark.sql import functions as F

from codelode.plans.index_flow import IndexConfig
from codelode.sources import files, listing
from codelode.sources.store import ChunkStore
from codelode.streaming import live


def _write(root, texts):
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    _write(tmp_path, {
        ".gitignore": "/out/\nnode_modules/\n", "a.py": "1", ".hidden.py": "2", "out/x.py": "3", "out/.gitignore": "*.py\n",
        "src/a.py": "4", "src/.gitignore": "*.tmp.py\n/deep/skip\n", "src/b.tmp.py": "5", "src/deep/skip/c.py": "6", "src/deep/keep/c.py": "7",
        "lib/node_modules/m/i.js": "8", "lib/b.tmp.py": "9", "other/gen/x.py": "10", "empty é/ü.py": "11",
    })
    os.symlink(tmp_path, tmp_path / "src" / "upwards")
    os.symlink(tmp_path / "a.py", tmp_path / "src" / "link.py")
    os.symlink(tmp_path / "nowhere", tmp_path / "src" / "broken.py")
    (tmp_path / "bare").mkdir()
    return tmp_path


def test_levels_links_and_pruning(spark, tree):
    found = listing.list_tree(spark, {"one": str(tree)})
    names = sorted(r.filename for r in found.files.collect() if not r.filename.endswith(".gitignore"))
    assert names == sorted([
        ".hidden.py", "a.py", "empty é/ü.py", "lib/b.tmp.py", "other/gen/x.py", "src/a.py", "src/b.tmp.py", "src/deep/keep/c.py", "src/link.py",
    ])
    assert found.ignored == ["out", "out/**", "**/node_modules", "**/node_modules/**", "src/**/*.tmp.py", "src/deep/skip"]
    assert found.levels == 4  # the root, src and others, src/deep, src/deep/keep
    whole = listing.list_tree(spark, {"one": str(tree)}, use_gitignore=False)
    assert whole.files.filter("filename = 'lib/node_modules/m/i.js'").count() == 1 and whole.ignored == []


def test_scan_of_several_roots(spark, tree, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    _write(other, {"z.rs": "fn main() {}"})
    found = {(r.source_name, r.filename): r.content for r in files.scan(spark, [str(tree), str(other)]).collect()}
    assert found == {
        ("files_0", "a.py"): "1", ("files_0", ".hidden.py"): "2", ("files_0", "src/a.py"): "4", ("files_0", "src/deep/keep/c.py"): "7",
        ("files_0", "lib/b.tmp.py"): "9", ("files_0", "other/gen/x.py"): "10", ("files_0", "empty é/ü.py"): "11", ("files_0", "src/link.py"): "1",
        ("files_1", "z.rs"): "fn main() {}", ("files_0", ".gitignore"): "/out/\nnode_modules/\n", ("files_0", "src/.gitignore"): "*.tmp.py\n/deep/skip\n",
    }
    only = files.list_files(spark, [str(tree)], include=["**/*.py"], exclude=["src/"], use_gitignore=True)
    assert only.filter(F.col("filename").startswith("src/")).count() == 0 and only.filter("filename = 'a.py'").count() == 1


def test_missing_and_empty_roots(spark, tmp_path):
    assert files.scan(spark, [str(tmp_path / "none")]).count() == 0
    assert files.scan(spark, [str(tmp_path)]).count() == 0


def test_content_is_read_only_where_it_is_used(spark, tree):
    rows = files.scan(spark, [str(tree)])
    plan = rows.select("filename")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_an_update_opens_changed_files_only(spark, tmp_path):
    root = tmp_path / "root"
    _write(root, {"a.txt": "first", "b.txt": "other"})
    kept, config = ChunkStore(spark, str(tmp_path / "store")), IndexConfig(paths=[str(root)], use_gitignore=False)
    assert live.update_paths(spark, kept, config) == 0
    before = os.stat(root / "a.txt")
    (root / "a.txt").write_text("FIRST")
    os.utime(root / "a.txt", ns=(before.st_atime_ns, before.st_mtime_ns))  # same time and size: the listing cannot tell
    assert live.update_paths(spark, kept, config) == 0
    (root / "b.txt").write_text("more text")
    assert live.update_paths(spark, kept, config) == 1
    assert {r.filename: r.code for r in kept.table().collect()} == {"a.txt": "first", "b.txt": "more text"}


def test_wide_and_deep(spark, tmp_path):
    for k in range(120):
        _write(tmp_path, {f"d{k % 10}/e{k}/" + "/".join("f" * (k % 5)) + f"/x{k}.py": str(k)})
    found = listing.list_tree(spark, {"one": str(tmp_path)})
    assert found.files.count() == 120 and found.levels == 7
