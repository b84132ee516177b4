"""Chunkers against slow, obvious re-computation of what they promise."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import languages
from codelode.functions.packing import running_totals
from codelode.functions.lists import lists_of, rows_of, structs_of
from codelode.operators import chunking, ordered

WORDS = ["def f(x):", "    return x", "", "class A:", "    def m(self):", "x = 1", "# note", "import os", "y" * 90, "z" * 5000]


def _texts():
    pick = random.Random(7)
    made = ["\n".join(pick.choice(WORDS) for _ in range(pick.randint(0, 400))) for _ in range(20)]
    return ["", "\n", "one", "one\n", "\n\n\n", "a\n\n\nb\n\n", "é" * 4001 + "\n" + "ß"] + made


@pytest.fixture(scope="module")
def files(spark):
    langs = ["Python", "Haskell", "Markdown", "Kotlin", "Java", "C"]
    rows = [(f"f{i}", t, langs[i % len(langs)]) for i, t in enumerate(_texts() * 2)]
    return spark.createDataFrame(rows, "filename string, content string, language string").cache()


def _by_file(df, *columns):
    out = {}
    for r in df.select("filename", *columns).collect():
        out.setdefault(r.filename, []).append(r)
    return out


def test_fixed_lines(files):
    rows = files.select("filename", "content", F.inline(chunking.fixed_lines(F.col("content"), 7)).alias(
        "text", "location", "start", "end", "method"))
    got = _by_file(rows, "text", "location", "start", "end")
    for file in files.collect():
        lines, expected = file.content.split("\n"), []
        for i in range(0, len(lines), 7):
            part = lines[i : i + 7]
            if "\n".join(part).strip():
                expected.append(("\n".join(part), f"line:{i + 1}#{len(expected)}", i + 1, i + len(part)))
        assert [tuple(r)[1:] for r in got.get(file.filename, [])] == expected


@pytest.mark.parametrize("default", [False, True])
@pytest.mark.parametrize("percent", [100, 30])
def test_packed_chunks_keep_all_text_and_sizes(files, default, percent):
    rows = chunking.chunk_files(files, default, percent).withColumn(
        "size", languages.chunk_params(F.col("language"), percent)["chunk_size"]
    )
    got = _by_file(rows, "chunk_content", "location", "start", "end", "chunking_method", "size")
    for file in files.collect():
        chunks, lines = got.get(file.filename, []), file.content.split("\n")
        assert len({c.location for c in chunks}) == len(chunks)
        covered = set()
        for c in chunks:
            assert c.chunk_content.strip()
            assert c.chunk_content in file.content
            whole = "\n".join(lines[c.start - 1 : c.end])
            assert c.chunk_content in whole
            covered.update(range(c.start, c.end + 1))
            if default:
                assert len(c.chunk_content) <= c.size
            elif c.chunking_method != chunking.FIXED_LINES:
                assert len(c.chunk_content) <= catalog.STRUCTURAL_BUDGET
        assert {i + 1 for i, line in enumerate(lines) if line.strip()} <= covered
        if not default:  # no overlap: every solid character exactly once
            joined = "".join("".join(c.chunk_content.split()) for c in chunks)
            assert joined == "".join(file.content.split())


def test_structural_cut_prefers_definitions(spark):
    body = "".join(f"def f{i}():\n" + "    x = 1\n" * 30 + "\n" for i in range(20))
    row = spark.createDataFrame([("a.py", body, "Python")], "filename string, content string, language string")
    starts = [r.chunk_content.split("\n")[0] for r in chunking.chunk_files(row).collect()]
    assert len(starts) > 2 and all(s.startswith("def f") for s in starts)


def test_overlap_repeats_the_end(spark):
    text = "\n".join(f"line {i:04d} " + "w" * 40 for i in range(200))
    row = spark.createDataFrame([("a.md", text, "Markdown")], "filename string, content string, language string")
    chunks = chunking.chunk_files(row, default_chunking=True).orderBy("start").collect()
    assert len(chunks) > 3
    for a, b in zip(chunks, chunks[1:]):
        assert a.start < b.start <= a.end
        shared = "\n".join(text.split("\n")[b.start - 1 : a.end])
        assert 0 < len(shared) <= 200 and b.chunk_content.startswith(shared)


def test_haskell_regex_starts_at_declarations(spark):
    text = "module A where\nimport B\nf :: Int\nf = 1\n  where x = 2\n\n\ndata T = T\n" + "  long line\n" * 400
    row = spark.createDataFrame([("a.hs", text)], "filename string, content string")
    chunks = chunking.haskell_regex_chunks(row, 500).orderBy("start").collect()
    assert [c.chunk_content.split("\n")[0] for c in chunks[:5]] == ["module A where", "import B", "f :: Int", "f = 1", "data T = T"]
    assert all(len("".join(c.chunk_content.split())) <= 500 for c in chunks)
    assert "".join("".join(c.chunk_content.split()) for c in chunks) == "".join(text.split())


def test_unique_locations_skip_taken_names(spark):
    rows = [(["a", "a", "b", "a", "a#1", "a#1"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "n array<string>")
    chunks = df.withColumn("chunks", F.transform("n", lambda x: F.struct(x.alias("content"), x.alias("location"))))
    got = [r[0] for r in chunking.with_unique_locations(chunks).select("chunks.location").collect()]
    assert got[0] == ["a", "a#1", "b", "a#2", "a#1#1", "a#1#2"]
    assert got[1:] == [[], None]


def test_merge_adjacent(spark):
    parts = [("aa", 0, 2, "x"), ("bb", 2, 4, "x"), ("cc", 5, 7, "x"), ("dd", 7, 9, "y"), ("ee", 9, 11, "y"), ("ff", 11, 13, "y")]
    df = spark.createDataFrame([(parts,)], "c array<struct<content:string,start:bigint,end:bigint,category:string>>")
    merged = chunking.merge_adjacent(df, "c", 5).first()[0]
    assert [(m.content, m.start, m.end) for m in merged] == [("aa\nbb", 0, 4), ("cc", 5, 7), ("dd\nee", 7, 11), ("ff", 11, 13)]


def test_running_totals(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "n array<bigint>")
    assert [r[0] for r in df.select(running_totals(F.col("n"))).collect()] == [[1, 3, 6], [], None]


def _ranges():
    pick = random.Random(3)
    rows = []
    for key in ["hot", "cold", None]:
        for _ in range(3000 if key == "hot" else 40):
            start = pick.randint(0, 9900)
            rows.append((key, start, start + pick.randint(0, 60), pick.random()))
    return rows


@pytest.mark.parametrize("span", [1, 97, 100_000])
def test_ordered_operators_on_a_hot_key(spark, span):
    rows = _ranges()
    df = spark.createDataFrame(rows, "k string, start bigint, end bigint, t double").repartition(7)
    numbered = ordered.number_rows(df, ["k"], "start", "n", ties=["t"], span=span)
    reach = ordered.max_before(df, ["k"], "start", "end", "m", ties=["t"], span=span)
    got_n = {(r.k, r.start, r.t): r.n for r in numbered.collect()}
    got_m = {(r.k, r.start, r.t): r.m for r in reach.collect()}
    bounds = spark.createDataFrame([("hot", 0, 10_000), ("cold", 0, 10_000), (None, 0, 10_000), ("none", 5, 9)], "k string, start bigint, end bigint")
    gaps = sorted(map(tuple, ordered.uncovered_ranges(df, bounds, ["k"], span=span).collect()), key=repr)
    expected = [("none", 5, 9)]
    for key in ["hot", "cold", None]:
        mine = sorted((s, t, e) for k, s, e, t in rows if k == key)
        best, at = None, 0
        for i, (s, t, e) in enumerate(mine):
            assert got_n[(key, s, t)] == i + 1
            assert got_m[(key, s, t)] == best
            best = e if best is None else max(best, e)
            if at < s:
                expected.append((key, at, s))
            at = max(at, e)
        if at < 10_000:
            expected.append((key, at, 10_000))
    assert gaps == sorted(expected, key=repr)


def test_header(spark):
    df = spark.createDataFrame([("x", "a.hs", 1, 4)], "c string, f string, s bigint, e bigint")
    make = chunking.with_header
    assert df.select(make(F.col("c"), F.col("f"), F.col("s"), F.col("e"), F.lit(None), F.lit("m"))).first()[0] == (
        "-- File: a.hs | Lines: 1-4 | Node type: unknown | Method: m\nx"
    )


def test_ordered_operators_keep_null_and_far_positions(spark):
    far = 2**60
    rows = [("a", None, 1), ("a", far, 2), ("a", far + 1, 3), ("a", -5, 4), ("a", 5, 5), ("b", None, 6)]
    df = spark.createDataFrame(rows, "k string, p bigint, v int")
    numbered = ordered.number_rows(df, ["k"], "p", "n", span=1)
    assert {(r.v, r.n) for r in numbered.collect()} == {(1, 1), (4, 2), (5, 3), (2, 4), (3, 5), (6, 1)}
    reach = ordered.max_before(df, ["k"], "p", "v", "m", span=10)
    assert {(r.v, r.m) for r in reach.collect()} == {(1, None), (4, 1), (5, 4), (2, 5), (3, 5), (6, None)}


def test_lists_of_slices_and_null_rows():
    lists = pa.array([[1], None, [], [2, 3], None, [4]], pa.list_(pa.int32()))
    assert list(rows_of(lists)) == lists.to_pylist() and list(rows_of(lists.slice(1, 3))) == [None, [], [2, 3]]
    assert structs_of([None, [], [(1, 2)]], [pa.field(n, pa.int32()) for n in "ab"]).to_pylist() == [None, [], [{"a": 1, "b": 2}]]
    assert lists_of([], pa.int64()).to_pylist() == [] and lists_of([None, [5]], pa.int64()).to_pylist() == [None, [5]]


def test_most_segments_are_passed_over_by_one_anchored_search():
    sql = chunking._levels("s", "language", chunking.STRUCTURE_STARTS)
    assert all(p.startswith("^") for found in [*chunking.STRUCTURE_STARTS.values(), *catalog.LINE_SEPARATORS.values()] for p in found)
    assert sql.count("NOT s RLIKE '^(?:") == sql.count("NOT s RLIKE ") == len({tuple(p) for p in chunking.STRUCTURE_STARTS.values()})
