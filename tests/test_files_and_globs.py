import pytest
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import languages
from codelode.sources import files, globs


@pytest.mark.parametrize(
    "line, expected",
    [
        ("target/", ["**/target", "**/target/**"]),
        ("*.log", ["**/*.log"]),
        ("/build", ["build"]),
        ("/build/", ["build", "build/**"]),
        ("**/x", ["**/x"]),
        ("  a.txt ", ["**/a.txt"]),
        ("# note", []), ("!keep", []), ("", []), ("/", []),
    ],
)
def test_gitignore_line(line, expected):
    assert globs.gitignore_to_globs(line) == expected


def test_nested_gitignore_is_anchored():
    assert globs.gitignore_globs(["*.log", "/gen/"], "src") == ["src/**/*.log", "src/gen", "src/gen/**"]


@pytest.mark.parametrize(
    "includes, excludes, path, kept",
    [
        (["**/*.py"], [], "src/main.py", True),
        (["**/*.py"], [], "main.py", True),
        (["**/*.py"], [], "src/main.rs", False),
        (["**/*.sql"], ["**/target/**"], "admin/target/classes/db/schema.sql", False),
        (["**/*.sql"], ["**/target/**"], "src/target.sql", True),
        (["**/*.java"], ["**/target", "**/target/**"], "target/A.java", False),
        (["**/*.java"], ["**/target"], "target/A.java", False),
        ([], [], "src/main.py", False),
        (["*.py"], [], "deep/down/x.py", True),
        (["src/*.py"], [], "src/a/x.py", False),
        (["src/?.py"], [], "src/x.py", True),
        (["**/[ab]*.py"], [], "q/bc.py", True),
        (["**/[!ab]*.py"], [], "q/bc.py", False),
        (["**/a+b.py"], [], "a+b.py", True),
    ],
)
def test_path_rule(spark, includes, excludes, path, kept):
    row = spark.createDataFrame([(path,)], "p string")
    assert row.select(globs.path_matches(F.col("p"), includes, excludes)).first()[0] is kept


def test_pattern_precedence():
    pick = lambda *a, **k: globs.choose_patterns(["I"], ["E"], *a, **k)
    assert pick([]) == (["I"], ["E"])
    assert pick(["g"]) == (["I"], ["g"])
    assert pick(["g"], ["**/*.md"], ["tmp/"]) == (["**/*.md"], ["g", "**/tmp", "**/tmp/**"])
    assert pick(["g"], use_gitignore=False) == (["I"], ["E"])


def _write(root, texts):
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    _write(one, {
        ".gitignore": "target/\n*.log\n", "src/.gitignore": "/gen\n", "src/a b.py": "x = 1\n",
        "src/gen/z.py": "no", "target/q.py": "no", "run.log": "no", "keep/gen/z.py": "yes", "img.png": "no",
        "bad.txt": b"ok \xff end",
    })
    _write(two, {"main.rs": "fn main() {}\n"})
    found = files.scan(spark, [str(one), str(two)]).collect()
    assert sorted((r.source_name, r.filename) for r in found) == [
        ("files_0", ".gitignore"), ("files_0", "bad.txt"), ("files_0", "keep/gen/z.py"), ("files_0", "src/.gitignore"), ("files_0", "src/a b.py"), ("files_1", "main.rs"),
    ]
    by_name = {r.filename: r.content for r in found}
    assert by_name["src/a b.py"] == "x = 1\n"
    assert by_name["bad.txt"] == "ok � end"
    only = files.scan(spark, [str(one)], include=["**/*.py"], exclude=["src/"], use_gitignore=False)
    assert sorted((r.source_name, r.filename) for r in only.collect()) == [("files", "keep/gen/z.py")]
    assert files.full_path(spark, "x").endswith("/x")


def test_scan_filters_names_while_listing(spark, tmp_path):
    _write(tmp_path, {"a.py": "x"})
    assert globs.listing_glob(catalog.DEFAULT_INCLUDES).startswith("{*.py,")
    assert globs.listing_glob(["src/*.py"]) is None
    names = files.scan(spark, [str(tmp_path)]).select("filename")
    assert "content" not in names._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


@pytest.mark.parametrize(
    "path, language",
    [
        ("a/Makefile", "Makefile"), ("DOCKERFILE", "Dockerfile"), ("CMakeLists.txt", "CMake"), ("go.mod", "Go"),
        ("x/stack.yaml", "Haskell"), ("my-docker-compose.yml", "Dockerfile"), ("a.PY", "Python"), ("a.R", "R"),
        ("a.pyi", "pyi"), ("noext", "Unknown"), (".bashrc", "Unknown"), ("a.b/c", "Unknown"), ("x.tar.rs", "Rust"),
        ("pom.xml", "Maven"), ("build.gradle.kts", "Gradle"),
    ],
)
def test_language(spark, path, language):
    row = spark.createDataFrame([(path,)], "p string")
    assert row.select(languages.language_of(F.col("p"))).first()[0] == language


def test_catalog_sizes():
    assert len(catalog.CHUNK_COLUMNS) == 46
    assert len(catalog.DEFAULT_INCLUDES) == 128
    assert len(catalog.DEFAULT_EXCLUDES) == 54
    assert len(catalog.NODE_WEIGHTS) == 41
    assert len(catalog.CHUNK_PARAMS) == 26
    assert languages.scaled_params(50)["Python"] == (500, 150, 125, 2000)
    assert languages.model_for_language_name("TSX") == "microsoft/unixcoder-base"
    assert languages.model_args("microsoft/x") == {"trust_remote_code": True}


def test_selector(spark):
    rows = spark.createDataFrame(
        [("js", None), (None, "a.kt"), ("tsx", None), (" PY ", None), (None, "a.unknown")], "l string, p string"
    )
    picked = rows.select(languages.select_model(F.col("l"), F.col("p")).alias("m")).collect()
    assert [r.m.split("/")[1] for r in picked] == [
        "graphcodebert-base", "unixcoder-base", "all-mpnet-base-v2", "graphcodebert-base", "all-mpnet-base-v2",
    ]
    assert rows.select(languages.select_model(F.col("l"), force="mine").alias("m")).first().m == "mine"
