"""The keyed chunk table on plain Parquet.

Three datasets lie side by side, each with one folder per attempt to write a run:

* ``chunks`` - the rows a run added;
* ``stale``  - (file, older run) pairs the run replaced or removed;
* ``files``  - one small row per file of the run: its version, or a removal.

An attempt writes to fresh folders and becomes a run by one small file in
``commits``, created last and never overwritten.  Readers open the folders of
committed attempts only, so an aborted or repeated attempt can neither show rows
nor hide any.  A commit may carry a token; a second one with the same token is
refused, which makes a replayed batch of a stream a run that is already there.
A run only appends, so its cost follows what changed.  ``compact`` makes one run
of all current rows; readers start at the last such run.  One writer at a time.

The states of files are kept in levels: once ``FAN`` of the latest segments are of like
size they are merged into one, so readers open a number of segments that grows with the
logarithm of the rows, and each row is merged as often.  A merged segment counts from the
moment its marker in ``levels`` is there; until then the ones it was made of are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions.text import content_hash

BASE = "base"
FAN = 4
FILE_KEY = ["source_name", "filename"]
FILE_SCHEMA = "source_name string, filename string, version string, removed boolean, run bigint"
STALE_SCHEMA = "source_name string, filename string, stale_run bigint, run bigint"
CHUNK_SCHEMA = ", ".join(f"`{n}` {k}" for n, k in catalog.CHUNK_COLUMNS) + ", run bigint"


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str] = catalog.CHUNK_KEY) -> DataFrame:
    """Existing rows with the rows of ``updates`` put in by key."""
    kept = existing.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates)


def replace_files(existing: DataFrame, new_rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Whole-file replacement: all rows of files in ``new_rows`` or ``gone``
    leave, the new rows come in.  Stale chunks of a shrunk file vanish too."""
    touched = new_rows.select(*FILE_KEY).unionByName(gone.select(*FILE_KEY)).distinct()
    return existing.join(touched, FILE_KEY, "left_anti").unionByName(new_rows)


def snapshot(files: DataFrame) -> DataFrame:
    """One row per file with its version.

    With a file scan that is time and size, which the listing knows without
    opening a file; otherwise it is the content hash.
    """
    if "modified" in files.columns:
        version = F.concat_ws(":", F.unix_micros("modified"), F.col("n_bytes"))
    else:
        version = content_hash("content")
    return files.select(*FILE_KEY, version.alias("version"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each file between two snapshots:
    ``added``, ``changed``, ``removed`` or ``unchanged``.  Where the earlier one is
    a manifest, ``stale_run`` tells which run holds the file's rows."""
    held = [F.col("run").alias("stale_run")] if "run" in before.columns else []
    old = before.select(*FILE_KEY, F.col("version").alias("_old"), *held)
    new = after.select(*FILE_KEY, F.col("version").alias("_new"))
    state = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
        .otherwise("unchanged")
    )
    return old.join(new, FILE_KEY, "full_outer").select(*FILE_KEY, state.alias("state"), *(["stale_run"] if held else []))


def to_merge(rows: list[int]) -> int:
    """How many of the latest segments, given their rows, are to become one; 0 if none.

    Size classes are powers of ``FAN``.  Older segments of a lower class than the latest
    join it, so classes fall from old to new; ``FAN`` of one class become one of a higher."""
    classes = [0] * len(rows)
    for k, n in enumerate(rows):
        while n >= FAN:
            n, classes[k] = n // FAN, classes[k] + 1
    older = list(reversed(classes[:-1]))
    lower = next((k for k, c in enumerate(older) if c >= classes[-1]), len(older)) if rows else 0
    if lower:
        return lower + 1
    equal = next((k for k, c in enumerate(reversed(classes)) if c != classes[-1]), len(classes))
    return equal if equal >= FAN else 0


class ChunkStore:
    """A chunk table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return path.getFileSystem(conf), path

    def drop_work(self, folder: str) -> None:
        """Remove a folder of intermediate decisions below the store."""
        files, path = self._place(folder.removeprefix(f"{self.folder}/"))
        files.delete(path, True)

    def commits(self) -> list[tuple[int, str, str]]:
        """(run, attempt, token) of the runs that count, oldest first."""
        files, path = self._place("commits")
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        found = sorted((int(run), attempt, token) for run, attempt, token in (n.split(".", 2) for n in names if n.count(".") >= 2))
        base = max((k for k, c in enumerate(found) if c[2] == BASE), default=0)
        return found[base:]

    def runs(self) -> list[int]:
        """Numbers of the runs that count, oldest first."""
        return [run for run, _, _ in self.commits()]

    def has(self, token: str) -> bool:
        """Whether a run was committed with this token, also before the last compaction."""
        files, path = self._place("commits")
        return files.exists(path) and any(s.getPath().getName().split(".", 2)[-1] == token for s in files.listStatus(path))

    def _read(self, name: str, schema: str) -> DataFrame:
        attempts = [attempt for _, attempt, _ in self.commits()]
        if not attempts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/{attempt}" for attempt in attempts))

    def segments(self, before: int | None = None) -> list[tuple[int, int, int | None, str]]:
        """(first run, last run, rows if known, folder) of the file states, oldest first,
        optionally of the runs before one: the widest merged segments, else single runs."""
        runs = {run: attempt for run, attempt, _ in self.commits() if before is None or run < before}
        files, path = self._place("levels")
        wide: dict[int, list[tuple[int, int, str]]] = {}
        for status in files.listStatus(path) if files.exists(path) else []:
            first, last, rows, place = status.getPath().getName().split(".", 3)
            wide.setdefault(int(first), []).append((int(last), int(rows), place.replace("_", "/")))
        found, after = [], -1
        for run in sorted(runs):
            if run <= after:
                continue
            after, rows, place = max((w for w in wide.get(run, []) if w[0] in runs), default=(run, None, f"files/{runs[run]}"))
            found.append((run, after, rows, f"{self.folder}/{place}"))
        return found

    def _mark(self, first: int, last: int, rows: int, place: str) -> None:
        files, path = self._place(f"levels/{first}.{last}.{rows}.{place.replace('/', '_')}")
        files.create(path, True).close()

    def merge_levels(self) -> None:
        """Merge the latest segments of like size; called after each run."""
        while True:
            found = self.segments()
            for k, (first, last, rows, place) in enumerate(found):
                if rows is None:
                    rows = self._states([place]).count()
                    self._mark(first, last, rows, place.removeprefix(f"{self.folder}/"))
                    found[k] = (first, last, rows, place)
            count = to_merge([rows for _, _, rows, _ in found])
            if not count:
                return
            chosen = found[-count:]
            merged = self._latest(self._states([place for *_, place in chosen]))
            if count == len(found):
                merged = merged.filter("NOT removed")  # nothing older is left to hide
            place = f"merged/{uuid.uuid4().hex}"
            merged.hint("rebalance").sortWithinPartitions(*FILE_KEY).write.parquet(f"{self.folder}/{place}")
            rows = self._states([f"{self.folder}/{place}"]).count()
            self._mark(chosen[0][0], chosen[-1][1], rows, place)

    def _states(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(FILE_SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], FILE_SCHEMA)

    def _latest(self, rows: DataFrame) -> DataFrame:
        latest = F.max_by(F.struct("version", "removed"), "run")
        found = rows.groupBy(*FILE_KEY).agg(latest.alias("_s"), F.max("run").alias("run"))
        return found.select(*FILE_KEY, "_s.version", "_s.removed", "run")

    def manifest(self, only: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The latest state of every file, or of the files in ``only``, optionally as it
        was before a run.  Removed files are listed until nothing older needs to be hidden."""
        rows = self._states([place for *_, place in self.segments(before)])
        if only is not None:
            rows = rows.join(only.select(*FILE_KEY), FILE_KEY, "left_semi")
        return self._latest(rows)

    def table(self) -> DataFrame:
        """The current chunk rows."""
        stale = self._read("stale", STALE_SCHEMA).select(*FILE_KEY, F.col("stale_run").alias("run"))
        return self._read("chunks", CHUNK_SCHEMA).join(stale, [*FILE_KEY, "run"], "left_anti").drop("run")

    def next_run(self) -> int:
        return max(self.runs(), default=-1) + 1

    def _commit(self, run: int, attempt: str, token: str) -> None:
        files, path = self._place(f"commits/{run}.{attempt}.{token}")
        files.create(path, False).close()

    def write_run(
        self, run: int, chunks: DataFrame, files: DataFrame, removed: DataFrame | None = None, token: str = "", replaced: DataFrame | None = None
    ) -> None:
        """Store one run: rows, what they replace, the file states, and last the commit.

        ``replaced`` (file key and ``stale_run``) spares a look at the earlier states
        where the caller knows which runs hold the files' present rows."""
        if run in self.runs():
            raise ValueError(f"run {run} is already there")
        attempt = uuid.uuid4().hex
        states = files.select(*FILE_KEY, "version", F.lit(False).alias("removed"))
        if removed is not None:
            gone = removed.select(
                *FILE_KEY, F.lit(None).cast("string").alias("version"), F.lit(True).alias("removed")
            )
            states = states.unionByName(gone)
        if replaced is None:
            earlier = self.manifest(states, run).filter(~F.col("removed"))
            replaced = earlier.select(*FILE_KEY, F.col("run").alias("stale_run"))
        number = F.lit(run).cast("bigint")
        # Spark splits large and joins small partitions here: few files, rows of a language together.
        rows = chunks.withColumn("run", number).hint("rebalance", "language", "embedding_model")
        rows = rows.sortWithinPartitions("language", "embedding_model", *FILE_KEY)
        for name, part in (("chunks", rows), ("stale", replaced.withColumn("run", number)), ("files", states.withColumn("run", number))):
            part.write.parquet(f"{self.folder}/{name}/{attempt}")
        self._commit(run, attempt, token)
        self.merge_levels()

    def clear(self) -> None:
        """Forget everything: the commits first, then the rows."""
        for name in ("levels", "commits", "merged", "files", "stale", "chunks"):
            files, path = self._place(name)
            files.delete(path, True)

    def compact(self, target: ChunkStore | None = None) -> None:
        """Rewrite the current rows as one run: of another, empty store, or of this
        one, whose readers then start there."""
        states = self.manifest().filter(~F.col("removed"))
        if target is not None:
            target.write_run(0, self.table(), states)
        elif self.runs():
            self.write_run(self.next_run(), self.table(), states, token=BASE)

    def info(self) -> dict:
        """Row count, columns and which known columns are absent."""
        rows = self.table()
        return {
            "table_name": self.folder,
            "row_count": rows.count(),
            "columns": [
                {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in rows.schema
            ],
            "missing_columns": sorted({n for n, _ in catalog.CHUNK_COLUMNS} - set(rows.columns)),
        }
