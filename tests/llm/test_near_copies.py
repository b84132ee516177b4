"""What the near-copy join moves and reads again, on rows made here."""

from __future__ import annotations

import random
import re

import numpy as np

from codelode.llm import jaccard, tables


def _rows(spark):
    """40 texts of their own, 20 near copies of one, a NULL and an empty text."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"t{k}x{i}" for i in range(80))) for k in range(40)]
    for k in range(20):
        copy = [f"w{i}" for i in range(80)]
        copy[rng.randrange(80)] = f"e{k}"
        rows.append((100 + k, " ".join(copy)))
    return spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")


def test_n_grams_are_shuffled_once_to_be_written_with_their_blocks(spark, monkeypatch):
    exchanges, kept, conf = [], tables.kept, "spark.sql.autoBroadcastJoinThreshold"

    def seen(frame, purpose, *rest):
        if purpose == "blocked-sets":
            plan = frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
            exchanges.append([x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan) if re.search(r"\bgrams#|\bfirst#|\bvalue#", x)])
        return kept(frame, purpose, *rest)

    monkeypatch.setattr(tables, "kept", seen)
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")  # tables are not small where it matters
    try:
        found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(_rows(spark)).collect()}
    finally:
        spark.conf.set(conf, before)
    assert [len(x) for x in exchanges] == [1]
    assert found == {k: k for k in [*range(40), 200, 201]} | {100 + k: 100 for k in range(20)}


def test_texts_without_a_chained_set_are_not_hashed_again(spark, monkeypatch):
    passed, chains, members = [], jaccard.chains, jaccard.members

    def round_of(*values, **named):
        passed.append([v for v in (*values, *named.values()) if isinstance(v, np.ndarray)])
        return chains(*values, **named)

    def last(*values, **named):
        passed.append([v for v in (*values, *named.values()) if isinstance(v, np.ndarray)])
        return members(*values, **named)

    monkeypatch.setattr(jaccard, "chains", round_of)
    monkeypatch.setattr(jaccard, "members", last)
    assert jaccard.near_duplicates(_rows(spark)).where("NOT first").count() == 19
    hashes = {r.h for r in _rows(spark).selectExpr("xxhash64(coalesce(text, '')) AS h", "doc_id").where("doc_id BETWEEN 100 AND 119").collect()}
    want = np.array(sorted(hashes), np.int64)
    assert len(passed) > 2 and all(tables.has_bit(p[-1], want).all() and np.bitwise_count(p[-1]).sum() <= 20 for p in passed[1:])
    assert all(len(p) == 3 for p in passed[1:])  # the order, the sets and the texts still asked for
