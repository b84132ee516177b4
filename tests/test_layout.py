"""Haskell layout: every character once, exact cuts, recovery."""

import random

from codelode.functions import layout
from codelode.operators.layout import RECOVERY, layout_chunks

TEXT = """\
{- header
module Fake where
-}
module A where
import B
import C

-- | adds
add :: Int -> Int
add x
  | x > 0 = x
  | otherwise = go x
  where
    go y = y
add _ = 0

where broken
  inner lost
) also lost

data T = A
  | B
instance Show T where
  show A = "a"
  show B = "b"
(<+>) :: T -> T -> T
a <+> b = a"""


def chunks(spark, text, **sizes):
    rows = spark.createDataFrame([(text,)], "content string")
    return layout_chunks(rows, "m", **sizes).first().chunks


def test_declarations_and_recovery(spark):
    got = [(c.start, c.end, c.category, c.chunking_method) for c in chunks(spark, TEXT, limit=10_000, least=0)]
    assert got == [
        (1, 4, "module", "m"), (5, 5, "import", "m"), (6, 7, "import", "m"), (8, 16, "function", "m"),
        (17, 20, RECOVERY, "rust_haskell_error_recovery"), (21, 22, "data_type", "m"), (23, 25, "instance", "m"),
        (26, 26, "function", "m"), (27, 27, "function", "m"),
    ]
    joined = chunks(spark, TEXT, limit=10_000, least=20)
    assert (5, 7, "import") in [(c.start, c.end, c.category) for c in joined]
    wide = chunks(spark, "f = " + "x" * 5000 + "\ng = 1\n", limit=1800, least=0)
    assert [(c.start, c.end, len(c.content)) for c in wide] == [(1, 1, 1800), (1, 1, 1800), (1, 1, 1404), (2, 2, 5)]
    assert chunks(spark, "  \n\t\n") == [] and chunks(spark, "") == [] and chunks(spark, None) is None
    assert [(c.start, c.end) for c in chunks(spark, "\n\n  indented first\nf = 1")] == [(1, 3), (4, 4)]


def test_large_ones_are_cut_at_nested_nodes(spark):
    text = "f x = do\n" + "".join(f"  step {k}\n    more {k}\n" for k in range(40)) + "g = 1"
    got = chunks(spark, text, limit=120, least=0)
    assert "\n".join(c.content for c in got) == text
    assert all(len(c.content) <= 120 for c in got) and len(got) <= 2 + len(text) // 80
    assert all(c.content.startswith(("f x", "  step", "g")) for c in got)  # never between a step and what is in it


def test_every_line_once():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 40)
        indents = [rng.choice([-1, 0, 0, 2, 4, 6]) for _ in range(n)]
        sizes, kinds, names = ([rng.randrange(top) for _ in range(n)] for top in (30, 10, 3))
        limit, least = rng.randrange(1, 200), rng.randrange(50)
        found = layout.spans(indents, sizes, kinds, names, limit, least)
        if max(indents) < 0:
            assert found == []
            continue
        assert [a for a, _, _ in found] == [0, *[b for _, b, _ in found[:-1]]] and found[-1][1] == n
        for a, b, _ in found:  # over the limit only where nothing is nested
            if sum(sizes[a:b]) > limit:
                inked = [k for k in range(a, b) if indents[k] >= 0]
                assert len(inked) <= 1 or (a == 0 and len(inked) == 2 and indents[0] < 0) or all(indents[k] > indents[inked[0]] for k in inked[1:])


def test_deep_and_long_texts_take_linear_time():
    n = 200_000
    assert layout.spans(list(range(n)), [5] * n, [3] * n, [1] * n, 100, 0)[-1][1] == n
    assert len(layout.spans([0] * n, [5] * n, [3] * n, list(range(n)), 100, 0)) == n
    assert layout.spans([0] * n, [5] * n, [3] * n, [1] * n, 100, 0)[-1][1] == n
