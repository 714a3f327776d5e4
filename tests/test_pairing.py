"""Pair batches against the rules that a sequential loop keeps."""

import collections
import math
import random

import pytest

from scoreloom.operators import pairing

SCHEMA = "id string, p string, a double, b double"


def batches(spark, rows, **kw):
    got = pairing.pair_batches(spark.createDataFrame(rows, SCHEMA).repartition(3), prompt="p", key="id", scores=["a", "b"], **kw).orderBy("batch").collect()
    return [(r.prompt, r.l, r.r) for r in got]


def covered_by_loop(rows, gap, seed):
    """Rows that picking pairs one by one covers, uncovered rows first."""
    rng, out = random.Random(seed), 0
    for p in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == p]
        pairs = [(x[0], y[0]) for i, x in enumerate(mine) for y in mine[i + 1 :] if max(abs(x[2] - y[2]), abs(x[3] - y[3])) > gap]
        left = {r[0] for r in mine}
        for _ in range(math.ceil(len(mine) / 2)):
            pick = rng.choice([x for x in pairs if x[0] in left or x[1] in left] or pairs)
            left -= set(pick)
        out += len(mine) - len(left)
    return out


@pytest.mark.parametrize("gap", [0.0, 1.0])
def test_pairs_keep_the_rules(spark, gap):
    rng = random.Random(1)
    rows = [(f"i{i}", rng.choice("xxxxy"), rng.randint(2, 10) / 2, rng.randint(2, 10) / 2) for i in range(301)]
    rows += [(f"h{i}", "hot", 3.0, 3.0) for i in range(90)] + [(f"o{i}", "hot", 5.0, 1.0) for i in range(10)]
    got = batches(spark, rows, gap=gap)
    of = {r[0]: r for r in rows}
    n = collections.Counter(r[1] for r in rows)
    assert collections.Counter(p for p, _, _ in got) == {p: math.ceil(k / 2) for p, k in n.items()}
    for p, x, y in got:
        x, y = of[x], of[y]
        assert x[1] == y[1] == p and x[0] != y[0] and max(abs(x[2] - y[2]), abs(x[3] - y[3])) > gap
    covered = {k for _, x, y in got for k in (x, y)}
    assert len(covered) >= max(covered_by_loop(rows, gap, s) for s in range(3))
    assert got == batches(spark, rows[::-1], gap=gap) != batches(spark, rows, gap=gap, epoch=1)


def test_small_prompts(spark):
    two = [("a", "p", 1.0, 1.0), ("b", "p", 1.0, 2.0)]
    assert batches(spark, two) == [("p", "a", "b")]
    three = [*two, ("c", "p", 1.0, 1.0)]  # two batches for two kinds of rows
    assert {frozenset(x[1:]) for x in batches(spark, three)} == {frozenset("ab"), frozenset("bc")}
    far = [("a", "p", 1.0, 1.0), ("b", "p", 5.0, 1.0), ("c", "p", 3.0, 1.0)]  # c differs from none by more than 3: a pair comes twice
    assert [x[1:] for x in batches(spark, far, gap=3.0)] == [("a", "b"), ("a", "b")]
    with pytest.raises(Exception, match="no pair of different scores for prompt q"):
        batches(spark, [*two, ("c", "q", 1.0, 1.0), ("d", "q", 1.0, 1.0)])
    with pytest.raises(ValueError, match="gap"):
        batches(spark, two, gap=-1)
    assert batches(spark, []) == []
