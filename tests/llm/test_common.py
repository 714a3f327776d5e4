import random

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import common


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)], [(i, 50) for i in range(50)], None])
def test_components(spark, edges):
    if edges is None:
        rng = random.Random(1)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len(nodes)
    assert {r.node: r.root for r in got} == {x: find(x) for x in nodes}


def test_runs_join_batches():
    b = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([], []), ([2, 2], [4, 5]), ([3], [6]))]
    assert [g.column("v").to_pylist() for g in common.runs(b, ["k"])] == [[1, 2], [3, 4, 5], [6]]


def test_words_and_hashes():
    texts = [b"ab cd", b"", b"  ", b"cd", b"ab"]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    s, e, at = common.words(data, off)
    assert [data[a:z].tobytes() for a, z in zip(s, e, strict=True)] == [b"ab", b"cd", b"cd", b"ab"]
    assert at.tolist() == [0, 2, 2, 2, 3, 4]
    h = common.span_hash(data, s, e)
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    full, row, pos = common.shingles(h, at, 2)
    assert row.tolist() == [0, 3, 4] and pos.tolist() == [0, 2, 3] and len(set(full.tolist())) == 3
