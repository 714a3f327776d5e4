"""Sources by id: digests, differences and refusals."""

import pytest

from scoreloom.operators import alignment

SCHEMA = "id string, prompt string, fold int, pred double"
ROWS = [(f"i{k:02d}", "pq"[k % 2] if k else None, k % 3, float(k)) for k in range(12)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_digests_are_free_of_order(spark):
    get = lambda rows, parts=2: tuple(alignment.set_digest(frame(spark, rows, parts), ["id", "prompt"]).first())
    whole = get(ROWS)
    assert whole == get(ROWS[::-1], 5)
    twice = [*ROWS, ROWS[3], ROWS[3]]
    assert len({whole, get(ROWS[1:]), get(twice), get([*ROWS[1:], ("i00", "p", 0, 0.0)]), get([])}) == 5


def test_sources_align(spark):
    many = {f"s{i}": frame(spark, [(*r[:3], r[3] + i) for r in ROWS], 1 + i) for i in range(5)}
    got = {r.id: r for r in alignment.align(many, "id", ["pred"], equal=["prompt", "fold"]).collect()}
    assert len(got) == 12 and got["i00"].prompt is None
    assert [got["i07"][f"pred_s{i}"] for i in range(5)] == [7.0 + i for i in range(5)]
    assert alignment.align({s: d.where("false") for s, d in many.items()}, "id", ["pred"]).count() == 0


def test_differences_are_told(spark):
    odd = [*ROWS[1:7], ROWS[2], *((r[0], "other", r[2], 0.0) for r in ROWS[7:]), ("new", None, 0, 0.0)]
    sources = {"a": frame(spark, ROWS), "b": frame(spark, odd)}
    got = {(r.source, r.kind): (r.n, r.ids) for r in alignment.differences(sources, "id", ["prompt", "fold"]).collect()}
    assert got == {("b", "missing"): (1, ["i00"]), ("b", "extra"): (1, ["new"]), ("b", "repeated"): (1, ["i02"]), ("b", "prompt"): (5, [f"i{k:02d}" for k in range(7, 12)])}
    with pytest.raises(ValueError, match=r"b missing 1 \(i00\); b prompt 5 \(i07, i08, i09, i10, i11\)"):
        alignment.align(sources, "id", ["pred"], equal=["prompt", "fold"])
    assert alignment.differences({"a": sources["a"], "b": sources["a"]}, "id", ["prompt"]).count() == 0
    with pytest.raises(ValueError, match="columns missing: b: pred"):
        alignment.align({"a": sources["a"], "b": sources["a"].drop("pred")}, "id", ["pred"])
    twice = frame(spark, [*ROWS, ROWS[0]])
    with pytest.raises(Exception, match="repeated id i00"):  # the same repeats in all sources: digests agree
        alignment.align({"a": twice, "b": twice}, "id", ["pred"]).collect()
