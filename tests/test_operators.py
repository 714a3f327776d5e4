"""Exact values, invariants and refusals of the operators that SQL does not cover."""

import hashlib
import inspect
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom import cli, plans
from scoreloom.functions import hashing as H
from scoreloom.functions import text as T
from scoreloom.functions.numbers import TRAITS, correlation, ratio, unit
from scoreloom.operators import combined, comparison, folds, metrics, models, neighbours, rationale, terms, training
from scoreloom.sources import control, strict
from scoreloom.streaming import scoring


def fails(df):
    with pytest.raises(Exception):
        df.collect()
    return True


# ------------------------------------------------------------------- metrics


def test_metric_values(spark):
    d = spark.createDataFrame([("content", 1.0, 2.0), ("content", 3.0, 2.0)], "trait string, gold double, pred double")
    r = metrics.regression_metrics(metrics.cells(d, ["trait"]), ["trait"]).first()
    assert (r.rmse, r.mae, r.bias, r.pearson, r.spearman, r.within_0_5, r.within_1_0) == (1, 1, 0, 0, 0, 0, 1)
    assert abs(r.gold_sd - math.sqrt(2)) < 1e-12 and r.pred_sd == 0


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(0)
    g, p = np.round(rng.uniform(1, 5, 500), 1), rng.uniform(1, 5, 500)
    d = spark.createDataFrame(pd.DataFrame({"trait": "x", "gold": g, "pred": p}))
    r = metrics.regression_metrics(metrics.cells(d, ["trait"]), ["trait"]).first()
    ranks = [pd.Series(x).rank() for x in (g, p)]
    assert np.allclose([r.rmse, r.pearson, r.spearman], [np.sqrt(np.mean((p - g) ** 2)), np.corrcoef(g, p)[0, 1], np.corrcoef(*ranks)[0, 1]])


def test_single_row_and_unguarded(spark):
    d = spark.createDataFrame([("x", 2.0, 3.0)], "trait string, gold double, pred double")
    c = metrics.cells(d, ["trait"])
    assert metrics.regression_metrics(c, ["trait"]).first().spearman == 0
    assert metrics.regression_metrics(c, ["trait"], guarded=False).first().spearman is None


def test_alignment_refuses(spark):
    g = spark.createDataFrame([("a", 1), ("b", 2)], "id string, g int")
    assert metrics.align(g, spark.createDataFrame([("b", 1), ("a", 2)], "id string, p int")).count() == 2
    for rows in ([("a", 1)], [("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 1), ("b", 2)]):
        assert fails(metrics.align(g, spark.createDataFrame(rows, "id string, p int")))


def test_length_quantiles_keep_order_of_ties(spark):
    d = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([3, 3, 3, 3, 3, 3])], "ordinal int, essay string")
    got = [r.length_quantile for r in metrics.length_quantiles(d).orderBy("ordinal").collect()]
    assert got == [0, 0, 1, 2, 2, 3]


# --------------------------------------------------------------------- folds


def brute_folds(rows, k=5, seed=42):
    h = lambda v: int.from_bytes(hashlib.blake2b(f"{seed}\0{v}".encode(), digest_size=8).digest(), "big")
    strata = {}
    for i, *key in rows:
        strata.setdefault(tuple(key), []).append(i)
    total, out = [0] * k, {}
    for key, ids in sorted(strata.items(), key=lambda x: (-len(x[1]), h(repr(x[0])))):
        own = [0] * k
        for i in sorted(ids, key=lambda i: (h(i), i)):
            f = min(range(k), key=lambda c: (own[c], total[c], h(f"{key!r}\0{c}")))
            out[i] = f
            own[f] += 1
            total[f] += 1
    return out


def test_folds_equal_the_greedy_loop(spark):
    rows = [(f"id{i}", f"Q{1 + i % 3}", str(2023 + i % 2), i % 17 // 4) for i in range(153)]
    d = spark.createDataFrame(rows, "id string, prompt_num string, cohort string, band int")
    got = {r.id: r.fold for r in folds.stratified_folds(d).collect()}
    assert got == brute_folds(rows)
    assert {r.id: r.fold for r in folds.stratified_folds(d.orderBy(F.rand(3))).collect()} == got
    sizes = np.bincount(list(got.values()))
    assert sizes.max() - sizes.min() <= 1
    v = folds.validate_folds(spark.createDataFrame(list(got.items()), "id string, fold int"), "id", 5).first()
    assert tuple(v) == (153, 153, 0, 0)


def test_lopo_contract(spark):
    d = spark.createDataFrame([(f"i{i}", f"Q{i % 4}") for i in range(12)], "id string, prompt_num string")
    assert tuple(control.lopo_contract(folds.lopo_folds(d)).first()) == (True, True, True)


# -------------------------------------------------------------------- models


def long_rows(n=60):
    rng = np.random.default_rng(7)
    return [("content", f"Q{i % 2}", i % 3, float(rng.uniform(1, 5)), float(rng.uniform(1, 5)), float(rng.uniform(1, 5))) for i in range(n)]


LONG = "trait string, prompt_num string, fold int, gold double, a double, b double"


@pytest.mark.parametrize("op", ["mean", "calibrate", "stack"])
def test_held_labels_do_not_leak(spark, op):
    rows = long_rows()
    other = [(t, p, f, 6 - g if f == 1 else g, a, b) for t, p, f, g, a, b in rows]
    out = []
    for r in (rows, other):
        d = spark.createDataFrame(r, LONG)
        got = {"mean": lambda: models.mean_oof(d, "gold"), "calibrate": lambda: models.calibrate_oof(d, "a", "gold"), "stack": lambda: models.cross_fit_stack(d, ["a", "b"], "gold")}[op]()  # noqa: B023
        col = {"mean": "pred", "calibrate": "calibrated", "stack": "stacked"}[op]
        out.append({(r.a, r.b): r[col] for r in got.where("fold = 1").collect()})
    assert out[0].keys() == out[1].keys() and all(abs(out[0][k] - out[1][k]) < 1e-9 for k in out[0])


def test_calibration_removes_a_line(spark):
    x = np.linspace(1.5, 4.5, 30)
    d = spark.createDataFrame([("content", "Q1" if i < 15 else "Q2", 0, float(0.5 + 0.8 * v), float(v), 0.0) for i, v in enumerate(x)], LONG)
    line, offsets = models.affine(models.moments_xy(d, ["trait", "prompt_num"], "a", "gold"), ["trait"])
    r = line.first()
    assert abs(r.slope - 0.8) < 1e-9 and abs(r.intercept - 0.5) < 1e-9
    new = spark.createDataFrame([("content", "Q9", 0, 0.0, 3.0, 0.0)], LONG)
    assert abs(models.apply_affine(new, line, offsets, ["trait"], "a").first().calibrated - 2.9) < 1e-9


def test_simplex_recovers_weights(spark):
    rng = np.random.default_rng(5)
    s = rng.uniform(1, 5, (20, 3))
    y = s @ [0.5, 0.3, 0.2]
    d = spark.createDataFrame([("content", *map(float, r), float(v)) for r, v in zip(s, y, strict=True)], "trait string, a double, b double, c double, gold double")
    got = {r.source: r.weight for r in models.simplex_weights(d, ["trait"], ["a", "b", "c"], "gold").collect()}
    assert np.allclose([got[k] for k in "abc"], [0.5, 0.3, 0.2], atol=1e-6)
    grid = np.array([(i, j, 20 - i - j) for i in range(21) for j in range(21 - i)]) / 20
    for _ in range(20):
        y = rng.uniform(1, 5, 20)
        w = models.simplex(s.T @ s, s.T @ y)
        assert ((s @ w - y) ** 2).sum() <= min(((s @ v - y) ** 2).sum() for v in grid) + 1e-9


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(6)
    x, fold = rng.normal(size=(60, 4)), np.arange(60) % 3
    y = np.clip(3 + x @ [0.3, -0.2, 0.1, 0.0], 1, 5)
    d = spark.createDataFrame([(i, int(f), r.tolist(), float(v)) for i, (f, r, v) in enumerate(zip(fold, x, y, strict=True))], "i int, fold long, x array<double>, y double")
    got = {r.i: r.pred[0] for r in models.ridge_oof(d, "x", ["y"], 4, alpha=2.0).collect()}
    for f in range(3):
        t = fold != f
        mu, sd = x[t].mean(0), x[t].std(0)
        z = (x - mu) / sd
        w = np.linalg.solve(z[t].T @ z[t] + 2 * np.eye(4), z[t].T @ (y[t] - y[t].mean()))
        assert np.allclose([got[i] for i in np.flatnonzero(~t)], np.clip(y[t].mean() + z[~t] @ w, 1, 5))
    best = models.select_ridge(d, "x", "y", 4, alphas=[0.1, 10.0], widths=[2, 4]).collect()
    assert {r.width for r in best} == {4}


def test_neighbours(spark):
    v = [(1, "p", [1.0, 0.0], 0), (2, "p", [1.0, 0.1], 1), (3, "q", [0.9, 0.0], 1), (4, "z", [0.0, 1.0], 1)]
    q = spark.createDataFrame(v, "id long, prompt_hash string, embedding array<double>, fold long")
    b = q.where("id < 4").withColumn("scores", F.array(*[F.col("id").cast("double")] * 3))
    for block in (1, 4096):
        got = {r.id: r for r in neighbours.knn(q, b, block=block).collect()}
        assert got[1].neighbours == [2] and not got[1].fallback
        assert got[3].fallback and set(got[3].neighbours) == {1, 2}
        assert got[4].fallback and got[4].neighbours[0] == 2
    assert fails(neighbours.knn(q, b, unknown="error"))
    assert fails(spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(unit(F.col("v"))))


# ------------------------------------------------------------------- records


def good(**kw):
    return {"id": "a", "document_id": "d", "prompt_num": "Q1", "prompt": "p", "essay": " e ", "score": {"content": 3.5, "organization": 3, "expression": 4, "average": 3.5}} | kw


@pytest.mark.parametrize(("line", "error"), [
    (json.dumps(good()), None), (json.dumps(good()) + "\r", None), ("", "blank"), ("[1]", "not_object"), ("{", "syntax"), (json.dumps(good()) + "x", "syntax"), (json.dumps(good(extra=1)), "keys"), (json.dumps(good(prompt=" ")), "text"),
    (json.dumps(good(score=good()["score"] | {"content": 5.1})), "score"), (json.dumps(good(score=good()["score"] | {"content": True})), "score"), (json.dumps(good(score=good()["score"] | {"content": "3"})), "score"),
    (json.dumps(good(score=good()["score"] | {"content": float("nan")})), "constant"), ('{"id":"a",' + json.dumps(good())[1:], "duplicate_key"),
])
def test_strict_lines(spark, line, error):
    r = strict.parse_lines(spark.createDataFrame([(line,)], "value string"), "labelled").first()
    assert r.error == error and (r.essay == " e ") == (error is None)


def test_strict_file(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 0)], "id string, fold int")
    path = str(tmp_path / "folds")
    strict.write_folds(d, path)
    assert sorted(map(tuple, strict.read_strict(spark, path, "folds").select("id", "fold").collect())) == [("a", 1), ("b", 0)]
    with pytest.raises(Exception):
        strict.write_folds(d, path)
    strict.write_folds(d.union(d), str(tmp_path / "twice"))
    assert fails(strict.read_strict(spark, str(tmp_path / "twice"), "folds"))


def test_gold_forms(spark):
    rows = ['{"id":"a","score":{"content":2}}', '{"id":"a","scores":{"content":2}}', '{"id":"a","gold_score":{"content":{"score":2}}}', '{"id":"a","content":2}']
    assert [r.content for r in strict.gold_scores(spark.createDataFrame([(x,) for x in rows], "value string")).collect()] == [2.0] * 4


# ---------------------------------------------------------------- rationales

ESSAY = " 저는 찬성한다고 생각합니다. 왜냐하면 근거가 있기 때문이다!  하지만 반대도 있다. 따라서 필요하다. "


def test_ledger_spans(spark):
    for text in (ESSAY, "...", "no end", "", "\n\n가。나\n다"):
        d = rationale.ledger(spark.createDataFrame([(text,)], "essay string"))
        r = d.select("ledger", rationale.spans_hold(F.col("essay"), F.col("ledger")).alias("ok")).first()
        assert r.ok
        for s in r.ledger.spans:
            assert s is None or text[s.start : s.end] == s.text
    assert d.first().ledger.sentence_count == 3


def test_grounding(spark):
    d = rationale.ledger(spark.createDataFrame([(ESSAY,)], "essay string"))
    x = d.withColumn("x", rationale.rationales(F.col("ledger"), {t: F.lit(v) for t, v in zip(TRAITS, (4.5, 3.2, 2.0), strict=True)}))
    v = x.select("x", rationale.valid_rationales(F.col("x")).alias("v"), rationale.grounding(F.col("x"), F.col("essay"), F.col("ledger")).alias("g")).first()
    assert v.v and v.g.accepted and all(h > 0 for h in v.g.hits)
    bad = x.withColumn("x", F.col("x").withField("content", F.lit("통계에 따르면 42 명이 '없는 말'을 했다고 하는 긴 문장이다")))
    g = bad.select(rationale.grounding(F.col("x"), F.col("essay"), F.col("ledger")).alias("g")).first().g
    assert len(g.reasons) == 4 and not g.accepted


def test_text_functions(spark):
    d = spark.createDataFrame([("  A b.  C!\nD? e ", "GWGR2300000001070")], "t string, id string")
    r = d.select(T.feature_sentences(F.col("t")).alias("s"), T.strip(F.lit("　 x\x85")).alias("x"), T.cohort(F.col("id")).alias("c"), T.shorten(F.lit("y" * 70)).alias("q")).first()
    assert r.s == ["A b.", "C!", "D?", "e"] and r.x == "x" and r.c == "2023" and r.q == "y" * 63 + "…"
    assert rationale.fallback_sentence(F.lit("a."), F.lit("b!")) is not None


# ---------------------------------------------------------------- comparison


def _optimum(gram, cross):
    """The best of all active sets."""
    n, best = len(cross), (np.inf, None)
    for mask in range(1, 1 << n):
        i = np.array([j for j in range(n) if mask >> j & 1])
        k = np.block([[gram[np.ix_(i, i)], np.ones((len(i), 1))], [np.ones((1, len(i))), np.zeros((1, 1))]])
        w = np.zeros(n)
        w[i] = np.linalg.lstsq(k, np.r_[cross[i], 1.0], rcond=None)[0][:-1]
        if (w >= -1e-9).all() and abs(w.sum() - 1) < 1e-6:
            best = min(best, (w @ gram @ w - 2 * cross @ w, w.tolist()))
    return best


def test_simplex_of_many_sources():
    rng = np.random.default_rng(5)
    for case in range(60):
        x = rng.normal(size=(40, 4))
        if case % 3 == 0:
            x[:, 3] = x[:, 1]  # a copy
        y = x @ rng.dirichlet(np.ones(4)) + rng.normal(size=40) * (case % 2)
        g, c = x.T @ x / 40, x.T @ y / 40
        w = models.simplex(g, c)
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        assert w @ g @ w - 2 * c @ w == pytest.approx(_optimum(g, c)[0], abs=1e-8)
    for n in (20, 60):
        x = rng.normal(size=(200, n)) + rng.normal(size=(200, 1))
        y = x[:, :7] @ rng.dirichlet(np.ones(7)) + rng.normal(size=200) * 0.3
        g, c = x.T @ x / 200, x.T @ y / 200
        w = models.simplex(g, c)
        slope = g @ w - c
        level = slope[w > 0]
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        assert np.ptp(level) < 1e-8 and (slope >= level.min() - 1e-8).all()  # Karush, Kuhn and Tucker
    assert models.simplex(np.zeros((3, 3)), np.zeros(3)).sum() == 1
    assert models.simplex(np.eye(1), np.ones(1)).tolist() == [1.0]


def test_copies_give_k_neighbours():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sim = rng.integers(0, 4, (30, 50)) / 4.0
        sim[rng.random((30, 50)) < 0.2] = -np.inf
        sim[:3] = 1.0
        keep = neighbours._first(sim, 5)
        for row, mine in zip(sim, keep, strict=True):
            want = sorted((j for j in range(50) if np.isfinite(row[j])), key=lambda j: (-row[j], j))[:5]
            assert np.flatnonzero(mine).tolist() == sorted(want)
    assert neighbours._first(np.array([[1.0, -np.inf]]), 5).tolist() == [[True, False]]


def test_bootstrap_of_equal_predictions(spark):
    d = spark.createDataFrame([(i, "AB"[i % 2], t, 1.0 + i % 3, 2.0, 2.0) for i in range(20) for t in comparison.CRITERIA[:2]], "k int, s string, trait string, gold double, a double, b double")
    for r in comparison.bootstrap_report(d, "k", "a", "b", stratum="s", resamples=10).collect():
        assert (r.point, r.mean, r.sd, r.p_better) == (0, 0, 0, 0.5)
    _, draws = comparison.hash_draws(comparison.joint_rows(d, "k", "a", "b", "s"), resamples=10)
    assert {tuple(r) for r in draws.groupBy("iteration", "s").agg(F.sum("times")).select("s", "sum(times)").collect()} == {("A", 10), ("B", 10)}


def _paired(spark, n=60):
    rng = np.random.default_rng(8)
    rows = [(i, ["A", "B", "C"][i % 3] if i < 50 else "D", t, float(rng.integers(4, 20)) / 4, float(rng.integers(4, 20)) / 4, float(rng.integers(8, 12)) / 4) for i in range(n) for t in ("x", "y")]
    rows += [(1000 + i, "A", t, 2.0, 3.0, 2.0) for i in range(30) for t in ("x", "y")]  # one joint cell
    return spark.createDataFrame(rows, "k int, s string, trait string, gold double, a double, b double").repartition(3)


def test_bootstrap_draws_cells_as_rows(spark):
    """Cells held by tasks, rows met by a shuffle and a plain loop give the same resamples."""
    d = _paired(spark)
    get = lambda **kw: {(r.iteration, r.metric): r.delta for r in comparison.bootstrap_metrics(d, "k", "a", "b", stratum="s", resamples=7, **kw).collect()}
    got = get()
    shuffled = get(cells=0)
    assert got.keys() == shuffled.keys() and len(got) == 8 * 6
    assert all(abs(got[k] - shuffled[k]) < 1e-9 for k in got)
    wide = d.toPandas().pivot(index="k", columns="trait")
    wide = wide.assign(s=wide["s"]["x"]).drop(columns=[("s", "y")], errors="ignore")
    order = [(c, t) for t in ("x", "y") for c in ("gold", "a", "b")]
    for i in range(7):
        rows = []
        for stratum, part in wide.groupby(wide["s"].iloc[:, 0] if hasattr(wide["s"], "columns") else wide["s"]):
            part = part.assign(key=part.index).sort_values([*order, ("key", "")]).reset_index(drop=True)
            for j in range(len(part)):
                h = hashlib.sha256(f"42|{i}|{stratum}|{j // 8}".encode()).hexdigest()[8 * (j % 8) : 8 * (j % 8) + 8]
                rows.append(part.iloc[int(h, 16) % len(part)])
        x = pd.DataFrame(rows)
        e = {c: np.sqrt(((x[(c, "x")] - x[("gold", "x")]).astype(float) ** 2).mean()) for c in ("a", "b")}
        r = {c: x[(c, "x")].astype(float).rank().corr(x[("gold", "x")].astype(float).rank()) for c in ("a", "b")}
        assert got[i, "rmse_x"] == pytest.approx(e["a"] - e["b"], abs=1e-9) and got[i, "spearman_x"] == pytest.approx(r["a"] - r["b"], abs=1e-9)


def test_bootstrap_takes_metrics_of_its_own(spark):
    d = _paired(spark)
    bias = comparison.Sums(lambda g, p: np.stack([np.ones_like(g), p - g], 1), lambda s: s[..., 1] / s[..., 0])
    far = lambda g, p, w: (w * (np.abs(p - g) > 1)).sum() / w.sum()
    many = comparison.bootstrap_report(d, "k", "a", "b", stratum="s", resamples=400, metrics={"bias": bias, "far": far}, draws="multinomial", higher=())
    got = {r.metric: r for r in many.collect()}
    assert set(got) == {f"{m}_{t}" for m in ("bias", "far") for t in ("x", "y", "macro")}
    x = d.where("trait = 'x'").toPandas()
    assert got["bias_x"].point == pytest.approx((x.a - x.b).mean())
    assert got["far_x"].point == pytest.approx(((x.a - x.gold).abs() > 1).mean() - ((x.b - x.gold).abs() > 1).mean())
    within = x.assign(d=x.a - x.b).groupby("s").d
    assert got["bias_x"].sd == pytest.approx(np.sqrt((within.size() * within.var(ddof=0)).sum()) / len(x), rel=0.15)  # of a stratified mean
    assert got["bias_x"].mean == pytest.approx(got["bias_x"].point, abs=4 * got["bias_x"].sd / 20)
    with pytest.raises(ValueError, match="joint cells"):
        comparison.bootstrap_metrics(d, "k", "a", "b", stratum="s", metrics={"far": far}, cells=3)


def test_bootstrap_of_nothing(spark):
    assert comparison.bootstrap_report(_paired(spark).where("false"), "k", "a", "b", stratum="s", resamples=3).count() == 0


def test_bootstrap_report(spark):
    from scoreloom.plans.essays import sources_long

    sf = "/root/testdata/sf0.001"
    got = {r.metric: r for r in plans.queries()["paired_bootstrap"](spark, sf).collect()}
    assert set(got) == {f"{m}_{t}" for m in ("rmse", "spearman") for t in (*TRAITS, "macro")}
    d = sources_long(spark, sf).toPandas()
    for t in TRAITS:
        x = d[d.trait == t]
        e = {s: np.sqrt(((x[s] - x.gold) ** 2).mean()) for s in ("alpha", "beta")}
        r = {s: x[s].rank().corr(x.gold.rank()) for s in ("alpha", "beta")}
        for name, m in (("rmse", e), ("spearman", r)):
            row = got[f"{name}_{t}"]
            assert abs(row.point - (m["alpha"] - m["beta"])) < 1e-5 and row.low < row.point < row.high
    assert inspect.signature(comparison.bootstrap_report).parameters["resamples"].default == cli.RESAMPLES == 2000


def test_document_tfidf_covers_documents(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet").where(F.regexp_like("text", F.lit(r"(?U)\w\w")))
    got = plans.queries()["document_tfidf"](spark, sf).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("one"))
    assert got.count() == d.count() > 0
    assert got.where("abs(one - 1) > 0.001").count() == 0


def test_judgements(spark):
    d = spark.createDataFrame([("A", "B"), ("B", "A"), ("TIE", "TIE"), ("A", "A")], "f string, b string")
    got = d.select(comparison.reconciled(F.col("f"), comparison.unswapped(F.col("b"), F.lit(True))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("A", False), ("B", False), ("TIE", False), ("TIE", True)]
    one = spark.createDataFrame([("r", "c", "TIE", False)], "review_id string, criterion string, decision string, unstable boolean")
    key = spark.createDataFrame([("r", "A")], "review_id string, candidate string")
    assert comparison.tally(one, key).first().decisive_win_rate is None
    assert fails(comparison.tally(one, key.union(spark.createDataFrame([("s", "B")], key.schema))))


def test_losses(spark):
    d = spark.range(1)
    perfect = F.transform(comparison.soft_targets(F.lit(3.0), "content"), lambda p: F.log(p + 1e-300))
    assert abs(d.select(comparison.ordinal_loss(perfect, F.lit(3.0), "content").alias("x")).first().x) < 1e-9
    assert d.select(comparison.pairwise_loss(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(3.0)).alias("x")).first().x is None


def test_epoch_ties(spark):
    d = spark.createDataFrame([("r", 1, 0.5, 0.5), ("r", 2, 0.5, 0.5)], "run string, epoch int, macro_rmse double, macro_spearman double")
    assert [r.epoch for r in comparison.epoch_policy(d).where("chosen").collect()] == [1]
    assert comparison.best_epoch(d).first().epoch == 1


# ------------------------------------------------------------------ the rest


def test_training_pieces(spark):
    d = spark.createDataFrame([("a", [5, 6, 7])], "id string, t array<int>")
    r = d.select(training.padded(F.col("t"), F.lit(5), 0).alias("p"), training.completion_labels(F.col("t"), F.lit(2)).alias("l")).first()
    assert r.p.ids == [5, 6, 7, 0, 0] and r.p.mask == [1, 1, 1, 0, 0] and r.l == [-100, -100, 7]
    assert d.select(training.last_real_token(F.array(F.lit(1), F.lit(1), F.lit(0))).alias("x")).first().x == 1
    assert fails(training.length_gate(d, "t", 2)) and training.length_gate(d, "t", 3).count() == 1
    p = d.select(training.restricted_probabilities(F.array(*[F.lit(float(i)) for i in range(6)]), [0, 2]).alias("p")).first().p
    assert abs(sum(p) - 1) < 1e-12 and p[1] > p[0]
    got = training.score_with(d.select("id"), lambda: lambda b: b.assign(y=1.5), "id string, y double").first()
    assert got.y == 1.5


def test_combination(spark):
    d = spark.createDataFrame([("a", "d1", "Q", "x"), ("b", "d1", "Q", "y")], "id string, document_id string, prompt_num string, essay string")
    with pytest.raises(control.ContractError):
        combined.combine(d, d, acknowledged=False)
    kinds = {(r.field, r.kind) for r in combined.collisions(combined.combine(d, d, acknowledged=True)).collect()}
    assert kinds == {("id", "duplicate"), ("document_id", "conflicting"), ("essay", "duplicate")}
    assert fails(combined.merge_oof([d.select("id"), d.select("id")], d))


def test_control(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    control.write_pair((a, b"1"), (b, b"2"))
    with pytest.raises(FileExistsError):
        control.write_pair((str(tmp_path / "c"), b"1"), (b, b"2"))
    assert not (tmp_path / "c").exists()
    for bad in (lambda: control.require_new(a=a), lambda: control.require_distinct(a=a, b=a), lambda: control.require_outside({"r": str(tmp_path)}, a=a), lambda: control.unchanged({a: "0"})):
        with pytest.raises(control.ContractError):
            bad()
    m = control.manifest("r", str(tmp_path), {"x": 1}, {"a": a})
    control.write_manifest(str(tmp_path / "m.json"), m, create_only=True)
    assert m["inputs"]["a"]["sha256"] == hashlib.sha256(b"1").hexdigest()
    (tmp_path / "lock").write_text("a==1 \\\n --hash=sha256:0\n# c\nB.c==2 ; x\n")
    assert control.locked_requirements(str(tmp_path / "lock")) == {"a": "1", "b-c": "2"}
    d = spark.range(10)
    assert control.fingerprint(d) == control.fingerprint(d.orderBy(F.desc("id")).repartition(3)) != control.fingerprint(spark.range(11))
    f = control.oof_fields(d, d, d, "s", "x", 1)
    with pytest.raises(control.ContractError):
        control.check_oof(f, d, d, d)
    grid = control.task_grid(spark, 2, [1])
    assert fails(control.advance(grid, spark.createDataFrame([(1, 0, "complete")], "seed int, fold int, to string")))


def test_hashes_and_numbers(spark):
    r = spark.range(1).select(H.keyed_blake2b(F.lit(42), F.lit("x")).alias("b"), H.attempt_seed(1, F.lit("R"), F.lit(2)).alias("s"), ratio(F.lit(1), F.lit(0)).alias("z"), correlation(*[F.lit(float(x)) for x in (2, 3, 3, 5, 5, 5)], F.lit(False)).alias("c")).first()
    assert r.b == H.blake2b_hex(42, "x") and r.z == 0 and abs(r.c - 1) < 1e-9
    assert r.s == int(hashlib.sha256(b"1\0R\x002").hexdigest()[:8], 16) & 0x7FFFFFFF


def test_terms(spark):
    d = spark.createDataFrame([(1, "Aa bb aa"), (2, "")], "k int, t string")
    assert sorted(r.term for r in d.select(F.explode(terms.word_grams(F.col("t"))).alias("term")).collect()) == sorted(["aa", "bb", "aa", "aa bb", "bb aa"])
    assert d.select(F.size(terms.char_grams(F.col("t"), 3, 4)).alias("n")).orderBy("n").collect()[1].n == 6 + 5


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "content", "Q1", 3.0), ("b", "content", "Q2", 9.0)], "id string, trait string, prompt_num string, x double").write.parquet(src)
    line = spark.createDataFrame([("content", 1.0, 0.5)], "trait string, slope double, intercept double")
    off = spark.createDataFrame([("content", "Q1", 0.25)], "trait string, prompt_num string, offset double")
    for k in (1, 2):  # a second run, also without its checkpoint, adds nothing
        s = spark.readStream.schema("id string, trait string, prompt_num string, x double").parquet(src)
        scoring.append_new(scoring.calibrated_stream(s, line, off, "x"), str(tmp_path / "log"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted((r.id, r.calibrated) for r in scoring.read_log(spark, str(tmp_path / "log")).collect()) == [("a", 3.75), ("b", 5.0)]


def test_submission_survives_a_crash(spark, tmp_path):
    """A run that dies within a batch goes on: nothing is lost, nothing comes twice, and no batch reads the log."""
    src, log, at = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    schema, tries = "id string, x double", []

    def put(lo, hi):
        spark.createDataFrame([(f"i{k}", float(k)) for k in range(lo, hi)] + [("i0", -1.0)], schema).coalesce(1).write.mode("append").parquet(src)

    def scored(batch):
        tries.append(batch.count())
        out = batch.withColumn("y", F.col("x") * 2)
        if len(tries) == 2:  # dies when its rows are written
            out = out.withColumn("y", F.when(F.col("x") == 15, F.raise_error("killed").cast("double")).otherwise(F.col("y")))
        return out

    def go():
        q = scoring.append_new(spark.readStream.schema(schema).parquet(src), log, at, work=scored)
        q.awaitTermination()

    put(0, 10)
    go()
    put(5, 20)
    with pytest.raises(Exception, match="killed"):
        go()
    go()
    go()  # nothing new
    got = scoring.read_log(spark, log)
    assert sorted((r.id, r.y) for r in got.where("id <> 'i0'").collect()) == sorted((f"i{k}", 2.0 * k) for k in range(1, 20))
    assert got.where("id = 'i0'").count() == 1 and got.select("run").distinct().count() == 1
    assert tries == [10, 10, 10]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in before


def test_nested_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(9)
    n, folds = 60, 4
    x = {t: rng.normal(size=(n, 6)) * [1, 5, 0.1, 1, 1, 0] for t in ("a", "b")}
    y = {t: np.clip(3 + x[t][:, :2] @ [0.5, 0.1] + rng.normal(size=n) * 0.5, 0, 6) for t in x}
    y["b"][7] = np.nan
    rows = [(i, i % folds, *(x[t][i].tolist() for t in x), *(None if np.isnan(y[t][i]) else float(y[t][i]) for t in x)) for i in range(n)]
    d = spark.createDataFrame(rows, "id long, fold long, xa array<double>, xb array<double>, a double, b double").repartition(3)
    pred, choices = models.nested_ridge_oof(d, "id", {"a": "xa", "b": "xb"}, alphas=[0.1, 10.0], widths=[2, 4, 6])

    def ridge(train, t, width, alpha):
        train = train & ~np.isnan(y[t])
        z, v = x[t][:, :width], y[t][train]
        mean, sd = z[train].mean(0), z[train].std(0)
        z = (z - mean) / np.where(sd > 1e-12, sd, 1)
        w = np.linalg.solve(z[train].T @ z[train] + alpha * np.eye(width), z[train].T @ (v - v.mean()))
        return z @ w + v.mean()

    fold = np.arange(n) % folds
    got, told = {r.id: r for r in pred.collect()}, {(r.outer_fold, r.target): r for r in choices.collect()}
    assert len(got) == n and len(told) == 8
    for o in range(folds):
        for t in x:
            scores = []
            for width in (2, 4, 6):
                for alpha in (0.1, 10.0):
                    e = [(ridge((fold != o) & (fold != f), t, width, alpha) - y[t])[(fold == f) & ~np.isnan(y[t])] for f in range(folds) if f != o]
                    scores.append((round(float(np.sqrt(np.mean(np.concatenate(e) ** 2))), 9), width, -alpha))
            best = min(scores)
            r = told[o, t]
            assert (r.width, r.alpha) == (best[1], -best[2]) and r.rmse == pytest.approx(best[0], abs=1e-8)
            want = np.clip(ridge(fold != o, t, r.width, r.alpha), 1, 5)
            assert all(got[i][t] == pytest.approx(want[i], abs=1e-8) for i in np.flatnonzero(fold == o).tolist())
    with pytest.raises(ValueError, match="three folds"):
        models.nested_ridge_oof(d.where("fold < 2"), "id", {"a": "xa"}, alphas=[1.0], widths=[2])
