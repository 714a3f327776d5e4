"""Contracts of lines, sidecars and seeds; hostile values."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import hashing as H
from scoreloom.functions.numbers import TRAITS
from scoreloom.operators import comparison, models, training
from scoreloom.sources import control, strict


def errors(spark, contract, lines):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return [r.error for r in strict.parse_lines(d, contract).orderBy("i").collect()]


def test_hostile_lines_get_an_error_class(spark, tmp_path):
    assert errors(spark, "folds", ['{"id":"a","fold":1}', '{"id":"a","fold":100000000000000000000000000000}', '{"id":"\\ud800","fold":1}', '{"id":"a","fold":true}', None]) == [None, "fold", "unicode", "fold", "blank"]
    big = '{"id":"a","prompt_num":"q","model":"m","prediction":{"content":' + "9" * 400 + ',"organization":1,"expression":1}}'
    assert errors(spark, "canonical", [big]) == ["score"]
    (tmp_path / "x.jsonl").write_bytes(b'{"id":"a","fold":1}\n{"id":"\xff","fold":2}\r\n{"id":"b","fold":3}\r\n')
    got = strict.parse_lines(strict.read_lines(spark, str(tmp_path / "x.jsonl")), "folds").collect()
    assert sorted((r.error or "", r.id or "") for r in got) == [("", "a"), ("", "b"), ("utf8", "")]


def review(**new):
    texts = {t: "why" for t in TRAITS}
    return json.dumps({"review_id": "R1", "prompt_num": "q", "prompt": "p", "essay": "e", "fixed_scores": dict.fromkeys(TRAITS, 3), "option_a": texts, "option_b": texts, "review": strict.NEUTRAL} | new)


def test_reviews_and_keys(spark):
    assert errors(spark, "review", [review(), review(review={}), review(option_a={}), review(essay=" "), review(fixed_scores=dict.fromkeys(TRAITS, 6))]) == [None, "not_neutral", "keys", "text", "score"]
    key = {"review_id": "R1", "id": "a", "option_a": "candidate", "option_b": "baseline"}
    assert errors(spark, "review_key", [json.dumps(key), json.dumps(key | {"option_b": "candidate"}), json.dumps(key | {"option_a": 1})]) == [None, "assignment", "assignment"]
    assert errors(spark, "run", ['{"id":"a","parse_ok":true,"elapsed_sec":1}', '{"id":"a","parse_ok":1}', '{"parse_ok":true}', '{"id":"a","parse_ok":true,"elapsed_sec":-1}']) == [None, "keys", "text", "elapsed"]


def test_sidecars(spark, tmp_path):
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, content double")
    model = tmp_path / "m.bin"
    model.write_bytes(b"x")
    fields = control.prediction_fields(p, p, "knn", "sig", str(model))
    control.check_predictions(fields, p.orderBy("content", ascending=False), p, scorer="knn", signature="sig")
    for bad in (lambda: control.check_predictions(fields, p.limit(1)), lambda: control.check_predictions(fields, p, scorer="x"), lambda: control.check_predictions({}, p), lambda: control.prediction_fields(p, p, " ", "s")):
        with pytest.raises(control.ContractError):
            bad()
    base = control.oof_fields(p, p, p, "s", "sig", 0) | {"checkpoints": control.checkpoint_signature({"f0": str(model)})}
    control.check_precision_pair(base | {"precision": "4bit"}, base | {"precision": "bf16"})
    for a, b in (({"precision": "4bit"}, {"precision": "4bit"}), ({"precision": "4bit"}, {"precision": "bf16", "checkpoints": "y"}), ({"precision": "4bit", "oof_level": 1}, {"precision": "bf16"})):
        with pytest.raises(control.ContractError):
            control.check_precision_pair(base | a, base | b)
    o = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal int, id string")
    assert control.ordered_ids(o) == control.ordered_ids(o.repartition(3)) != control.ordered_ids(o.withColumn("ordinal", 1 - F.col("ordinal")))


def test_epoch_evidence(spark):
    e = [(r, k, 1.0) for r in ("x", "y") for k in (1, 2)]
    d = spark.createDataFrame(e, "run string, epoch int, v double")
    assert control.check_epochs(d, epochs=2, runs=2).count() == 4
    for bad in (d.limit(3), d.where("epoch = 1"), d.where("run = 'x'")):
        with pytest.raises(Exception):
            control.check_epochs(bad, epochs=2, runs=2).collect()


def test_seeds_digests_jitter(spark):
    want = (42 + int(hashlib.sha256(b'{"outer_fold":3}').hexdigest()[:8], 16)) % 2147483647
    assert H.inner_seed(42, 3) == want
    m = np.arange(6).reshape(2, 3)
    assert H.matrix_digest(m) == H.matrix_digest(m.astype(float).T.copy().T) == hashlib.sha256(m.astype("<f8").tobytes()).hexdigest()
    d = spark.createDataFrame([("a", 3.0, 3.0, 3.0)], "id string, content double, organization double, expression double")
    for r in training.jittered(d, copies=2, width=0.5, seed=7).collect():
        for t in TRAITS:
            u = int.from_bytes(hashlib.blake2b(f"7\0a\0{r.copy - 1}\0{t}".encode(), digest_size=8).digest(), "big") / (2**64 - 1)
            assert abs(r[t] - (3 + (2 * u - 1) * 0.5)) < 1e-12


def test_total_loss_and_single_rows(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "g string, p double, y double")
    assert {r.g for r in comparison.soft_rank_loss(d, ["g"], "p", "y").collect()} == {"b"}
    x = spark.range(1).select(comparison.total_loss(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(4.0), weights=(1, 0.5, 1, 0.25)).alias("x")).first().x
    assert x == 3.0
    with pytest.raises(ValueError):
        comparison.total_loss(*[F.lit(1.0)] * 4, weights=(-1, 0, 0, 0))


def test_one_model_is_an_ensemble(spark):
    d = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], 1.0 + 0.3 * (i % 5) + 0.2 * (i % 3)) for i in range(30)], "id int, x array<double>, y double")
    got = models.ensemble_predict(d, models.ridge_table(d, "x", ["y"], 2, alpha=1e-9), "x", "id").join(d, "id").collect()
    assert len(got) == 30 and all(abs(r.pred[0] - r.y) < 1e-6 for r in got)
