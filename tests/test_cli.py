import json

import pytest

from scoreloom import cli
from scoreloom.functions.numbers import TRAITS


def test_commands(spark, tmp_path):
    rows = [{"id": f"GWGR23{i:08d}", "document_id": f"d{i}", "prompt_num": f"Q{i % 2}", "prompt": "p", "essay": "저는 찬성한다. " * (i + 1), "score": {t: 1 + (i * k) % 17 * 0.25 for k, t in enumerate((*TRAITS, "average"), 1)}} for i in range(24)]
    pred = [{"id": r["id"], "prompt_num": r["prompt_num"], "model": "m", "prediction": {t: min(5.0, r["score"][t] + 0.25) for t in TRAITS}} for r in rows]
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, pred)))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(p | {"prediction": dict.fromkeys(TRAITS, 3.0)}) for p in pred))
    at = lambda n: str(tmp_path / n)
    cli.main(["folds", "--gold", at("gold.jsonl"), "--n", "3", "--out", at("folds.parquet")])
    both = ["--gold", at("gold.jsonl"), "--folds", at("folds.parquet"), "--source", f"a={at('a.jsonl')}", "--source", f"b={at('b.jsonl')}"]
    cli.main(["evaluate", "--gold", at("gold.jsonl"), "--predictions", at("a.jsonl"), "--out", at("report")])
    cli.main(["weights", *both, "--out", at("weights")])
    cli.main(["stack", *both, "--out", at("stack")])
    cli.main(["rationales", "--gold", at("gold.jsonl"), "--out", at("rationales")])
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({k: v for k, v in r.items() if k != "score"}, ensure_ascii=False) for r in rows))
    (tmp_path / "run.jsonl").write_text("\n".join(json.dumps({"id": r["id"], "parse_ok": i % 4 > 0, "elapsed_sec": 2}) for i, r in enumerate(rows[:20])) + "\n\n")
    (tmp_path / "raw.txt").write_text('Sure: {"content":{"score":3,"rationale":"x"},"organization":{"score":"4점","rationale":"y"},"expression":{"score":2,"rationale":"z"}} end\nno\n')
    cli.main(["finalize", "--inputs", at("in.jsonl"), "--predictions", at("a.jsonl"), "--model", "m", "--out", at("final")])
    cli.main(["coverage", "--inputs", at("in.jsonl"), "--log", at("run.jsonl"), "--out", at("coverage")])
    cli.main(["parse-outputs", "--log", at("raw.txt"), "--out", at("parsed")])
    cli.main(["means", *both, "--out", at("means")])
    cli.main(["gate", *both, "--n", "20", "--out", at("gate")])
    final = spark.read.parquet(at("final")).collect()
    assert len(final) == 24 and {r.id: r.content for r in final} == {p["id"]: p["prediction"]["content"] for p in pred}
    assert spark.read.parquet(at("coverage")).first().asDict() | {"x": 1} == {"expected": 24, "generated": 20, "parsed": 15, "failed": 5, "missing": 4, "mean_elapsed": 2.0, "parse_rate": 0.75, "x": 1}
    assert [r.error for r in spark.read.parquet(at("parsed")).orderBy("error").collect()] == [None, "keys"]
    assert spark.read.parquet(at("means")).count() == 72 and spark.read.parquet(at("gate")).first().promote
    assert spark.read.parquet(at("report")).where("slice = 'overall'").count() == 5
    assert spark.read.parquet(at("weights")).where("source = 'a' and mean > 0.5").count() == 3
    assert spark.read.parquet(at("stack")).count() == 72
    assert spark.read.parquet(at("rationales")).where("grounding.accepted").count() == 24
    with pytest.raises(Exception):
        cli.main(["lopo", "--gold", at("gold.jsonl"), "--out", at("stack")])


def test_bootstrap_takes_2000_resamples_of_every_metric(monkeypatch, tmp_path):
    asked = []
    monkeypatch.setattr(cli, "session", lambda: None)
    monkeypatch.setattr(cli, "_long", lambda spark, a: None)

    def report(scores, key, a, b, *, resamples, seed):
        asked.append((a, b, resamples, seed))
        raise StopIteration

    monkeypatch.setattr(cli.comparison, "bootstrap_report", report)
    for more in ([], ["--n", "7"]):
        with pytest.raises(StopIteration):
            cli.main(["bootstrap", "--gold", "g", "--folds", "f", "--source", "a=x", "--source", "b=y", *more, "--out", str(tmp_path / "new")])
    assert asked == [("a", "b", 2000, 42), ("a", "b", 7, 42)]
