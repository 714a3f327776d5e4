"""Command line: one subcommand per flow. Tables are Parquet, or JSON lines under a strict contract; outputs are new folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.numbers import TRAITS
from .operators import combined, comparison, final, folds, metrics, models, neighbours, rationale, text_ridge
from .session import session
from .sources import control, strict


def _read(spark: SparkSession, path: str, contract: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else strict.read_strict(spark, path, contract)


def _struct(name: str) -> F.Column:
    return F.struct(*TRAITS).alias(name)


def _long(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """id, prompt_num, fold, trait, gold and a column per source, aligned by id."""
    d = _read(spark, a.gold, "labelled").select("id", "prompt_num", _struct("gold"))
    d = metrics.align(d, _read(spark, a.folds, "folds").select("id", "fold"))
    for name, path in (s.split("=", 1) for s in a.source):
        d = metrics.align(d, _read(spark, path, "canonical").select("id", _struct(name)))
    names = [s.split("=", 1)[0] for s in a.source]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col("gold")[t].alias("gold"), *[F.col(n)[t].alias(n) for n in names]) for t in TRAITS]))
    return d.select("id", "prompt_num", "fold", each.alias("x")).select("id", "prompt_num", "fold", "x.*")


def evaluate(spark, a):
    g = _read(spark, a.gold, "labelled").withColumn("ordinal", F.col("id"))
    g = metrics.length_quantiles(g).select("id", "prompt_num", "length_quantile", _struct("gold"))
    j = metrics.align(g, _read(spark, a.predictions, a.contract).select("id", _struct("pred")))
    return metrics.sliced_report(metrics.long_scores(j, ["prompt_num", "length_quantile"]), {"prompt": "prompt_num", "length": "length_quantile"})


def audit(spark, a):
    return metrics.split_audit(_read(spark, a.gold, "labelled").withColumn("split", F.lit("all")), ["split"])


def make_folds(spark, a):
    from .functions.text import cohort

    g = _read(spark, a.gold, "labelled").withColumn("mean", sum(F.col(t) for t in TRAITS) / 3).withColumn("cohort", cohort(F.col("id")))
    return folds.stratified_folds(folds.score_bands(g, "mean", a.bins), folds=a.n, seed=a.seed)


def lopo(spark, a):
    return folds.lopo_folds(_read(spark, a.gold, "labelled")).select("id", "fold")


def calibrate(spark, a):
    return models.calibrate_oof(_long(spark, a), a.source[0].split("=")[0], "gold")


def stack(spark, a):
    return models.cross_fit_stack(_long(spark, a), [s.split("=")[0] for s in a.source], "gold")


def weights(spark, a):
    d = _long(spark, a)
    return models.weight_stability(models.simplex_weights(d, ["trait"], [s.split("=")[0] for s in a.source], "gold", "fold"), ["trait", "source"])


def bootstrap(spark, a):
    x, y = (s.split("=")[0] for s in a.source[:2])
    return comparison.bootstrap_report(_long(spark, a), "id", x, y, resamples=a.n, seed=a.seed)


def knn(spark, a):
    return neighbours.knn(spark.read.parquet(a.queries), spark.read.parquet(a.bank), k=a.n)


def rationales(spark, a):
    led = rationale.ledger(_read(spark, a.gold, "labelled"))
    own = led.withColumn("x", rationale.rationales(F.col("ledger"), {t: F.col(t) for t in TRAITS}))
    return own.select("id", "prompt_num", *TRAITS, *[F.col("x")[t].alias(f"{t}_rationale") for t in TRAITS], rationale.grounding(F.col("x"), F.col("essay"), F.col("ledger")).alias("grounding"))


def means(spark, a):
    return models.mean_oof(_long(spark, a), "gold")


def _texts(spark, a):
    d = _read(spark, a.gold, "labelled").select("id", "prompt_num", "prompt", "essay", *TRAITS)
    return metrics.align(d, _read(spark, a.folds, "folds").select("id", "fold"))


def _prompts(d):
    return [r[0] for r in d.select("prompt_num").distinct().orderBy("prompt_num").collect()]  # prompts are few


def surface(spark, a):
    d = _texts(spark, a)
    prompts = _prompts(d)
    x = text.surface_features(d).select("id", "fold", F.concat(F.array(*text.SURFACE), models.one_hot("prompt_num", prompts)).alias("x"), *TRAITS)
    return models.ridge_oof(x, "x", list(TRAITS), len(text.SURFACE) + len(prompts), alpha=1e-6).select("id", "fold", "pred")


def _features(d):
    return text.surface_features(d).withColumn("dense", F.array(*text.SURFACE))


def tfidf(spark, a):
    return text_ridge.text_ridge_oof(_features(_texts(spark, a)), "id", list(TRAITS), alpha=a.alpha[0] if a.alpha else 3.0, dense="dense", category="prompt_num")


def nested_tfidf(spark, a):
    return text_ridge.nested_text_ridge(_features(_texts(spark, a)), "id", list(TRAITS), alphas=a.alpha or [3.0, 1.0, 10.0], inner=a.n, seed=a.seed, dense="dense", category="prompt_num")[0]


def _scored(spark, path, contract="canonical"):
    d = _read(spark, path, contract)
    return d.select("id", "prompt_num", _struct("scores"), *([F.struct(*[F.col(f"{t}_rationale").alias(t) for t in TRAITS]).alias("texts")] if contract == "final" else []))


def finalize(spark, a):
    """Final rows from inputs and scores, with grounded texts; a broken row ends the run."""
    d = _read(spark, a.inputs, "unlabelled")
    none = spark.createDataFrame([], "id string, prompt_num string, conditioned struct<content:double,organization:double,expression:double>, texts struct<content:string,organization:string,expression:string>")
    return final.refuse_broken(final.compose(d, _scored(spark, a.predictions), none, a.model))


def reviews(spark, a):
    pack, _, _ = final.review_pack(_read(spark, a.inputs, "unlabelled").select("id", "prompt_num", "prompt", "essay"), _scored(spark, a.candidate, "final"), _scored(spark, a.baseline, "final"), seed=a.seed)
    return pack


def review_keys(spark, a):
    _, key, _ = final.review_pack(_read(spark, a.inputs, "unlabelled").select("id", "prompt_num", "prompt", "essay"), _scored(spark, a.candidate, "final"), _scored(spark, a.baseline, "final"), seed=a.seed)
    return key


def parse_outputs(spark, a):
    """Raw model outputs, a line each, read leniently, with an error where nothing could be read."""
    return strict.parse_lines(strict.read_lines(spark, a.log), "lenient").drop("file")


def coverage(spark, a):
    log = strict.parse_lines(strict.read_lines(spark, a.log), "run").where("error is null")
    last = metrics.keep_last(log.select("id", "parse_ok", "elapsed_sec", F.monotonically_increasing_id().alias("place")), "id", "place")
    return metrics.coverage(_read(spark, a.inputs, "unlabelled"), last, elapsed="elapsed_sec")


def gate(spark, a):
    x, y = (s.split("=")[0] for s in a.source[:2])
    wide = comparison.bootstrap_report(_long(spark, a), "id", x, y, resamples=a.n, seed=a.seed).where("metric in ('rmse_macro', 'spearman_macro')")
    one = wide.agg(*[F.max(F.when(F.col("metric") == f"{m}_macro", F.col(c))).alias(n) for m in ("rmse", "spearman") for c, n in (("point", f"{m}_delta"), ("p_better", f"p_{m}"))])
    return comparison.precision_gate(one)


def collided(spark, a):
    both = combined.combine(_read(spark, a.gold, "labelled"), _read(spark, a.validation, "labelled"), acknowledged=a.acknowledged)
    return combined.collisions(both)


COMMANDS = {
    "evaluate": (evaluate, ["gold", "predictions", "contract"]), "audit": (audit, ["gold"]), "folds": (make_folds, ["gold", "n", "bins", "seed"]), "lopo": (lopo, ["gold"]), "calibrate": (calibrate, ["gold", "folds", "source"]),
    "stack": (stack, ["gold", "folds", "source"]), "weights": (weights, ["gold", "folds", "source"]), "bootstrap": (bootstrap, ["gold", "folds", "source", "n", "seed"]), "knn": (knn, ["queries", "bank", "n"]), "rationales": (rationales, ["gold"]),
    "means": (means, ["gold", "folds", "source"]), "surface": (surface, ["gold", "folds"]), "tfidf": (tfidf, ["gold", "folds", "alpha"]), "nested-tfidf": (nested_tfidf, ["gold", "folds", "alpha", "n", "seed"]), "gate": (gate, ["gold", "folds", "source", "n", "seed"]),
    "finalize": (finalize, ["inputs", "predictions", "model"]), "reviews": (reviews, ["inputs", "candidate", "baseline", "seed"]), "review-keys": (review_keys, ["inputs", "candidate", "baseline", "seed"]), "parse-outputs": (parse_outputs, ["log"]), "coverage": (coverage, ["inputs", "log"]),
    "collisions": (collided, ["gold", "validation", "acknowledged"]),
}
RESAMPLES = 2000
OPTIONS = {"n": {"type": int, "default": 5}, "bins": {"type": int, "default": 5}, "seed": {"type": int, "default": 42}, "source": {"action": "append", "required": True, "help": "name=path, repeatable"}, "alpha": {"action": "append", "type": float}, "acknowledged": {"action": "store_true", "help": "labels of the validation split are used knowingly"}, "contract": {"default": "canonical", "choices": ["canonical", "final"]}}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scoreloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(f"--{o}", **OPTIONS.get(o, {"required": True}))
        if name in ("bootstrap", "gate"):
            s.set_defaults(n=RESAMPLES)
        s.add_argument("--out", required=True, help="a new folder; Parquet")
    a = p.parse_args(argv)
    control.require_new(out=a.out)
    run, _ = COMMANDS[a.command]
    run(session(), a).write.mode("errorifexists").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
