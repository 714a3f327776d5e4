"""Final rows: scores and rationales joined without changing a score; blind review packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import even_digit, sha_parts
from ..functions.numbers import TRAITS
from . import rationale as R


def same_scores(a: Column, b: Column) -> Column:
    """Whether two structs of the traits hold exactly equal scores."""
    ok = F.lit(True)
    for t in TRAITS:
        ok = ok & a[t].eqNullSafe(b[t])
    return ok


def compose(inputs: DataFrame, scores: DataFrame, rationales: DataFrame, model: str) -> DataFrame:
    """(id, prompt_num, model, traits, <trait>_rationale, status, fallback): a row per id of inputs or scores.

    ``inputs``: id, prompt_num, essay. ``scores``: id, prompt_num, scores (struct). ``rationales``: id, prompt_num,
    conditioned (struct of scores), texts (struct), repeated ids not allowed anywhere. An id without generated texts
    takes the deterministic grounded ones. status is ok, or the first contract that the row breaks: no_score, extra,
    prompt, rationale_prompt, conditioned (texts were written for other scores), invalid, ungrounded.
    """
    i = R.ledger(inputs.select("id", F.col("prompt_num").alias("asked"), "essay"))
    s = scores.select("id", F.col("prompt_num").alias("scored"), "scores")
    g = rationales.select("id", F.col("prompt_num").alias("explained"), "conditioned", "texts")
    j = i.join(s, "id", "full_outer").join(g, "id", "left")
    own = R.rationales(F.col("ledger"), {t: F.col("scores")[t] for t in TRAITS})
    j = j.withColumn("fallback", F.col("texts").isNull()).withColumn("x", F.coalesce("texts", own))
    accepted = R.grounding(F.col("x"), F.col("essay"), F.col("ledger"))["accepted"]
    status = (
        F.when(F.col("scores").isNull(), "no_score").when(F.col("asked").isNull(), "extra").when(F.col("asked") != F.col("scored"), "prompt")
        .when(~F.col("fallback") & ~F.col("explained").eqNullSafe(F.col("asked")), "rationale_prompt").when(~F.col("fallback") & ~same_scores(F.col("conditioned"), F.col("scores")), "conditioned")
        .when(~R.valid_rationales(F.col("x")), "invalid").when(~accepted, "ungrounded").otherwise("ok")
    )
    return j.select("id", F.coalesce("asked", "scored").alias("prompt_num"), F.lit(model).alias("model"), *[F.col("scores")[t].alias(t) for t in TRAITS], *[F.trim(F.col("x")[t]).alias(f"{t}_rationale") for t in TRAITS], status.alias("status"), "fallback")


def refuse_broken(final: DataFrame) -> DataFrame:
    """The rows without their status; a broken one is an error when it is read."""
    bad = F.when(F.col("status") != "ok", F.raise_error(F.concat(F.col("id"), F.lit(": "), F.col("status"))).cast("boolean")).otherwise(True)
    return final.where(bad).drop("status", "fallback")


def review_pack(inputs: DataFrame, candidate: DataFrame, baseline: DataFrame, *, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, hidden key, refused): options A and B by a coin from the review id; only rows with equal prompts and exactly equal scores.

    ``candidate`` and ``baseline``: id, prompt_num, scores, texts. refused: (id, reason) of ids that lack a side or differ.
    """
    c = candidate.select("id", F.col("prompt_num").alias("cp"), F.col("scores").alias("cs"), F.col("texts").alias("ct"))
    b = baseline.select("id", F.col("prompt_num").alias("bp"), F.col("scores").alias("bs"), F.col("texts").alias("bt"))
    j = inputs.join(c, "id", "full_outer").join(b, "id", "full_outer")
    lacks = F.col("essay").isNull() | F.col("cs").isNull() | F.col("bs").isNull()
    why = F.when(lacks, "missing").when((F.col("cp") != F.col("prompt_num")) | (F.col("bp") != F.col("prompt_num")), "prompt").when(~same_scores(F.col("cs"), F.col("bs")), "scores")
    j = j.withColumn("reason", why).withColumn("review_id", F.concat(F.lit("R"), F.substring(sha_parts(F.lit(str(seed)), F.col("id")), 1, 16)))
    first = even_digit(F.sha2("review_id", 256))  # the candidate is option A
    good = j.where("reason is null")
    reviews = good.select("review_id", "prompt_num", "prompt", "essay", F.col("cs").alias("fixed_scores"), F.when(first, F.col("ct")).otherwise(F.col("bt")).alias("option_a"), F.when(first, F.col("bt")).otherwise(F.col("ct")).alias("option_b"))
    key = good.select("review_id", "id", F.when(first, "candidate").otherwise("baseline").alias("option_a"), F.when(first, "baseline").otherwise("candidate").alias("option_b"))
    return reviews, key, j.where("reason is not null").select("id", "reason")
