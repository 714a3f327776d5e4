"""Data side of training and scoring: messages, length gates, masks, padding, silver rows, the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha_int, unit_hash
from ..functions.numbers import TRAITS, clip, dot, grid, let, sigmoid, softmax

IGNORED = -100


def messages(system: str, user: Column) -> Column:
    """A chat prompt of a fixed instruction and the row's text."""
    def m(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(m("system", F.lit(system)), m("user", user))


def scoring_prompt(df: DataFrame, system: str, out: str = "messages") -> DataFrame:
    """Only input columns are read: no label can reach the prompt."""
    user = F.concat(F.lit("[prompt "), F.col("prompt_num"), F.lit("]\n"), F.col("prompt"), F.lit("\n\n[essay]\n"), F.col("essay"))
    return df.withColumn(out, messages(system, user))


def evidence_json(ledger: Column) -> Column:
    """The ledger's span texts and counters as JSON."""
    spans = F.struct(*[ledger["spans"][k]["text"].alias(k) for k in ("first_sentence", "last_sentence", "stance", "support", "counterpoint", "conclusion")])
    names = ("sentence_count", "paragraph_count", "connective_count", "support_marker_count", "repeated_space_count", "repeated_punctuation_count", "long_sentence_count")
    return F.to_json(F.struct(spans.alias("spans"), F.struct(*[ledger[n].alias(n) for n in names]).alias("counters")))


def questions(spark, per_trait: int = 6) -> DataFrame:
    """(question_id, trait, place): the assessment questions' dimension."""
    rows = [(f"{t}_{i + 1}", t, i) for t in TRAITS for i in range(per_trait)]
    return spark.createDataFrame(rows, "question_id string, trait string, place int")


def ask_all(df: DataFrame, q: DataFrame) -> DataFrame:
    """Every row with every question: a product with a fixed small dimension."""
    return df.crossJoin(F.broadcast(q))


def length_gate(df: DataFrame, tokens: str, limit: int, key: str = "id") -> DataFrame:
    """Refuses a row over the limit by name; nothing is truncated."""
    long = F.size(tokens) > limit
    return df.withColumn("__ok", F.when(long, F.raise_error(F.concat(F.lit("over-long input: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).where("__ok").drop("__ok")


def padded(tokens: Column, to: Column, pad: int) -> Column:
    """struct(ids, mask) of length ``to``."""
    n = F.greatest(to - F.size(tokens), F.lit(0))
    return F.struct(F.concat(tokens, F.array_repeat(F.lit(pad), n)).alias("ids"), F.concat(F.transform(tokens, lambda _: F.lit(1)), F.array_repeat(F.lit(0), n)).alias("mask"))


def completion_labels(tokens: Column, prompt_size: Column) -> Column:
    """The prompt's tokens are ignored by the loss."""
    return F.concat(F.array_repeat(F.lit(IGNORED), prompt_size), F.slice(tokens, prompt_size + 1, F.greatest(F.size(tokens) - prompt_size, F.lit(0))))


def last_real_token(mask: Column) -> Column:
    """Index of the last unmasked token; null without one."""
    return F.array_max(F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull()))


def restricted_probabilities(logits: Column, codes: list[int]) -> Column:
    """Softmax over the answer codes alone."""
    return softmax(F.array(*[F.get(logits, c) for c in codes]))


def question_features(probs: Column, places: int) -> Column:
    """The first ``places`` questions' probabilities in one row."""
    return F.flatten(F.slice(probs, 1, places))


def bounded_score(x: Column) -> Column:
    return 1 + 4 * sigmoid(x)


def expected_score(logits: Column, trait: str) -> Column:
    """Expectation over the trait's levels."""
    return let(softmax(logits), lambda p: dot(p, grid(trait)))


def blended_score(regression: Column, logits: Column, trait: str, weight: float) -> Column:
    return weight * bounded_score(regression) + (1 - weight) * expected_score(logits, trait)


def jittered(df: DataFrame, *, copies: int, width: float, seed: int, key: str = "id", digest: str = "blake2b") -> DataFrame:
    """``copies`` rows each, scores moved by a uniform offset from a hash of (seed, key, copy, trait), clipped.

    blake2b joins the parts by NUL and counts copies from 0; sha256 joins them by | from 1, for engines without blake2b.
    """
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def unit(t: str) -> Column:
        parts = [F.lit(str(seed)), F.col(key).cast("string"), (F.col("copy") - int(digest == "blake2b")).cast("string"), F.lit(t)]
        return unit_hash(*parts) if digest == "blake2b" else sha_int(F.sha2(F.concat_ws("|", *parts), 256), 7) / float(16**7)

    return d.withColumns({t: clip(F.col(t) + (2 * unit(t) - 1) * width) for t in TRAITS})


def promotable(silver: DataFrame, *, least_rows: int = 500, least_rate: float = 0.5) -> DataFrame:
    """One row: generated, accepted, rate, and whether both floors are reached."""
    a = silver.agg(F.count("*").alias("generated"), F.count_if("accepted").alias("accepted"))
    return a.withColumn("rate", F.coalesce(F.try_divide("accepted", "generated"), F.lit(0.0))).withColumn("promote", (F.col("accepted") >= least_rows) & (F.col("rate") >= least_rate))


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """The hook for a model: ``load`` runs once a task and returns a function from a batch of rows to a batch of results."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)
