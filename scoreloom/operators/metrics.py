"""Agreement of predictions with gold scores.

Scores are pre-aggregated to cells (slice, trait, gold, pred, n) first: grids are
small, so the map side reduces rows to cells, and moments, shares and ranks are
computed from cells. Ranks accumulate in two levels (coarse score buckets, then
values in a bucket), so no task sorts all values of a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import TRAITS, correlation, sample_sd
from ..functions.text import BLANKS
from ..session import materialize

WITHIN = (0.25, 0.5, 1.0)


def long_scores(df: DataFrame, keep: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row per trait from struct columns of the three traits."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(gold)[t].alias("gold"), F.col(pred)[t].alias("pred")) for t in TRAITS]))
    return df.select(*keep, each.alias("x")).select(*keep, "x.*")


def align(gold: DataFrame, pred: DataFrame, key: str = "id") -> DataFrame:
    """Bijective join: a missing, extra or repeated id on either side is an error when the rows are read."""
    g = gold.groupBy(key).agg(F.count("*").alias("__g"), *[F.first(c).alias(c) for c in gold.columns if c != key])
    p = pred.groupBy(key).agg(F.count("*").alias("__p"), *[F.first(c).alias(c) for c in pred.columns if c != key])
    both = g.join(p, key, "full_outer")
    bad = F.col("__g").isNull() | F.col("__p").isNull() | (F.col("__g") > 1) | (F.col("__p") > 1)
    return both.withColumn("__ok", F.when(bad, F.raise_error(F.concat(F.lit("ids do not align: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).where("__ok").drop("__g", "__p", "__ok")


def coverage(expected: DataFrame, generated: DataFrame, key: str = "id", ok: str = "parse_ok", elapsed: str | None = None) -> DataFrame:
    """One row: expected, generated, parsed, failed, missing, parse_rate, and mean_elapsed of generated rows where asked for; ``ok`` null means not generated."""
    j = expected.select(key).join(generated.select(key, ok, *([elapsed] if elapsed else [])), key, "left")
    got = j.agg(F.count("*").alias("expected"), F.count(ok).alias("generated"), F.count_if(F.col(ok)).alias("parsed"), F.count_if(~F.col(ok)).alias("failed"), F.count_if(F.col(ok).isNull()).alias("missing"), *([F.avg(elapsed).alias("mean_elapsed")] if elapsed else []))
    return got.withColumn("parse_rate", F.coalesce(F.try_divide(F.col("parsed"), F.col("generated")), F.lit(0.0)))


def cells(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, gold, pred, n)."""
    return long.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))


def average_ranks(values: DataFrame, by: list[str], value: str, out: str, step: float = 0.01) -> DataFrame:
    """Average rank of each distinct value; ``values`` has (by, value, n)."""
    v = values.groupBy(*by, value).agg(F.sum("n").alias("n")).withColumn("__b", F.floor(F.col(value) / step))
    coarse = v.groupBy(*by, "__b").agg(F.sum("n").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(*by, "__b", before.alias("__before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return v.withColumn("__in", inside).join(coarse, [*by, "__b"]).select(*by, value, (F.col("__before") + F.col("__in") + (F.col("n") + 1) / 2).alias(out))


def _sums(x: str, y: str, tag: str) -> list[Column]:
    n, a, b = F.col("n"), F.col(x), F.col(y)
    return [F.sum(n * a).alias(f"{tag}x"), F.sum(n * b).alias(f"{tag}y"), F.sum(n * a * a).alias(f"{tag}xx"), F.sum(n * b * b).alias(f"{tag}yy"), F.sum(n * a * b).alias(f"{tag}xy")]


def regression_metrics(cell: DataFrame, by: list[str], guarded: bool = True) -> DataFrame:
    """Per group: n, rmse, mae, bias, pearson, spearman, means, sample deviations, shares within each threshold.

    A constant side or a single row gives correlation 0; null if not ``guarded``.
    """
    cell = materialize(cell.select(*by, "gold", "pred", "n"), "cells")  # ranks and moments read the cells, not the rows behind them
    c = cell.join(average_ranks(cell, by, "gold", "__rg"), [*by, "gold"]).join(average_ranks(cell, by, "pred", "__rp"), [*by, "pred"])
    e = F.col("pred") - F.col("gold")
    agg = c.groupBy(*by).agg(
        F.sum("n").alias("__n"), F.sum(F.col("n") * e * e).alias("__se"), F.sum(F.col("n") * F.abs(e)).alias("__ae"),
        *_sums("gold", "pred", "__p"), *_sums("__rg", "__rp", "__s"),
        ((F.min("gold") == F.max("gold")) | (F.min("pred") == F.max("pred"))).alias("__const"),
        *[F.sum(F.when(F.abs(e) <= t, F.col("n")).otherwise(0)).alias(f"__w{i}") for i, t in enumerate(WITHIN)],
    )
    n = F.col("__n")

    def corr(tag: str) -> Column:
        got = correlation(n, *[F.col(f"{tag}{k}") for k in ("x", "y", "xx", "yy", "xy")], F.col("__const"))
        return got if guarded else F.when((n < 2) | F.col("__const"), F.lit(None).cast("double")).otherwise(got)

    return agg.select(
        *by, n.alias("n"), F.sqrt(F.col("__se") / n).alias("rmse"), (F.col("__ae") / n).alias("mae"), ((F.col("__py") - F.col("__px")) / n).alias("bias"),
        corr("__p").alias("pearson"), corr("__s").alias("spearman"), (F.col("__px") / n).alias("gold_mean"), (F.col("__py") / n).alias("pred_mean"),
        sample_sd(n, F.col("__px"), F.col("__pxx")).alias("gold_sd"), sample_sd(n, F.col("__py"), F.col("__pyy")).alias("pred_sd"),
        *[(F.col(f"__w{i}") / n).alias(f"within_{str(t).replace('.', '_')}") for i, t in enumerate(WITHIN)],
    )


VALUES = ["rmse", "mae", "bias", "pearson", "spearman", "gold_mean", "pred_mean", "gold_sd", "pred_sd", *[f"within_{str(t).replace('.', '_')}" for t in WITHIN]]


def with_macro_micro(cell: DataFrame, by: list[str]) -> DataFrame:
    """Metrics by (by, trait), with rows ``macro`` (mean over traits) and ``micro`` (all scores as one vector)."""
    both = cell.withColumn("trait", F.explode(F.array("trait", F.lit("micro")))).groupBy(*by, "trait", "gold", "pred").agg(F.sum("n").alias("n"))
    own = regression_metrics(both, [*by, "trait"])
    macro = own.where("trait <> 'micro'").groupBy(*by).agg(F.sum("n").alias("n"), *[F.avg(v).alias(v) for v in VALUES]).withColumn("trait", F.lit("macro"))
    return own.unionByName(macro.select(*own.columns))


# ------------------------------------------------------------------- slices


def stable_ranks(df: DataFrame, key: Column, tie: str, out: str) -> DataFrame:
    """0-based rank by an integer key, ties by ``tie``: counts of smaller keys plus the place among equals."""
    k = df.withColumn("__k", key)
    counts = k.groupBy("__k").agg(F.count("*").alias("__n"))
    # one row a distinct key meets in the window; rows of one key rank among themselves
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__k", before.alias("__before"))
    return k.withColumn("__in", F.row_number().over(Window.partitionBy("__k").orderBy(tie)) - 1).join(counts, "__k").withColumn(out, F.col("__before") + F.col("__in")).drop("__k", "__in", "__before")


def length_quantiles(df: DataFrame, text: str = "essay", tie: str = "ordinal", k: int = 4) -> DataFrame:
    """Rank-balanced buckets floor(rank * k / n); ties in length keep input order."""
    total = df.agg(F.count("*").alias("__all"))
    ranked = stable_ranks(df.withColumn("chars", F.length(text)), F.col("chars"), tie, "__rank")
    return ranked.join(F.broadcast(total)).withColumn("length_quantile", F.floor(F.col("__rank") * k / F.col("__all")).cast("int")).drop("__rank", "__all")


def length_bounds(quantiled: DataFrame) -> DataFrame:
    """Rows, shortest and longest text of each length quantile."""
    return quantiled.groupBy("length_quantile").agg(F.count("*").alias("n"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"))


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by ``order``: a distributed top-n, no global sort."""
    return df.orderBy(order).limit(n)


def sliced_report(scored: DataFrame, slices: dict[str, str]) -> DataFrame:
    """Metrics with macro and micro rows overall and for each value of each slice column; ``scored`` is long."""
    names = list(slices)
    fine = scored.groupBy(*slices.values(), "trait", "gold", "pred").agg(F.count("*").alias("n"))
    each = F.explode(F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(k).alias("slice"), F.col(slices[k]).cast("string").alias("value")) for k in names]))
    cell = fine.select(each.alias("s"), "trait", "gold", "pred", "n").groupBy("s.slice", "s.value", "trait", "gold", "pred").agg(F.sum("n").alias("n"))
    return with_macro_micro(cell, ["slice", "value"])


# -------------------------------------------------------------------- audit


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (linear), max, distinct values."""
    q = F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), q.alias("__q"), F.max(value).alias("high"), F.count_distinct(value).alias("distinct")).withColumns({f"q{k}": F.col("__q")[i] for i, k in enumerate((25, 50, 75))}).drop("__q")


def split_audit(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ids, documents, essays and prompt texts, and white-space defects of a split; any Unicode white space counts at the ends."""
    e = F.col("essay")
    prompts = [F.count_distinct(F.sha2("prompt", 256)).alias("prompts")] if "prompt" in df.columns else []
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("document_id").alias("documents"), F.count_distinct(F.sha2("essay", 256)).alias("essays"), *prompts,
        F.count_if(e.rlike(rf"\A{BLANKS}")).alias("leading"), F.count_if(e.rlike(rf"{BLANKS}\z")).alias("trailing"), F.count_if(e.contains("\n")).alias("lf"), F.count_if(e.contains("\t")).alias("tab"), F.count_if(e.contains("\r")).alias("cr"), F.count_if(e.contains("  ")).alias("double_space"),
    )


def leakage(train: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """(key, shared): rows of ``valid`` whose key also occurs in ``train``; texts meet by hash."""
    out = None
    for k in keys:
        x = F.sha2(F.col(k).cast("string"), 256) if k == "essay" else F.col(k)
        n = valid.select(x.alias("k")).join(train.select(x.alias("k")).distinct(), "k", "left_semi").agg(F.lit(k).alias("key"), F.count("*").alias("shared"))
        out = n if out is None else out.unionAll(n)
    return out


def collisions(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: duplicate (rows equal) or conflicting."""
    rest = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != key])), 256)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(rest).alias("__d")).where("n > 1").select(key, "n", F.when(F.col("__d") == 1, "duplicate").otherwise("conflicting").alias("kind"))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r"))
    return last.select("r.*")
