"""Bootstrap comparisons, gates, epoch policies, pairwise judgements, losses."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import grid, huber, let, softmax, total
from ..session import materialize
from .metrics import regression_metrics

# ----------------------------------------------------------------- bootstrap


#: Draws that one hash gives; joint cells up to which a task holds all of them.
LANES, CELLS = 8, 1_000_000


@dataclass(frozen=True)
class Sums:
    """A metric of sums over rows: ``features(gold, pred)`` gives columns, which add up whatever the order of rows; ``finish`` makes the metric of their sums (... x columns)."""

    features: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


def _root(sums: np.ndarray) -> np.ndarray:
    return np.sqrt(sums[..., 1] / sums[..., 0])


RMSE = Sums(lambda g, p: np.stack([np.ones_like(g), (p - g) * (p - g)], 1), _root)


@dataclass(frozen=True)
class Prepared:
    """A metric of rows and how often each counts: ``prepare(gold, pred)`` once a task, ``finish(that, weight)`` each resample."""

    prepare: Callable[[np.ndarray, np.ndarray], object]
    finish: Callable[[object, np.ndarray], float]


def _codes(gold: np.ndarray, pred: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x, return_inverse=True)[1] for x in (gold, pred)]


def _rank_correlation(codes: list[np.ndarray], weight: np.ndarray) -> float:
    """Spearman's, ties by average rank; 0 where a side is constant."""
    n = weight.sum()
    if n < 2:
        return 0.0
    sides = []
    for code in codes:
        w = np.bincount(code, weight)
        rank = np.cumsum(w) - w / 2 + 0.5
        sides.append((rank - (w * rank).sum() / n)[code])
    g, p = sides
    weighted = weight * g
    var = (weighted @ g) * ((weight * p) @ p)
    return float(weighted @ p / np.sqrt(var)) if var > 0 else 0.0


#: A metric is ``Sums``, ``Prepared``, or a function of gold, predictions and how often each row counts.
Metric = Sums | Prepared | Callable[[np.ndarray, np.ndarray, np.ndarray], float]
METRICS: dict[str, Metric] = {"rmse": RMSE, "spearman": Prepared(_codes, _rank_correlation)}


def joint_rows(scores: DataFrame, key: str, a: str, b: str, stratum: str) -> DataFrame:
    """(s, key, of): each key's scores in all traits, of = sorted array of (trait, gold, a, b)."""
    of = F.sort_array(F.collect_list(F.struct("trait", F.col("gold").cast("double").alias("gold"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))))  # a row a trait
    return scores.groupBy(F.col(stratum).cast("string").alias("s"), F.col(key).alias("key")).agg(of.alias("of"))


def hash_draws(rows: DataFrame, *, resamples: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows (s, key, of) with their 1-based rank k, draws (iteration, s, k, times)) of stratified resamples with replacement.

    Draw d of stratum s in iteration i takes the row of rank pmod(32 bits of hash(seed|i|s|d / 8), n_s) + 1, rows ranked by
    their scores and then their key; so draws are rows, and any engine can redo them. Strata keep their sizes.
    """
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("of", "key")))
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    per = rows.sparkSession.range(resamples).select(F.col("id").alias("iteration")).join(F.broadcast(sizes))  # strata are few
    hashed = per.select("iteration", "s", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LANES))).alias("d"))
    hashed = hashed.withColumn("h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("iteration").cast("string"), F.col("s"), F.col("d").cast("string")), 256))
    lane = F.explode(F.sequence(F.lit(0), F.least(F.lit(LANES), F.col("n") - F.col("d") * LANES).cast("int") - 1))
    draws = hashed.select("iteration", "s", "n", "h", lane.alias("j"))
    draws = draws.select("iteration", "s", (F.pmod(F.conv(F.substr("h", F.col("j") * 8 + 1, F.lit(8)), 16, 10).cast("long"), F.col("n")) + 1).cast("int").alias("k"))
    return ranked, draws.groupBy("iteration", "s", "k").agg(F.count("*").alias("times"))


def _times(seed: int, iteration: int, stratum: str, sizes: np.ndarray, draws: str) -> np.ndarray:
    """How often each cell of a stratum (of ``sizes`` rows) is drawn."""
    n = int(sizes.sum())
    name = f"{seed}|{iteration}|{stratum}|"
    if draws == "multinomial":
        rng = np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(name.encode()).digest()[:16], "big")))
        return rng.multinomial(n, sizes / n)
    raw = b"".join(hashlib.sha256(f"{name}{d}".encode()).digest() for d in range(-(-n // LANES)))
    return np.bincount(np.searchsorted(np.cumsum(sizes), np.frombuffer(raw, ">u4")[:n] % n, "right"), minlength=len(sizes))


def cell_bootstrap(cells: DataFrame, *, resamples: int, seed: int, metrics: dict[str, Metric], draws: str) -> DataFrame:
    """(iteration, trait, metric, a, b): each side's metric in each resample, from joint cells (s, of, m).

    A task draws how often each cell counts in its iterations and folds the counts with the cells' features, so there
    is no row a draw and no shuffle; iteration -1 counts the cells as they are.
    """
    spark, held = cells.sparkSession, cells.orderBy("s", "of").toArrow()  # bounded by the caller
    strata, first = np.unique(np.array(held.column("s").to_pylist(), object).astype(str), return_index=True) if held.num_rows else (np.zeros(0, str), np.zeros(0, int))
    size = held.column("m").to_numpy()
    lists = held.column("of").combine_chunks()
    flat = lists.flatten()
    at = np.repeat(np.arange(held.num_rows), lists.value_lengths().to_numpy())
    names = np.array(flat.field("trait").to_pylist(), object)
    by_trait = {t: (at[names == t], *(flat.field(c).to_numpy(zero_copy_only=False)[names == t] for c in ("gold", "a", "b"))) for t in dict.fromkeys(names.tolist())}
    shared = spark.sparkContext.broadcast((strata.tolist(), [*first.tolist(), held.num_rows], size, by_trait))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strata, bounds, size, by_trait = shared.value
        ready = {(t, m, x): f.features(gold, p) if isinstance(f, Sums) else f.prepare(gold, p) if isinstance(f, Prepared) else (gold, p) for t, (_, gold, *sides) in by_trait.items() for m, f in metrics.items() for x, p in zip("ab", sides, strict=True)}

        def value(f: Metric, of: object, w: np.ndarray) -> float:
            return float(f.finish(w @ of) if isinstance(f, Sums) else f.finish(of, w) if isinstance(f, Prepared) else f(*of, w))

        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                w = size.astype(float) if i < 0 else np.concatenate([np.zeros(0), *(_times(seed, i, s, size[j:k], draws) for s, j, k in zip(strata, bounds, bounds[1:], strict=False))])
                for t, (cell, *_) in by_trait.items():
                    mine = w[cell]
                    out += [(i, t, m, *(value(f, ready[t, m, x], mine) for x in "ab")) for m, f in metrics.items()]
            i, t, m, a, b = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.string()), pa.array(m, pa.string()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["iteration", "trait", "metric", "a", "b"])

    tasks = min(resamples + 1, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(-1, resamples, 1, tasks).mapInArrow(run, "iteration long, trait string, metric string, a double, b double")


def summarize(deltas: DataFrame, column: str, *, by: tuple[str, ...] = (), confidence: float = 0.95, higher_is_better: bool | Column = False) -> DataFrame:
    """One row (of each ``by``): mean, sd, interval, and the probability of being better; ties count half."""
    d = F.col(column)
    tail = (1 - confidence) / 2
    better = F.when(F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better, d > 0).otherwise(d < 0)
    lo_hi = F.percentile(d, F.array(F.lit(tail), F.lit(1 - tail)))
    got = deltas.groupBy(*by).agg(F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), lo_hi.alias("q"), F.avg(F.when(better, 1.0).when(d == 0, 0.5).otherwise(0.0)).alias("p_better"))
    return got.select(*by, "mean", "sd", F.get("q", 0).alias("low"), F.get("q", 1).alias("high"), "p_better")


def bootstrap_metrics(scores: DataFrame, key: str, a: str, b: str, *, stratum: str = "prompt_num", resamples: int = 2000, seed: int = 42, metrics: dict[str, Metric] | None = None, draws: str = "hash", cells: int = CELLS) -> DataFrame:
    """(iteration, metric, delta): a minus b in each metric, trait and macro (mean over traits); iteration -1 holds the observed rows.

    ``scores``: key, stratum, trait, gold, a and b, no nulls; a key stands for one row of each of its traits, and rows with the same scores in all
    of them are one joint cell. ``draws``: ``hash`` (see ``hash_draws``) or ``multinomial``, whose work does not grow with the rows of a cell.
    Up to ``cells`` joint cells, tasks hold them all; beyond, draws by hash are rows that meet their cells by a shuffle, for the two built-in metrics.
    """
    use = METRICS if metrics is None else metrics
    rows = joint_rows(scores, key, a, b, stratum)
    joint = rows.groupBy("s", "of").agg(F.count("*").alias("m"))
    if joint.count() <= cells:
        got = cell_bootstrap(joint, resamples=resamples, seed=seed, metrics=use, draws=draws)
    elif metrics is None and draws == "hash":
        got = _shuffled(rows, resamples=resamples, seed=seed)
    else:
        raise ValueError(f"more than {cells} joint cells: round the scores, or take the built-in metrics by hash")
    per = got.select("iteration", "trait", "metric", (F.col("a") - F.col("b")).alias("delta"))
    per = per.unionByName(per.groupBy("iteration", "metric").agg(F.avg("delta").alias("delta")).withColumn("trait", F.lit("macro")))
    return per.select("iteration", F.concat("metric", F.lit("_"), "trait").alias("metric"), F.round("delta", 12).alias("delta"))


def _shuffled(rows: DataFrame, *, resamples: int, seed: int) -> DataFrame:
    """The same for more joint cells than a task should hold: (iteration, trait, metric, a, b)."""
    ranked, draws = hash_draws(rows, resamples=resamples, seed=seed)
    drawn = ranked.select(F.lit(-1).cast("long").alias("iteration"), "of", F.lit(1).cast("long").alias("times")).unionByName(draws.join(ranked, ["s", "k"]).select("iteration", "of", "times"))
    each = drawn.select("iteration", "times", F.explode("of").alias("x")).select("iteration", "times", "x.*")
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("pred")) for k in ("a", "b")]))
    cell = each.select("iteration", "times", "trait", "gold", side.alias("y")).groupBy("iteration", "y.side", "trait", "gold", "y.pred").agg(F.sum("times").alias("n"))
    got = regression_metrics(cell, ["iteration", "side", "trait"])
    sides = got.groupBy("iteration", "trait").agg(*[F.max(F.when(F.col("side") == x, F.col(m))).alias(f"{m}_{x}") for m in METRICS for x in "ab"])
    return sides.select("iteration", "trait", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in METRICS])).alias("z")).select("iteration", "trait", "z.*")


def bootstrap_report(scores: DataFrame, key: str, a: str, b: str, *, stratum: str = "prompt_num", resamples: int = 2000, seed: int = 42, higher: tuple[str, ...] = ("spearman",), **kw) -> DataFrame:
    """A row per metric: observed difference a minus b (point), mean, sd, interval and probability that a is better; metrics in ``higher`` are better when they are larger. ``kw``: see ``bootstrap_metrics``."""
    d = materialize(bootstrap_metrics(scores, key, a, b, stratum=stratum, resamples=resamples, seed=seed, **kw), "resamples")
    point = d.where("iteration < 0").select("metric", F.col("delta").alias("point"))
    return summarize(d.where("iteration >= 0"), "delta", by=("metric",), higher_is_better=reduce(Column.__or__, [F.startswith(F.col("metric"), F.lit(f"{m}_")) for m in higher], F.lit(False))).join(point, "metric")


# --------------------------------------------------------------------- gates


def precision_gate(report: DataFrame, *, max_rmse_increase: float = 0.0, max_spearman_drop: float = 0.0, min_rmse_gain: float = 0.0, min_spearman_gain: float = 0.0, min_probability: float = 0.9) -> DataFrame:
    """Adds no_harm, better and promote to a row of rmse_delta, spearman_delta, p_rmse, p_spearman (candidate minus baseline)."""
    safe = (F.col("rmse_delta") <= max_rmse_increase) & (F.col("spearman_delta") >= -max_spearman_drop)
    gain = ((F.col("rmse_delta") <= -min_rmse_gain) & (F.col("p_rmse") >= min_probability)) | ((F.col("spearman_delta") >= min_spearman_gain) & (F.col("p_spearman") >= min_probability))
    return report.withColumn("no_harm", safe).withColumn("better", gain).withColumn("promote", F.col("no_harm") & F.col("better"))


def epoch_policy(evidence: DataFrame, *, rmse_weight: float = 0.5, spearman_weight: float = 0.5) -> DataFrame:
    """(epoch, mean_rank), best first: average ranks of rmse (low) and spearman (high) within each run, weighted; ties go to the smaller epoch."""
    def rank(order: Column, value: str) -> Column:
        return F.rank().over(Window.partitionBy("run").orderBy(order)) + (F.count("*").over(Window.partitionBy("run", value)) - 1) / 2

    r = evidence.withColumn("__r", rmse_weight * rank(F.asc("macro_rmse"), "macro_rmse") + spearman_weight * rank(F.desc("macro_spearman"), "macro_spearman"))
    return r.groupBy("epoch").agg(F.avg("__r").alias("mean_rank")).withColumn("chosen", F.row_number().over(Window.orderBy(F.round("mean_rank", 9), "epoch")) == 1)


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of the smallest rmse; the earliest wins ties."""
    return history.groupBy("run").agg(F.min_by("epoch", F.struct("macro_rmse", "epoch")).alias("epoch"), F.min("macro_rmse").alias("macro_rmse"))


def uniform(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether each column holds one value."""
    return df.agg(*[(F.count_distinct(c) == 1).alias(c) for c in columns])


# ----------------------------------------------------------------- judgement

CRITERIA = ("grounded_in_essay", "specific_and_helpful", "trait_separation", "consistent_with_fixed_scores", "overall_preference")


def unswapped(choice: Column, reverse: Column) -> Column:
    """A judgement of swapped options, in terms of the options as stored."""
    return F.when(reverse & (choice == "A"), "B").when(reverse & (choice == "B"), "A").otherwise(choice)


def reconciled(forward: Column, backward: Column) -> Column:
    """struct(decision, unstable): orders that disagree are an unstable tie."""
    same = forward == backward
    return F.struct(F.when(same, forward).otherwise("TIE").alias("decision"), (~same).alias("unstable"))


def tally(results: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per criterion: wins of the candidate, of the baseline, ties, unstable, and rates; the decisive rate is null without decisive rows.

    ``results``: review_id, criterion, decision, unstable; ``hidden``: review_id, candidate (A or B). Sets of ids must agree.
    """
    j = results.join(hidden, "review_id", "full_outer")
    bad = F.col("criterion").isNull() | F.col("candidate").isNull()
    j = j.withColumn("__ok", F.when(bad, F.raise_error(F.concat(F.lit("review without its other half: "), F.col("review_id"))).cast("boolean")).otherwise(True)).where("__ok")
    win, tie = F.col("decision") == F.col("candidate"), F.col("decision") == "TIE"
    got = j.groupBy("criterion").agg(F.count("*").alias("n"), F.count_if(win).alias("wins"), F.count_if(~win & ~tie).alias("losses"), F.count_if(tie).alias("ties"), F.count_if("unstable").alias("unstable"))
    return got.withColumn("win_rate", F.col("wins") / F.col("n")).withColumn("decisive_win_rate", F.try_divide(F.col("wins"), F.col("wins") + F.col("losses"))).withColumn("unstable_rate", F.col("unstable") / F.col("n"))


# -------------------------------------------------------------------- losses

#: Widths of the soft targets.
SIGMAS = {"content": 0.15, "organization": 0.25, "expression": 0.25}


def soft_targets(target: Column, trait: str) -> Column:
    """Normalized Gaussian weights of the trait's levels."""
    w = F.transform(grid(trait), lambda g: F.exp(-0.5 * F.pow((g - target) / SIGMAS[trait], 2)))
    return let(w, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))


def ordinal_loss(logits: Column, target: Column, trait: str) -> Column:
    """KL divergence of the soft targets from softmax(logits); 0 log 0 is 0."""
    p = softmax(logits)
    return total(F.zip_with(soft_targets(target, trait), p, lambda t, q: F.when(t > 0, t * (F.log(t) - F.log(q))).otherwise(0.0)))


def pairs(df: DataFrame, *, prompt: str, key: str, gap: Column, min_gap: float = 0.0) -> DataFrame:
    """(l, r) unordered pairs of one prompt whose ``gap`` exceeds min_gap; for batches and mining within bounded prompts.

    ``gap`` speaks of the columns of the two sides as l and r structs.
    """
    s = df.select(F.col(prompt).alias("__p"), F.struct(*df.columns).alias("l"))
    o = df.select(F.col(prompt).alias("__p"), F.struct(*df.columns).alias("r"))
    return s.join(o, "__p").where((F.col(f"l.{key}") < F.col(f"r.{key}")) & (gap > min_gap)).select("l", "r")


def cell_pairs(df: DataFrame, *, prompt: str, scores: list[str]) -> DataFrame:
    """(prompt, l, r, n): how many pairs of one prompt have scores l and r, in either order; pairs of equal scores are left out.

    Rows are counted by their scores first, so the work is that of the score cells of a prompt, not of its rows.
    """
    cell = df.groupBy(F.col(prompt).alias("__p"), *scores).agg(F.count("*").alias("__n"))
    s, o = (cell.select("__p", F.struct(*scores).alias(x), F.col("__n").alias(f"n_{x}")) for x in ("l", "r"))
    return s.join(o, "__p").where("l < r").select(F.col("__p").alias(prompt), "l", "r", (F.col("n_l") * F.col("n_r")).alias("n"))


def pairwise_loss(pred_l: Column, pred_r: Column, gold_l: Column, gold_r: Column, *, tie: float = 0.0, temperature: float = 1.0, order_weight: float = 0.5, beta: float = 0.1) -> Column:
    """Order loss plus Huber loss of the differences; null for ties, which are left out of means."""
    dp, dg = pred_l - pred_r, gold_l - gold_r
    order = F.log1p(F.exp(-F.signum(dg) * dp / temperature))
    return F.when(F.abs(dg) > tie, order_weight * order + (1 - order_weight) * huber(dp - dg, beta))


def percentile_within(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(wins + half the ties) / (n - 1) within a group, the row itself aside; null for single rows. Counts per distinct value, no pairs."""
    v = df.groupBy(by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(by)
    below = F.coalesce(F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.select(by, value, F.try_divide(below + (F.col("__c") - 1) / 2, F.sum("__c").over(w) - 1).alias(out))
    return df.join(v, [by, value])


def soft_rank_loss(batches: DataFrame, by: list[str], pred: str, gold: str, *, temperature: float = 0.25, tie: float = 0.0, beta: float = 0.1) -> DataFrame:
    """(by, loss): mean Huber loss between predicted and gold percentiles inside each group of a batch; single rows give none.

    A row's predicted percentile is its mean sigmoid win over the others, its gold percentile counts gaps of at most ``tie`` as
    half a win. Groups are what one training batch holds of a prompt, so a row of the group carries them all.
    """
    g = batches.groupBy(*by).agg(F.collect_list(F.struct(F.col(pred).cast("double").alias("p"), F.col(gold).cast("double").alias("g"))).alias("of")).where("size(of) > 1")
    n = F.size("of")

    def one(x: Column) -> Column:
        others = F.col("of")
        wins = F.aggregate(others, F.lit(0.0), lambda a, y: a + 1 / (1 + F.exp(-(x["p"] - y["p"]) / temperature))) - 0.5  # itself wins half
        gold_wins = F.aggregate(others, F.lit(0.0), lambda a, y: a + F.when(x["g"] - y["g"] > tie, 1.0).when(x["g"] - y["g"] < -tie, 0.0).otherwise(0.5)) - 0.5
        return huber((wins - gold_wins) / (n - 1), beta)

    return g.select(*by, (F.aggregate(F.transform("of", one), F.lit(0.0), lambda a, x: a + x) / n).alias("loss"))


def total_loss(mse: Column, ordinal: Column, pairwise: Column, soft_rank: Column, *, weights: tuple[float, float, float, float] = (1.0, 0.3, 0.2, 0.0)) -> Column:
    """Weighted sum of the four losses; a loss that a batch does not have is null and counts nothing."""
    if min(weights) < 0:
        raise ValueError("weights are not negative")
    got = F.lit(0.0)
    for w, x in zip(weights, (mse, ordinal, pairwise, soft_rank), strict=True):
        got = got + w * F.coalesce(x, F.lit(0.0))
    return got
