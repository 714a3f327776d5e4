"""Estimators that fit from additive moments: means, affine calibration, simplex blends, ridge.

Moments are summed once per fold; ``fit on all folds but f`` is the total minus fold
f. No model is fitted by scanning rows once a fold, and labels of a held fold cannot
reach its own model.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip

SHRINKAGE, LEAST_SLOPE, EPSILON = 20.0, 1e-6, 1e-12


def held_out(moments: DataFrame, by: list[str], sums: list[str], fold: str = "fold") -> DataFrame:
    """For each fold f (as ``held``): the sums over all other folds, per ``by``. Groups that only f has are absent."""
    folds = moments.select(F.col(fold).alias("held")).distinct()
    total = moments.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])
    own = moments.groupBy(F.col(fold).alias("held"), *by).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    all_ = total.join(F.broadcast(folds))  # as many copies as folds
    cond = [all_.held == own.held, *[all_[b].eqNullSafe(own[b]) for b in by]]
    j = all_.join(own, cond, "left")
    return j.select(all_.held, *[all_[b] for b in by], *[(all_[s] - F.coalesce(own[f"__{s}"], F.lit(0))).alias(s) for s in sums]).where("n > 0")


# --------------------------------------------------------------------- means


def mean_oof(df: DataFrame, y: str, *, prompt: str = "prompt_num", fold: str = "fold", by: tuple[str, ...] = ("trait",)) -> DataFrame:
    """Adds ``pred``: the prompt's mean over the other folds, or their overall mean for a prompt they lack."""
    m = df.groupBy(*by, prompt, fold).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    fine = held_out(m, [*by, prompt], ["n", "s"], fold).select("held", *by, prompt, (F.col("s") / F.col("n")).alias("__p"))
    coarse = held_out(m, list(by), ["n", "s"], fold).select("held", *by, (F.col("s") / F.col("n")).alias("__g"))
    d = df.withColumn("held", F.col(fold))
    return d.join(fine, ["held", *by, prompt], "left").join(coarse, ["held", *by], "left").withColumn("pred", F.coalesce("__p", "__g")).drop("held", "__p", "__g")


# --------------------------------------------------------------- calibration


def affine(moments: DataFrame, by: list[str], *, prompt: str = "prompt_num", shrinkage: float = SHRINKAGE) -> tuple[DataFrame, DataFrame]:
    """((by, slope, intercept), (by, prompt, offset)) from moments n, sx, sy, sxx, sxy per (by, prompt).

    slope = max(cov / var, 1e-6), 1e-6 without variance; a prompt's offset is its mean
    residual, shrunk by n / (n + shrinkage).
    """
    t = moments.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy")])
    n, var = F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    slope = F.when(var > EPSILON, F.greatest(F.try_divide(cov, var), F.lit(LEAST_SLOPE))).otherwise(F.lit(LEAST_SLOPE))
    line = t.select(*by, slope.alias("slope"), (F.col("sy") / n).alias("__my"), (F.col("sx") / n).alias("__mx"))
    line = line.select(*by, "slope", (F.col("__my") - F.col("slope") * F.col("__mx")).alias("intercept"))
    resid = (F.col("sy") - F.col("slope") * F.col("sx")) / n - F.col("intercept")
    offsets = moments.join(line, by).select(*by, prompt, (n / (n + shrinkage) * resid).alias("offset"))
    return line, offsets


def moments_xy(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))


def apply_affine(df: DataFrame, line: DataFrame, offsets: DataFrame, by: list[str], x: str, *, prompt: str = "prompt_num", out: str = "calibrated") -> DataFrame:
    """clip(intercept + slope * x + offset); a prompt without an offset has 0. Works on streams: the tables are static."""
    d = df.join(F.broadcast(line), by).join(F.broadcast(offsets), [*by, prompt], "left")
    return d.withColumn(out, clip(F.col("intercept") + F.col("slope") * F.col(x) + F.coalesce("offset", F.lit(0.0)))).drop("slope", "intercept", "offset")


def calibrate_oof(df: DataFrame, x: str, y: str, *, prompt: str = "prompt_num", fold: str = "fold", by: tuple[str, ...] = ("trait",)) -> DataFrame:
    """Adds ``calibrated``: each fold by the calibrator of the other folds."""
    m = moments_xy(df, [*by, prompt, fold], x, y)
    rest = held_out(m, [*by, prompt], ["n", "sx", "sy", "sxx", "sxy"], fold)
    line, offsets = affine(rest, ["held", *by], prompt=prompt)
    return apply_affine(df.withColumn("held", F.col(fold)), line, offsets, ["held", *by], x, prompt=prompt).drop("held")


# ------------------------------------------------------------------ stacking


def pair_weights(df: DataFrame, by: list[str], a: str, b: str, y: str, fold: str | None = None) -> DataFrame:
    """Two sources in closed form: weight of a = clip(sum d (y - b) / sum d^2, 0, 1), d = a - b; 0.5 if they agree."""
    d = F.col(a) - F.col(b)
    keys = [*by, *([fold] if fold else [])]
    m = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d * (F.col(y) - F.col(b))).alias("s"), F.sum(d * d).alias("dd"))
    if fold:
        m, by = held_out(m, by, ["n", "s", "dd"], fold), ["held", *by]
    w = F.when(F.col("dd") <= EPSILON, F.lit(0.5)).otherwise(clip(F.try_divide(F.col("s"), F.col("dd")), 0.0, 1.0))
    return m.select(*by, w.alias("weight"), (F.col("dd") <= EPSILON).alias("degenerate"))


def simplex(gram: np.ndarray, cross: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Weights on the simplex that minimize w'Gw - 2 c'w, by a primal active set: from the best single source, the source
    whose gradient is lowest joins, the minimum over the joined ones is taken or approached until a weight is 0 and leaves.

    It ends where no source's gradient is below that of the joined ones, the condition of the optimum; each step lowers the
    objective, so no set comes twice. Of sources that add nothing to others none joins.
    """
    n = len(cross)
    w = np.zeros(n)
    w[np.argmin(np.diag(gram) - 2 * cross)] = 1.0
    inside = w > 0
    scale = max(1.0, float(np.abs(gram).max(initial=0)))
    for _ in range(50 * n + 50):
        i = np.flatnonzero(inside)
        k = np.block([[gram[np.ix_(i, i)], np.ones((len(i), 1))], [np.ones((1, len(i))), np.zeros((1, 1))]])
        z = np.zeros(n)
        z[i] = np.linalg.lstsq(k, np.r_[cross[i], 1.0], rcond=None)[0][:-1]
        down = np.flatnonzero(inside & (z < 0))
        if len(down):
            part = w[down] / (w[down] - z[down])
            step = part.min()
            w = np.maximum(w + step * (z - w), 0.0)
            w[down[part <= step]] = 0.0
            w /= w.sum()
            inside = w > 0
            continue
        w = z / z.sum()
        slope = gram @ w - cross
        level = slope[inside].min()
        best = int(np.argmin(np.where(inside, np.inf, slope)))
        if inside.all() or slope[best] >= level - tolerance * scale:
            return w
        inside[best] = True
    return w


def simplex_weights(df: DataFrame, by: list[str], sources: list[str], y: str, fold: str | None = None) -> DataFrame:
    """(by, source, weight, degenerate) for any number of sources, from the sums of products. With ``fold``, per held fold."""
    pairs = [(i, j) for i in range(len(sources)) for j in range(i, len(sources))]
    sums = [F.sum(F.col(sources[i]) * F.col(sources[j])).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(F.col(s) * F.col(y)).alias(f"c{i}") for i, s in enumerate(sources)]
    names = [f"g{i}_{j}" for i, j in pairs] + [f"c{i}" for i in range(len(sources))]
    m = df.groupBy(*by, *([fold] if fold else [])).agg(F.count("*").alias("n"), *sums)
    if fold:
        m, by = held_out(m, by, ["n", *names], fold), ["held", *by]

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                g = np.zeros((len(sources),) * 2)
                for i, j in pairs:
                    g[i, j] = g[j, i] = row[f"g{i}_{j}"] / row["n"]
                w = simplex(g, np.array([row[f"c{i}"] / row["n"] for i in range(len(sources))]))
                contrast = g[:-1, :-1] - g[-1:, :-1] - g[:-1, -1:] + g[-1, -1]
                flat = bool(np.linalg.matrix_rank(contrast, tol=1e-9) < len(sources) - 1)
                rows += [{**{b: row[b] for b in by}, "source": s, "weight": float(x), "degenerate": flat} for s, x in zip(sources, w, strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "source", "weight", "degenerate"])

    kinds = dict(m.dtypes)
    return m.mapInPandas(solve, ", ".join(f"{b} {kinds[b]}" for b in by) + ", source string, weight double, degenerate boolean")


def blend(df: DataFrame, weights: DataFrame, by: list[str], sources: list[str], out: str = "blend") -> DataFrame:
    """Adds the clipped weighted sum of the sources."""
    w = weights.groupBy(*by).agg(*[F.sum(F.when(F.col("source") == s, F.col("weight"))).alias(f"__w_{s}") for s in sources])
    total = F.lit(0.0)
    for s in sources:
        total = total + F.col(s) * F.col(f"__w_{s}")
    return df.join(F.broadcast(w), by).withColumn(out, clip(total)).drop(*[f"__w_{s}" for s in sources])


def cross_fit_stack(df: DataFrame, sources: list[str], y: str, *, prompt: str = "prompt_num", fold: str = "fold", by: tuple[str, ...] = ("trait",), weights: DataFrame | None = None) -> DataFrame:
    """Adds ``stacked``: per held fold, weights and then a calibrator from the other folds.

    Clipping between the two is not linear, so the calibrator's moments are summed over
    (held, row) pairs: as many copies of a row as there are other folds, reduced in the same stage.
    """
    by = list(by)
    w = weights if weights is not None else simplex_weights(df, by, sources, y, fold)
    held = w.select("held").distinct()
    others = df.join(F.broadcast(held), F.col("held") != F.col(fold))
    rest = blend(others, w, ["held", *by], sources)
    line, offsets = affine(moments_xy(rest, ["held", *by, prompt], "blend", y), ["held", *by], prompt=prompt)
    own = blend(df.withColumn("held", F.col(fold)), w, ["held", *by], sources)
    return apply_affine(own, line, offsets, ["held", *by], "blend", prompt=prompt, out="stacked").drop("held")


def weight_stability(weights: DataFrame, by: list[str]) -> DataFrame:
    """Per source: mean, deviation, range of weights over folds, and how often one lies at 0 or 1."""
    w = F.col("weight")
    return weights.groupBy(*by).agg(F.avg(w).alias("mean"), F.coalesce(F.stddev_samp(w), F.lit(0.0)).alias("sd"), F.min(w).alias("low"), F.max(w).alias("high"), F.count_if((w <= 1e-9) | (w >= 1 - 1e-9)).alias("at_boundary"))


def equal_mean(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Equal-weight mean over seeds, folds or sources."""
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


# --------------------------------------------------------------------- ridge


def gram_moments(df: DataFrame, by: list[str], x: str, targets: list[str]) -> DataFrame:
    """(by, n, g): sums of products of (1, x, targets), upper triangle flat; partitions sum in NumPy before the shuffle."""
    def fold(batches):
        import pyarrow as pa

        sums: dict[tuple, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            rows = np.array(t.column(x).to_pylist(), float)
            if not len(rows):
                continue
            y = np.stack([t.column(k).to_numpy().astype(float) for k in targets], 1)
            z = np.hstack([np.ones((len(rows), 1)), rows, y])
            keys = list(zip(*[t.column(k).to_pylist() for k in by], strict=True))
            for key in dict.fromkeys(keys):
                pick = np.fromiter((k == key for k in keys), bool, len(keys))
                got = sums.setdefault(key, [0, 0.0])
                got[0] += int(pick.sum())
                got[1] = got[1] + z[pick].T @ z[pick]
        if sums:
            names = [*by, "n", "g"]
            cols = [pa.array(c, k) for c, k in zip(zip(*sums, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1][np.triu_indices(len(v[1]))].tolist() for v in sums.values()], pa.list_(pa.float64()))], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(df.schema[k].dataType) for k in by]
    part = df.select(*by, x, *targets).mapInArrow(fold, ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in by) + ", n long, g array<double>")
    each = part.select(*by, "n", F.posexplode("g").alias("p", "v")).groupBy(*by, "p").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("g"))


def ridge_from_gram(g: np.ndarray, features: int, targets: int, alpha: float, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) on standardized features (population deviation, 1 where it is 0); the intercept is free of penalty."""
    keep = np.arange(features) if keep is None else keep
    n = g[0, 0]
    mean = g[0, 1 : 1 + features][keep] / n
    ymean = g[0, 1 + features :] / n
    xx = g[1 : 1 + features, 1 : 1 + features][np.ix_(keep, keep)] - n * np.outer(mean, mean)
    xy = g[1 : 1 + features, 1 + features :][keep] - n * np.outer(mean, ymean)
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 0))
    sd[sd <= 1e-12] = 1.0
    a = xx / np.outer(sd, sd) + alpha * np.eye(len(keep))
    w = np.linalg.lstsq(a, xy / sd[:, None], rcond=None)[0] / sd[:, None]
    return w, ymean - mean @ w


def square(flat: list[float]) -> np.ndarray:
    k = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = flat
    return g + np.triu(g, 1).T


def ridge_oof(df: DataFrame, x: str, targets: list[str], features: int, *, alpha: float, fold: str = "fold", out: str = "pred") -> DataFrame:
    """Adds ``pred`` (array, one per target, clipped): ridge fitted on the other folds. One Gram matrix a fold reaches the driver."""
    moments = {r[fold]: square(r.g) for r in gram_moments(df, [fold], x, targets).collect()}
    whole = sum(moments.values())
    fits = []
    for f, own in moments.items():
        w, b = ridge_from_gram(whole - own, features, len(targets), alpha)
        fits.append((f, [w[:, t].tolist() for t in range(len(targets))], b.tolist()))
    return apply_linear(df, df.sparkSession.createDataFrame(fits, "held long, w array<array<double>>, b array<double>"), x, fold, out)


def apply_linear(df: DataFrame, fits: DataFrame, x: str, fold: str, out: str) -> DataFrame:
    d = df.join(F.broadcast(fits), F.col(fold) == F.col("held"))
    return d.withColumn(out, F.zip_with("w", "b", lambda w, b: clip(F.aggregate(F.zip_with(x, w, lambda a, c: a * c), b, lambda s, v: s + v)))).drop("held", "w", "b")


def _candidates(moments: dict[int, np.ndarray], features: int, alphas: list[float], widths: list[int]) -> list[tuple]:
    """(outer, width, alpha, rmse) of each candidate over the inner folds; no rows of the outer fold take part.

    Inner errors come from Gram matrices alone: the held fold's squared error is a quadratic form of its own moments.
    """
    rows, whole = [], sum(moments.values())
    for outer in moments:
        inner = [f for f in moments if f != outer]
        trains = {f: whole - moments[outer] - moments[f] for f in inner if len(inner) > 1}
        for width in widths:
            for alpha in alphas:
                se = n = 0.0
                for f, train in trains.items():
                    w, b = ridge_from_gram(train, features, 1, alpha, np.arange(width))
                    v = np.zeros(len(train))
                    v[0], v[1 : 1 + width], v[-1] = b[0], w[:, 0], -1.0
                    se += v @ moments[f] @ v
                    n += moments[f][0, 0]
                rows.append((outer, width, float(alpha), float(np.sqrt(max(se, 0) / max(n, 1)))))
    return rows


def select_ridge(df: DataFrame, x: str, target: str, features: int, *, alphas: list[float], widths: list[int], fold: str = "fold") -> DataFrame:
    """Nested choice per outer fold: (outer, width, alpha, rmse); the smallest rmse over inner folds, then fewer features, then larger alpha."""
    moments = {r[fold]: square(r.g) for r in gram_moments(df, [fold], x, [target]).collect()}
    all_ = df.sparkSession.createDataFrame(_candidates(moments, features, alphas, widths), "outer_fold long, width int, alpha double, rmse double")
    best = F.min_by(F.struct("width", "alpha", "rmse"), F.struct(F.round("rmse", 12), "width", -F.col("alpha")))
    return all_.groupBy("outer_fold").agg(best.alias("x")).select("outer_fold", "x.*")


def nested_ridge_oof(df: DataFrame, key: str, blocks: dict[str, str], *, alphas: list[float], widths: list[int], fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(predictions, choices): each target of ``blocks`` (target -> its array of features) is predicted out of fold by ridge on the first features.

    Width and penalty are chosen per outer fold and target, as ``select_ridge`` does, and the model is fitted on all rows of the
    other folds. predictions: key, fold and a clipped column per target; choices: (outer_fold, target, width, alpha, rmse).
    One Gram matrix a fold and target reaches the driver. A target's fit leaves out rows where it is null; at least three folds.
    """
    fits, told, most = [], [], max(widths)
    for target, x in blocks.items():
        moments = {r[fold]: square(r.g) for r in gram_moments(df.where(F.col(target).isNotNull()).withColumn(x, F.slice(x, 1, most)), [fold], x, [target]).collect()}
        if len(moments) < 3:
            raise ValueError(f"{target}: nested choice needs three folds")
        whole, all_ = sum(moments.values()), _candidates(moments, most, alphas, widths)
        for outer in moments:
            mine = [c for c in all_ if c[0] == outer]
            _, width, alpha, rmse = min(mine, key=lambda c: (round(c[3], 12), c[1], -c[2]))
            w, b = ridge_from_gram(whole - moments[outer], most, 1, alpha, np.arange(width))
            fits.append((outer, target, w[:, 0].tolist(), float(b[0])))
            told.append((outer, target, width, alpha, rmse))
    spark = df.sparkSession
    table = spark.createDataFrame(fits, "held long, target string, w array<double>, b double").groupBy("held").agg(*[F.first(F.when(F.col("target") == t, F.struct("w", "b")), ignorenulls=True).alias(f"__{t}") for t in blocks])
    pred = lambda t, x: clip(F.aggregate(F.zip_with(F.slice(x, 1, F.size(F.col(f"__{t}")["w"])), F.col(f"__{t}")["w"], lambda a, c: a * c), F.col(f"__{t}")["b"], lambda s, v: s + v))
    out = df.join(F.broadcast(table), F.col(fold) == F.col("held"), "left").select(key, fold, *[pred(t, x).alias(t) for t, x in blocks.items()])  # a row a fold
    return out, spark.createDataFrame(told, "outer_fold long, target string, width int, alpha double, rmse double")


def one_hot(column: str, values: list[str]) -> Column:
    """0/1 array; unknown values give zeros."""
    return F.array(*[(F.col(column) == v).cast("double") for v in values])


def ridge_table(df: DataFrame, x: str, targets: list[str], features: int, *, alpha: float, fold: str | None = None) -> DataFrame:
    """(held, w, b): coefficients of all rows (held null), or of all but each fold: the deployment models."""
    part = F.lit(-1).cast("long") if fold is None else F.col(fold).cast("long")
    moments = {r.held: square(r.g) for r in gram_moments(df.withColumn("held", part), ["held"], x, targets).collect()}
    whole = sum(moments.values())
    fits = []
    for f, own in moments.items():
        w, b = ridge_from_gram(whole - own if fold else whole, features, len(targets), alpha)
        fits.append((f if fold else None, [w[:, t].tolist() for t in range(len(targets))], b.tolist()))
    return df.sparkSession.createDataFrame(fits, "held long, w array<array<double>>, b array<double>")


def ensemble_predict(df: DataFrame, models: DataFrame, x: str, key: str, out: str = "pred") -> DataFrame:
    """(key, out): mean of the models' predictions, then clipped; one model is an ensemble of one. Models are a row a fold."""
    each = df.select(key, x).join(F.broadcast(models)).select(key, "held", F.posexplode(F.zip_with("w", "b", lambda w, b: F.aggregate(F.zip_with(x, w, lambda a, c: a * c), b, lambda s, v: s + v))).alias("t", "p"))
    mean = each.groupBy(key, "t").agg(F.avg("p").alias("p"))
    return mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("of")).select(key, F.transform("of", lambda s: clip(s["p"])).alias(out))


def best_candidate(errors: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidate, rmse): the smallest mean over traits of the root mean squared error; ties go to the earlier candidate.

    ``errors``: by, candidate (place in the configuration), trait, squared error sums se and rows n.
    """
    per = errors.groupBy(*by, "candidate", "trait").agg(F.sqrt(F.sum("se") / F.sum("n")).alias("rmse")).groupBy(*by, "candidate").agg(F.avg("rmse").alias("rmse"))
    return per.groupBy(*by).agg(F.min_by(F.struct("candidate", "rmse"), F.struct(F.round("rmse", 12), "candidate")).alias("x")).select(*by, "x.*")
