"""Folds, baselines, calibration, stacking, neighbours, ridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import TRAITS
from ..operators import folds as FO
from ..operators import models as M
from ..operators import neighbours as N
from ..operators import text_ridge as TR
from ..session import materialize
from .essays import ESSAYS, SCORES, essays, gold_score, r, read, rounded, sources_long
from .texts import with_prompts


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = essays(spark, sf_dir).withColumn("average", (F.col("gold.content") + F.col("gold.organization") + F.col("gold.expression")) / 3)
    return FO.score_bands(e.select("doc_id", "id", "prompt_num", "cohort", "average"), "average", 5)


_BANDS = f"{ESSAYS}, av AS (SELECT *, (content + organization + expression) / 3 AS average FROM essays), cut AS (SELECT quantile_cont(average, [0.2, 0.4, 0.6, 0.8]) AS c FROM av), banded AS (SELECT av.*, len(list_filter(c, lambda x: x <= average)) AS band FROM av, cut)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir).groupBy("prompt_num", "band").agg(F.count("*").alias("n"))


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.stratified_folds(banded(spark, sf_dir))


def lopo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.lopo_folds(essays(spark, sf_dir)).select("id", "prompt_num", F.col("fold").cast("long").alias("fold"))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.holdout(essays(spark, sf_dir).select("id"), "id", 0.1)


HOLDOUT_SQL = "SELECT 'D' || doc_id AS id, row_number() OVER (ORDER BY sha256('D' || doc_id)) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.1::DOUBLE, 0)) AS validation FROM documents"


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.balanced_sample(banded(spark, sf_dir).select("id", "prompt_num", "band"), 60, seed=2026, sep="|")


REVIEW_SQL = f"""WITH {_BANDS}, q AS (SELECT id, prompt_num, band, row_number() OVER (PARTITION BY prompt_num, band ORDER BY sha256('2026|' || id)) AS rn, sha256('2026|' || prompt_num || '|' || band) AS t FROM banded)
SELECT id, prompt_num, band::INT AS band, format('R{{:04d}}', row_number() OVER (ORDER BY rn, t, id)) AS review_id FROM q ORDER BY rn, t, id LIMIT 60"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = FO.group_batches(essays(spark, sf_dir).select("doc_id", "prompt_num"), 7, order=F.col("doc_id"))
    return b.groupBy("prompt_num", "batch").agg(F.count("*").alias("n"))


BATCH_SQL = """WITH a AS (SELECT lang AS prompt_num, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT prompt_num, (CASE WHEN n % 7 = 1 AND k // 7 = (n - 1) // 7 AND n > 7 THEN k // 7 - 1 ELSE k // 7 END)::INT AS batch, count(*) AS n FROM a GROUP BY ALL"""


def prompt_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.mean_oof(sources_long(spark, sf_dir), "gold")
    return rounded(d.groupBy("fold", "trait", "prompt_num").agg(F.count("*").alias("n"), F.avg("pred").alias("pred"), F.sqrt(F.avg((F.col("pred") - F.col("gold")) ** 2)).alias("rmse")))


MEAN_SQL = f"""WITH {SCORES}, f AS (SELECT DISTINCT fold AS held FROM scores), m AS (SELECT held, trait, prompt_num, avg(gold) AS pred FROM scores JOIN f ON fold <> held GROUP BY ALL)
SELECT fold::INT AS fold, trait, prompt_num, count(*) AS n, {r('avg(pred)')} AS pred, {r('sqrt(avg((pred-gold)*(pred-gold)))')} AS rmse FROM scores JOIN m USING (trait, prompt_num) WHERE held = fold GROUP BY ALL"""


def calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.moments_xy(sources_long(spark, sf_dir), ["trait", "prompt_num"], "alpha", "gold")
    line, offsets = M.affine(m, ["trait"])
    return rounded(line.join(offsets, "trait"))


_LINE = "greatest(coalesce(regr_slope(y, x), 1e-6), 1e-6)"
CALIBRATOR_SQL = f"""WITH {SCORES}, l AS (SELECT trait, {_LINE.replace('y, x', 'gold, alpha')} AS slope, avg(gold) AS my, avg(alpha) AS mx FROM scores GROUP BY trait),
p AS (SELECT trait, slope, my - slope * mx AS intercept FROM l)
SELECT trait, prompt_num, {r('any_value(slope)')} AS slope, {r('any_value(intercept)')} AS intercept, {r('count(*) / (count(*) + 20.0) * avg(gold - intercept - slope * alpha)')} AS "offset" FROM scores JOIN p USING (trait) GROUP BY trait, prompt_num"""


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.calibrate_oof(sources_long(spark, sf_dir), "alpha", "gold")
    return rounded(d.groupBy("fold", "trait").agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("calibrated") - F.col("gold")) ** 2)).alias("rmse"), F.avg("calibrated").alias("mean")))


def _calibrate_sql(source: str, rows: str, own: str) -> str:
    """rows: (held, trait, prompt_num, x, y) to fit on; own: (fold, trait, prompt_num, x, y) to transform."""
    return f"""fit AS ({rows}), l AS (SELECT held, trait, {_LINE} AS slope, avg(y) AS my, avg(x) AS mx FROM fit GROUP BY ALL), p AS (SELECT held, trait, slope, my - slope * mx AS intercept FROM l),
o AS (SELECT held, trait, prompt_num, count(*) / (count(*) + 20.0) * avg(y - intercept - slope * x) AS off FROM fit JOIN p USING (held, trait) GROUP BY ALL), own AS ({own}),
z AS (SELECT own.fold, own.trait, own.y, least(greatest(intercept + slope * x + coalesce(off, 0), 1.0), 5.0) AS c FROM own JOIN p ON p.held = own.fold AND p.trait = own.trait LEFT JOIN o ON o.held = own.fold AND o.trait = own.trait AND o.prompt_num = own.prompt_num)"""


CALIBRATED_SQL = f"""WITH {SCORES}, f AS (SELECT DISTINCT fold AS held FROM scores), {_calibrate_sql('alpha', 'SELECT held, trait, prompt_num, alpha AS x, gold AS y FROM scores JOIN f ON fold <> held', 'SELECT fold, trait, prompt_num, alpha AS x, gold AS y FROM scores')}
SELECT fold::INT AS fold, trait, count(*) AS n, {r('sqrt(avg((c-y)*(c-y)))')} AS rmse, {r('avg(c)')} AS mean FROM z GROUP BY fold, trait"""


def two_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pair_weights(sources_long(spark, sf_dir), ["trait"], "alpha", "beta", "gold", "fold"))


_PAIR = "w AS (SELECT held, trait, CASE WHEN sum((alpha-beta)*(alpha-beta)) <= 1e-12 THEN 0.5 ELSE least(greatest(sum((alpha-beta)*(gold-beta)) / sum((alpha-beta)*(alpha-beta)), 0), 1) END AS weight, sum((alpha-beta)*(alpha-beta)) <= 1e-12 AS degenerate FROM scores JOIN f ON fold <> held GROUP BY ALL)"
PAIR_SQL = f"WITH {SCORES}, f AS (SELECT DISTINCT fold AS held FROM scores), {_PAIR} SELECT held::INT AS held, trait, {r('weight')} AS weight, degenerate FROM w"


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.weight_stability(M.pair_weights(sources_long(spark, sf_dir), ["trait"], "alpha", "beta", "gold", "fold"), ["trait"]))


STABILITY_SQL = f"WITH {SCORES}, f AS (SELECT DISTINCT fold AS held FROM scores), {_PAIR} SELECT trait, {r('avg(weight)')} AS mean, {r('coalesce(stddev_samp(weight),0)')} AS sd, {r('min(weight)')} AS low, {r('max(weight)')} AS high, count(*) FILTER (weight <= 1e-9 OR weight >= 1 - 1e-9) AS at_boundary FROM w GROUP BY trait"


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-fitted two-source blend and calibration."""
    d = sources_long(spark, sf_dir)
    w = M.pair_weights(d, ["trait"], "alpha", "beta", "gold", "fold")
    both = F.explode(F.array(F.struct(F.lit("alpha").alias("source"), F.col("weight").alias("weight")), F.struct(F.lit("beta").alias("source"), (1 - F.col("weight")).alias("weight"))))
    got = M.cross_fit_stack(d, ["alpha", "beta"], "gold", weights=w.select("held", "trait", both.alias("x")).select("held", "trait", "x.*"))
    return rounded(got.groupBy("fold", "trait").agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("stacked") - F.col("gold")) ** 2)).alias("rmse"), F.avg("stacked").alias("mean")))


_BL = "least(greatest(alpha * weight + beta * (1 - weight), 1.0), 5.0)"
STACKED_SQL = f"""WITH {SCORES}, f AS (SELECT DISTINCT fold AS held FROM scores), {_PAIR}, {_calibrate_sql('b', f'SELECT held, trait, prompt_num, {_BL} AS x, gold AS y FROM scores JOIN w USING (trait) WHERE fold <> held', f'SELECT fold, trait, prompt_num, {_BL} AS x, gold AS y FROM scores JOIN w USING (trait) WHERE fold = held')}
SELECT fold::INT AS fold, trait, count(*) AS n, {r('sqrt(avg((c-y)*(c-y)))')} AS rmse, {r('avg(c)')} AS mean FROM z GROUP BY fold, trait"""


def three_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.simplex_weights(sources_long(spark, sf_dir), ["trait"], ["alpha", "beta", "gamma"], "gold", "fold"))


_G = {f"g{i}{j}": (a, b) for i, a in enumerate("abc") for j, b in enumerate("abc") if i <= j}
_NAMES = {"a": "alpha", "b": "beta", "c": "gamma"}


def _edge(i: str, j: str, k: str) -> str:
    """The best weights of two sources alone (an end is one source)."""
    g = lambda x, y: f"g{''.join(sorted(str('abc'.index(v)) for v in (x, y)))}"
    t = f"CASE WHEN {g(i, i)} - 2 * {g(i, j)} + {g(j, j)} <= 0 THEN 0 ELSE least(greatest((c{i} - c{j} - {g(i, j)} + {g(j, j)}) / ({g(i, i)} - 2 * {g(i, j)} + {g(j, j)}), 0), 1) END"
    return f"SELECT *, {t} AS w{i}, 1 - ({t}) AS w{j}, 0.0 AS w{k} FROM m"


_WEIGHTS = ", ".join(f"w{x}" for x in "abc")
SIMPLEX_SQL = f"""WITH {SCORES}, m AS (SELECT held, trait, {', '.join(f'avg({_NAMES[a]} * {_NAMES[b]}) AS {g}' for g, (a, b) in _G.items())}, {', '.join(f'avg({v} * gold) AS c{k}' for k, v in _NAMES.items())} FROM scores JOIN range(5) t(held) ON doc_id * 7 % 5 <> held GROUP BY ALL),
d AS (SELECT *, g00 - 2 * g02 + g22 AS p, g01 - g02 - g12 + g22 AS q, g11 - 2 * g12 + g22 AS s, ca - cc - g02 + g22 AS x, cb - cc - g12 + g22 AS y FROM m),
face AS (SELECT * EXCLUDE (p, q, s, x, y), (s * x - q * y) / (p * s - q * q) AS wa, (p * y - q * x) / (p * s - q * q) AS wb, 1 - (s * x - q * y + p * y - q * x) / (p * s - q * q) AS wc FROM d),
o AS (SELECT held, trait, {_WEIGHTS}, {' + '.join(f"{'' if a == b else '2 * '}w{a} * w{b} * {g}" for g, (a, b) in _G.items())} - 2 * (wa * ca + wb * cb + wc * cc) AS v
 FROM (SELECT * FROM face WHERE least({_WEIGHTS}) >= 0 UNION ALL BY NAME {_edge('a', 'b', 'c')} UNION ALL BY NAME {_edge('a', 'c', 'b')} UNION ALL BY NAME {_edge('b', 'c', 'a')})),
w AS (SELECT held, trait, unnest(['alpha', 'beta', 'gamma']) AS source, unnest([{_WEIGHTS}]) AS weight FROM o QUALIFY row_number() OVER (PARTITION BY held, trait ORDER BY v) = 1)
SELECT held, trait, source, {r('weight')} AS weight, false AS degenerate FROM w"""


def seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sources_long(spark, sf_dir)
    tall = d.select("doc_id", "trait", F.explode(F.array("alpha", "beta", "gamma")).alias("pred"))
    return rounded(M.equal_mean(tall, ["doc_id", "trait"], ["pred"]))


SEED_SQL = f"WITH {SCORES} SELECT doc_id, trait, {r('(alpha + beta + gamma) / 3')} AS pred FROM scores"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(v.alias("id"), F.col("label").alias("prompt_hash"), F.col("embedding").cast("array<double>").alias("embedding"), (v % 5).alias("fold"), F.array(1 + v * 37 % 41 * F.lit(0.1), 1 + v * 7 % 17 * F.lit(0.25), 1 + (v * 11 + 3) % 17 * F.lit(0.25)).alias("scores"))


def knn_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    got = N.knn(v.drop("scores"), v, other_folds=True)
    return rounded(got.select("id", *[F.get("pred", i).alias(t) for i, t in enumerate(TRAITS)], "mean_distance", "fallback", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours")), 5)


KNN_SQL = f"""WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e, vec_id % 5 AS fold, 1 + vec_id * 37 % 41 * 0.1::DOUBLE AS c, 1 + vec_id * 7 % 17 * 0.25::DOUBLE AS o, 1 + (vec_id * 11 + 3) % 17 * 0.25::DOUBLE AS x FROM embeddings),
s AS (SELECT q.id, b.id AS near, list_cosine_similarity(q.e, b.e) AS sim, b.c, b.o, b.x FROM v q JOIN v b ON q.label = b.label AND q.id <> b.id AND q.fold <> b.fold),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, near) AS k FROM s QUALIFY k <= 8), u AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY id)) / 0.07) AS w FROM t)
SELECT id, {', '.join(r(f'least(greatest(sum(w*{k})/sum(w),1),5)', 5) + f' AS {t}' for k, t in zip('cox', TRAITS, strict=True))}, {r('sum(w*(1-sim))/sum(w)', 5)} AS mean_distance, false AS fallback, string_agg(near::VARCHAR, ',' ORDER BY k) AS neighbours FROM u GROUP BY id"""


def surface_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with a vanishing penalty on the surface features, out of fold."""
    e = T.surface_features(with_prompts(spark, sf_dir)).withColumn("fold", F.col("doc_id") * 7 % 5)
    prompts = ["en", "fr", "de", "es"]
    x = e.select("doc_id", "fold", F.concat(F.array(*T.SURFACE), M.one_hot("prompt_num", prompts)).alias("x"), *[F.col("gold")[t].alias(t) for t in TRAITS])
    got = M.ridge_oof(x, "x", list(TRAITS), len(T.SURFACE) + len(prompts), alpha=1e-6)
    return rounded(got.select("doc_id", "fold", *[F.get("pred", i).alias(t) for i, t in enumerate(TRAITS)]), 4)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, their prompts and surface features, made-up scores and five folds."""
    e = T.surface_features(with_prompts(spark, sf_dir))
    return e.select("doc_id", "prompt_num", "cohort", (F.col("doc_id") * 7 % 5).cast("int").alias("fold"), "essay", "prompt", F.array(*T.SURFACE).alias("dense"), *[F.col("gold")[t].alias(t) for t in TRAITS])


def text_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on TF-IDF of characters, words and prompts, prompt categories and surface features of whole documents, out of fold."""
    got = TR.text_ridge_oof(_texts(spark, sf_dir), "doc_id", list(TRAITS), dense="dense", category="prompt_num")
    return rounded(got.select("doc_id", "fold", *[F.get("pred", i).alias(t) for i, t in enumerate(TRAITS)]), 2)


def nested_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the same ridge, three penalties by two by two caps, with their inner errors, for each of five outer folds."""
    got = TR.ridge_candidates(_texts(spark, sf_dir), "doc_id", list(TRAITS), dense="dense", category="prompt_num")
    return rounded(got.candidates, 3)


def fold_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse document frequencies of the other folds' characters and words, per held-out fold: the most frequent 3000 of each."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 % 5).cast("int").alias("f"), F.lit(None).cast("array<int>").alias("inner"), F.col("text").alias("essay"))
    sets = [(o, None) for o in range(5)]
    wide = materialize(TR.set_frequencies(d, len(sets), char=(3, 4)), "frequencies")  # read several times
    kept = TR.vocabularies(wide, caps={"char": 3000, "word": 3000})
    sizes = F.broadcast(d.agg(*[F.count_if(TR.seen(s)).alias(f"n{s[0]}") for s in sets]).select(F.array(*[f"n{o}" for o, _ in sets]).alias("n")))  # a row
    idf = F.log((1 + F.get("n", F.col("held"))) / (1 + F.get("df", F.col("held")))) + 1
    return rounded(kept.select("block", "term", "df", F.explode("has").alias("held")).join(sizes).select("held", "block", "term", idf.alias("idf")))


VOCABULARY_SQL = rf"""WITH low AS (SELECT doc_id, doc_id * 7 % 5 AS fold, lower(text) AS text FROM documents), one AS (SELECT doc_id, fold, regexp_replace(text, '\s\s+', ' ', 'g') AS text FROM low),
w AS (SELECT doc_id, fold, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM low), k AS (SELECT unnest([3, 4]) AS k),
t AS (SELECT doc_id, fold, 'word' AS block, unnest(w) AS term FROM w UNION ALL SELECT doc_id, fold, 'word', w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)
UNION ALL SELECT doc_id, fold, 'char', substr(text, i, k) FROM (SELECT *, unnest(range(1, length(text) - k + 2)) AS i FROM one, k)),
c AS (SELECT doc_id, fold, block, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT h AS held, count(*) AS n FROM documents JOIN range(5) r(h) ON doc_id * 7 % 5 <> h GROUP BY h),
v AS (SELECT h AS held, block, term, count(*) AS df, sum(n) AS tf FROM c JOIN range(5) r(h) ON fold <> h GROUP BY ALL HAVING count(*) >= CASE block WHEN 'char' THEN 3 ELSE 2 END)
SELECT held, block, term, {r('ln((1 + n) / (1.0 + df)) + 1')} AS idf FROM v JOIN s USING (held) QUALIFY row_number() OVER (PARTITION BY held, block ORDER BY tf DESC, term) <= 3000"""


def answer_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up answers to 18 questions with five codes each: rows of positive integers, normalized."""
    q = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda q: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: 1.0 + F.pmod(3 * F.col("doc_id") + q + c, F.lit(7))))
    norm = F.transform(q, lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))
    d = read(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", (F.col("doc_id") * 7 % 5).alias("fold"), norm.alias("probs"), gold_score("content").alias("content"))


def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested choice of question count and penalty for one trait's ridge on answer probabilities."""
    a = answer_probabilities(spark, sf_dir).withColumn("x", F.flatten(F.slice("probs", 1, 6)))
    got = M.select_ridge(a, "x", "content", 30, alphas=[0.01, 0.1, 1.0, 10.0, 100.0], widths=[15, 20, 25, 30])
    return rounded(got)


def assessment_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of the three traits, each from its own six questions; width (three to six questions) and penalty are chosen within."""
    a = answer_probabilities(spark, sf_dir).select("doc_id", "fold", *[F.flatten(F.slice("probs", 6 * i + 1, 6)).alias(f"x_{t}") for i, t in enumerate(TRAITS)], *[gold_score(t).alias(t) for t in TRAITS])
    got, _ = M.nested_ridge_oof(a, "doc_id", {t: f"x_{t}" for t in TRAITS}, alphas=[0.01, 0.1, 1.0, 10.0, 100.0], widths=[15, 20, 25, 30])
    return rounded(got, 4)


QUERIES = {
    "assessment_oof": (assessment_oof, None),
    "score_bands": (bands, f"WITH {_BANDS} SELECT prompt_num, band::INT AS band, count(*) AS n FROM banded GROUP BY ALL"),
    "stratified_folds": (stratified, None),
    "lopo_folds": (lopo, "SELECT 'D' || doc_id AS id, lang AS prompt_num, dense_rank() OVER (ORDER BY lang) - 1 AS fold FROM documents"),
    "hash_holdout": (holdout, HOLDOUT_SQL),
    "balanced_review_sample": (review_sample, REVIEW_SQL),
    "prompt_batches": (batches, BATCH_SQL),
    "prompt_mean_oof": (prompt_mean, MEAN_SQL),
    "affine_calibrator": (calibrator, CALIBRATOR_SQL),
    "calibration_oof": (calibrated, CALIBRATED_SQL),
    "pair_weights": (two_source, PAIR_SQL),
    "weight_stability": (stability, STABILITY_SQL),
    "cross_fit_stack": (stacked, STACKED_SQL),
    "simplex_weights": (three_source, SIMPLEX_SQL),
    "seed_mean": (seed_mean, SEED_SQL),
    "knn_oof": (knn_oof, KNN_SQL),
    "surface_ols_oof": (surface_ols, None),
    "assessment_selection": (assessment, None),
    "text_ridge_oof": (text_ridge, None),
    "nested_text_ridge": (nested_ridge, None),
    "fold_vocabulary": (fold_vocabulary, VOCABULARY_SQL),
}
