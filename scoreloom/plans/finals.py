"""Final rows, review packs, judge contracts, lenient outputs, losses of batches, deployment models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import TRAITS
from ..operators import comparison as CO
from ..operators import final as FI
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import pairing as PA
from ..operators import rationale as R
from ..sources import strict as S
from .essays import SCORES, essays, gold_score, r, read, rounded, source_score, sources_long


def _scores(spark: SparkSession, sf_dir: str, source: str = "alpha") -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("prompt_num"), F.struct(*[source_score(t, source).alias(t) for t in TRAITS]).alias("scores"))


def final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final rows of planted cases: generated texts for some documents, written for other scores or prompts, or not grounded; scores missing or extra."""
    e = essays(spark, sf_dir, heavy=True)
    s = _scores(spark, sf_dir)
    kind = F.col("doc_id") % 8
    led = R.ledger(e).join(s.select("doc_id", "scores"), "doc_id")
    own = R.rationales(F.col("ledger"), {t: F.col("scores")[t] for t in TRAITS})
    texts = F.when(kind == 4, own.withField("content", F.concat(own["content"], F.lit(" 987654321.5")))).otherwise(own)
    g = led.where(kind.isin(1, 2, 3, 4)).select("id", F.when(kind == 3, "other").otherwise(F.col("prompt_num")).alias("prompt_num"), F.when(kind == 2, F.col("scores").withField("content", F.lit(1.01))).otherwise(F.col("scores")).alias("conditioned"), texts.alias("texts"))
    scored = s.where("doc_id % 8 <> 5").select("id", F.when(kind == 6, "elsewhere").otherwise(F.col("prompt_num")).alias("prompt_num"), "scores")
    got = FI.compose(e.where("doc_id % 8 <> 7").select("id", "prompt_num", "essay"), scored, g, "m")
    return rounded(got.select("id", "prompt_num", "model", *TRAITS, "status", "fallback"))


def _max(t: str, s: str = "alpha") -> str:
    return f"max({s}) FILTER (trait = '{t}')"


FINAL_SQL = f"""WITH {SCORES}, d AS (SELECT doc_id, prompt_num, {', '.join(f'{_max(t)} AS {t}' for t in TRAITS)} FROM scores GROUP BY ALL)
SELECT 'D' || doc_id AS id, CASE doc_id % 8 WHEN 7 THEN prompt_num ELSE prompt_num END AS prompt_num, 'm' AS model, {', '.join(f'{r(f"CASE WHEN doc_id % 8 <> 5 THEN {t} END")} AS {t}' for t in TRAITS)},
 CASE doc_id % 8 WHEN 2 THEN CASE WHEN content = 1.01 THEN 'ok' ELSE 'conditioned' END WHEN 3 THEN 'rationale_prompt' WHEN 4 THEN 'ungrounded' WHEN 5 THEN 'no_score' WHEN 6 THEN 'prompt' WHEN 7 THEN 'extra' ELSE 'ok' END AS status, doc_id % 8 NOT IN (1, 2, 3, 4) AS fallback FROM d"""


def review_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind reviews of two sources of texts; a fifth of the rows has other scores, a seventh lacks a side."""
    e = essays(spark, sf_dir).withColumn("prompt", F.lit("p"))
    s = _scores(spark, sf_dir)
    def texts(x: str):
        return F.struct(*[F.concat(F.lit(f"{x} {t} "), F.col("id")).alias(t) for t in TRAITS]).alias("texts")
    c = s.where("doc_id % 7 <> 0").select("id", "prompt_num", "scores", texts("new"))
    b = s.select("id", "prompt_num", F.when(F.col("doc_id") % 5 == 0, F.col("scores").withField("content", F.lit(0.5))).otherwise(F.col("scores")).alias("scores"), texts("old"))
    reviews, key, refused = FI.review_pack(e.select("id", "prompt_num", "prompt", "essay"), c, b, seed=2026)
    j = reviews.join(key.select("review_id", "id", F.col("option_a").alias("a")), "review_id")
    ok = j.select("id", "review_id", "a", F.sha2(F.concat_ws("|", *[F.col("option_a")[t] for t in TRAITS], *[F.col("option_b")[t] for t in TRAITS]), 256).alias("texts_sha256"), F.lit(None).cast("string").alias("reason"))
    return ok.unionByName(refused.select("id", F.lit(None).cast("string").alias("review_id"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("texts_sha256"), "reason"))


def _side(x: str) -> str:
    return " || '|' || ".join(f"'{x} {t} D' || doc_id" for t in TRAITS)


PACK_SQL = f"""WITH d AS (SELECT doc_id, 'D' || doc_id AS id, 'R' || substr(sha256('2026' || chr(0) || 'D' || doc_id), 1, 16) AS review_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'scores' END AS reason FROM documents),
f AS (SELECT *, contains('02468ace', right(sha256(review_id), 1)) AS first FROM d)
SELECT id, CASE WHEN reason IS NULL THEN review_id END AS review_id, CASE WHEN reason IS NULL THEN CASE WHEN first THEN 'candidate' ELSE 'baseline' END END AS a,
 CASE WHEN reason IS NULL THEN sha256(CASE WHEN first THEN {_side('new')} || '|' || {_side('old')} ELSE {_side('old')} || '|' || {_side('new')} END) END AS texts_sha256, reason FROM f"""


def judge_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge responses with planted breaches, by error."""
    kind = F.col("doc_id") % 6
    pick = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.concat(*[F.concat(F.lit(f'"{k}":"'), F.when(kind == 1, "a").otherwise(pick) if k == "overall" else pick, F.lit('",')) for k in S.DECISIONS])
    reason = F.when(kind == 2, F.repeat(F.lit("x"), 221)).when(kind == 3, "one\\ntwo").when(kind == 4, " ").otherwise(" 근거가 충실하다 ")
    line = F.concat(F.lit("{"), body, F.lit('"reason":"'), reason, F.lit('"'), F.when(kind == 5, ',"more":1').otherwise(""), F.lit("}"))
    p = S.parse_lines(read(spark, sf_dir, "documents").select("doc_id", line.alias("value")), "judgement")
    return p.groupBy(F.coalesce("error", F.lit("none")).alias("error"), "overall").agg(F.count("*").alias("n"), F.max(F.length("reason")).alias("reason_chars"))


JUDGE_SQL = """SELECT CASE doc_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'decision' WHEN 2 THEN 'reason' WHEN 3 THEN 'reason' WHEN 4 THEN 'text' ELSE 'keys' END AS error, CASE WHEN doc_id % 6 = 0 THEN ['A', 'B', 'TIE'][doc_id % 3 + 1] END AS overall, count(*) AS n,
 max(CASE WHEN doc_id % 6 = 0 THEN length('근거가 충실하다') END)::INT AS reason_chars FROM documents GROUP BY 1, 2"""


def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs with planted defects, read leniently: scores found, by kind of defect."""
    kind = F.col("doc_id") % 7
    x = F.format_string("%.2f", gold_score("content"))
    def part(t: str, score, close="}"):
        return F.concat(F.lit(f'"{t}":{{"score":'), score, F.lit(',"rationale":"because \\"so\\""'), F.lit(close) if isinstance(close, str) else close)
    quoted = F.when(kind == 2, F.concat(F.lit('"'), x, F.lit('점"'))).otherwise(x)
    body = F.concat(F.lit("{"), part("content", quoted), F.lit(","), part("organization", F.lit("3")), F.lit(","), part("expression", F.lit("4.5"), F.when(kind == 1, ")").otherwise("}")), F.lit("}"))
    raw = F.when(kind == 3, F.concat(F.lit("Sure: {x} "), body, F.lit(" done"))).when(kind == 4, F.replace(body, F.lit('},"organization"'), F.lit('} "organization"'))).when(kind == 5, F.substring(body, 1, 40)).when(kind == 6, F.regexp_replace(body, '"score":3', '"score":9')).otherwise(body)
    p = S.parse_lines(read(spark, sf_dir, "documents").select("doc_id", raw.alias("value")), "lenient")
    return rounded(p.select("doc_id", "content", "organization", "expression", F.coalesce("error", F.lit("none")).alias("error"), F.length("content_rationale").alias("chars")))


LENIENT_SQL = f"""WITH {SCORES}, d AS (SELECT doc_id, {_max('content', 'gold')} AS x FROM scores GROUP BY doc_id)
SELECT doc_id, {r("CASE WHEN doc_id % 7 < 5 THEN round(x, 2) END")} AS content, CASE WHEN doc_id % 7 < 5 THEN 3.0::DOUBLE END AS organization, CASE WHEN doc_id % 7 < 5 THEN 4.5::DOUBLE END AS expression,
 CASE doc_id % 7 WHEN 5 THEN 'text' WHEN 6 THEN 'score' ELSE 'none' END AS error, CASE WHEN doc_id % 7 < 5 THEN 12 END AS chars FROM d"""


def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's log with blank and broken rows, kept last by id, against the documents: coverage and mean time."""
    kind = F.col("doc_id") % 9
    line = F.when(kind == 0, "").when(kind == 1, "{").otherwise(F.concat(F.lit('{"id":"D'), F.col("doc_id").cast("string"), F.lit('","parse_ok":'), F.when(kind == 2, "false").otherwise("true"), F.lit(',"elapsed_sec":'), (kind * 0.5).cast("string"), F.lit(',"raw":"x"}')))
    d = read(spark, sf_dir, "documents")
    log = S.parse_lines(d.select("doc_id", line.alias("value")), "run").where("error is null")
    last = M.keep_last(log.select("id", "doc_id", "parse_ok", "elapsed_sec"), "id", "doc_id")
    return rounded(M.coverage(d.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id")), last, elapsed="elapsed_sec"))


RUN_SQL = f"""SELECT count(*) AS expected, count(*) FILTER (doc_id % 9 > 1) AS generated, count(*) FILTER (doc_id % 9 > 2) AS parsed, count(*) FILTER (doc_id % 9 = 2) AS failed, count(*) FILTER (doc_id % 9 < 2) AS missing,
 {r('avg(doc_id % 9 * 0.5) FILTER (doc_id % 9 > 1)')} AS mean_elapsed, {r('count(*) FILTER (doc_id % 9 > 2)::DOUBLE / count(*) FILTER (doc_id % 9 > 1)')} AS parse_rate FROM documents"""


def length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.length_bounds(M.length_quantiles(essays(spark, sf_dir)))


BOUNDS_SQL = "SELECT q AS length_quantile, count(*) AS n, min(c)::INT AS min_chars, max(c)::INT AS max_chars FROM (SELECT length(text) AS c, floor((row_number() OVER (ORDER BY length(text), doc_id) - 1) * 4 / count(*) OVER ())::INT AS q FROM documents) GROUP BY q"


def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents: the limit is the feature."""
    return M.head(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 20)


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-rank loss of batches of up to eight documents of a prompt, and the weighted total with the mean squared error."""
    d = sources_long(spark, sf_dir).where("trait = 'content'").withColumn("batch", F.floor(F.col("doc_id") / 32))
    soft = CO.soft_rank_loss(d, ["prompt_num", "batch"], "alpha", "gold", tie=0.1001)
    mse = d.groupBy("prompt_num", "batch").agg(F.avg((F.col("alpha") - F.col("gold")) ** 2).alias("mse"))
    none = F.lit(None).cast("double")
    return rounded(mse.join(soft, ["prompt_num", "batch"], "left").select("prompt_num", "batch", "mse", F.col("loss").alias("soft_rank"), CO.total_loss(F.col("mse"), none, none, F.col("loss"), weights=(1.0, 0.3, 0.2, 0.5)).alias("total")))


LOSS_SQL = f"""WITH {SCORES}, d AS (SELECT doc_id, prompt_num, doc_id // 32 AS batch, gold, alpha FROM scores WHERE trait = 'content'),
p AS (SELECT a.doc_id, a.prompt_num, a.batch, avg(1 / (1 + exp(-(a.alpha - b.alpha) / 0.25::DOUBLE))) AS p, avg(CASE WHEN a.gold - b.gold > 0.1001 THEN 1 WHEN a.gold - b.gold < -0.1001 THEN 0 ELSE 0.5 END) AS g FROM d a JOIN d b ON a.prompt_num = b.prompt_num AND a.batch = b.batch AND a.doc_id <> b.doc_id GROUP BY ALL),
s AS (SELECT prompt_num, batch, avg(CASE WHEN abs(p - g) < 0.1 THEN 0.5 * (p - g) * (p - g) / 0.1 ELSE abs(p - g) - 0.05 END) AS loss FROM p GROUP BY ALL), m AS (SELECT prompt_num, batch, avg((alpha - gold) * (alpha - gold)) AS mse FROM d GROUP BY ALL)
SELECT prompt_num, batch, {r('mse')} AS mse, {r('loss')} AS soft_rank, {r('mse + 0.5 * coalesce(loss, 0)')} AS total FROM m LEFT JOIN s USING (prompt_num, batch)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three sources as candidates, held out by fold: smallest mean error over traits on the other folds."""
    d = sources_long(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(s).alias("p")) for i, s in enumerate(("alpha", "beta", "gamma"))]))
    errors = d.select("fold", "trait", "gold", each.alias("x")).groupBy("fold", "trait", "x.candidate").agg(F.sum((F.col("x.p") - F.col("gold")) ** 2).alias("se"), F.count("*").alias("n"))
    outer = spark.range(5).select(F.col("id").cast("int").alias("outer_fold"))
    return rounded(MO.best_candidate(errors.join(F.broadcast(outer), F.col("fold") != F.col("outer_fold")), ["outer_fold"]))


CANDIDATE_SQL = f"""WITH {SCORES}, l AS (SELECT fold, trait, 0 AS candidate, (alpha - gold) * (alpha - gold) AS e FROM scores UNION ALL SELECT fold, trait, 1, (beta - gold) * (beta - gold) FROM scores UNION ALL SELECT fold, trait, 2, (gamma - gold) * (gamma - gold) FROM scores),
c AS (SELECT o AS outer_fold, candidate, trait, sqrt(avg(e)) AS v FROM l JOIN range(5) t(o) ON o <> fold GROUP BY ALL), m AS (SELECT outer_fold, candidate, avg(v) AS v FROM c GROUP BY ALL)
SELECT outer_fold::INT AS outer_fold, candidate, {r('v')} AS rmse FROM m QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY round(v, 12), candidate) = 1"""


def deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold models of two sources, fitted by least squares, applied as an ensemble."""
    s = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 % 5).alias("fold"), F.array(source_score("content", "alpha"), source_score("content", "beta")).alias("x"), gold_score("content").alias("content"), gold_score("expression").alias("expression"))
    models = MO.ridge_table(s, "x", ["content", "expression"], 2, alpha=1e-9, fold="fold")
    got = MO.ensemble_predict(s, models, "x", "doc_id")
    return rounded(got.select("doc_id", F.col("pred")[0].alias("content"), F.col("pred")[1].alias("expression")), 5)


def _fit(y: str, k: str) -> str:
    cov = "covar_samp"
    return f"""(SELECT o, avg({y}) - b1 * avg(a) - b2 * avg(b) AS b0, b1, b2 FROM (SELECT *, ({cov}(a, {y}) OVER w * var_samp(b) OVER w - {cov}(b, {y}) OVER w * {cov}(a, b) OVER w) / (var_samp(a) OVER w * var_samp(b) OVER w - {cov}(a, b) OVER w ** 2) AS b1,
 ({cov}(b, {y}) OVER w * var_samp(a) OVER w - {cov}(a, {y}) OVER w * {cov}(a, b) OVER w) / (var_samp(a) OVER w * var_samp(b) OVER w - {cov}(a, b) OVER w ** 2) AS b2 FROM t WINDOW w AS (PARTITION BY o)) GROUP BY o, b1, b2) {k}"""


DEPLOY_SQL = f"""WITH {SCORES}, d AS (SELECT doc_id, fold, {_max('content', 'alpha')} AS a, {_max('content', 'beta')} AS b, {_max('content', 'gold')} AS y, {_max('expression', 'gold')} AS z FROM scores GROUP BY doc_id, fold), t AS (SELECT o, a, b, y, z FROM d JOIN range(5) r(o) ON o <> fold),
p AS (SELECT doc_id, avg(y.b0 + y.b1 * a + y.b2 * b) AS c, avg(z.b0 + z.b1 * a + z.b2 * b) AS e FROM d, {_fit('y', 'y')} JOIN {_fit('z', 'z')} USING (o) GROUP BY doc_id)
SELECT doc_id, {r('least(greatest(c, 1), 5)', 5)} AS content, {r('least(greatest(e, 1), 5)', 5)} AS expression FROM p"""

def pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch's batches of two documents of one language whose made-up scores differ."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", *[gold_score(t).alias(t) for t in TRAITS])
    return PA.pair_batches(d, prompt="lang", key="doc_id", scores=list(TRAITS))


QUERIES = {
    "pair_batches": (pair_batches, None),
    "final_rows": (final_rows, FINAL_SQL),
    "review_pack": (review_pack, PACK_SQL),
    "judge_contract": (judge_contract, JUDGE_SQL),
    "lenient_outputs": (lenient, LENIENT_SQL),
    "run_coverage": (run_coverage, RUN_SQL),
    "length_bounds": (length_bounds, BOUNDS_SQL),
    "first_rows": (shortest, "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20"),
    "batch_losses": (batch_losses, LOSS_SQL),
    "candidate_selection": (candidates, CANDIDATE_SQL),
    "ensemble_deployment": (deployment, DEPLOY_SQL),
}
