"""Evaluation, slices, audit and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as AL
from ..operators import metrics as M
from .essays import ENDED_SQL, ESSAYS, SCORES, essays, predictions, r, read, rounded, sources_long

STATS = f"""count(*) AS n, {r('sqrt(avg((p-g)*(p-g)))')} AS rmse, {r('avg(abs(p-g))')} AS mae, {r('avg(p)-avg(g)')} AS bias,
 {r('CASE WHEN count(*)<2 OR min(g)=max(g) OR min(p)=max(p) THEN 0 ELSE corr(g,p) END')} AS pearson,
 {r('CASE WHEN count(*)<2 OR min(g)=max(g) OR min(p)=max(p) THEN 0 ELSE corr(rg,rp) END')} AS spearman,
 {r('avg(g)')} AS gold_mean, {r('avg(p)')} AS pred_mean, {r('coalesce(stddev_samp(g),0)')} AS gold_sd, {r('coalesce(stddev_samp(p),0)')} AS pred_sd,
 {r('avg((abs(p-g)<=0.25)::INT)')} AS within_0_25, {r('avg((abs(p-g)<=0.5)::INT)')} AS within_0_5, {r('avg((abs(p-g)<=1.0)::INT)')} AS within_1_0"""
RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY slice, value, trait ORDER BY g) + (count(*) OVER (PARTITION BY slice, value, trait, g) - 1) / 2.0 AS rg,
 rank() OVER (PARTITION BY slice, value, trait ORDER BY p) + (count(*) OVER (PARTITION BY slice, value, trait, p) - 1) / 2.0 AS rp FROM tall)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predictions, aligned by id, one row a trait."""
    joined = M.align(essays(spark, sf_dir).select("id", "prompt_num", "gold"), predictions(spark, sf_dir))
    return M.long_scores(joined, ["id", "prompt_num"])


def prompt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.regression_metrics(M.cells(scored(spark, sf_dir), ["prompt_num", "trait"]), ["prompt_num", "trait"]))


PROMPT_SQL = f"WITH {SCORES}, tall AS (SELECT 'p' AS slice, prompt_num AS value, trait, gold AS g, alpha AS p FROM scores), {RANKED} SELECT value AS prompt_num, trait, {STATS} FROM ranked GROUP BY value, trait"


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.length_quantiles(essays(spark, sf_dir)).select("id", "prompt_num", "length_quantile", "gold")
    j = M.align(e, predictions(spark, sf_dir))
    return rounded(M.sliced_report(M.long_scores(j, ["prompt_num", "length_quantile"]), {"prompt": "prompt_num", "length": "length_quantile"}))


_TALL = f"""{SCORES}, lq AS (SELECT doc_id, floor((row_number() OVER (ORDER BY length(text), doc_id) - 1) * 4 / count(*) OVER ())::INT AS q FROM documents),
s3 AS (SELECT 'overall' AS slice, 'all' AS value, trait, gold AS g, alpha AS p FROM scores UNION ALL SELECT 'prompt', prompt_num, trait, gold, alpha FROM scores
 UNION ALL SELECT 'length', q::VARCHAR, trait, gold, alpha FROM scores JOIN lq USING (doc_id)),
tall AS (SELECT * FROM s3 UNION ALL SELECT slice, value, 'micro', g, p FROM s3), {RANKED},
own AS (SELECT slice, value, trait, {STATS.replace('(round(', '((').replace(', 6)', ')')} FROM ranked GROUP BY ALL)"""
FULL_SQL = f"""WITH {_TALL}, both_ AS (SELECT * FROM own UNION ALL SELECT slice, value, 'macro', sum(n)::BIGINT, {', '.join(f'avg({v})' for v in M.VALUES)} FROM own WHERE trait <> 'micro' GROUP BY slice, value)
SELECT slice, value, trait, n, {', '.join(f'{r(v)} AS {v}' for v in M.VALUES)} FROM both_"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = essays(spark, sf_dir, endings=True).withColumn("prompt", F.concat("prompt_num", F.lit("?")))
    return M.split_audit(e, ["prompt_num"])


_BLANK = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AUDIT_SQL = rf"""WITH d AS (SELECT doc_id, lang, {ENDED_SQL} AS text FROM documents) SELECT lang AS prompt_num, count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT doc_id) AS documents, count(DISTINCT text) AS essays, count(DISTINCT lang) AS prompts,
 count(*) FILTER (regexp_matches(text, '\A{_BLANK}')) AS leading, count(*) FILTER (regexp_matches(text, '{_BLANK}\z')) AS trailing, count(*) FILTER (contains(text, chr(10))) AS lf, count(*) FILTER (contains(text, chr(9))) AS tab,
 count(*) FILTER (contains(text, chr(13))) AS cr, count(*) FILTER (contains(text, '  ')) AS double_space FROM d GROUP BY lang"""


def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.summary(essays(spark, sf_dir).withColumn("chars", F.length("essay")), ["prompt_num"], "chars"))


SUMMARY_SQL = f"SELECT lang AS prompt_num, count(c) AS n, {r('avg(c)')} AS mean, {r('stddev_samp(c)')} AS sd, min(c) AS low, max(c) AS high, count(DISTINCT c) AS distinct, {', '.join(r(f'quantile_cont(c, {q / 100})') + f' AS q{q}' for q in (25, 50, 75))} FROM (SELECT lang, length(text) AS c FROM documents) GROUP BY lang"


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.summary(read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q")), ["l_returnflag"], "q"), 4)


PRICE_SQL = f"SELECT l_returnflag, count(q) AS n, {r('avg(q)', 4)} AS mean, {r('stddev_samp(q)', 4)} AS sd, min(q) AS low, max(q) AS high, count(DISTINCT q) AS distinct, {', '.join(r(f'quantile_cont(q, {k / 100})', 4) + f' AS q{k}' for k in (25, 50, 75))} FROM (SELECT l_returnflag, l_quantity::DOUBLE AS q FROM lineitem) GROUP BY l_returnflag"


def leak_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by doc_id in which three ids share a document, and some validation ids stand in the train part too."""
    e = essays(spark, sf_dir).withColumn("document_id", F.floor(F.col("doc_id") / 3))
    return M.leakage(e.where("doc_id % 5 <> 0 or doc_id % 35 = 0"), e.where("doc_id % 5 = 0"), ["id", "document_id", "essay"])


LEAK_SQL = """WITH t AS (SELECT * FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 35 = 0), v AS (SELECT * FROM documents WHERE doc_id % 5 = 0)
SELECT 'id' AS key, count(*) AS shared FROM v WHERE doc_id IN (SELECT doc_id FROM t) UNION ALL SELECT 'document_id', count(*) FROM v WHERE doc_id // 3 IN (SELECT doc_id // 3 FROM t) UNION ALL SELECT 'essay', count(*) FROM v WHERE text IN (SELECT text FROM t)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold against a run that covers the labelled documents; toxic ones failed to parse."""
    e = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    g = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("parse_ok"))
    return rounded(M.coverage(e, g))


COVERAGE_SQL = f"""SELECT count(*) AS expected, count(ok) AS generated, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS missing,
 {r('(count(*) FILTER (ok))::DOUBLE / count(ok)')} AS parse_rate FROM documents LEFT JOIN (SELECT doc_id, toxic = 0 AS ok FROM labels) USING (doc_id)"""


def text_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, by hash; equal in language and source or not."""
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256"), "lang", "source")
    return M.collisions(d, "text_sha256")


COLLISION_SQL = "SELECT sha256(text) AS text_sha256, count(*) AS n, CASE WHEN count(DISTINCT (lang, source)) = 1 THEN 'duplicate' ELSE 'conflicting' END AS kind FROM documents GROUP BY text HAVING count(*) > 1"


def resume_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return M.keep_last(e, "user_id", "event_id")


RESUME_SQL = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label row has done yet."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


PENDING_SQL = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each prompt and fold, folds as columns."""
    d = sources_long(spark, sf_dir).where("trait = 'content'")
    return d.groupBy("prompt_num").pivot("fold", [0, 1, 2, 3, 4]).count().select("prompt_num", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"fold_{k}") for k in range(5)])


GROUP_SQL = f"SELECT lang AS prompt_num, {', '.join(f'count(*) FILTER (doc_id * 7 % 5 = {k}) AS fold_{k}' for k in range(5))} FROM documents GROUP BY lang"


def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of parsed rows alone, without the guard for constant vectors."""
    g = read(spark, sf_dir, "labels").where("toxic = 0").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"))
    s = scored(spark, sf_dir).join(g, "id", "left_semi")
    return rounded(M.regression_metrics(M.cells(s, ["trait"]), ["trait"], guarded=False).select("trait", "n", "rmse", "pearson", "spearman"))


ZERO_SQL = f"""WITH {SCORES}, tall AS (SELECT 'z' AS slice, 'z' AS value, trait, gold AS g, alpha AS p FROM scores WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)), {RANKED}
SELECT trait, count(*) AS n, {r('sqrt(avg((p-g)*(p-g)))')} AS rmse, {r('corr(g,p)')} AS pearson, {r('corr(rg,rp)')} AS spearman FROM ranked GROUP BY trait"""


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Predictions of three sources with planted defects: rows that lack, come twice or are new, other prompts, hashes and folds."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_sha256"), (F.col("doc_id") % 5).alias("fold"))
    alpha = d.select("doc_id", "id", F.col("lang").alias("prompt_num"), "input_sha256", "fold")
    beta = alpha.where("doc_id % 11 <> 3").unionByName(alpha.where("doc_id % 19 = 1"))
    gamma = alpha.withColumns({"id": F.when(F.col("doc_id") % 17 == 2, F.concat(F.lit("X"), "id")).otherwise(F.col("id")), "prompt_num": F.when(F.col("doc_id") % 13 == 4, "zz").otherwise(F.col("prompt_num")), "input_sha256": F.when(F.col("doc_id") % 23 == 5, F.lit(None)).otherwise(F.col("input_sha256")), "fold": F.when(F.col("doc_id") % 29 == 6, 9).otherwise(F.col("fold"))})
    return {"alpha": alpha, "beta": beta, "gamma": gamma}


def source_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planted sources differ in, against the first: rows and the first five ids of each kind."""
    got = AL.differences(_sources(spark, sf_dir), "id", ["prompt_num", "input_sha256", "fold"])
    return got.select("source", "kind", "n", F.array_join("ids", ",").alias("ids"))


DIFFERENCES_SQL = """WITH a AS (SELECT doc_id, 'D' || doc_id AS id FROM documents), x AS (
SELECT 'beta' AS source, 'missing' AS kind, id FROM a WHERE doc_id % 11 = 3 AND doc_id % 19 <> 1 UNION ALL SELECT 'beta', 'repeated', id FROM a WHERE doc_id % 11 <> 3 AND doc_id % 19 = 1
UNION ALL SELECT 'gamma', 'missing', id FROM a WHERE doc_id % 17 = 2 UNION ALL SELECT 'gamma', 'extra', 'X' || id FROM a WHERE doc_id % 17 = 2 UNION ALL SELECT 'gamma', 'prompt_num', id FROM a WHERE doc_id % 13 = 4 AND doc_id % 17 <> 2
UNION ALL SELECT 'gamma', 'input_sha256', id FROM a WHERE doc_id % 23 = 5 AND doc_id % 17 <> 2 UNION ALL SELECT 'gamma', 'fold', id FROM a WHERE doc_id % 29 = 6 AND doc_id % 17 <> 2)
SELECT source, kind, count(*) AS n, array_to_string(list(id ORDER BY id)[1:5], ',') AS ids FROM x GROUP BY ALL"""


def aligned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content scores of three sources in one row an id: same ids, prompts and folds are checked by digests."""
    d = sources_long(spark, sf_dir).where("trait = 'content'")
    got = AL.align({s: d.select("id", "prompt_num", "fold", F.col(s).alias("pred")) for s in ("alpha", "beta", "gamma")}, "id", ["pred"], equal=["prompt_num", "fold"])
    return rounded(got)


ALIGNED_SQL = f"WITH {SCORES} SELECT 'D' || doc_id AS id, prompt_num, (doc_id * 7 % 5)::INT AS fold, {r('alpha')} AS pred_alpha, {r('beta')} AS pred_beta, {r('gamma')} AS pred_gamma FROM scores WHERE trait = 'content'"


QUERIES = {
    "source_differences": (source_differences, DIFFERENCES_SQL),
    "aligned_sources": (aligned_sources, ALIGNED_SQL),
    "metrics_by_prompt": (prompt_report, PROMPT_SQL),
    "evaluation_report": (full_report, FULL_SQL),
    "split_audit": (audit, AUDIT_SQL),
    "length_summary": (length_summary, SUMMARY_SQL),
    "descriptive_summary": (price_summary, PRICE_SQL),
    "leakage_probe": (leak_probe, LEAK_SQL),
    "coverage": (coverage, COVERAGE_SQL),
    "text_collisions": (text_collisions, COLLISION_SQL),
    "keep_last": (resume_last, RESUME_SQL),
    "pending_ids": (pending, PENDING_SQL),
    "fold_pivot": (group_counts, GROUP_SQL),
    "zero_shot_metrics": (zero_shot, ZERO_SQL),
    "value_counts": (value_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
}
