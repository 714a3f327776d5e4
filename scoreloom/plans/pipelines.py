"""Whole flows and the remaining operators: combination, registry, silver rows, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import TRAITS
from ..operators import combined as CB
from ..operators import comparison as CO
from ..operators import rationale as R
from ..operators import training as TR
from ..sources import control as CT
from .essays import SCORES, essays, gold_score, r, read, rounded, sources_long
from .texts import planted_rationales


def combined_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions between a split by doc_id and its rest."""
    e = essays(spark, sf_dir).select("doc_id", "id", "document_id", "prompt_num", "essay")
    rows = CB.combine(e.where("doc_id % 5 <> 0"), e.where("doc_id % 5 = 0"), acknowledged=True)
    return CB.collisions(rows).groupBy("field", "kind").agg(F.count("*").alias("n"))


COLLISION_SQL = "SELECT 'essay' AS field, 'duplicate' AS kind, count(*) AS n FROM (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 5 = 0) > 1) HAVING count(*) > 0"


def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CT.advance(CT.task_grid(spark, 5, [42, 43, 44]), spark.createDataFrame([(42, 0, "running"), (43, 1, "running")], "seed int, fold int, to string"))


GRID_SQL = "SELECT s::INT AS seed, f::INT AS fold, CASE WHEN (s = 42 AND f = 0) OR (s = 43 AND f = 1) THEN 'running' ELSE 'pending' END AS status FROM (VALUES (42), (43), (44)) a(s), range(5) b(f)"


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rationales, some of them planted as not grounded, against the promotion floors."""
    own = planted_rationales(R.ledger(essays(spark, sf_dir, heavy=True, endings=True)))
    g = own.select(R.grounding(F.col("x"), F.col("essay"), F.col("ledger")).alias("g")).select(F.col("g.accepted").alias("accepted"))
    return rounded(TR.promotable(g))


_GOOD = "count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 1)"
SILVER_SQL = f"SELECT count(*) AS generated, {_GOOD} AS accepted, {r(f'{_GOOD}::DOUBLE / count(*)')} AS rate, {_GOOD} >= 500 AND {_GOOD}::DOUBLE / count(*) >= 0.5 AS promote FROM documents"


def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), *[gold_score(t).alias(t) for t in TRAITS])
    return rounded(TR.jittered(d, copies=2, width=0.08, seed=42, digest="sha256").select("doc_id", "copy", *TRAITS))


def _jit(t: str) -> str:
    return r(f"least(greatest(max(gold) FILTER (trait = '{t}') + (('0x' || substr(sha256('42|' || doc_id || '|' || copy || '|{t}'), 1, 7))::BIGINT / 268435456.0::DOUBLE * 2 - 1) * 0.08::DOUBLE, 1.0), 5.0)")


JITTER_SQL = f"WITH {SCORES} SELECT doc_id, copy::INT AS copy, {', '.join(f'{_jit(t)} AS {t}' for t in TRAITS)} FROM scores, range(1, 3) c(copy) GROUP BY doc_id, copy"


def pair_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embedding rows of one label whose content scores differ by more than 3."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", (1 + F.col("vec_id") * 37 % 41 * F.lit(0.1)).alias("c"))
    p = CO.cell_pairs(v, prompt="label", scores=["c"]).where("abs(l.c - r.c) > 3.0")
    loss = CO.pairwise_loss(F.col("l.c") * 0.9, F.col("r.c") * 0.9, F.col("l.c"), F.col("r.c"))
    return rounded(p.groupBy("label").agg(F.sum("n").alias("n"), (F.sum(loss * F.col("n")) / F.sum("n")).alias("loss")))


PAIR_SQL = f"""WITH v AS (SELECT vec_id, label, 1 + vec_id * 37 % 41 * 0.1::DOUBLE AS c FROM embeddings), p AS (SELECT a.label, (a.c - b.c) AS dg, 0.9::DOUBLE * a.c - 0.9::DOUBLE * b.c AS dp FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.c - b.c) > 3)
SELECT label, count(*) AS n, {r('avg(0.5 * ln(1 + exp(-sign(dg) * dp)) + 0.5 * CASE WHEN abs(dp - dg) < 0.1 THEN (dp - dg) * (dp - dg) * 0.5 / 0.1 ELSE abs(dp - dg) - 0.05 END)')} AS loss FROM p GROUP BY label"""


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion gate over a table of deltas and probabilities, one row a document."""
    d = read(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 7 % 11 - 5) * F.lit(0.01)).alias("rmse_delta"), ((F.col("doc_id") * 5 % 11 - 5) * F.lit(0.01)).alias("spearman_delta"), (F.col("doc_id") * 3 % 11 / 10).alias("p_rmse"), (F.col("doc_id") * 2 % 11 / 10).alias("p_spearman"))
    return CO.precision_gate(d).groupBy("no_harm", "better", "promote").agg(F.count("*").alias("n"))


GATE_SQL = """WITH d AS (SELECT (doc_id * 7 % 11 - 5) * 0.01::DOUBLE AS a, (doc_id * 5 % 11 - 5) * 0.01::DOUBLE AS b, (doc_id * 3 % 11)::DOUBLE / 10 AS p, (doc_id * 2 % 11)::DOUBLE / 10 AS q FROM documents),
g AS (SELECT a <= 0 AND b >= 0 AS no_harm, (a <= 0 AND p >= 0.9) OR (b >= 0 AND q >= 0.9) AS better FROM d) SELECT no_harm, better, no_harm AND better AS promote, count(*) AS n FROM g GROUP BY ALL"""


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected scores of made-up logits, blended with bounded regression."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    logits = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.pmod(F.col("doc_id") * 3 + i * 5, F.lit(7)).cast("double"))
    return rounded(d.select("doc_id", TR.expected_score(logits, "organization").alias("expected"), TR.blended_score((F.col("doc_id") % 5 - 2).cast("double"), logits, "organization", 0.5).alias("blended")))


EXPECT_SQL = f"""WITH l AS (SELECT doc_id, list_transform(range(17), lambda i: exp(((doc_id * 3 + i * 5) % 7)::DOUBLE)) AS e FROM documents),
x AS (SELECT doc_id, list_sum(list_transform(range(17), lambda i: e[i + 1] * (1 + i * 0.25::DOUBLE))) / list_sum(e) AS v FROM l)
SELECT doc_id, {r('v')} AS expected, {r('0.5 * (1 + 4 / (1 + exp(-((doc_id % 5) - 2)::DOUBLE))) + 0.5 * v')} AS blended FROM x"""


def quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by fold: share of good and of toxic rows."""
    s = sources_long(spark, sf_dir).where("trait = 'content'").join(read(spark, sf_dir, "labels"), "doc_id")
    return rounded(s.groupBy("fold").agg(F.count("*").alias("n"), F.avg("quality").alias("good"), F.avg("toxic").alias("toxic")))


LABEL_SQL = f"SELECT (doc_id * 7 % 5)::INT AS fold, count(*) AS n, {r('avg(quality)')} AS good, {r('avg(toxic)')} AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1"

QUERIES = {
    "combined_collisions": (combined_collisions, COLLISION_SQL),
    "task_grid": (task_grid, GRID_SQL),
    "silver_promotion": (silver, SILVER_SQL),
    "score_jitter": (jitter, JITTER_SQL),
    "pair_mining": (pair_mining, PAIR_SQL),
    "precision_gate": (gate, GATE_SQL),
    "expected_scores": (expectations, EXPECT_SQL),
    "label_rates": (quality_join, LABEL_SQL),
}
