"""Strict records, bootstrap, gates, judgements, losses, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.numbers import TRAITS, grid
from ..operators import comparison as CO
from ..operators import terms as TE
from ..sources import strict as S
from .essays import SCORES, essays, gold_score, r, read, rounded, source_score, sources_long

DEFECTS = ("none", "duplicate_key", "constant", "score", "keys", "text", "syntax", "blank")


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical prediction line per document, one of eight kinds of defect in each."""
    d = read(spark, sf_dir, "documents").select("doc_id", *[F.format_string("%.2f", source_score(t, "alpha")).alias(t) for t in TRAITS])
    kind = F.col("doc_id") % 8
    body = F.concat(F.lit('{"content":'), F.when(kind == 2, "NaN").when(kind == 3, "true").otherwise(F.col("content")), F.lit(',"organization":'), F.col("organization"), F.lit(',"expression":'), F.col("expression"), F.when(kind == 1, ',"content":3').otherwise(""), F.when(kind == 4, ',"extra":1').otherwise(""), F.lit("}"))
    line = F.concat(F.lit('{"id":"D'), F.col("doc_id").cast("string"), F.lit('","prompt_num":"'), F.when(kind == 5, " ").otherwise("Q1"), F.lit('","prediction":'), body, F.lit(',"model":"m"'), F.when(kind == 6, "").otherwise("}"))
    return d.select("doc_id", F.when(kind == 7, "  ").otherwise(line).alias("value"))


def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.parse_lines(broken_lines(spark, sf_dir), "canonical")
    return p.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"), F.count("id").alias("with_id"))


STRICT_SQL = "SELECT CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(DEFECTS)) + " END AS error, count(*) AS n, count(*) FILTER (doc_id % 8 = 0) AS with_id FROM documents GROUP BY 1"


def relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four legacy forms of one prediction give the same row."""
    d = read(spark, sf_dir, "documents").select("doc_id", *[F.floor(gold_score(t)).cast("double").alias(t) for t in TRAITS])
    flat = F.struct(*TRAITS)
    nested = F.struct(*[F.struct(F.col(t).alias("score"), F.lit("x").alias("rationale")).alias(t) for t in TRAITS])
    key, kind = F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id") % 4
    line = F.when(kind == 0, F.to_json(F.struct(key, flat.alias("prediction"), F.lit("m0").alias("model")))).when(kind == 1, F.to_json(F.struct(key, nested.alias("parsed"), F.lit("m1").alias("model_id")))).when(kind == 2, F.to_json(F.struct(key, flat.alias("scores"), F.lit("m2").alias("run_tag")))).otherwise(F.to_json(F.struct(key, *TRAITS)))
    return rounded(S.relaxed_predictions(d.select(line.alias("value"))).drop("prompt_num"))


RELAXED_SQL = f"WITH {SCORES} SELECT 'D' || doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' ELSE 'unknown' END AS model, {', '.join(f'max(floor(gold)) FILTER (trait = {chr(39)}{t}{chr(39)}) AS {t}' for t in TRAITS)} FROM scores GROUP BY doc_id"


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs with the known defects: strictly right, right after repair, or neither."""
    kind = F.col("doc_id") % 5
    one = F.lit('{"score":3.5,"rationale":"because"}')
    last = F.when(kind == 1, '{"score":3.5,"rationale":"because")').otherwise(one)
    body = F.concat(F.lit('{"content":'), one, F.lit(',"organization":'), one, F.lit(',"expression":'), last, F.when(kind == 2, ",}").otherwise("}"))
    raw = F.when(kind == 3, F.concat(F.lit("Answer: "), body, F.lit(" done"))).when(kind == 4, '{"content":3}').otherwise(body)
    d = read(spark, sf_dir, "documents").select("doc_id", raw.alias("value"))
    strict = S.parse_lines(d, "submission").select("doc_id", F.col("error").isNull().alias("strict"))
    fixed = S.parse_lines(d.select("doc_id", S.repaired(F.col("value")).alias("value")), "submission").select("doc_id", F.col("error").isNull().alias("repaired"))
    return strict.join(fixed, "doc_id").groupBy("strict", "repaired").agg(F.count("*").alias("n"))


REPAIR_SQL = "SELECT doc_id % 5 = 0 AS strict, doc_id % 5 <> 4 AS repaired, count(*) AS n FROM documents GROUP BY ALL"


def embedding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, some of them planted as not finite, short, zero or repeated."""
    e, k = F.col("embedding"), F.col("vec_id") % 50
    d = read(spark, sf_dir, "embeddings")
    planted = F.when(k == 0, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(e, 2, 63))).when(k == 1, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("inf")).cast("float")))).when(k == 2, F.slice(e, 1, 63)).when(k == 3, F.transform(e, lambda x: x * 0)).otherwise(e)
    return S.check_vectors(d.select(F.when(k == 4, F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("vec_id"), planted.alias("embedding")), "embedding", 64)


EMBEDDING_SQL = """WITH v AS (SELECT CASE WHEN vec_id % 50 = 4 THEN vec_id - 1 ELSE vec_id END AS id, CASE vec_id % 50 WHEN 0 THEN ['nan'::FLOAT] || embedding[2:] WHEN 1 THEN embedding[:63] || ['inf'::FLOAT] WHEN 2 THEN embedding[:63] WHEN 3 THEN list_transform(embedding, lambda x: x * 0) ELSE embedding END AS e FROM embeddings)
SELECT count(*) AS rows, count(*) FILTER (len(e) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(e, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (list_sum(list_transform(e, lambda x: x * x)) = 0) AS zero_norm, count(*) - count(DISTINCT id) AS repeated FROM v"""


def serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and read back strictly: equal scores."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("prompt_num"), F.lit("m").alias("model"), *[source_score(t, "alpha").alias(t) for t in TRAITS])
    lines = d.select(S.prediction_json(["id", "prompt_num", "model"]).alias("value"))
    return rounded(S.parse_lines(lines, "canonical").where("error is null").select("id", "prompt_num", "model", *TRAITS))


SERIAL_SQL = f"WITH {SCORES} SELECT 'D' || doc_id AS id, prompt_num, 'm' AS model, {', '.join(f'{r(f"max(alpha) FILTER (trait = {chr(39)}{t}{chr(39)})")} AS {t}' for t in TRAITS)} FROM scores GROUP BY doc_id, prompt_num"

RESAMPLES = 2000


def bootstrap(other: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Source alpha against another in all traits and metrics over 2000 paired stratified resamples."""
        return rounded(CO.bootstrap_report(sources_long(spark, sf_dir), "doc_id", "alpha", other, resamples=RESAMPLES))

    return query


def _corr(x: str, y: str) -> str:
    return f"(sum(n*{x}*{y}) - sum(n*{x})*sum(n*{y})/sum(n)) / sqrt((sum(n*{x}*{x}) - sum(n*{x})*sum(n*{x})/sum(n)) * (sum(n*{y}*{y}) - sum(n*{y})*sum(n*{y})/sum(n)))"


_KEY = "PARTITION BY i, side, trait"
BOOT_SQL = f"""WITH {SCORES}, d AS (SELECT prompt_num AS s, trait, gold, alpha, beta, doc_id FROM scores), o AS (SELECT s, doc_id, list([gold, alpha, beta] ORDER BY trait) AS sig FROM d GROUP BY ALL),
o2 AS (SELECT doc_id, row_number() OVER (PARTITION BY s ORDER BY sig, doc_id) AS k FROM o), dk AS (SELECT d.*, k FROM d JOIN o2 USING (doc_id)),
n AS (SELECT lang AS s, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT i, s, n, unnest(range(0, n)) AS j FROM range({RESAMPLES}) t(i), n), h AS (SELECT i, s, k, count(*) AS t FROM (SELECT i, s, ('0x' || substr(sha256('42|' || i || '|' || s || '|' || (j // 8)), 1 + 8 * (j % 8), 8))::BIGINT % n + 1 AS k FROM w) GROUP BY ALL),
u AS (SELECT -1 AS i, trait, gold, alpha, beta, 1 AS t FROM dk UNION ALL SELECT i, trait, gold, alpha, beta, t FROM h JOIN dk USING (s, k)),
c AS (SELECT i, side, trait, gold AS g, p, sum(t)::DOUBLE AS n FROM (SELECT *, 'a' AS side, alpha AS p FROM u UNION ALL SELECT *, 'b', beta FROM u) GROUP BY ALL),
k AS (SELECT *, sum(n) OVER ({_KEY} ORDER BY g) - sum(n) OVER ({_KEY}, g) / 2 + 0.5 AS rg, sum(n) OVER ({_KEY} ORDER BY p) - sum(n) OVER ({_KEY}, p) / 2 + 0.5 AS rp FROM c),
m AS (SELECT i, side, trait, sqrt(sum(n * (p - g) * (p - g)) / sum(n)) AS rmse, CASE WHEN sum(n) < 2 OR min(g) = max(g) OR min(p) = max(p) THEN 0 ELSE {_corr('rg', 'rp')} END AS spearman FROM k GROUP BY ALL),
x AS (SELECT i, trait, sum(CASE WHEN side = 'a' THEN rmse ELSE -rmse END) AS rmse, sum(CASE WHEN side = 'a' THEN spearman ELSE -spearman END) AS spearman FROM m GROUP BY ALL),
y AS (SELECT * FROM x UNION ALL SELECT i, 'macro', avg(rmse), avg(spearman) FROM x GROUP BY i),
z AS (SELECT i, 'rmse_' || trait AS metric, round(rmse, 12) AS delta FROM y UNION ALL SELECT i, 'spearman_' || trait, round(spearman, 12) FROM y)
SELECT metric, {r('max(delta) FILTER (i < 0)')} AS point, {r('avg(delta) FILTER (i >= 0)')} AS mean, {r('stddev_samp(delta) FILTER (i >= 0)')} AS sd, {r('quantile_cont(delta, 0.025) FILTER (i >= 0)')} AS low, {r('quantile_cont(delta, 0.975) FILTER (i >= 0)')} AS high,
 {r("avg(CASE WHEN delta = 0 THEN 0.5 WHEN (delta > 0) = starts_with(metric, 'spearman') THEN 1.0 ELSE 0 END) FILTER (i >= 0)")} AS p_better FROM z GROUP BY metric"""


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two presentation orders per review, reconciled and tallied against the hidden key."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("review_id"))
    coin = F.when(H.even_digit(F.sha2("review_id", 256)), "A").otherwise("B")
    each = d.select("doc_id", "review_id", F.posexplode(F.array(*[F.lit(c) for c in CO.CRITERIA])).alias("q", "criterion"))
    def choice(m: int) -> F.Column:
        return F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), ((F.col("doc_id") * m + F.col("q")) % 3 + 1).cast("int"))
    both = CO.reconciled(choice(5), CO.unswapped(choice(7), F.lit(True)))
    return rounded(CO.tally(each.select("review_id", "criterion", both.alias("x")).select("review_id", "criterion", "x.*"), d.select("review_id", coin.alias("candidate"))))


JUDGE_SQL = f"""WITH d AS (SELECT doc_id, 'R' || doc_id AS review_id, CASE WHEN contains('02468ace', right(sha256('R' || doc_id), 1)) THEN 'A' ELSE 'B' END AS cand FROM documents),
c AS (SELECT d.*, q, [{', '.join(f"'{c}'" for c in CO.CRITERIA)}][q + 1] AS criterion, ['A','B','TIE'][(doc_id * 5 + q) % 3 + 1] AS f, ['B','A','TIE'][(doc_id * 7 + q) % 3 + 1] AS b FROM d, range(5) t(q)),
x AS (SELECT *, CASE WHEN f = b THEN f ELSE 'TIE' END AS dec, f <> b AS unstable FROM c), g AS (SELECT criterion, count(*) AS n, count(*) FILTER (dec = cand) AS wins, count(*) FILTER (dec <> cand AND dec <> 'TIE') AS losses, count(*) FILTER (dec = 'TIE') AS ties, count(*) FILTER (unstable) AS unstable FROM x GROUP BY criterion)
SELECT *, {r('wins::DOUBLE / n')} AS win_rate, {r('CASE WHEN wins + losses = 0 THEN NULL ELSE wins::DOUBLE / (wins + losses) END')} AS decisive_win_rate, {r('unstable::DOUBLE / n')} AS unstable_rate FROM g"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("review_id"))
    return d.select("review_id", H.attempt_seed(2026, F.col("review_id"), F.lit(1)).alias("seed"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean ranks of made-up epochs: event types as runs, hours as epochs."""
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.hour("ts").alias("epoch")).agg(F.round(F.avg("value"), 3).alias("macro_rmse"), F.count("*").cast("double").alias("macro_spearman"))
    return rounded(CO.epoch_policy(e))


EPOCH_SQL = f"""WITH e AS (SELECT event_type AS run, hour(ts)::INT AS epoch, round(avg(value), 3) AS a, count(*) AS b FROM events GROUP BY ALL),
k AS (SELECT epoch, 0.5 * (rank() OVER (PARTITION BY run ORDER BY a) + (count(*) OVER (PARTITION BY run, a) - 1) / 2.0) + 0.5 * (rank() OVER (PARTITION BY run ORDER BY b DESC) + (count(*) OVER (PARTITION BY run, b) - 1) / 2.0) AS k FROM e),
m AS (SELECT epoch, avg(k) AS m FROM k GROUP BY epoch) SELECT epoch, {r('m')} AS mean_rank, row_number() OVER (ORDER BY round(m, 9), epoch) = 1 AS chosen FROM m"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared and ordinal losses by trait; logits fall with the distance from the prediction."""
    out = None
    for t in TRAITS:
        d = read(spark, sf_dir, "documents").select(gold_score(t).alias("gold"), source_score(t, "alpha").alias("pred"))
        logits = F.transform(grid(t), lambda g: -F.abs(g - F.col("pred")) * 4)
        row = d.agg(F.lit(t).alias("trait"), F.avg((F.col("pred") - F.col("gold")) ** 2).alias("mse"), F.avg(CO.ordinal_loss(logits, F.col("gold"), t)).alias("ordinal"))
        out = row if out is None else out.unionAll(row)
    return rounded(out)


def _loss_sql(t: str, levels: str, sigma: float) -> str:
    return f"""SELECT '{t}' AS trait, {r('avg((alpha-gold)*(alpha-gold))')} AS mse, {r('avg(list_sum(list_transform(list_zip(tg, lp), lambda z: CASE WHEN z[1] > 0 THEN z[1] * (ln(z[1]) - z[2]) ELSE 0 END)))')} AS ordinal FROM (
 SELECT gold, alpha, list_transform(w, lambda x: x / list_sum(w)) AS tg, list_transform(l, lambda x: x - ln(list_sum(list_transform(l, lambda y: exp(y))))) AS lp FROM (
  SELECT gold, alpha, list_transform({levels}, lambda g: exp(-0.5 * ((g - gold) / {sigma}) * ((g - gold) / {sigma}))) AS w, list_transform({levels}, lambda g: -abs(g - alpha) * 4) AS l FROM scores WHERE trait = '{t}'))"""


LOSS_SQL = f"WITH {SCORES} " + " UNION ALL ".join(_loss_sql(t, "list_transform(range(41), lambda i: round(1 + i * 0.1::DOUBLE, 1))" if t == "content" else "list_transform(range(17), lambda i: 1 + i * 0.25::DOUBLE)", CO.SIGMAS[t]) for t in TRAITS)


def soft_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sources_long(spark, sf_dir).where("trait = 'expression'").select("doc_id", "prompt_num", "gold")
    return rounded(CO.percentile_within(d, "prompt_num", "gold", "percentile").select("doc_id", "percentile"))


RANK_SQL = f"WITH {SCORES} SELECT doc_id, {r('(rank() OVER (PARTITION BY prompt_num ORDER BY gold) - 1 + (count(*) OVER (PARTITION BY prompt_num, gold) - 1) / 2.0) / (count(*) OVER (PARTITION BY prompt_num) - 1)')} AS percentile FROM scores WHERE trait = 'expression'"


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = TE.counts(read(spark, sf_dir, "documents"), "doc_id", TE.word_grams(F.col("text"), 1, 1))
    return TE.vocabulary(c, min_df=2)


TERM_SQL = r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2"


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of benchmark items: weights of every term."""
    b = read(spark, sf_dir, "benchmark")
    c = TE.counts(b, "item_id", TE.word_grams(F.col("text"), 1, 2))
    got = TE.tfidf(c, TE.vocabulary(c), F.lit(b.count()), "item_id")
    return rounded(got)


TFIDF_SQL = rf"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM benchmark), t AS (SELECT item_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
c AS (SELECT item_id, term, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), x AS (SELECT item_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS w FROM c JOIN d USING (term))
SELECT item_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY item_id))')} AS weight FROM x"""


def document_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of whole documents: weights of every term."""
    return rounded(TE.document_weights(read(spark, sf_dir, "documents"), "doc_id"))


DOCUMENT_TFIDF_SQL = TFIDF_SQL.replace("benchmark", "documents").replace("item_id", "doc_id")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of messages: counts and a digest of each."""
    c = read(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", F.size("m").alias("messages"), F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n"), 256).alias("sha256"))


PROMPT_SQL = "SELECT conv_id, count(*)::INT AS messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id"

QUERIES = {
    "strict_scan": (strict_scan, STRICT_SQL),
    "relaxed_predictions": (relaxed, RELAXED_SQL),
    "repaired_outputs": (repairs, REPAIR_SQL),
    "embedding_check": (embedding_check, EMBEDDING_SQL),
    "prediction_round_trip": (serialized, SERIAL_SQL),
    "paired_bootstrap": (bootstrap("beta"), BOOT_SQL),
    "bootstrap_report": (bootstrap("gamma"), BOOT_SQL.replace("gold, alpha, beta", "gold, alpha, gamma").replace("'b', beta", "'b', gamma")),
    "judge_tally": (judge, JUDGE_SQL),
    "attempt_seeds": (seeds, "SELECT 'R' || doc_id AS review_id, ('0x' || substr(sha256('2026' || chr(0) || 'R' || doc_id || chr(0) || '1'), 1, 8))::BIGINT & 2147483647 AS seed FROM documents"),
    "epoch_policy": (epochs, EPOCH_SQL),
    "trait_losses": (losses, LOSS_SQL),
    "soft_rank_targets": (soft_ranks, RANK_SQL),
    "term_frequencies": (term_table, TERM_SQL),
    "tfidf_weights": (tfidf, TFIDF_SQL),
    "document_tfidf": (document_tfidf, DOCUMENT_TFIDF_SQL),
    "chat_messages": (prompts, PROMPT_SQL),
}
