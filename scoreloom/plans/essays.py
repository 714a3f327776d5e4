"""The test tables seen as scored essays, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: trait: (multiplier, shift, levels, step) of the made-up gold scores.
GOLD = {"content": (37, 0, 41, 0.1), "organization": (7, 0, 17, 0.25), "expression": (11, 3, 17, 0.25)}
#: source: (multiplier, shift) of its made-up error.
SOURCES = {"alpha": (13, 5), "beta": (29, 2), "gamma": (17, 11)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt out for work that is heavy per row; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gold_score(trait: str):
    a, b, m, step = GOLD[trait]
    return 1.0 + ((F.col("doc_id") * a + b) % m) * F.lit(step)


def source_score(trait: str, source: str):
    a, b = SOURCES[source]
    noise = ((F.col("doc_id") * a + b) % 21 - 10) * F.lit(0.08)
    return F.least(F.greatest(gold_score(trait) + noise, F.lit(1.0)), F.lit(5.0))


#: Endings given to the texts in turn, so that Korean markers, Unicode digits and Unicode white space occur.
ENDINGS = (
    "", "\n따라서 나는 찬성한다고 생각한다. 첫째, 값은 １２３ 이고 ٤٥ 이다.", "\n\u3000\n물론 반론도 있다. 그러나 통계에 따르면 사례가 많다!", "\u3000", "\n예를 들어 경험이 있다. 결론적으로 (하나) 2,5 와 3.14.", "\x0b\xa0", "\n\n또한편 둘째 근거로 왜냐하면 필요하다\u2029",
)


def ended(text: str = "text"):
    """The text with its ending."""
    return F.concat(F.col(text), F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("doc_id") % len(ENDINGS) + 1).cast("int")))


ENDED_SQL = f"(text || [{', '.join(chr(39) + x + chr(39) for x in ENDINGS)}][doc_id % {len(ENDINGS)} + 1])"


def essays(spark: SparkSession, sf_dir: str, heavy: bool = False, endings: bool = False) -> DataFrame:
    """ordinal, id, document_id, prompt_num, cohort, essay, and the struct gold."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    d = spread(d) if heavy else d
    d = d.withColumn("text", ended()) if endings else d
    return d.select(
        F.col("doc_id"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("document_id"),
        F.col("lang").alias("prompt_num"), F.col("source").alias("cohort"), F.col("text").alias("essay"), F.struct(*[gold_score(t).alias(t) for t in GOLD]).alias("gold"),
    )


def predictions(spark: SparkSession, sf_dir: str, source: str = "alpha") -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.struct(*[source_score(t, source).alias(t) for t in GOLD]).alias("pred"))


def sources_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, id, prompt_num, fold, trait, gold and a column per source: all from one scan."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), gold_score(t).alias("gold"), *[source_score(t, s).alias(s) for s in SOURCES]) for t in GOLD]))
    return d.select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("prompt_num"), (F.col("doc_id") * 7 % 5).cast("int").alias("fold"), each.alias("x")).select("doc_id", "id", "prompt_num", "fold", "x.*")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, and no negative zero: engines sum in different orders."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ----------------------------------------------------------------------- SQL


def _gold_sql(t: str) -> str:
    a, b, m, step = GOLD[t]
    return f"(1.0::DOUBLE + ((doc_id * {a} + {b}) % {m}) * {step}::DOUBLE)"


def _source_sql(t: str, s: str) -> str:
    a, b = SOURCES[s]
    return f"least(greatest({_gold_sql(t)} + ((doc_id * {a} + {b}) % 21 - 10) * 0.08::DOUBLE, 1.0), 5.0)"


_UNION = " UNION ALL ".join(f"SELECT doc_id, lang AS prompt_num, doc_id * 7 % 5 AS fold, '{t}' AS trait, {_gold_sql(t)} AS gold, {', '.join(f'{_source_sql(t, s)} AS {s}' for s in SOURCES)} FROM documents" for t in GOLD)
#: CTE scores(doc_id, prompt_num, fold, trait, gold, alpha, beta, gamma)
SCORES = f"scores AS ({_UNION})"
#: CTE essays(doc_id, id, prompt_num, cohort, essay, content, organization, expression)
ESSAYS = f"essays AS (SELECT doc_id, 'D' || doc_id AS id, lang AS prompt_num, source AS cohort, text AS essay, {', '.join(f'{_gold_sql(t)} AS {t}' for t in GOLD)} FROM documents)"


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"
