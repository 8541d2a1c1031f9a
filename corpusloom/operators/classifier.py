"""The classifier stage of the cascade: excludes on its own what it is nearly sure of."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS, EXCLUDE_FROM = 5, 0.90
#: Fixed value: the code of what the classifier excludes.
CODE = "SVM_FAST"
FEATURES = 1 << 14


def text_of() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))


def can_train(labelled: DataFrame) -> bool:
    """Five examples and both classes."""
    r = labelled.agg(F.count("*").alias("n"), F.count_distinct("human_decision").alias("classes")).first()
    return r["n"] >= LEAST_ROWS and r["classes"] == 2


def train(labelled: DataFrame) -> PipelineModel | None:
    """A model of P(YES) from (title, abstract, human_decision), null if there is too little to learn from.

    Words and word pairs are hashed, so no vocabulary is held by the driver.
    """
    rows = labelled.where(F.col("human_decision").isin("YES", "NO"))
    if not can_train(rows):
        return None
    rows = rows.select(text_of().alias("_text"), (F.col("human_decision") == "YES").cast("double").alias("label"))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=FEATURES),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="features"),
        LogisticRegression(regParam=1e-4, maxIter=20),
    ]
    *features, learner = stages
    made = Pipeline(stages=features).fit(rows)
    # each of the learner's passes reads the features, not the texts
    kept = made.transform(rows).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(stages=[*made.stages, learner.fit(kept)])
    finally:
        kept.unpersist()


def score(papers: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``papers`` with p_no, auto_excluded from EXCLUDE_FROM on, and the decision that follows: status, codes and rationale.

    Without a model nothing is excluded and p_no is null.
    """
    if model is None:
        scored = papers.withColumn("p_no", F.lit(None).cast("double"))
    else:
        scored = model.transform(papers.withColumn("_text", text_of())).withColumn("p_no", vector_to_array("probability")[0])
    out = F.coalesce(F.col("p_no") >= EXCLUDE_FROM, F.lit(False))
    return scored.select(
        *papers.columns, "p_no", out.alias("auto_excluded"), F.when(out, "EXCLUDED").alias("auto_status"),
        F.when(out, F.array(F.lit(CODE))).alias("auto_codes"), F.when(out, F.format_string("P(NO) = %.2f", "p_no")).alias("rationale"),
    )
