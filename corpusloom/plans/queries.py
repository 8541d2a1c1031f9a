"""Queries of the screening engine over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ENTITIES, HIDDEN_PATTERN, TAG_PATTERN, alnum_key, html_text, normalize_title
from corpusloom.operators import review as R
from corpusloom.operators import screening as S
from corpusloom.sources.papers import decisions, papers, sheet_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ORDER = ["EC1", "EC3", "EC4"]
#: Words that stand for the rule's own in tables that hold none of them.
WORDS = ["the", "de"]

_P = """papers AS (
  SELECT doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) < 14 THEN 'WL' ELSE 'GL' END AS source_type,
    CAST(2005 + n_chars % 20 AS INTEGER) AS publication_year,
    CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS language, source AS library
  FROM documents
)"""
_D = """dec AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id,
    CASE WHEN quality = 0 THEN 'EXCLUDED' WHEN toxic = 0 THEN 'INCLUDED' ELSE 'NEEDS_REVIEW' END AS status,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'IC1' WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'EC3' ELSE 'QC_FAIL' END AS code,
    CASE WHEN (quality + toxic) % 2 = 1 THEN 'YES' ELSE 'NO' END AS human_decision
  FROM labels
)"""
_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(title), '^\s+|\s+$', '', 'g'), '[^\pL\pN_\s]', '', 'g'), '\s+', ' ', 'g')"
_DUP = f"""marked AS (
  SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ordinal) > 1 AS is_duplicate FROM papers
)"""
_CODE = """coded AS (
  SELECT *, CASE WHEN is_duplicate THEN 'EC6' WHEN trim(language) <> '' AND lower(trim(language)) <> 'english' THEN 'EC1'
    WHEN publication_year > 0 AND publication_year < 2015 THEN 'EC4' END AS code FROM marked
)"""


def query(sql: str | None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _filter(name: str, condition, where: str) -> None:  # noqa: ANN001
    """A predicate over papers, as a query of ids."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        return papers(spark, d).where(condition()).select("id")

    f.__name__ = name
    query(f"WITH {_P} SELECT id FROM papers WHERE {where}")(f)


_has = lambda c, s: F.lower(F.col(c)).contains(s)
_filter("search_any", lambda: _has("title", "tion") | _has("abstract", "tion"), "contains(lower(title), 'tion') OR contains(lower(abstract), 'tion')")
_filter("title_contains", lambda: _has("title", "the"), "contains(lower(title), 'the')")
_filter("abstract_contains", lambda: _has("abstract", "entre"), "contains(lower(abstract), 'entre')")
_filter("year_range", lambda: F.col("publication_year").between(2010, 2015), "publication_year BETWEEN 2010 AND 2015")
_filter("source_filter", lambda: F.col("source_type") == "GL", "source_type = 'GL'")
_filter("rule_ec1", S.rule_ec1, "trim(language) <> '' AND lower(trim(language)) <> 'english'")
_filter("rule_ec3", lambda: S.rule_ec3(WORDS), r"regexp_matches(title, '(?i)(^|[^\pL\pN_\p{Mn}])(the|de)($|[^\pL\pN_\p{Mn}])') OR regexp_matches(language, '(?i)^(the|de)$')")
_filter("rule_ec4", S.rule_ec4, "publication_year > 0 AND publication_year < 2015")


@query(f"WITH {_P} SELECT ordinal, id, title, length(abstract) AS abstract_chars, source_type, publication_year, language, library FROM papers")
def papers_view(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    return papers(spark, d).select("ordinal", "id", "title", F.length("abstract").cast("long").alias("abstract_chars"), "source_type", "publication_year", m["Language"].alias("language"), m["Library"].alias("library"))


#: Sheet names that stand for a workbook's, made of each document's source; the same SQL in both engines.
_SHEET = "CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'White ' || source WHEN 1 THEN 'GL web' WHEN 2 THEN 'grey WL ' || source WHEN 3 THEN upper(lang) || ' grey' ELSE 'notes ' || lang END"


@query(f"""WITH s AS (SELECT {_SHEET} AS name FROM documents) SELECT name, CASE WHEN regexp_matches(name, '(?i)(white|wl)') THEN 'WL' ELSE 'GL' END AS source_type, count(*) AS n
FROM s WHERE regexp_matches(name, '(?i)(white|wl|grey|gl)') GROUP BY ALL""")
def sheet_routing(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/documents.parquet").select(F.expr(_SHEET).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", sheet_type(F.col("name")).alias("source_type"), "n").where("source_type is not null")


@query(f"WITH {_P} SELECT id, {_KEY} AS norm FROM papers")
def norm_title(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("id", normalize_title(F.col("title")).alias("norm"))


@query(rf"WITH {_P} SELECT id, regexp_replace(lower(title), '[^\pL\pN]', '', 'g') AS key FROM papers")
def title_key(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("id", alnum_key(F.col("title")).alias("key"))


@query(rf"WITH {_P} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY regexp_replace(lower(title), '[^\pL\pN]', '', 'g') ORDER BY ordinal) AS n FROM papers) WHERE n = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    keyed = papers(spark, d).select("id", "ordinal", alnum_key(F.col("title")).alias("key"))
    return keyed.groupBy("key").agg(F.min_by("id", "ordinal").alias("id")).select("id")


@query(f"WITH {_P}, {_DUP} SELECT id, is_duplicate FROM marked")
def dedup_ec6(spark: SparkSession, d: str) -> DataFrame:
    return S.mark_duplicates(papers(spark, d)).select("id", "is_duplicate")


@query(f"""WITH {_P}, {_D}, m AS (
  SELECT id, status, coalesce(sum(CASE WHEN status IS NULL OR status <> 'NEEDS_REVIEW' THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEY} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM papers LEFT JOIN dec ON id = paper_id)
SELECT id, status IS NULL AND seen > 0 AS is_duplicate FROM m""")
def dedup_resumed(spark: SparkSession, d: str) -> DataFrame:
    return S.mark_duplicates(papers(spark, d), decisions(spark, d)).select("id", "is_duplicate")


@query(f"WITH {_P}, {_DUP}, {_CODE} SELECT id, code FROM coded")
def heuristic_cascade(spark: SparkSession, d: str) -> DataFrame:
    return S.outcome(papers(spark, d), ORDER).select("id", "code")


@query(f"""WITH {_P}, {_DUP}, {_CODE} SELECT source_type, count(*) AS total, CAST(count_if(code = 'EC6') AS BIGINT) AS duplicates,
  CAST(count_if(code <> 'EC6') AS BIGINT) AS by_rule, CAST(count_if(code IS NULL) AS BIGINT) AS pending FROM coded GROUP BY source_type""")
def screening_outcome(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code")
    counts = [F.count("*").alias("total"), F.count_if(code == "EC6").alias("duplicates"), F.count_if(code != "EC6").alias("by_rule"), F.count_if(code.isNull()).alias("pending")]
    return S.outcome(papers(spark, d), ORDER).groupBy("source_type").agg(*counts)


@query(f"""WITH {_P}, {_DUP}, {_CODE} SELECT source_type, coalesce(code, 'NONE') AS code, count(*) AS n FROM coded GROUP BY ROLLUP (source_type, coalesce(code, 'NONE'))""")
def prisma_rollup(spark: SparkSession, d: str) -> DataFrame:
    coded = S.outcome(papers(spark, d), ORDER).select("source_type", F.coalesce("code", F.lit("NONE")).alias("code"))
    return coded.rollup("source_type", "code").agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, {_D} SELECT id, title, source_type, status, human_decision FROM papers LEFT JOIN dec ON id = paper_id WHERE publication_year >= 2010 ORDER BY ordinal LIMIT 50 OFFSET 50""")
def listing_page(spark: SparkSession, d: str) -> DataFrame:
    joined = papers(spark, d).where("publication_year >= 2010").join(decisions(spark, d).withColumnRenamed("paper_id", "id"), "id", "left")
    return joined.orderBy("ordinal").offset(50).limit(50).select("id", "title", "source_type", "status", "human_decision")


def _export(source: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        kept = decisions(spark, d).where(F.col("status").isin("INCLUDED", "EXCLUDED"))
        joined = kept.join(papers(spark, d).where(F.col("source_type") == source).withColumnRenamed("id", "paper_id"), "paper_id")
        codes = lambda p: F.array_join(F.filter("codes", lambda c: c.startswith(p)), "; ")
        placed = R.places(joined.select("paper_id", "metadata", "codes", "status"), F.col("paper_id"))
        return placed.select(F.col("place").cast("int").alias("number"), "paper_id", F.col("metadata")["Library"].alias("library"), codes("IC").alias("cis"), codes("EC").alias("ces"), F.when(F.col("status") == "INCLUDED", "YES").otherwise("NO").alias("revisor"))

    f.__name__ = f"export_{source.lower()}"
    query(f"""WITH {_P}, {_D} SELECT CAST(row_number() OVER (ORDER BY paper_id) AS INTEGER) AS number, paper_id, library, CASE WHEN code LIKE 'IC%' THEN code ELSE '' END AS cis,
  CASE WHEN code LIKE 'EC%' THEN code ELSE '' END AS ces, CASE WHEN status = 'INCLUDED' THEN 'YES' ELSE 'NO' END AS revisor
FROM dec JOIN papers ON id = paper_id WHERE status <> 'NEEDS_REVIEW' AND source_type = '{source}'""")(f)


_export("WL")
_export("GL")


@query(f"WITH {_P}, {_D} SELECT id FROM papers WHERE id IN (SELECT paper_id FROM dec WHERE status = 'NEEDS_REVIEW')")
def calibration_semi(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).join(decisions(spark, d).where("status = 'NEEDS_REVIEW'").select(F.col("paper_id").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {_P}, {_D} SELECT id FROM papers WHERE id NOT IN (SELECT paper_id FROM dec)")
def unscreened_anti(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).join(decisions(spark, d).select(F.col("paper_id").alias("id")), "id", "left_anti").select("id")


@query(f"WITH {_P}, {_D} SELECT id, CASE WHEN status IS NULL THEN 'screen' WHEN status = 'NEEDS_REVIEW' THEN 'again' ELSE 'skip' END AS action FROM papers LEFT JOIN dec ON id = paper_id")
def existing_skip(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("status")
    joined = papers(spark, d).join(decisions(spark, d).select(F.col("paper_id").alias("id"), "status"), "id", "left")
    return joined.select("id", F.when(status.isNull(), "screen").when(status == "NEEDS_REVIEW", "again").otherwise("skip").alias("action"))


@query(f"WITH {_P}, {_D} SELECT id, CASE WHEN human_decision = 'YES' THEN 1 ELSE 0 END AS label, length(title) + length(abstract) + 1 AS chars FROM papers JOIN dec ON id = paper_id")
def training_set(spark: SparkSession, d: str) -> DataFrame:
    joined = papers(spark, d).join(decisions(spark, d).withColumnRenamed("paper_id", "id"), "id")
    return joined.select("id", F.when(F.col("human_decision") == "YES", 1).otherwise(0).alias("label"), (F.length("title") + F.length("abstract") + 1).cast("long").alias("chars"))


@query(f"""WITH {_D} SELECT CAST(count_if(code IN ('EC1', 'EC3', 'EC4')) AS BIGINT) AS by_rule, CAST(count_if(status = 'EXCLUDED' AND code NOT IN ('EC1', 'EC3', 'EC4', 'EC6')) AS BIGINT) AS by_model,
  CAST(count_if(code = 'EC6') AS BIGINT) AS duplicates, CAST(count_if(status = 'INCLUDED') AS BIGINT) AS included, count(*) AS screened FROM dec""")
def progress_counts(spark: SparkSession, d: str) -> DataFrame:
    codes = F.col("codes")
    ec6 = F.array_contains(codes, "EC6")
    rule = ~ec6 & F.arrays_overlap(codes, F.array(*[F.lit(c) for c in ORDER]))
    excluded = F.col("status") == "EXCLUDED"
    return decisions(spark, d).agg(F.count_if(rule).alias("by_rule"), F.count_if(excluded & ~rule & ~ec6).alias("by_model"), F.count_if(ec6).alias("duplicates"), F.count_if(F.col("status") == "INCLUDED").alias("included"), F.count("*").alias("screened"))


_M = f"""{_D}, m AS (
  SELECT CAST(count_if(status = 'INCLUDED' AND human_decision = 'YES') AS BIGINT) AS tp, CAST(count_if(status = 'EXCLUDED' AND human_decision = 'NO') AS BIGINT) AS tn,
    CAST(count_if(status = 'INCLUDED' AND human_decision = 'NO') AS BIGINT) AS fp, CAST(count_if(status = 'EXCLUDED' AND human_decision = 'YES') AS BIGINT) AS fn FROM dec)"""


@query(f"WITH {_M} SELECT * FROM m")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return R.confusion(R.pairs_of(decisions(spark, d)))


@query(f"""WITH {_M}, n AS (SELECT *, CAST(tp + tn + fp + fn AS DOUBLE) AS n, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM n),
q AS (SELECT *, coalesce((po - pe) / nullif(1 - pe, 0), 0) AS kp FROM k)
SELECT tp, tn, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(kp, 4) AS kappa,
  CASE WHEN kp < 0.4 THEN 'Poor' WHEN kp < 0.6 THEN 'Moderate' WHEN kp < 0.8 THEN 'Substantial' ELSE 'Almost perfect' END AS band FROM q""")
def agreement_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.agreement(R.confusion(R.pairs_of(decisions(spark, d))))


@query(f"WITH {_D} SELECT status, count(*) AS size, greatest(1, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (), 0) AS INTEGER)) AS sample FROM dec GROUP BY status")
def strata_sizes(spark: SparkSession, d: str) -> DataFrame:
    counted = decisions(spark, d).groupBy("status").agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy())  # of one row a status
    return counted.withColumn("sample", F.greatest(F.lit(1), F.bround(F.lit(100.0) * F.col("size") / total, 0).cast("int")))


@query(f"WITH {_D} SELECT paper_id, CASE WHEN human_decision = 'YES' THEN CASE WHEN code LIKE 'IC%' THEN code ELSE 'IC1' END ELSE CASE WHEN code LIKE 'EC%' THEN code ELSE 'EC5' END END AS codes FROM dec")
def reconcile_codes(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).select("paper_id", F.array_join(R.reconciled_codes(F.col("codes"), F.col("human_decision")), ";").alias("codes"))


@query(f"""WITH {_D}, s AS (SELECT *, doc_id % 5 AS score FROM dec)
SELECT paper_id, CASE WHEN score < 2 THEN 'EXCLUDED' WHEN code = 'QC_FAIL' THEN 'INCLUDED' ELSE status END AS status, CASE WHEN score < 2 THEN 'QC_FAIL' WHEN code = 'QC_FAIL' THEN '' ELSE coalesce(code, '') END AS codes FROM s""")
def quality_state(spark: SparkSession, d: str) -> DataFrame:
    s = decisions(spark, d).withColumn("s", R.quality_state(F.col("status"), F.col("codes"), F.col("doc_id") % 5))
    return s.select("paper_id", "s.status", F.array_join("s.codes", ";").alias("codes"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return R.latest(log, "user_id", "event_id")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def context_concat(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "block")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["block"]), "\n\n").alias("context"))


@query(f"WITH {_P} SELECT id, row_number() OVER (ORDER BY try_cast(id AS BIGINT) NULLS LAST, id) AS place FROM papers")
def qa_order_all(spark: SparkSession, d: str) -> DataFrame:
    """Every paper's place."""
    number = F.col("id").try_cast("bigint")
    return R.places(papers(spark, d).select("id"), number.isNull(), number, F.col("id"))


def _text_sql(html: str, lines: int = 200) -> str:
    """SQL of a page's visible text."""
    text = f"regexp_replace(regexp_replace({html}, '{HIDDEN_PATTERN}', chr(10), 'g'), '{TAG_PATTERN}', chr(10), 'g')"
    for entity, char in ENTITIES:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    stripped = r"regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda s: {stripped}), lambda s: s <> '')[1:{lines}], chr(10))"


@query(f"SELECT page_id, {_text_sql('html')} AS text FROM pages")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))
