"""Queries of reviewing: decisions, samples, audits and joins, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.response import parse_answer, parse_quality
from corpusloom.operators import classifier, counters, linking, runs, sampling, store
from corpusloom.operators import review as R
from corpusloom.plans.queries import _D, _P, ORACLE, query
from corpusloom.sources.papers import decisions, papers
from corpusloom.sources.scratch import fresh_path

SIZE, SEED = 100, 42

#: Texts that stand for a model's answers; the same SQL in both engines.
ANSWER = """CASE doc_id % 9 WHEN 0 THEN '{"reasoning":"r","criteria_evaluation":{"EC2":false,"IC1":true},"decision":"INCLUDED"}'
  WHEN 1 THEN '{"decision":"EXCLUDED","criteria_evaluation":{"IC1":false,"EC2":true}}' WHEN 2 THEN '{"decision": BANANA' WHEN 3 THEN '{"status":"BANANA"}'
  WHEN 4 THEN '{"status":"INCLUDED","rationale":"r","applied_criteria_codes":["IC1"]}' WHEN 5 THEN '{"decision":"INCLUDED","criteria_evaluation":{"IC1":true,"EC5":true,"EC2":true}}'
  WHEN 6 THEN '{"decision":"EXCLUDED","criteria_evaluation":{"IC3":true}}' WHEN 7 THEN '{"decision":"INCLUDED","criteria_evaluation":{"IC2":"true","IC1":true}}' ELSE '[1, 2]' END"""
_CODES = """CASE WHEN len(evaluated) > 0 THEN evaluated ELSE listed END"""


@query(f"""WITH a AS (SELECT doc_id, CASE WHEN json_valid({ANSWER}) THEN CAST({ANSWER} AS JSON) END AS j FROM labels),
b AS (SELECT doc_id, CASE WHEN j->>'$.decision' IN ('INCLUDED', 'EXCLUDED', 'NEEDS_REVIEW') THEN j->>'$.decision' WHEN j->>'$.status' IN ('INCLUDED', 'EXCLUDED', 'NEEDS_REVIEW') THEN j->>'$.status' END AS named,
  coalesce(list_filter(json_keys(j, '$.criteria_evaluation'), lambda k: json_extract(j, '$.criteria_evaluation.' || k) = 'true'::JSON), []) AS evaluated,
  coalesce(CAST(j->'$.applied_criteria_codes' AS VARCHAR[]), []) AS listed FROM a),
c AS (SELECT *, {_CODES} AS codes FROM b),
d AS (SELECT *, list_filter(codes, lambda x: x LIKE 'IC%') AS ic, list_filter(codes, lambda x: x LIKE 'EC%') AS ec FROM c),
e AS (SELECT *, CASE WHEN named IS NULL THEN NULL WHEN len(ic) > 0 AND len(ec) = 0 AND NOT list_contains(ic, 'IC1') AND list_has_any(ic, ['IC2', 'IC3', 'IC4', 'IC5']) THEN 'NEEDS_REVIEW'
  WHEN len(ic) > 0 AND len(ec) > 0 AND named = 'INCLUDED' THEN 'EXCLUDED' ELSE named END AS final FROM d)
SELECT doc_id, coalesce(final, 'NEEDS_REVIEW') AS status, CAST(CASE WHEN final IS NULL THEN 0 WHEN final = 'NEEDS_REVIEW' THEN 0.5 ELSE 1 END AS DOUBLE) AS confidence,
  CASE WHEN final IS NULL THEN '' WHEN len(ic) > 0 AND len(ec) > 0 THEN array_to_string(list_sort(list_distinct(ec)), ';') ELSE array_to_string(codes, ';') END AS codes FROM e""")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    read = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", parse_answer(F.expr(ANSWER)).alias("a"))
    return read.select("doc_id", "a.status", "a.confidence", F.array_join("a.codes", ";").alias("codes"))


SCORES = """CASE doc_id % 4 WHEN 0 THEN '{"q1":1,"q2":0.5,"q3":0,"q4":1}' WHEN 1 THEN '{"q1":1,"q3":0.5}' WHEN 2 THEN 'no json' ELSE '{"q1":"x","q2":1}' END"""


@query(f"""WITH a AS (SELECT doc_id, CASE WHEN json_valid({SCORES}) THEN CAST({SCORES} AS JSON) END AS j FROM labels),
q AS (SELECT doc_id, coalesce(try_cast(j->>'$.q1' AS DOUBLE), 0) AS q1, coalesce(try_cast(j->>'$.q2' AS DOUBLE), 0) AS q2, coalesce(try_cast(j->>'$.q3' AS DOUBLE), 0) AS q3, coalesce(try_cast(j->>'$.q4' AS DOUBLE), 0) AS q4 FROM a)
SELECT doc_id, q1, q2, q3, q4, q1 + q2 + q3 + q4 AS score FROM q""")
def quality_parse(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", parse_quality(F.expr(SCORES)).alias("q")).select("doc_id", "q.*")


@query(f"""WITH {_P}, {_D} SELECT (SELECT count(*) FROM papers) AS total, (SELECT count(*) FROM dec) AS screened,
  greatest((SELECT count(*) FROM papers) - (SELECT count(*) FROM dec), 0) AS pending, (SELECT count(*) FROM dec WHERE status <> 'NEEDS_REVIEW') AS calibrated""")
def progress_totals(spark: SparkSession, d: str) -> DataFrame:
    total = papers(spark, d).agg(F.count("*").alias("total"))
    seen = decisions(spark, d).agg(F.count("*").alias("screened"), F.count_if(F.col("status") != "NEEDS_REVIEW").alias("calibrated"))
    # one row each
    return total.crossJoin(seen).select("total", "screened", F.greatest(F.col("total") - F.col("screened"), F.lit(0)).alias("pending"), "calibrated")


@query(f"""WITH {_P}, {_D} SELECT id, title, source_type, coalesce(nullif(library, ''), 'Unknown') AS library, CASE status WHEN 'INCLUDED' THEN 'YES' WHEN 'EXCLUDED' THEN 'NO' WHEN 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' ELSE 'PENDING' END AS ai_decision,
  human_decision, coalesce(human_decision, CASE status WHEN 'INCLUDED' THEN 'YES' WHEN 'EXCLUDED' THEN 'NO' END, 'PENDING') AS label FROM papers LEFT JOIN dec ON id = paper_id""")
def paper_listing(spark: SparkSession, d: str) -> DataFrame:
    joined = papers(spark, d).join(decisions(spark, d).select(F.col("paper_id").alias("id"), "status", "human_decision"), "id", "left")
    ai = F.when(F.col("status") == "INCLUDED", "YES").when(F.col("status") == "EXCLUDED", "NO")
    library = F.coalesce(F.nullif(F.col("metadata")["Detected_Source"], F.lit("")), F.nullif(F.col("metadata")["Library"], F.lit("")), F.lit("Unknown"))
    shown = F.coalesce(ai, F.when(F.col("status").isNotNull(), "NEEDS_REVIEW"), F.lit("PENDING"))
    return joined.select("id", "title", "source_type", library.alias("library"), shown.alias("ai_decision"), "human_decision", F.coalesce("human_decision", ai, F.lit("PENDING")).alias("label"))


@query(f"""WITH {_D} SELECT paper_id FROM dec JOIN documents USING (doc_id) WHERE status = 'NEEDS_REVIEW' AND (split_part(text, chr(10), 1) ILIKE '%the%' OR split_part(text, chr(10), 1) ILIKE 'a%')""")
def title_patterns(spark: SparkSession, d: str) -> DataFrame:
    waiting = decisions(spark, d).where("status = 'NEEDS_REVIEW'").select(F.col("paper_id").alias("id"))
    return linking.by_pattern(papers(spark, d).join(waiting, "id"), [("%the%", "YES"), ("a%", "NO")]).select(F.col("id").alias("paper_id"))


@query(f"WITH {_P}, {_D}, v AS (SELECT CAST(doc_id + 7 AS VARCHAR) AS paper_id FROM labels) SELECT paper_id, paper_id IN (SELECT paper_id FROM dec) AS found FROM v")
def verdicts_found(spark: SparkSession, d: str) -> DataFrame:
    verdicts = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") + 7).cast("string").alias("paper_id"))
    known = decisions(spark, d).select("paper_id", F.lit(True).alias("found"))
    return verdicts.join(known, "paper_id", "left").select("paper_id", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {_D} SELECT human_decision, count(*) AS n FROM dec GROUP BY human_decision")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).groupBy("human_decision").agg(F.count("*").alias("n"))


@query("SELECT (count(*) + 49) // 50 AS pages, count(*) AS total FROM documents")
def page_count(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 50)).alias("pages"), F.count("*").alias("total"))


@query(f"WITH {_D} SELECT count(*) >= 5 AND count(DISTINCT human_decision) = 2 AS trainable, count(*) >= 20 AS certifiable FROM dec WHERE human_decision IS NOT NULL")
def audit_gates(spark: SparkSession, d: str) -> DataFrame:
    audited = decisions(spark, d).where("human_decision is not null")
    return audited.agg(((F.count("*") >= classifier.LEAST_ROWS) & (F.count_distinct("human_decision") == 2)).alias("trainable"), (F.count("*") >= 20).alias("certifiable"))


_SHARE = f"greatest(1, CAST(round_even({SIZE}.0 * n / sum(n) OVER (), 0) AS INTEGER))"


@query(f"""WITH {_D}, s AS (SELECT status, count(*) AS n FROM dec GROUP BY status), t AS (SELECT status, {_SHARE} AS target FROM s),
r AS (SELECT paper_id, dec.status, target, md5('{SEED}:' || paper_id) AS place, row_number() OVER (PARTITION BY dec.status ORDER BY md5('{SEED}:' || paper_id), paper_id) AS k FROM dec JOIN t ON t.status = dec.status)
SELECT paper_id, status FROM (SELECT * FROM r WHERE k <= target ORDER BY place, paper_id LIMIT {SIZE})""")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.audit_sample(decisions(spark, d), SIZE, SEED).select("paper_id", "status")


@query(rf"""WITH {_P}, u AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(title), '[^\pL\pN]', '', 'g') ORDER BY ordinal) AS first FROM papers),
s AS (SELECT source_type, count(*) AS n FROM u WHERE first = 1 GROUP BY source_type), w AS (SELECT source_type, {_SHARE} AS share FROM s),
t AS (SELECT source_type, CASE WHEN source_type = 'WL' THEN share ELSE {SIZE} - coalesce((SELECT share FROM w WHERE source_type = 'WL'), 0) END AS target FROM w),
r AS (SELECT id, u.source_type, target, md5('{SEED}:' || id) AS place, row_number() OVER (PARTITION BY u.source_type ORDER BY md5('{SEED}:' || id), id) AS k FROM u JOIN t ON t.source_type = u.source_type WHERE first = 1)
SELECT id, source_type FROM (SELECT * FROM r WHERE k <= target ORDER BY place, id LIMIT {SIZE})""")
def calibration_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.calibration_sample(papers(spark, d), SIZE, SEED).select("id", "source_type")


@query(f"WITH {_D} SELECT paper_id, human_decision FROM dec WHERE human_decision IS NOT NULL ORDER BY md5('{SEED}:' || paper_id), paper_id LIMIT 3")
def few_shot(spark: SparkSession, d: str) -> DataFrame:
    return sampling.few_shot(decisions(spark, d), 3, SEED).select("paper_id", "human_decision")


@query(f"""WITH {_D}, m AS (SELECT *, doc_id % 9 / 2.0 AS score FROM dec) SELECT CAST(count_if(status <> 'NEEDS_REVIEW' AND human_decision IS NOT NULL) AS BIGINT) AS total_audited,
  coalesce(round(avg(score), 2), 0) AS avg_quality, count(score) AS n_quality FROM m""")
def audit_quality_all(spark: SparkSession, d: str) -> DataFrame:
    """Over every scored row."""
    return R.quality_stats(decisions(spark, d).withColumn("score", F.col("doc_id") % 9 / 2.0))


@query(f"""WITH {_P}, {_D} SELECT source_type, CAST(row_number() OVER (PARTITION BY source_type ORDER BY id) AS INTEGER) AS number, id FROM papers JOIN dec ON id = paper_id WHERE status <> 'NEEDS_REVIEW'""")
def sheet_numbers(spark: SparkSession, d: str) -> DataFrame:
    kept = papers(spark, d).join(decisions(spark, d).where("status <> 'NEEDS_REVIEW'").select(F.col("paper_id").alias("id")), "id", "left_semi")
    return R.places(kept.select("source_type", "id"), F.col("id"), group=("source_type",), name="number").withColumn("number", F.col("number").cast("int"))


#: ``events`` as a decision log; the same SQL in both engines.
LOG = """event_id AS seq, CAST(user_id AS STRING) AS paper_id,
  CASE WHEN event_id % 8 < 3 THEN 'decide' WHEN event_id % 8 = 3 THEN 'seed' WHEN event_id % 8 = 4 THEN 'audit' WHEN event_id % 8 < 7 THEN 'quality' WHEN event_id % 3 = 0 THEN 'delete' WHEN event_id % 3 = 1 THEN 'flag' ELSE 'unflag' END AS kind,
  CASE event_id % 5 WHEN 0 THEN 'INCLUDED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'EXCLUDED' END AS status, CASE event_id % 5 WHEN 0 THEN 'IC1' WHEN 1 THEN '' WHEN 2 THEN 'QC_FAIL' ELSE 'EC2' END AS code,
  CASE event_id % 2 WHEN 0 THEN 'YES' ELSE 'NO' END AS human_decision, CAST(event_id * 7 % 9 AS DOUBLE) / 2 AS score"""


@query(f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY seq) AS k FROM (SELECT {LOG} FROM events)),
s AS (
  SELECT paper_id, CAST(0 AS BIGINT) AS k, false AS there, CAST(NULL AS VARCHAR) AS status, CAST('' AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS human_decision, false AS audited, false AS cal, CAST(NULL AS DOUBLE) AS score FROM l WHERE k = 1
  UNION ALL
  SELECT s.paper_id, l.k, CASE WHEN kind = 'delete' THEN false WHEN kind IN ('decide', 'seed') THEN true ELSE there END,
    CASE WHEN kind = 'delete' THEN NULL WHEN kind = 'decide' THEN l.status WHEN kind = 'seed' AND NOT there THEN 'NEEDS_REVIEW' WHEN NOT there THEN NULL
      WHEN kind = 'quality' AND l.score < 2 THEN 'EXCLUDED' WHEN kind = 'quality' AND s.status = 'EXCLUDED' AND s.code = 'QC_FAIL' THEN 'INCLUDED' ELSE s.status END,
    CASE WHEN kind = 'delete' THEN '' WHEN kind = 'decide' THEN l.code WHEN kind = 'seed' AND NOT there THEN '' WHEN NOT there THEN ''
      WHEN kind = 'quality' AND l.score < 2 THEN 'QC_FAIL' WHEN kind = 'quality' AND s.status = 'EXCLUDED' AND s.code = 'QC_FAIL' THEN '' ELSE s.code END,
    CASE WHEN kind = 'delete' THEN NULL WHEN kind = 'seed' OR (kind = 'audit' AND there) THEN l.human_decision ELSE s.human_decision END,
    CASE WHEN kind = 'delete' THEN false WHEN kind = 'seed' OR (kind = 'audit' AND there) THEN true ELSE audited END,
    CASE WHEN kind = 'delete' THEN false WHEN kind = 'seed' OR (kind = 'flag' AND there) THEN true WHEN kind = 'unflag' THEN false ELSE cal END,
    CASE WHEN kind = 'delete' THEN NULL WHEN kind = 'quality' AND there THEN l.score ELSE s.score END
  FROM s JOIN l ON l.paper_id = s.paper_id AND l.k = s.k + 1)
SELECT paper_id, status, code AS codes, human_decision, audited AS is_audited, cal AS is_calibration, score FROM s JOIN (SELECT paper_id, max(k) AS k FROM l GROUP BY paper_id) USING (paper_id, k) WHERE there""")
def store_state(spark: SparkSession, d: str) -> DataFrame:
    return _shown(store.state(_log(spark, d)))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr(*_columns(LOG)).withColumns({"codes": F.filter(F.array("code"), lambda c: c != ""), "confidence": F.lit(1.0), "reconcile": F.lit(False)})


def _shown(state: DataFrame) -> DataFrame:
    return state.select("paper_id", "status", F.array_join("codes", ";").alias("codes"), "human_decision", "is_audited", "is_calibration", "score")


#: Shares of the log, by seq, that are added to the store of runs one after another: the last ones stay runs of their own.
SHARES = (0.0, 0.7, 0.85, 0.95, 0.99, 1.0)


def _runs(spark: SparkSession, d: str, add: Callable[[DataFrame, str, int], None] = runs.add) -> str:
    """The log in a store of runs, taken in by batches."""
    log, path = _log(spark, d), fresh_path(spark, "runs")
    least, most = log.agg(F.min("seq"), F.max("seq")).first()
    cuts = [least + int((most - least + 1) * share) for share in SHARES] if least is not None else [0] * len(SHARES)
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        add(log.where(F.col("seq").between(a, b - 1)), path, batch)
    return path


@query(ORACLE["store_state"])
def compacted_state(spark: SparkSession, d: str) -> DataFrame:
    """The state by merged runs."""
    return _shown(runs.state(spark, _runs(spark, d)))


@query(f"""SELECT s.* FROM ({ORACLE["store_state"]}) s WHERE paper_id IN (SELECT CAST(doc_id * 3 AS VARCHAR) FROM labels)""")
def decision_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The decisions of the ids that ``labels`` names, from the store of runs."""
    ids = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") * 3).cast("string").alias("paper_id"))
    return _shown(runs.decisions_of(spark, _runs(spark, d), ids))


@query(f"""SELECT status, codes, human_decision, is_audited, is_calibration, count(*) AS n FROM ({ORACLE["store_state"]}) GROUP BY ALL""")
def state_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the state, kept by the changes of each batch."""
    return counters.cells(spark, _runs(spark, d, counters.add))


def _columns(sql: str) -> list[str]:
    """The parts of a select list, at commas outside of brackets."""
    out, depth = [""], 0
    for c in sql:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query(f"""WITH {_P}, {_D} SELECT id, CASE WHEN abstract <> '' THEN 'own' WHEN source_type = 'GL' THEN 'page' ELSE 'catalogue' END AS abstract_from FROM papers""")
def enrichment_source(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("abstract") != "", "own").when(F.col("source_type") == "GL", "page").otherwise("catalogue")
    return papers(spark, d).select("id", source.alias("abstract_from"))


@query(None)
def classifier_cascade(spark: SparkSession, d: str) -> DataFrame:
    labelled = papers(spark, d).join(decisions(spark, d).select(F.col("paper_id").alias("id"), "human_decision"), "id")
    model = classifier.train(labelled)
    return classifier.score(papers(spark, d), model).select("id", "p_no", "auto_excluded")


@query(None)
def catalogue_match(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("title"))
    catalogue = items.select(F.col("id").alias("match_id"), "title", F.col("title").alias("abstract"))
    return linking.catalogue_abstracts(items, catalogue)
