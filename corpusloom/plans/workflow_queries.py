"""Queries of listings, exports, resumed runs, calibration rounds, paper facts and prompts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import json_list, json_object
from corpusloom.operators import criteria, export, facts, lifecycle, linking, listing, prompts, search_index, store
from corpusloom.operators import review as R
from corpusloom.operators import screening as S
from corpusloom.plans.queries import _D, _KEY, _P, ORACLE, ORDER, query
from corpusloom.sources.papers import decisions, papers, papers_of
from corpusloom.sources.scratch import fresh_path
from corpusloom.streaming import screening

#: Fact events from ``labels``: two scorings a paper, the second of every other one; the first line of a text as what was fetched.
_FACTS = """fe AS (
  SELECT 1 AS seq, CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'WL' ELSE 'GL' END AS source, (doc_id % 3) / 2.0 AS q1, 0.5 AS q2, CAST(NULL AS DOUBLE) AS q3, (doc_id % 2) * 1.0 AS q4,
    CASE WHEN doc_id % 5 = 0 THEN 'https://example.org/' || doc_id || '.pdf' END AS pdf_url, CAST(NULL AS VARCHAR) AS full_text FROM labels
  UNION ALL SELECT 2, CAST(doc_id AS VARCHAR), 'GL', (doc_id % 7) / 6.0, 1.0, 1.0, 0.5, NULL, 'page of ' || doc_id FROM labels WHERE doc_id % 4 = 1
), fs AS (SELECT *, coalesce(q1, q2, q3, q4) IS NOT NULL AS scored, coalesce(q1, 0) + coalesce(q2, 0) + coalesce(q3, 0) + coalesce(q4, 0) AS total FROM fe),
facts AS (SELECT paper_id, """ + ", ".join(f"arg_max(coalesce(q{i}, 0), seq) FILTER (scored AND source = '{s.upper()}') AS {s}_q{i}" for s in ("wl", "gl") for i in range(1, 5)) + """,
  arg_max(total, seq) FILTER (scored AND source = 'WL') AS wl_quality_score, arg_max(total, seq) FILTER (scored AND source = 'GL') AS quality_score, arg_max(pdf_url, seq) FILTER (pdf_url IS NOT NULL) AS pdf_url, arg_max(full_text, seq) FILTER (full_text IS NOT NULL) AS full_text FROM fs GROUP BY paper_id)"""


def _fact_events(spark: SparkSession, d: str) -> DataFrame:
    of, i = spark.read.parquet(f"{d}/labels.parquet"), F.col("doc_id")
    null = lambda t: F.lit(None).cast(t)
    first = of.select(
        F.lit(1).cast("long").alias("seq"), i.cast("string").alias("paper_id"), F.when(i % 2 == 0, "WL").otherwise("GL").alias("source"), (i % 3 / 2.0).alias("q1"), F.lit(0.5).alias("q2"), null("double").alias("q3"), (i % 2 * 1.0).alias("q4"),
        F.when(i % 5 == 0, F.concat(F.lit("https://example.org/"), i, F.lit(".pdf"))).alias("pdf_url"), null("string").alias("full_text"),
    )
    second = of.where(i % 4 == 1).select(
        F.lit(2).cast("long").alias("seq"), i.cast("string").alias("paper_id"), F.lit("GL").alias("source"), (i % 7 / 6.0).alias("q1"), F.lit(1.0).alias("q2"), F.lit(1.0).alias("q3"), F.lit(0.5).alias("q4"),
        null("string").alias("pdf_url"), F.concat(F.lit("page of "), i).alias("full_text"),
    )
    return first.unionByName(second)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts(_fact_events(spark, d))


@query(f"WITH {_FACTS} SELECT paper_id, " + ", ".join(facts.SCORES) + ", wl_quality_score, quality_score, pdf_url, full_text FROM facts WHERE gl_q1 IS NOT NULL OR wl_q1 IS NOT NULL OR pdf_url IS NOT NULL OR full_text IS NOT NULL")
def quality_map(spark: SparkSession, d: str) -> DataFrame:
    return facts.with_some(_facts(spark, d))


def _moved(seq: int, state: str) -> str:
    """SQL of a scoring's effect on status and code."""
    return f"""m{seq} AS (SELECT s.paper_id, CASE WHEN f.total < 2 THEN 'EXCLUDED' WHEN f.total >= 2 AND s.status = 'EXCLUDED' AND s.code = 'QC_FAIL' THEN 'INCLUDED' ELSE s.status END AS status,
  CASE WHEN f.total < 2 THEN 'QC_FAIL' WHEN f.total >= 2 AND s.status = 'EXCLUDED' AND s.code = 'QC_FAIL' THEN '' ELSE s.code END AS code
FROM {state} s LEFT JOIN (SELECT * FROM fs WHERE seq = {seq} AND scored) f USING (paper_id))"""


@query(f"""WITH {_D}, {_FACTS}, m0 AS (SELECT paper_id, status, coalesce(code, '') AS code FROM dec), {_moved(1, "m0")}, {_moved(2, "m1")}
SELECT paper_id, status, code AS codes, wl_quality_score, quality_score FROM m2 LEFT JOIN facts USING (paper_id)""")
def quality_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Scores by source, and the state of each paper after all of its scorings."""
    scored = _fact_events(spark, d)
    made = lifecycle._events(decisions(spark, d), 0, "decide", status=F.col("status"), codes=F.col("codes"), confidence=F.lit(1.0))
    current = store.state(made.unionByName(facts.score_events(scored)))
    known = facts.facts(scored).select("paper_id", "wl_quality_score", "quality_score")
    return current.select("paper_id", "status", F.array_join("codes", ";").alias("codes")).join(known, "paper_id", "left")


@query(f"WITH {_P}, {_D}, {_FACTS} SELECT d.paper_id, f.full_text, md5(coalesce(nullif(f.full_text, ''), nullif(p.abstract, ''), '(no content available)')) AS content FROM dec d LEFT JOIN facts f USING (paper_id) JOIN papers p ON p.id = d.paper_id WHERE d.status = 'INCLUDED'")
def included_content(spark: SparkSession, d: str) -> DataFrame:
    joined = facts.included(decisions(spark, d), _facts(spark, d)).join(papers(spark, d).select(F.col("id").alias("paper_id"), "abstract"), "paper_id")
    return joined.select("paper_id", "full_text", F.md5(facts.content(F.col("full_text"), F.col("abstract"))).alias("content"))


_LISTED = "p.ordinal, p.id, p.title, p.source_type, p.publication_year, coalesce(nullif(p.library, ''), 'Unknown') AS source_library, d.status, coalesce(d.code, '') AS codes, d.human_decision, f.quality_score, f.full_text AS crawled_abstract"
_JOINED = "FROM papers p LEFT JOIN dec d ON d.paper_id = p.id LEFT JOIN facts f ON f.paper_id = p.id"


def _listed(spark: SparkSession, d: str, **by: object) -> tuple[DataFrame, DataFrame]:
    rows, counts = listing.list_papers(papers(spark, d), decisions(spark, d), _facts(spark, d), **by)
    shown = rows.select("ordinal", "id", "title", "source_type", "publication_year", "source_library", "status", F.array_join("codes", ";").alias("codes"), "human_decision", "quality_score", "crawled_abstract")
    return shown, counts


@query(f"WITH {_P}, {_D}, {_FACTS} SELECT {_LISTED} {_JOINED} WHERE d.status = 'INCLUDED' AND p.source_type = 'WL' ORDER BY p.ordinal LIMIT 50")
def list_papers_status(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, status="INCLUDED", source_type="WL")[0]


@query(f"WITH {_P}, {_D}, {_FACTS} SELECT {_LISTED} {_JOINED} WHERE (contains(lower(p.title), 'the') OR contains(lower(p.abstract), 'the')) AND p.publication_year >= 2008 AND p.publication_year <= 2020 ORDER BY p.ordinal LIMIT 20 OFFSET 20")
def list_papers_second_page(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, page=2, size=20, search="The", year_from=2008, year_to=2020)[0]


@query("SELECT 1 AS page, 50 AS size, CAST(0 AS BIGINT) AS total, CAST(1 AS BIGINT) AS total_pages")
def list_papers_no_match(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, title_contains="no title holds this")[1]


@query(f"WITH {_P}, {_D} SELECT 1 AS page, 50 AS size, count(*) AS total, greatest(1, (count(*) + 49) // 50) AS total_pages FROM papers p JOIN dec d ON d.paper_id = p.id WHERE d.status = 'EXCLUDED'")
def list_papers_totals(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, status="EXCLUDED")[1]


def _sheet(source: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return export.sheet(papers(spark, d), decisions(spark, d), _facts(spark, d), source)

    content = "p.abstract" if source == "WL" else "coalesce(nullif(f.full_text, ''), '(No web content scraped)')"
    f.__name__ = f"export_sheet_{source.lower()}"
    query(f"""WITH {_P}, {_D}, {_FACTS} SELECT coalesce(nullif(p.library, ''), 'Unknown Database') AS library, d.paper_id, row_number() OVER (ORDER BY d.paper_id) AS number, p.title, {content} AS content, '' AS keywords,
  CASE WHEN d.code LIKE 'IC%' THEN d.code ELSE '' END AS cis1, CASE WHEN d.code LIKE 'EC%' THEN d.code ELSE '' END AS ces1, coalesce(d.human_decision, '') AS revisor1, '' AS cis2, '' AS ces2, '' AS revisor2,
  CASE WHEN d.status = 'INCLUDED' THEN 'YES' ELSE 'NO' END AS decision
FROM dec d JOIN papers p ON p.id = d.paper_id LEFT JOIN facts f ON f.paper_id = d.paper_id WHERE d.status <> 'NEEDS_REVIEW' AND p.source_type = '{source}'""")(f)


_sheet("WL")
_sheet("GL")


@query(f"""WITH {_P}, {_D}, m AS (
  SELECT p.*, status, coalesce(sum(CASE WHEN status IS NULL OR status <> 'NEEDS_REVIEW' THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEY} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM papers p LEFT JOIN dec ON id = paper_id WHERE source_type = 'WL')
SELECT id, CASE WHEN status IS NULL AND seen > 0 THEN 'EC6' WHEN trim(language) <> '' AND lower(trim(language)) <> 'english' THEN 'EC1' WHEN publication_year > 0 AND publication_year < 2015 THEN 'EC4' END AS code
FROM m WHERE status IS NULL OR status = 'NEEDS_REVIEW'""")
def resume_run(spark: SparkSession, d: str) -> DataFrame:
    return S.resumed(papers(spark, d), decisions(spark, d), ORDER, target="WL").select("id", "code")


@query(ORACLE["resume_run"])
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """The same by the stream: decisions lie in its log, and all papers arrive."""
    path = fresh_path(spark, "stream")
    store.append(spark, lifecycle._events(decisions(spark, d), 0, "decide", status=F.col("status"), codes=F.col("codes"), confidence=F.lit(1.0)), f"{path}/log")
    documents = f"{d}/documents.parquet"
    arriving = papers_of(spark.readStream.schema(spark.read.parquet(documents).schema).option("recursiveFileLookup", True).parquet(documents)).where("source_type = 'WL'")
    screening.screen_stream(arriving, path, f"{path}/checkpoint", ORDER).awaitTermination()
    return screening.read_log(spark, path).where("seq > 0").select(F.col("paper_id").alias("id"), F.try_element_at("codes", F.lit(1)).alias("code"))


#: A log: every labelled paper decided, a third of them seeded, some audited, a few flagged.
_LOG_SQL = """cur AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id, CASE WHEN quality = 0 THEN 'EXCLUDED' WHEN toxic = 0 THEN 'INCLUDED' ELSE 'NEEDS_REVIEW' END AS status,
  doc_id % 3 = 0 OR doc_id % 7 = 0 AS is_audited, doc_id % 3 = 0 AS is_calibration,
  CASE WHEN doc_id % 7 = 0 THEN 'NO' WHEN doc_id % 3 = 0 THEN 'YES' END AS human_decision,
  CASE WHEN doc_id % 7 = 0 THEN CASE WHEN quality = 0 AND toxic = 1 THEN 'EC3' ELSE 'EC5' END WHEN quality = 1 AND toxic = 0 THEN 'IC1' WHEN quality = 1 THEN '' WHEN toxic = 1 THEN 'EC3' ELSE 'QC_FAIL' END AS codes FROM labels)"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    made, i = decisions(spark, d), F.col("doc_id")

    def events(rows: DataFrame, seq: int, kind: str, **sets: object) -> DataFrame:
        return lifecycle._events(rows, seq, kind, **sets)

    log = events(made, 1, "decide", status=F.col("status"), codes=F.col("codes"), confidence=F.lit(1.0))
    log = log.unionByName(events(made.where(i % 3 == 0), 2, "seed", human_decision=F.lit("YES")))
    return store.state(log.unionByName(events(made.where(i % 7 == 0), 3, "audit", human_decision=F.lit("NO"), reconcile=F.lit(True))))


@query(f"WITH {_LOG_SQL} SELECT paper_id, status, codes, human_decision, is_audited, is_calibration FROM cur")
def reconciled_state(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("paper_id", "status", F.array_join("codes", ";").alias("codes"), "human_decision", "is_audited", "is_calibration")


@query(f"WITH {_LOG_SQL}, ids AS (SELECT DISTINCT CAST(doc_id + 3 AS VARCHAR) AS paper_id FROM labels) SELECT count(*) AS asked, count(cur.paper_id) AS affected, count(*) - count(cur.paper_id) AS unknown FROM ids LEFT JOIN cur USING (paper_id)")
def audit_dispatch(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") + 3).cast("string").alias("paper_id"))
    return lifecycle.audited(_current(spark, d), ids, "NO", 9)[1]


@query(f"WITH {_LOG_SQL} SELECT paper_id, CASE WHEN is_audited THEN 'flag' ELSE 'unflag' END AS kind FROM cur WHERE is_audited <> is_calibration")
def calibration_from_audits(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.seeded_from_audits(_current(spark, d), 9).select("paper_id", "kind")


@query(f"WITH {_LOG_SQL} SELECT count(*) AS total, CAST(count_if(status <> 'NEEDS_REVIEW') AS BIGINT) AS screened, CAST(count_if(status = 'NEEDS_REVIEW') AS BIGINT) AS pending, round(100.0 * count_if(status <> 'NEEDS_REVIEW') / count(*), 1) AS percent FROM cur WHERE is_calibration")
def calibration_progress(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.progress(0, _current(spark, d), True)


@query(f"WITH {_LOG_SQL} SELECT count_if(is_calibration) > 0 AND count_if(NOT is_calibration) = 0 AS calibrating FROM cur")
def auto_calibration(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.in_calibration(_current(spark, d))


@query(f"""WITH {_LOG_SQL}, {_FACTS}, n AS (SELECT count_if(is_calibration) > 0 AS cal FROM cur WHERE is_audited),
u AS (SELECT * FROM cur, n WHERE is_audited AND (is_calibration OR NOT cal)),
m AS (SELECT any_value(cal) AS calibration_used, CAST(count_if(status <> 'NEEDS_REVIEW') AS BIGINT) AS total_audited, CAST(count_if(status = 'INCLUDED' AND human_decision = 'YES') AS BIGINT) AS tp, CAST(count_if(status = 'EXCLUDED' AND human_decision = 'NO') AS BIGINT) AS tn,
  CAST(count_if(status = 'INCLUDED' AND human_decision = 'NO') AS BIGINT) AS fp, CAST(count_if(status = 'EXCLUDED' AND human_decision = 'YES') AS BIGINT) AS fn FROM u),
r AS (SELECT *, CAST(tp + tn + fp + fn AS DOUBLE) AS n, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM r),
q AS (SELECT *, coalesce((po - pe) / nullif(1 - pe, 0), 0) AS kp FROM k)
SELECT total_audited, calibration_used, tp, tn, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(kp, 4) AS kappa,
  CASE WHEN kp < 0.4 THEN 'Poor' WHEN kp < 0.6 THEN 'Moderate' WHEN kp < 0.8 THEN 'Substantial' ELSE 'Almost perfect' END AS interpretation,
  (SELECT coalesce(round(avg(quality_score), 2), 0) FROM facts) AS avg_quality, (SELECT count(quality_score) FROM facts) AS n_quality FROM q""")
def audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.audit_metrics(_current(spark, d), _facts(spark, d))


@query(f"WITH {_P}, {_D} SELECT paper_id, human_decision FROM dec JOIN papers ON id = paper_id WHERE status <> 'NEEDS_REVIEW' AND source_type = 'WL'")
def verdicts_csv(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of an exported sheet, written as CSV and read back as a reviewer's file."""
    sheet = export.sheet(papers(spark, d), decisions(spark, d), _facts(spark, d), "WL")
    path = fresh_path(spark, "sheet")
    export.write_csv(sheet, "WL", path)
    return lifecycle.seeded(lifecycle.read_verdicts(spark, path), papers(spark, d), 1)[0].select("paper_id", "human_decision")


_SAID = "CASE doc_id % 4 WHEN 0 THEN ' yes ' WHEN 1 THEN 'No' WHEN 2 THEN 'maybe' END"


@query(f"""WITH {_P}, said AS (SELECT CAST(doc_id * 2 AS VARCHAR) AS paper_id, upper(trim({_SAID})) AS verdict FROM labels),
k AS (SELECT DISTINCT paper_id FROM said WHERE verdict IN ('YES', 'NO') AND paper_id IN (SELECT id FROM papers)) SELECT (SELECT count(*) FROM papers) AS imported, (SELECT count(*) FROM k) AS seeded""")
def import_counters(spark: SparkSession, d: str) -> DataFrame:
    said = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") * 2).cast("string").alias("paper_id"), F.expr(_SAID).alias("verdict"))
    return lifecycle.seeded(said, papers(spark, d), 1)[1]


_OA = """CASE doc_id % 5 WHEN 0 THEN '{"oa_locations":[{"url_for_pdf":null},{"url_for_pdf":"http://a/1.pdf"}],"best_oa_location":{"url_for_pdf":"http://b/2.pdf"}}' WHEN 1 THEN '{"oa_locations":[],"best_oa_location":{"url_for_pdf":"http://b/2.pdf"}}'
  WHEN 2 THEN '{"oa_locations":[{"url":"x"}]}' WHEN 3 THEN 'no json' END"""
_DOI = "CASE doc_id % 3 WHEN 0 THEN 'DOI' WHEN 1 THEN 'doi' ELSE 'Library' END"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'http://a/1.pdf' WHEN 1 THEN 'http://b/2.pdf' END AS pdf_url, CASE WHEN doc_id % 3 <> 2 THEN '10.1/' || doc_id END AS doi FROM labels")
def doi_lookup(spark: SparkSession, d: str) -> DataFrame:
    metadata = F.create_map(F.lit("Year"), F.lit("2020"), F.expr(_DOI), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")))
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", facts.pdf_url_of(F.expr(_OA)).alias("pdf_url"), facts.doi_of(metadata).alias("doi"))


_CRITERIA = [("IC1", "IC", "about the topic"), ("IC2", "IC", "empirical"), ("EC1", "EC", "not in English"), ("EC5", "EC", "off topic")]
_SHARED = "'Include if:' || chr(10) || 'IC1: about the topic' || chr(10) || 'IC2: empirical' || chr(10) || chr(10) || 'Exclude if:' || chr(10) || 'EC1: not in English' || chr(10) || 'EC5: off topic' || chr(10)"


@query(f"""WITH {_P}, {_D}, s AS (SELECT title, human_decision, id FROM papers JOIN dec ON id = paper_id WHERE human_decision IS NOT NULL ORDER BY md5('42:' || id), id LIMIT 3),
x AS (SELECT string_agg(title || ' -> ' || human_decision, chr(10) ORDER BY id) AS shown FROM s)
SELECT id, md5({_SHARED} || CASE WHEN source_type = 'GL' THEN chr(10) || 'This is a web source; judge its content, not its venue.' || chr(10) ELSE '' END
  || CASE WHEN shown <> '' THEN chr(10) || 'Judged before:' || chr(10) || shown || chr(10) ELSE '' END || chr(10) || 'Title: ' || title || chr(10) || 'Abstract: ' || abstract) AS prompt FROM papers, x""")
def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import sampling

    every = papers(spark, d)
    picked = sampling.few_shot(decisions(spark, d), 3, 42).select(F.col("paper_id").alias("id"), "human_decision")
    examples = every.select("id", "title").join(picked, "id")
    listed = spark.createDataFrame(_CRITERIA, "code string, type string, description string")
    return prompts.prompts(every, listed, examples).select("id", F.md5("prompt").alias("prompt"))


@query(f"WITH {_P} SELECT id FROM papers WHERE contains(lower(title), 'tion') OR contains(lower(abstract), 'tion')")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """A substring search by the posting index, which is made here of all papers."""
    path = fresh_path(spark, "index")
    search_index.add(papers(spark, d), path, 0)
    return search_index.search(spark, path, "Tion")


@query(f"WITH {_P}, {_D} SELECT id AS Global_ID, title AS Title, '' AS URL, abstract AS Abstract, source_type AS Source_Type, status AS Status, '' AS Rationale, coalesce(code, '') AS Applied_Criteria FROM papers JOIN dec ON id = paper_id")
def flat_results(spark: SparkSession, d: str) -> DataFrame:
    return export.results(papers(spark, d), decisions(spark, d))


_RULES = "SELECT '%' || split_part(text, ' ', 2) || '%' || split_part(text, ' ', 4) || '%' AS pattern, CASE WHEN item_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS verdict, item_id AS place FROM benchmark"


@query(f"""WITH {_P}, {_D}, rules AS ({_RULES}), w AS (SELECT id, title FROM papers JOIN dec ON id = paper_id WHERE status = 'NEEDS_REVIEW')
SELECT id, min(place) AS place, arg_min(verdict, place) AS verdict FROM w JOIN rules ON title ILIKE pattern GROUP BY id""")
def title_pattern_table(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of papers that wait, by patterns of two words that ``benchmark``'s texts give."""
    word = lambda i: F.split_part(F.col("text"), F.lit(" "), F.lit(i))
    rules = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("%"), word(2), F.lit("%"), word(4), F.lit("%")).alias("pattern"), F.when(F.col("item_id") % 2 == 0, "YES").otherwise("NO").alias("verdict"), F.col("item_id").alias("place"))
    waiting = decisions(spark, d).where("status = 'NEEDS_REVIEW'").select(F.col("paper_id").alias("id"))
    return linking.by_pattern_table(papers(spark, d).join(waiting, "id").select("id", "title"), rules).select("id", "place", "verdict")


@query(f"""WITH {_P}, {_LOG_SQL} SELECT id AS paper_id, title, abstract, source_type, CASE status WHEN 'INCLUDED' THEN 'YES' WHEN 'EXCLUDED' THEN 'NO' ELSE 'NEEDS_REVIEW' END AS ai_decision, codes, human_decision
FROM papers JOIN cur ON id = paper_id WHERE is_calibration ORDER BY id""")
def calibration_list(spark: SparkSession, d: str) -> DataFrame:
    return listing.calibration(papers(spark, d), _current(spark, d)).withColumn("codes", F.array_join("codes", ";"))


_JSON = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


@query(f"""WITH {_P}, {_D} SELECT paper_id, CASE WHEN code IS NULL THEN '[]' ELSE '[' || {_JSON.format("code")} || ']' END AS codes_json, '{{"Language": ' || coalesce({_JSON.format("language")}, 'null') || ', "Library": ' || coalesce({_JSON.format("library")}, 'null') || '}}' AS metadata_json
FROM papers JOIN dec ON id = paper_id""")
def decision_json(spark: SparkSession, d: str) -> DataFrame:
    joined = papers(spark, d).select(F.col("id").alias("paper_id"), "metadata").join(decisions(spark, d), "paper_id")
    return joined.select("paper_id", json_list(F.col("codes")).alias("codes_json"), json_object(F.col("metadata")).alias("metadata_json"))


_CRITERIA_SQL = "cr AS (SELECT 'c' || lpad(CAST(item_id AS VARCHAR), 9, '0') AS code, CASE WHEN item_id % 2 = 0 THEN 'IC' ELSE 'EC' END AS type, split_part(text, ' ', 1) AS title, text AS description FROM benchmark)"


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    """The items of ``benchmark`` as criteria; a third of them are changed twice."""
    i = F.col("item_id")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.concat(F.lit("c"), F.lpad(i.cast("string"), 9, "0")).alias("code"), F.when(i % 2 == 0, "IC").otherwise("EC").alias("type"), F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("title"), F.col("text").alias("description"))
    change = lambda seq, text: items.where(i % 3 == 0).select(F.lit(seq).alias("seq"), "code", "title", F.lit(text).alias("description"))
    return criteria.updated(items, change(2, "second text").unionByName(change(1, "first text")))


@query(f"WITH {_CRITERIA_SQL} SELECT code, type, title, CASE WHEN CAST(substr(code, 2) AS INTEGER) % 3 = 0 THEN 'second text' ELSE description END AS description FROM cr")
def criteria_update(spark: SparkSession, d: str) -> DataFrame:
    return _criteria(spark, d)


@query(f"""WITH {_CRITERIA_SQL}, c AS (SELECT code, type, CASE WHEN CAST(substr(code, 2) AS INTEGER) % 3 = 0 THEN 'second text' ELSE description END AS description FROM cr),
t AS (SELECT string_agg(code || ': ' || description, chr(10) ORDER BY code) FILTER (type = 'IC') AS inclusion, string_agg(code || ': ' || description, chr(10) ORDER BY code) FILTER (type = 'EC') AS exclusion FROM c)
SELECT md5(inclusion) AS inclusion, md5(exclusion) AS exclusion, md5('Inclusion Criteria (IC):' || chr(10) || inclusion || chr(10) || chr(10) || 'Exclusion Criteria (EC):' || chr(10) || exclusion) AS protocol FROM t""")
def protocol(spark: SparkSession, d: str) -> DataFrame:
    return criteria.protocol_text(_criteria(spark, d)).select(*[F.md5(c).alias(c) for c in ("inclusion", "exclusion", "protocol")])
