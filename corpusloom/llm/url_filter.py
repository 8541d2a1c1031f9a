"""Operator 3: URL filters, DataFrame functions only.

A rule is a regular expression over host and path. Each is indexed under its rarest literal
token, by counts over the table's own urls; a url's tokens fetch candidate rules and only those
run their expressions. Site rules (host, path) fit the host and its subdomains where the path
starts with the rule's; the longest that fits decides. Where none fits, the pattern rules decide:
block if one matches and no exception does, else allow. Pattern rules may be read from a file or a table in the syntax of
published filter lists (``list_rule``); a short list of names is the default. A rule without a literal token is tried on every url.

Up to INLINE_RULES rules the index is a literal map and the whole filter a projection without a
shuffle. Beyond that, distinct urls are exploded to tokens and joined with the index, in
whatever way Spark chooses by its size.

Cases: a null url, or one without ``://``, has an empty host and path; no rule fits and the
verdict is block, as no site answers for it. A url without a path fits no site rule. Repeated
rows are judged alike, an empty table gives none, extra columns are kept out of the result. A very long url is judged whole: its
tokens are looked up once each, and only rules that share one are tried on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, table

INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``tokens``: literals that every match holds between delimiters."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    site: bool
    length: int


def _tokens(s: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if t]


def site_rule(verdict: str, site: str) -> Rule:
    """From ``host/path``."""
    host, _, path = site.partition("/")
    # the path's last token may go on in a url, unless a delimiter ends it
    inner = path if not path or not path[-1].isalnum() else path[: len(path) - len(re.split(r"[^A-Za-z0-9]+", path)[-1])]
    return Rule(site, rf"^(?:[^/]*\.)?\Q{host}/{path}\E", tuple(_tokens(host) + _tokens(inner)), verdict, True, len(site))


def pattern_rule(token: str, regex: str) -> Rule:
    """A blocking expression, each match of which holds ``token`` between delimiters."""
    return Rule(token, regex, (token,), "block", False, 0)


def list_rule(line: str) -> Rule | None:
    """From a line of a filter list; None for comments and headers.

    ``||`` stands for the beginning of a host or of a part of it after a dot, ``|`` for the beginning or end, ``^`` for a separator (neither
    letter, digit nor ``_.%-``) or the end, ``*`` for anything; ``@@`` marks an exception. Letters fit in either case. What is matched is the
    host and path. Options (``$``) and rules on page elements (``##``) ask for more than a url and are a ValueError.
    """
    text = line.strip()
    if not text or text[0] in "![":
        return None
    if "$" in text or "##" in text or "#@#" in text:
        raise ValueError(f"not a rule on urls alone: {text}")
    exception = text.startswith("@@")
    body = text[2:] if exception else text
    host, body = body.startswith("||"), body.removeprefix("||")
    start = not host and body.startswith("|")
    body, end = body[start:], body.endswith("|")
    body = body[: len(body) - end]
    regex, tokens = "(?iu)" + (r"^(?:[^/]*\.)?" if host else "^" if start else ""), []
    parts = re.findall(r"[A-Za-z0-9]+|.", body, re.S)
    for i, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += r"(?:[^A-Za-z0-9_.%\-]|$)"
        else:
            regex += re.sub(r"([^A-Za-z0-9])", r"\\\1", part) if part.isascii() else rf"\Q{part}\E"
            opens = parts[i - 1] != "*" if i else host or start
            closes = parts[i + 1] != "*" if i + 1 < len(parts) else end
            if opens and closes and part.isascii() and part.isalnum():
                tokens.append(part.lower())
    return Rule(text, regex + ("$" if end else ""), tuple(tokens), "allow" if exception else "block", False, 0)


def read_rules(lines: DataFrame, column: str = "value") -> list[Rule]:
    """The rules of a table of filter-list lines, as ``spark.read.text`` gives one. A list has some 10,000s of lines; the driver holds them to index them."""
    return [r for r in (list_rule(x[0]) for x in lines.select(column).where(F.col(column).isNotNull()).distinct().collect()) if r is not None]


SITE_RULES = [
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
]

#: Names that hosts of gambling, adult, pharmacy and advertising sites carry, as whole tokens.
PATTERN_RULES = [pattern_rule(t, rf"^(?:[^/]*[.\-])?{t}(?:[.\-][^/]*)?(?:/|$)") for t in ("casino", "bets", "pills", "adult", "porn", "spam", "ads", "adserver")] + [
    pattern_rule(t, rf"/{t}(?:[/.]|$)") for t in ("login", "signin", "signup", "cart", "checkout")
]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(F.concat(host, F.lit("/"), path)), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(parts: DataFrame, rules: list[Rule]) -> list[str]:
    """For each rule the token that fewest urls hold, by one count over the rules' own tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if len(rules) <= INLINE_RULES:
        held = F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*[F.lit(t) for t in wanted]))
        counted = parts.select(F.explode(held).alias("token")).groupBy("token").count()
    else:
        spark = parts.sparkSession
        counted = parts.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).join(spark.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi").groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counted.collect()}  # a row a token of the rules at most
    return [min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="") for r in rules]


def _outcome(fits: Column) -> Column:
    """Of the rules that matched: the longest site rule, and whether a pattern did."""
    sites = F.filter(fits, lambda r: r["site"])
    best = F.array_max(F.transform(sites, lambda r: F.struct(r["length"].alias("length"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    return F.struct(best["name"].alias("rule"), best["verdict"].alias("ruled"), (F.exists(fits, lambda r: ~r["site"] & (r["verdict"] == "block")) & ~F.exists(fits, lambda r: ~r["site"] & (r["verdict"] == "allow"))).alias("pattern"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None, inline: int = INLINE_RULES) -> DataFrame:
    """id, host, path, rule, verdict of every row."""
    rules = SITE_RULES + PATTERN_RULES if rules is None else rules
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rarest = rarest_tokens(parts, rules)
    # the empty token fetches the rules without one
    looked_up = lambda: F.concat(tokens_of(F.col("host"), F.col("path")), F.array(F.lit(""))) if "" in rarest else tokens_of(F.col("host"), F.col("path"))
    fields = "struct<name:string,regex:string,verdict:string,site:boolean,length:int>"
    subject = F.concat("host", "path")
    if len(rules) <= inline:
        index: dict[str, list[Column]] = {}
        for r, t in zip(rules, rarest, strict=True):
            index.setdefault(t, []).append(F.struct(*[F.lit(x).alias(n) for n, x in (("name", r.name), ("regex", r.regex), ("verdict", r.verdict), ("site", r.site), ("length", r.length))]))
        lookup = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*rs))])
        held = F.array_intersect(looked_up(), F.array(*[F.lit(t) for t in index]))
        candidates = F.flatten(F.transform(held, lambda t: lookup[t]))
        judged = parts.withColumn("_r", _outcome(F.filter(candidates, lambda r: F.regexp_like(subject, r["regex"]))))
    else:
        frame = pages.sparkSession.createDataFrame([(t, (r.name, r.regex, r.verdict, r.site, r.length)) for r, t in zip(rules, rarest, strict=True)], f"token string, rule {fields}")
        distinct = parts.select("host", "path").distinct()
        fits = distinct.withColumn("token", F.explode(looked_up())).join(frame, "token").where(F.regexp_like(subject, F.col("rule.regex")))
        by_url = fits.groupBy("host", "path").agg(_outcome(F.collect_set("rule")).alias("_r"))  # of one url's rules
        judged = parts.join(by_url, ["host", "path"], "left")
    verdict = F.coalesce(F.col("_r.ruled"), F.when((F.col("host") == "") | F.coalesce(F.col("_r.pattern"), F.lit(False)), "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_filter": op3_url_filter}

ORACLE = {
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(host_part, path_part, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), j AS (
  SELECT page_id, host, path,
    (SELECT max_by(host_part || path_part, length(host_part || path_part)) FROM rules
     WHERE (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part)) AS rule
  FROM p
)
SELECT j.page_id, j.host, j.path, j.rule,
  CASE WHEN r.verdict IS NOT NULL THEN r.verdict
       WHEN j.host = '' THEN 'block'
       WHEN regexp_matches(j.host, '(^|[.-])(casino|bets|pills|adult|porn|spam|ads|adserver)([.-]|$)') THEN 'block'
       WHEN regexp_matches(j.path, '/(login|signin|signup|cart|checkout)([/.]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM j LEFT JOIN rules r ON r.host_part || r.path_part = j.rule
"""
}
