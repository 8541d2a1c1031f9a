"""Rules of filter lists against a matcher of their own."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import url_filter as U


def fits(rule, subject):
    """Whether a rule's text (without its exception mark) fits, by trying all ways to read it."""
    s, r = subject.lower(), rule.lower()
    host = r.startswith("||")
    r = r.removeprefix("||")
    start = not host and r.startswith("|")
    r, end = r[start:], r.endswith("|")
    r = r[: len(r) - end]

    def here(i, j):
        if i == len(r):
            return not end or j == len(s)
        if r[i] == "*":
            return any(here(i + 1, k) for k in range(j, len(s) + 1))
        if r[i] == "^":
            return j == len(s) and here(i + 1, j) or j < len(s) and not (s[j].isascii() and (s[j].isalnum() or s[j] in "_.%-")) and here(i + 1, j + 1)
        return j < len(s) and s[j] == r[i] and here(i + 1, j + 1)

    if host:
        name = s.split("/")[0]
        return any(here(0, k) for k in [0, *(i + 1 for i, c in enumerate(name) if c == ".")])
    return here(0, 0) if start else any(here(0, k) for k in range(len(s) + 1))


def judged(rules, host, path):
    if not host:
        return "block"
    hit = {r.startswith("@@") for r in rules if fits(r.removeprefix("@@"), host + path)}
    return "block" if hit == {False} else "allow"


RULES = ["||ads.example.com^", "||shop.net/cart", "|www.a.com/x|", "/banner/*/img^", "-promo-", "@@||ads.example.com/ok^", "track", "^id^", "*.swf|", "||b.org^*/pay/", "@@/free/", "||Ü.de^", "a+b(c)", "! comment", "[Adblock Plus 2.0]", ""]
URLS = ["http://ads.example.com/", "http://x.ads.example.com", "http://badads.example.com/", "http://ads.example.com/ok", "http://shop.net/cartoon", "http://www.a.com/x", "http://www.a.com/xy", "http://c.com/banner/1/img", "http://c.com/banner/img", "http://c.com/big-promo-1", "http://c.com/TRACKER", "http://c.com/id/", "http://c.com/x.swf", "http://c.com/x.swf2", "http://b.org/1/pay/", "http://b.org/free/pay/", "http://ü.de/", "http://c.com/a+b(c)", None, "nothing", "http://c.com/" + "a/" * 20_000 + "track"]


@pytest.mark.parametrize("inline", [U.INLINE_RULES, 0])
def test_list_rules(spark, tmp_path, inline):
    (tmp_path / "list.txt").write_text("\n".join(RULES), encoding="utf-8")
    rules = U.read_rules(spark.read.text(str(tmp_path / "list.txt")))
    assert len(rules) == len(RULES) - 3 and {r.name: r.tokens for r in rules}["track"] == ()
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    own = [r for r in RULES if r and r[0] not in "!["]
    for r in U.filter_urls(df, rules=rules, inline=inline).collect():
        assert r.verdict == judged(own, r.host, r.path if len(r.path) < 1000 else "/track"), (r.host, r.path[:40])


def test_five_thousand_rules_from_a_file(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("ad", "pop", "shop", "news", "img", "go") for b in range(60)]
    made = [rnd.choice(["||{0}.{1}.com^", "||{0}.com/{1}/", "/{0}/*{1}", "-{0}.{1}^", "@@||{0}.com/{1}^", "{0}_{1}"]).format(rnd.choice(words), rnd.choice(words)) for _ in range(5000)]
    (tmp_path / "list.txt").write_text("\n".join(made))
    rules = U.read_rules(spark.read.text(str(tmp_path / "list.txt")))
    assert len(rules) == len(set(made)) > U.INLINE_RULES
    urls = [f"http://{rnd.choice(words)}.{rnd.choice([*words, 'com'])}.com/{rnd.choice(words)}/{rnd.choice(words)}-{rnd.choice(words)}.{rnd.choice(words)}" for _ in range(60)]
    got = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    want = {}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        want[i] = judged(sorted(set(made)), host, f"/{path}")
    assert got == want and {"block", "allow"} == set(got.values())


@pytest.mark.parametrize("line", ["||a.com^$third-party", "a.com##.banner"])
def test_rules_that_ask_for_more_than_a_url(line):
    with pytest.raises(ValueError, match="urls alone"):
        U.list_rule(line)
