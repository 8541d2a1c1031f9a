"""Operator 10: secret scans with multipart credential linking.

Strong patterns (assignments to secret names, access identifiers, long hex runs) are reported as
they stand. A credential also comes in parts, none of which shows what it is by itself: an
identifier (a cloud's or a service's, or a named user, account or client), a secret (letters and digits of
high entropy) and an endpoint (a url or a provider's host). These weak candidates are joined with each other by interval: a
scope reaches SCOPE code points around an identifier and ends at a blank line. A weak
secret is reported only in the scope of an identifier, a weak identifier only with
a secret in its scope, an endpoint only where both stand in one scope. The join is a sweep over
the parts of a document in order, so it is linear in them; all patterns are linear in the text.

Added kinds: ``secret``, ``identifier``, ``endpoint``. Base spans are never altered.

Cases: a null text is empty: no spans, empty strings, and the digest of the empty string. A null id stays null. Very long
texts are scanned whole. Of spans that begin at one place the kinds' order decides. Repeated rows give repeated results, an
empty table gives no rows. Extra columns are kept by ``scan``, but for those with its own names, and ignored by the query.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import in_slices, lean, table, texts_of

SCOPE = 400
#: Bytes of text that are scanned at once.
ROOM = 1 << 20
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A match of _ASSIGN holds one of these, in either case.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")

# Fixed values, published by the providers: prefixes and shapes of identifiers that are no secrets by themselves,
# and hosts of their interfaces.
_CLOUD_IDS = ("ABIA", "ACCA", "AGPA", "AIDA", "AIPA", "ANPA", "ANVA", "APKA", "AROA", "ASCA", "ASIA")
_ID_NAMES = ("access_key_id", "account", "account_id", "account_name", "client_id", "login", "project_id", "tenant_id", "user", "user_id", "user_name", "username")
_HOSTS = ("amazonaws.com", "azure.com", "cloudflarestorage.com", "digitaloceanspaces.com", "googleapis.com", "windows.net")

_WEAK_ID = re.compile(
    rf"(?<![A-Z0-9])(?:{'|'.join(_CLOUD_IDS)})[A-Z0-9]{{12,124}}(?![A-Z0-9])"  # of a cloud
    r"|(?<![A-Za-z0-9])(?:AC|SK)[0-9a-f]{32}(?![0-9A-Za-z])"  # of a telephony account
    r"|(?<![A-Za-z0-9_])[ps]k_(?:live|test)_[A-Za-z0-9]{16,124}(?![A-Za-z0-9])"  # of a payment account
    r"|(?<![a-z0-9.-])[a-z0-9-]{1,63}@[a-z0-9-]{1,63}\.iam\.gserviceaccount\.com(?![a-z0-9.-])"  # of a service
    rf"|(?<![A-Za-z0-9])(?i:{'|'.join(n.replace('_', '[_-]?') for n in _ID_NAMES)})[\"']?\x20{{0,8}}[:=]\x20{{0,8}}[\"']?[A-Za-z0-9_.@-]{{4,128}}",
    re.ASCII,
)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: A url of any scheme, or a host of a provider; both begin at a boundary and reach a bounded way back, so the search is linear.
_ENDPOINT = re.compile(rf"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{{1,15}}://[^\s\"'<>]+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}(?:{'|'.join(h.replace('.', '[.]') for h in _HOSTS)})(?![A-Za-z0-9-])[^\s\"'<>]*")
_BLANK = re.compile(r"\n[\x20\t]*\n")
#: Bits a character that a weak secret has at least; a word or path has fewer.
LEAST_ENTROPY = 3.5

#: A match of _WEAK_ID holds one of these.
_ID_HINT = re.compile(rf"(?i:account|client|login|project|tenant|user|access)|{'|'.join(_CLOUD_IDS)}|AC[0-9a-f]|SK[0-9a-f]|[ps]k_|@", re.ASCII)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), end exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def entropy(s: str) -> float:
    """Of a character of ``s``, in bits."""
    return -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values())


def _random(s: str) -> bool:
    """Digits and letters, of an entropy that words don't have."""
    return any(map(str.isdigit, s)) and any(map(str.isalpha, s)) and entropy(s) >= LEAST_ENTROPY


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak candidates whose complementary parts co-occur."""
    strong_ids = [s for s in base if s[2] == "access"]
    weak_ids = [(*m.span(), "identifier") for m in _WEAK_ID.finditer(text)] if _ID_HINT.search(text) else []
    if not strong_ids and not weak_ids:
        return []
    taken = [s for s in ordered([*base, *weak_ids]) if s[2] != "assign"]
    reach = list(accumulate((s[1] for s in taken), max))
    strong_secrets = [s for s in base if s[2] in ("assign", "hex")]

    def free(span: tuple[int, int]) -> bool:
        """No span that is taken overlaps: none of those that begin before its end ends after its start."""
        i = bisect_left(taken, (span[1],))
        return not i or reach[i - 1] <= span[0]

    weak_secrets = [(*m.span(), "secret") for m in _WEAK_SECRET.finditer(text) if free(m.span()) and _random(m[0])]
    endpoints = [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    breaks = [m.start() for m in _BLANK.finditer(text)]

    def scope(s: Span) -> tuple[int, int]:
        i = bisect_left(breaks, s[0])
        return max(s[0] - SCOPE, breaks[i - 1] if i else 0), min(s[1] + SCOPE, breaks[i] if i < len(breaks) else len(text))

    def within(parts: list[Span], lo: int, hi: int) -> list[Span]:
        """Parts are in order of their starts."""
        return [s for s in parts[bisect_left(parts, (lo,)) : bisect_left(parts, (hi,))] if s[1] <= hi]

    found: set[Span] = set()
    for ident in ordered([*strong_ids, *weak_ids]):
        lo, hi = scope(ident)
        secrets = within(weak_secrets, lo, hi)
        if secrets or within(strong_secrets, lo, hi):
            found.update(secrets)
            found.update(within(endpoints, lo, hi))
            if ident[2] == "identifier":
                found.add(ident)
    return list(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and added_spans (arrays of start, end, kind), and ``redacted``."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    docs = docs.drop("base_spans", "added_spans", "redacted")
    lean(docs.sparkSession)

    def column(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in own] for own in spans], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole, 512, ROOM, text_col):
                raw, texts = b.column(text_col).to_pylist(), texts_of(b, text_col)
                base = [base_spans(t) for t in texts]
                added = [ordered(linked_spans(t, s)) for t, s in zip(texts, base, strict=True)]
                clean = [None if r is None else redacted(t, ordered([*s, *a])) for r, t, s, a in zip(raw, texts, base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, column(base), column(added), pa.array(clean, pa.string())], names=[*b.schema.names, "base_spans", "added_spans", "redacted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("base_spans", kind), T.StructField("added_spans", kind), T.StructField("redacted", T.StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """The counts and digest columns of every document, in one pass."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole, 512, ROOM):
                texts = texts_of(b)
                base = [base_spans(t) for t in texts]
                spans = [written(ordered([*s, *linked_spans(t, s)])) for t, s in zip(texts, base, strict=True)]
                counts = [pa.array([sum(x[2] == k for x in s) for s in base], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([sha256(written(s).encode()).hexdigest() for s in base]), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE: dict[str, str] = {}
