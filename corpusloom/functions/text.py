"""Column expressions over text, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_title(title: Column) -> Column:
    """Key of duplicate titles: lower case, stripped, without punctuation, white space runs as one space."""
    stripped = F.regexp_replace(F.lower(title), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")


def alnum_key(title: Column) -> Column:
    """Key of the calibration sample: letters and digits alone."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "")


#: Elements whose content isn't visible.
HIDDEN = ("script", "style", "nav", "footer", "header")
# Each alternative reads on to its end, or to the text's end if it has none, so no place is read twice by a later match.
# The same patterns hold in engines without back-references.
HIDDEN_PATTERN = "(?is)" + "|".join([rf"<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in HIDDEN] + [r"<!--.*?(?:-->|\z)"])
TAG_PATTERN = r"(?s)</?[A-Za-z!?][^>]*(?:>|\z)"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column, lines: int = 200) -> Column:
    """Visible text: non-blank lines, trimmed, the first ``lines`` of them, in time linear in the page.

    A hidden element or comment that isn't closed hides the rest, and a tag that isn't closed ends with the page. Of hidden elements of
    one kind within each other the first end closes all.
    """
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN_PATTERN, "\n"), TAG_PATTERN, "\n")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    kept = F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.array_join(F.slice(kept, 1, lines), "\n")


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


#: Control characters whose escape has a letter; they are written in lower case here.
_LETTERED = [f"{i:02X}" for i in (*range(0x0B, 0x0C), *range(0x0E, 0x10), *range(0x1A, 0x20))]


def _json_string(text: Column) -> Column:
    written = F.to_json(F.array(text))
    written = F.substring(written, F.lit(2), F.length(written) - 2)
    fixed = written
    for code in _LETTERED:  # an even number of backslashes before it is escaped ones
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.isNull(), "null").when(written.contains("\\u00"), fixed).otherwise(written)


def json_list(texts: Column) -> Column:
    """Texts as a JSON list, with a space after each comma, and nothing but what must be escaped. A null list gives null, a null text ``null``."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, _json_string), ", "), F.lit("]"))


def json_object(pairs: Column) -> Column:
    """A map of texts as a JSON object, in the map's order, with a space after each comma and colon."""
    entries = F.transform(F.map_entries(pairs), lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
