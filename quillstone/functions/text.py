"""Scalar functions of ingestion, templates, hashing and tokens, as Columns or as small driver-side helpers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What surveys write for "no answer"; a parameter everywhere.
NA = ("", "NA", "N/A", "null")
#: Words that say nothing about a prompt; a parameter everywhere.
STOP_WORDS = ("about", "and", "any", "are", "but", "can", "does", "for", "from", "has", "have", "her", "his", "how", "into", "its", "not", "only", "other", "our", "out", "own", "she", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "was", "were", "what", "when", "which", "who", "will", "with", "you", "your")
UNKNOWN = "(unknown)"
_VARIABLE = re.compile(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}")


# normalisation of raw strings


def norm_na(c: Column, na: Sequence[str] = NA) -> Column:
    return F.when(~c.isin(*na), c)


def norm_multi(c: Column, separator: str = ";", na: Sequence[str] = NA) -> Column:
    """Trimmed non-empty parts; none for null."""
    parts = F.filter(F.transform(F.split(norm_na(c, na), re.escape(separator)), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def norm_num(c: Column) -> Column:
    """A finite number, or null."""
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def norm_years(c: Column) -> Column:
    """Years, where less than one is a half and more than fifty is 51."""
    return F.when(c.rlike("(?i)^less than 1"), F.lit(0.5)).when(c.rlike("(?i)^more than 50"), F.lit(51.0)).otherwise(norm_num(c))


def norm_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


# templates


def template_fields(template: str) -> list[str]:
    """Names of all {{ variables }}, in order, repeats kept."""
    return _VARIABLE.findall(template)


def fmt_num(c: Column) -> Column:
    """A double as text without `.0` and without an exponent, as far as 1e15."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _text_of(df_types: dict[str, str], name: str) -> Column:
    kind, c = df_types[name], F.col(f"`{name}`")
    if kind.startswith("array"):
        return F.array_join(c, ", ")
    if kind in ("double", "float") or kind.startswith("decimal"):
        return fmt_num(c.cast("double"))
    return c.cast("string")


def bounded(value: Column, most: int = 4000) -> Column:
    """The first most characters of a text that is to be bound; null stays null."""
    return F.substring(value, 1, most)


def bind_text(template: str, types: dict[str, str]) -> Column:
    """The template with each variable replaced by its field: null becomes `(unknown)`, an array its
    values with commas. types: of the table's columns, as in dict(df.dtypes)."""
    parts, at = [], 0
    for m in _VARIABLE.finditer(template):
        if m[1] not in types:
            raise ValueError(f"unknown field {m[1]}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(_text_of(types, m[1]), F.lit(UNKNOWN))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def content_hash(template: str, types: dict[str, str]) -> Column:
    """SHA-256 of the bound fields alone, as a JSON object in the order of first use, nulls included."""
    names = list(dict.fromkeys(template_fields(template)))
    cells = [(F.col(f"`{n}`") if types[n].startswith("array") else _text_of(types, n)).alias(n) for n in names]
    if not cells:
        return F.sha2(F.lit("{}"), 256)
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)


# tokens and prompt changes

_SPLIT = r"[^a-z0-9+#.]+"


def tokens(c: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct words of more than two characters that aren't stop words, without {{variables}}."""
    words = F.split(F.regexp_replace(F.lower(c), r"\{\{[^}]*\}\}", " "), _SPLIT)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def tokens_of(text: str, stop: Sequence[str] = STOP_WORDS) -> list[str]:
    words = re.split(_SPLIT, re.sub(r"\{\{[^}]*\}\}", " ", text.lower()))
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in stop))


def prompt_diff(old: str, new: str, stop: Sequence[str] = STOP_WORDS) -> dict[str, list[str]]:
    """Words added and removed between two prompts along a longest common subsequence, and the tokens of
    both. Two short strings: this is no work for a cluster."""
    a, b = old.split(), new.split()
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    added, removed = [], []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1]):
            removed.append(a[i])
            i += 1
        else:
            added.append(b[j])
            j += 1
    terms = tokens_of(" ".join(added), stop) + tokens_of(" ".join(removed), stop)
    return {"added": added, "removed": removed, "terms": list(dict.fromkeys(terms))}


def overlap_score(c: Column, terms: Sequence[str], stop: Sequence[str] = STOP_WORDS) -> Column:
    """How many of the changed terms the text holds."""
    return F.size(F.array_intersect(tokens(c, stop), F.array(*map(F.lit, terms)).cast("array<string>")))


def overlap_bucket(score: Column) -> Column:
    return F.when(score <= 0, "0").when(score <= 2, "1-2").otherwise("3+")


def fallback_title(c: Column, most: int = 72) -> Column:
    """A chat's first words as its title."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(c, r"[`*_#>]", ""), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def clipped_length(c: Column, most: int = 8000) -> Column:
    return F.least(F.length(c), F.lit(most))


def token_estimate(text: Column, framing: int = 160) -> Column:
    return F.lit(framing) + F.ceil(F.length(text) / 4)


# hashes and vectors


def fnv1a32(text: str) -> int:
    """32-bit FNV-1a over code points, for seeds."""
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def json_equal(a: Column, b: Column) -> Column:
    """Equality of canonical JSON text, nulls equal."""
    return a.eqNullSafe(b)


def parse_cell(c: Column) -> Column:
    """A stored cell as JSON text: as it is if it parses, else as a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.when(c.isNotNull(), quoted))


def parse_arrays(c: Column) -> Column:
    """A JSON list in text as an array; none for null and for what isn't a list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def titled(title: Column, first_message: Column, default: str = "New chat") -> Column:
    """A chat's own title, or one from its first message while it still has the default."""
    return F.when(title == default, fallback_title(first_message)).otherwise(title)
