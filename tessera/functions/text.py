"""Text functions as Column builders; all but ``nfkc`` run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOUNDEX_CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}
VOWELLIKE = "AEIOUYHW"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility forms of Unicode in their plain ones. Only texts beyond ASCII go to Python; store the result."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def unicode_tokens(text: Column) -> Column:
    """Distinct Unicode words in order, of trimmed lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.trim(text)), F.lit(r"(?U)\w+"), F.lit(0)))


def ascii_tokens(text: Column, underscore: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+" if underscore else "[a-z0-9]+"), F.lit(0))


def soundex_variant(token: Column) -> Column:
    """Soundex in which vowels and H, W alike end a run of one code; '' unless the token is all A-Z."""
    upper = F.upper(token)
    codes = "".join(next((d for group, d in SOUNDEX_CODES.items() if chr(c) in group), "0") for c in range(65, 91))
    coded = F.translate(upper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", codes)
    runs = F.regexp_replace(F.regexp_replace(coded, r"(.)\1+", "$1"), "0", "")
    # the first letter's own code starts the run, and is not written
    rest = F.when(F.substring(coded, 1, 1) == "0", runs).otherwise(F.expr("null"))
    tail = F.coalesce(rest, F.substring(runs, 2, 100))
    return F.when(upper.rlike("^[A-Z]+$"), F.substring(F.concat(F.substring(upper, 1, 1), tail, F.lit("000")), 1, 4)).otherwise("")


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length a + length b), by a dynamic programme over arrays; 1 for two empty strings."""
    xs, ys = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)

    def row(above, x):
        # state: row so far, led by its 0
        step = lambda acc, j: F.concat(
            acc,
            F.array(
                F.when(F.element_at(ys, j) == x, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(acc, -1)))
            ),
        )
        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), step)

    lcs = F.element_at(F.aggregate(xs, F.transform(F.sequence(F.lit(0), m), lambda _: F.lit(0)), row), -1)
    return F.when((n + m) == 0, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * lcs / (n + m))


def pair_similarity(a: Column, b: Column) -> Column:
    """Indel ratio, or 0.86 if that is more and the tokens sound and start alike and share two letters at an end."""
    alike = (soundex_variant(a) != "") & (soundex_variant(a) == soundex_variant(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    long = (F.length(a) >= 2) & (F.length(b) >= 2)
    anchor = long & ((F.substring(a, 1, 2) == F.substring(b, 1, 2)) | (F.right(a, F.lit(2)) == F.right(b, F.lit(2))))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(indel_ratio(a, b), F.when(alike & anchor, 0.86).otherwise(0.0)))


def names(text: Column, most: int = 12) -> Column:
    """Capitalised words of three letters or more, distinct, at most ``most``; the pattern leaves one spelling of each."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))), 1, most)


def block_type(text: Column) -> Column:
    """list, table, title or text, by the shape of a block."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.size(F.split(t, r"\s+"))
    return (
        F.when(t == "", "text")
        .when(t.rlike(r"^([\-*•]|\d+[.)])\s+"), "list")
        .when(t.contains("|") | t.contains("\t"), "table")
        .when(t.rlike(r"\b\d+\b.*\b\d+\b") & (words >= 4) & t.contains("  "), "table")
        .when((words <= 10) & (((F.upper(t) == t) & (F.lower(t) != t)) | t.endswith(":")), "title")
        .otherwise("text")
    )


def payload(*parts: Column) -> Column:
    """The parts that aren't blank, joined by newlines."""
    trimmed = F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts])
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def slug(name: Column, most: int = 64) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(cleaned, 1, most)


def json_field(raw: Column, name: str, closed: bool = False) -> Column:
    """A string field of JSON that may be cut off (unless ``closed``) or broken; '' if it isn't there."""
    return F.regexp_replace(F.regexp_extract(raw, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)' + '"' * closed, 1), r'\\(["\\/])', "$1")


def json_number(raw: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*(-?[0-9]+)', 1), F.lit("")).cast("long")


def json_list(raw: Column, name: str) -> Column:
    """A list of strings of JSON that may be broken elsewhere, trimmed and in lower case; empty if it isn't there."""
    listed = F.regexp_extract(raw, rf'"{name}"\s*:\s*(\[[^\]]*\])', 1)
    return F.coalesce(cleaned_tags(F.from_json(F.nullif(listed, F.lit("")), "array<string>")), F.array().cast("array<string>"))


def cleaned_tags(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != "")


PARSED = "struct<caption:string,summary:string,category:string,tags:string>"


def parsed(raw: Column) -> Column:
    """Caption, summary, category and tags of a model's answer: whole JSON, else its fields one by one, else its lines."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    whole = F.from_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), PARSED, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    as_list = F.from_json(whole["tags"], "array<string>")
    by_mark = cleaned_tags(F.split(F.coalesce(whole["tags"], F.lit("")), "[,;|]"))
    full = F.struct(
        F.trim(F.coalesce(whole["caption"], F.lit(""))).alias("caption"),
        F.trim(F.coalesce(whole["summary"], F.lit(""))).alias("summary"),
        F.trim(F.coalesce(whole["category"], F.lit("Other"))).alias("category"),
        F.coalesce(F.when(whole["tags"].startswith("["), cleaned_tags(as_list)).otherwise(by_mark), none).alias("tags"),
    )
    field = lambda name: F.trim(json_field(t, name, closed=True))
    single = F.struct(field("caption").alias("caption"), field("summary").alias("summary"), F.coalesce(F.nullif(field("category"), F.lit("")), F.lit("Other")).alias("category"), json_list(t, "tags").alias("tags"))
    lines = F.filter(F.transform(F.split(t, "\n"), F.trim), lambda x: (x != "") & ~x.isin("{", "}", "[", "]"))
    line = lambda i: F.regexp_replace(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), "^,+|,+$", "")
    caption = F.substring(line(0), 1, 220)
    words = F.filter(F.split(F.lower(caption), r"[\s,;|]+"), lambda w: F.length(w) > 3)
    plain = F.struct(caption.alias("caption"), F.when(F.size(lines) > 1, F.substring(line(1), 1, 400)).otherwise(caption).alias("summary"), F.lit("Other").alias("category"), F.slice(words, 1, 6).alias("tags"))
    found = (single["caption"] != "") | (single["summary"] != "") | (F.size(single["tags"]) > 0)
    ok = whole.isNotNull() & (whole["caption"].isNotNull() | whole["summary"].isNotNull() | whole["tags"].isNotNull() | whole["category"].isNotNull())
    return F.when(ok, full).when(found, single).otherwise(plain)


def capped(answer: Column) -> Column:
    """A parsed answer with its defaults and limits: 220 characters of caption, 600 of summary, 8 tags."""
    caption = F.coalesce(F.nullif(answer["caption"], F.lit("")), F.lit("image with identifiable visual content"))
    summary = F.coalesce(F.nullif(answer["summary"], F.lit("")), caption)
    tags_ = F.when(F.size(answer["tags"]) > 0, answer["tags"]).otherwise(F.array(F.lit("image")))
    return F.struct(F.substring(caption, 1, 220).alias("caption"), F.substring(summary, 1, 600).alias("summary"), answer["category"].alias("category"), F.slice(tags_, 1, 8).alias("tags"))


def tags(raw: Column) -> Column:
    """A JSON list of strings, or else what stands between commas."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(raw, "array<string>"), parts)


def malformed(text: Column) -> Column:
    """Empty, a lone bracket, or the start of a JSON fragment."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.isin("", "{", "}", "[", "]") | t.startswith('{"') | t.startswith('"caption"') | t.startswith('"summary"') | t.startswith("```")


def repaired(caption: Column, summary: Column) -> tuple[Column, Column]:
    """Caption and summary, trimmed, with malformed ones recovered from JSON fragments in either, or from each other."""
    cap, summ = (F.trim(F.coalesce(c, F.lit(""))) for c in (caption, summary))
    both = F.concat(cap, F.lit("\n"), summ)
    field = lambda name: F.nullif(F.trim(json_field(both, name, closed=True)), F.lit(""))
    cap = F.when(malformed(cap), F.coalesce(field("caption"), cap)).otherwise(cap)
    summ = F.when(malformed(summ), F.coalesce(field("summary"), F.nullif(cap, F.lit("")), summ)).otherwise(summ)
    return F.when(cap == "", summ).otherwise(cap), F.when(summ == "", cap).otherwise(summ)


def model_input(model: str, text: Column, is_query: bool) -> Column:
    """The text with the prefix that a family of embedding models asks for."""
    prefix = "search_query" if is_query else "search_document"
    if "nomic-embed-text" in model.lower():
        return F.concat(F.lit(prefix + ": "), F.trim(text))
    if "e5" in model.lower():
        return F.concat(F.lit(("query" if is_query else "passage") + ": "), F.trim(text))
    return F.trim(text)


def label_cleanup(text: Column, most: int = 50) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "[\"'\n]+", " "), " +", " ")), 1, most)


def time_key(ts: Column, unit: str) -> Column:
    return F.date_format(ts, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit])


def chunks(text: Column, size: int = 1400, overlap: int = 200) -> Column:
    """Paragraphs packed to ``size`` characters; longer ones in windows that overlap, after what was pending."""
    norm = F.regexp_replace(text, "\r\n?", "\n")
    paragraphs = F.filter(F.transform(F.split(norm, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def flushed(acc):
        return F.when(acc["open"] != "", F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])

    def windows(p):
        last = F.greatest(F.lit(0), F.ceil((F.length(p) - size) / F.lit(size - overlap)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.regexp_replace(F.substring(p, i * (size - overlap) + 1, F.lit(size)), r"^\s+|\s+$", ""))
        return F.filter(cut, lambda w: w != "")

    def step(acc, p):
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed(acc), windows(p)).alias("out"), F.lit("").alias("open")))
            .when(F.length(joined) <= size, F.struct(acc["out"].alias("out"), joined.alias("open")))
            .otherwise(F.struct(flushed(acc).alias("out"), p.alias("open")))
        )

    return F.aggregate(paragraphs, state, step, flushed)
