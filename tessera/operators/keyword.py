"""Keyword search: a postings table and BM25 over it."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
FLOOR = 1e-6  # least inverse document frequency


def query_terms(query: str) -> list[tuple[str, bool]]:
    """Distinct ASCII tokens in order, and whether each is a prefix (over three characters)."""
    return [(t, len(t) > 3) for t in dict.fromkeys(re.findall("[a-z0-9]+", query.lower()))]


def tokenised(items: DataFrame, key: str, *texts: str) -> DataFrame:
    """(id, tokens) over the joined text columns, Unicode words in lower case."""
    text = F.concat_ws(" ", *texts)
    return items.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)).alias("tokens"))


def postings(tokens: DataFrame, stem: bool = False) -> DataFrame:
    """(term, id, tf, dl): one row per term of an item. Stored by ``write_index`` in buckets of the term."""
    rows = tokens.select("id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    if stem:
        rows = rows.withColumn("term", porter("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def write_index(tokens: DataFrame, table: str, buckets: int = 64, stem: bool = False) -> None:
    """The postings as a bucketed table: whole terms read their buckets alone, and joins on term don't shuffle. Prefixes read all; ``blocks`` serves them."""
    postings(tokens, stem).write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def read_index(spark: SparkSession, table: str) -> DataFrame:
    """Stored postings. A filter on whole terms reads their buckets alone."""
    return spark.table(table)


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl."""
    return tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def term_df(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def _matches(term: str, prefix: bool) -> Column:
    return F.col("term").startswith(term) if prefix else F.col("term") == term


def bm25(index: DataFrame, stats: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """(id, bm25) of the items that hold every term; less is better, as in full-text indexes.

    The index is filtered to the terms before anything is grouped. A prefix counts any token that starts with it.
    """
    if not terms:
        return index.select("id", F.lit(0.0).alias("bm25")).limit(0)
    hit = reduce(lambda a, b: a | b, [_matches(*t) for t in terms])
    which = F.explode(F.array_compact(F.array(*[F.when(_matches(*t), F.lit(i)) for i, t in enumerate(terms)])))
    per = index.where(hit).select("id", "dl", "tf", which.alias("q")).groupBy("id", "q").agg(F.sum("tf").alias("f"), F.first("dl").alias("dl"))
    df = per.groupBy("q").agg(F.count("*").alias("n"))
    rows = per.join(F.broadcast(df), "q").crossJoin(F.broadcast(stats))  # one row a term; one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(FLOOR))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("found")).where(F.col("found") == len(terms)).select("id", "bm25")


def lexical_score(bm25_: Column) -> Column:
    """1 / (1 + max(0, bm25)) to six places; 1 wherever bm25 is negative, as it is for every hit."""
    return F.round(1.0 / (1.0 + F.greatest(F.lit(0.0), bm25_)), 6)


def bm25_batch(index: DataFrame, stats: DataFrame, queries: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(query_id, id, bm25) of many queries (query_id, terms array<string>), whole tokens, all terms needed.

    Frequencies are aggregated apart. Each query starts from the postings of its rarest term, and its other terms are
    looked up for these items alone, so that a common term's postings meet no query that has a rarer one. ``most``
    bounds the asked terms that are sent to every task; more are joined.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    words = asked.select("term").distinct()
    small = words.limit(most + 1).count() <= most
    sent = lambda df: F.broadcast(df) if small else df
    known = index.join(sent(words), "term", "left_semi")
    df = known.groupBy("term").agg(F.count("*").alias("n"))
    ranked_ = asked.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("rarest"), F.count("*").alias("asked"), F.collect_list(F.struct("term", F.coalesce("n", F.lit(0)).alias("n"))).alias("terms"))
    first = ranked_.where(F.forall("terms", lambda t: t["n"] > 0))
    seeds = known.select(F.col("term").alias("rarest"), "id").join(sent(first), "rarest").select("query_id", "id", "asked", F.explode("terms").alias("t")).select("query_id", "id", "asked", "t.term", "t.n")
    rows = seeds.join(known, ["term", "id"]).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("query_id", "id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("found"), F.first("asked").alias("asked"))
    return scored.where("found = asked").select("query_id", "id", "bm25")


def table_terms(text: str | Column) -> Column:
    """The words of ``query_terms`` for a column of queries; their order says nothing."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))))


def bm25_table(index: DataFrame, stats: DataFrame, queries: DataFrame, keep=lambda df: df, most: int = 1_000_000) -> DataFrame:
    """(query_id, id, bm25) of many queries (query_id, text): what ``bm25`` gives for ``query_terms`` of each.

    A term that is asked more than once is searched once. A word of the index meets the terms that it may start with by
    their first four letters, which is an equal join: a term of up to three letters is only matched whole, and every longer one
    has four. An item is one row with the frequencies of all asked terms that it holds, and meets the queries whose rarest term is among
    them; whether it holds their other terms is then seen in the row, so that what doesn't hit is neither shuffled nor stored. ``keep`` may
    store these rows, which are read twice. ``most`` bounds the queries' terms that are sent to every task; more are joined.
    """
    asked = queries.select("query_id", F.explode(table_terms("text")).alias("asked"))
    wanted = asked.select("asked", F.substring("asked", 1, 4).alias("lead")).distinct()
    words = index.select("term").distinct().withColumn("lead", F.substring("term", 1, 4))
    starts = (F.col("term") == F.col("asked")) | ((F.length("asked") > 3) & F.col("term").startswith(F.col("asked")))
    matched = wanted.join(words, "lead").where(starts).select("asked", "term")
    found = index.join(matched, "term").repartition("id").groupBy("asked", "id").agg(F.sum("tf").alias("f"), F.first("dl").alias("dl"))
    per = keep(found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("asked", "f"))).alias("held"), F.first("dl").alias("dl")))
    df = per.select(F.explode(F.map_keys("held")).alias("asked")).groupBy("asked").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    all_ = F.array_sort(F.collect_list(F.struct("asked", n.alias("n"))))
    first = asked.join(df, "asked", "left").groupBy("query_id").agg(F.min_by("asked", F.struct(n, "asked")).alias("rarest"), all_.alias("all"))
    first = first.where(F.forall("all", lambda t: t["n"] > 0)).crossJoin(F.broadcast(stats))  # one row
    small = asked.limit(most + 1).count() <= most
    seeds = per.where("id is not null").select("*", F.explode(F.map_keys("held")).alias("rarest")).join(F.broadcast(first) if small else first, "rarest")
    hits = seeds.where(F.forall("all", lambda t: F.map_contains_key("held", t["asked"])))

    def part(t: Column) -> Column:
        f = F.element_at("held", t["asked"])
        idf = F.greatest(F.log((F.col("n_docs") - t["n"] + 0.5) / (t["n"] + 0.5)), F.lit(FLOOR))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    return hits.select("query_id", "id", (-F.aggregate("all", F.lit(0.0), lambda s, t: s + part(t))).alias("bm25"))


def _measure(stem: str) -> int:
    return len(re.findall("[aeiouy]+[^aeiouy]+", re.sub("^[^aeiouy]*", "", re.sub("(?<![aeiou])y", "i", stem[:1].replace("y", "j") + stem[1:]))))


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _vowel(stem: str) -> bool:
    return bool(re.search("[aeiou]|(?<=.)y", stem))


def _cvc(word: str) -> bool:
    return bool(re.search("[^aeiou][aeiouy][^aeiouwxy]$", word))


def stem_word(word: str) -> str:
    """Porter's published algorithm (1980) for lower-case English words."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and _vowel(word[: -len(e)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"([^aeioulsz])\1$", word):
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, to in sorted((r.split(":") for r in rules), key=lambda r: -len(r[0])):
            if word.endswith(end):
                word = word[: -len(end)] + to if _measure(word[: -len(end)]) > 0 else word
                break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(T.StringType())
def porter(words: pd.Series) -> pd.Series:
    known = {w: stem_word(w) for w in words.dropna().unique()}
    return words.map(known)
