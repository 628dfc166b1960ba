"""Corrections for many words at once, without comparing each with the whole vocabulary.

Two words are likely enough if the letters they have in common in order are four fifths of their mean length. Words of
up to SHORT letters then meet in a word that deletions make of both; a longer word is cut into more pieces than there may
be letters too many, so that one piece stands whole in the other word. What meets is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

LEAST = 0.80  # the ratio that a correction must have
SHORT = 12  # letters; the shortest common words of such a word are 794 at most


def _common(n: Column, m: Column) -> Column:
    """The fewest letters that words of n and m letters must have in common."""
    return F.ceil(F.lit(LEAST / 2) * (n + m) - 1e-9)


def _shortened(word: Column) -> Column:
    """All words that deleting up to a third of the letters leaves; more is never needed, as the other word has two thirds of the letters or more."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    start = F.struct(F.array(word).alias("now"), F.array(word).alias("all"))

    def step(acc, _):
        now = F.array_distinct(F.flatten(F.transform(acc["now"], less)))
        return F.struct(now.alias("now"), F.concat(acc["all"], now).alias("all"))

    rounds = F.filter(F.sequence(F.lit(0), F.floor(F.length(word) / 3).cast("int")), lambda i: i > 0)
    return F.aggregate(rounds, start, step)["all"]


def _pieces(word: Column) -> Column:
    """The word in one piece more than two fifths of its letters, which are two or three letters each."""
    n, parts = F.length(word), F.floor(F.length(word) * 2 / 5) + 1
    at = lambda i: F.floor(i * n / parts).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), (parts - 1).cast("int")), lambda i: word.substr(at(i) + 1, at(i + 1) - at(i))))


def _runs(word: Column) -> Column:
    """All runs of two and of three letters of a word."""
    run = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - (k - 1))), lambda i: word.substr(i, F.lit(k)))
    return F.array_distinct(F.concat(run(2), run(3)))


def alike(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, token, ratio) of all terms (term) and words (token) whose indel ratio is LEAST or more, but for equal ones."""
    terms, words = terms.select("term").where("term <> ''").distinct(), words.select("token").where("token <> ''").distinct()
    n, m = F.length("term"), F.length("token")
    fits = (F.col("term") != F.col("token")) & (_common(n, m) <= F.least(n, m))
    short = lambda df, c: df.where(F.length(c) <= SHORT).select(c, F.explode(_shortened(F.col(c))).alias("left"))
    near = short(terms, "term").join(short(words, "token"), "left").where(fits & (F.length("left") == _common(n, m)))
    cut = lambda df, c, f: df.select(c, F.explode(f(F.col(c))).alias("piece"))
    longer = lambda df, c: df.where(F.length(c) > SHORT)
    first = cut(longer(terms, "term"), "term", _pieces).join(cut(words, "token", _runs), "piece").where(fits & (n >= m))
    second = cut(terms, "term", _runs).join(cut(longer(words, "token"), "token", _pieces), "piece").where(fits & (n < m))
    pairs = near.select("term", "token").unionByName(first.select("term", "token")).unionByName(second.select("term", "token")).distinct()
    return pairs.withColumn("ratio", X.indel_ratio(F.col("term"), F.col("token"))).where(F.col("ratio") >= LEAST)


def corrections(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, correction, ratio): the likeliest other word for each term of five letters or more; ties to the first word.

    Words have three letters or more. What ``ranking.corrections`` gives for a few terms, for a table of them.
    """
    found = alike(terms.where(F.length("term") >= 5), words.where(F.length("token") >= 3))
    return found.groupBy("term").agg(F.min_by("token", F.struct(-F.col("ratio"), F.col("token"))).alias("correction"), F.max("ratio").alias("ratio"))
