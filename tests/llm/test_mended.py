"""Cases that earlier versions got wrong, and what decides them now."""

import numpy as np

from tessera.llm import html_main, neardup, secret_scan

from .helpers import docs, near_classes

PAGES = "page_id long, url string, html string"


def thue_morse(letters, n=1024):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_words_whose_polynomial_hashes_collide_do_not_link(spark):
    rows = [(1, f"{thue_morse('ab')} b c d"), (2, f"{thue_morse('ba')} b c d"), (3, f"{thue_morse('ab')} b"), (4, f"{thue_morse('ba')} b"), (5, f"{thue_morse('ab')} b c d")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), width=4, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_a_whole_short_text_is_no_shingle_of_a_longer_one():
    assert not np.intersect1d(neardup.shingles("a b", 3), neardup.shingles("a b c", 3)).size
    assert not np.intersect1d(neardup.shingles("a", 1), neardup.shingles("a", 3)).size or len(neardup.shingles("a", 3)) == 1


def test_several_blocks_in_a_bucket(spark, monkeypatch):
    """Graded copies of one text in one crowd, with buckets of many small blocks: nothing is lost against all pairs."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(160):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), width=3, percent=85).collect()}
    want = near_classes(rows, 3, 85)
    assert got == want and 2 < len({c for _, c in want.values()}) < 160


FURNITURE = "<nav>Home News About</nav><article><h1>Day {0}</h1><p>what happened on day {0}</p><div class='share-price'>quotes come late by fifteen minutes and are given without any warranty at all</div></article><footer>all rights reserved</footer>"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_pages_with_the_same_furniture_are_different_pages(spark):
    got = texts(spark, [(i, f"http://h.example/{i}", FURNITURE.format(i)) for i in range(4)])
    assert got == {i: f"Day {i}\n\nwhat happened on day {i}" for i in range(4)}
    alone = texts(spark, [(i, "http://h.example/", FURNITURE.format(7)) for i in range(3)])
    assert set(alone.values()) == {"Day 7\n\nwhat happened on day 7\n\nquotes come late by fifteen minutes and are given without any warranty at all"}


def test_headings_of_an_article_stay(spark):
    page = "<article><h1 class='entry-header'>Weekly notes</h1><p>number {0}</p></article>"
    assert texts(spark, [(i, "http://h.example/", page.format(i)) for i in range(3)]) == {i: f"Weekly notes\n\nnumber {i}" for i in range(3)}


def test_names_are_matched_whole(spark):
    page = "<main><div class='ad-hoc-analysis'>one</div><p class='comments-on-draft'>two</p><div class='popup-book'>three</div><p class='promo-code'>four</p><div id='comment-free'>five</div>{}</main>"
    dropped = "".join(f"<div class='{c}'>gone</div>" for c in "ad ad-slot promo-box cookie-banner newsletter-signup comment-list comment-body user-comments sponsored-content popup-overlay adverts replies".split())
    assert texts(spark, [(1, "http://h.example/", page.format(dropped))]) == {1: "one\n\ntwo\n\nthree\n\nfour\n\nfive"}


def test_long_values_are_spanned_whole(spark):
    key = "".join(f"{(i * 2654435761) & 0xFFFFFFFF:08x}" for i in range(1, 55))[:430]
    rows = [(1, f'token = "{key}" ends'), (2, f"see {key} there"), (3, f"password: {key[:200]}!{key[200:]}")]
    found = secret_scan.candidates(docs(spark, rows), ["doc_id"], secret_scan.Words(), source=None).select("doc_id", "start", "end").collect()
    assert sorted(map(tuple, found)) == [(1, 9, 439), (2, 4, 434), (3, 10, 441)]
