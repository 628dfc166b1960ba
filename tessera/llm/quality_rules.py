"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

The target multinomial counts every trusted row, the raw one every row. A document's ratio is divided by its number of n-grams and held against one fixed threshold, so that equal texts get
equal verdicts.

Null and empty texts have no words and fail the base rule; without any trusted row the ratio is 0 for all
documents, which passes; a ratio of just the threshold passes; repeated rows are counted and judged as often as they
stand; very long texts are read whole, one at a time; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import grams as G
from .common import slices, text_buffer

THRESHOLD = -0.25  # nats an n-gram
ALPHA = 1.0
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def repeat_words(words: list, window: int = WINDOW) -> int:
    """How many words stand in ``window``-word runs (8 = three doublings) found twice or more; exact."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width, counts = 1, None
    while width < window:
        a, b = ids[:-width], ids[width:]
        unique, ids, counts = np.unique(a * (int(ids.max()) + 1) + b, return_inverse=True, return_counts=True)
        if len(unique) == len(ids):
            return 0
        width *= 2
    twice = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0d only
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids of all rows of quality 1."""
    return labels.where("quality = 1").select("doc_id")


def fit(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", alpha: float = ALPHA) -> np.ndarray:
    return G.log_ratio(*G.multinomials(docs, target, text, key, shapes=False), alpha)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, base verdict, mean log-likelihood ratio and whether it is kept."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted_ids(labels), text, key))

    def run(batches):
        for b in batches:
            total, n = [], []
            for i, j in slices(b.column(1)):
                s, k = G.sums(*text_buffer(b.column(1).slice(i, j - i)), weights.value, shapes=False)
                total += s.tolist()
                n += k.tolist()
            rows = []
            for t, s, k in zip(b.column(1), total, n):
                words, *rest = base = base_counts(t.as_py())
                failed = words < 20 or 100 * rest[3] > 30 * words
                llr = G.mean(s, k)
                rows.append((*base, failed, llr, not failed and llr >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(cols, kinds))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[key].cast("long"), docs[text]).mapInArrow(run, SCHEMA)
