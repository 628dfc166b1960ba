"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned: words, and stems (prefixes with many endings), that labelled toxic training rows hold far
more often than clean ones. A text's words run through the product of the lexicon trie and the Levenshtein automata
of its terms, built as far as words need it and kept by worker, so misspelt terms are found too. Words that clean
training rows hold are no misspellings, and terms with many such neighbours must be spelt right. Each hit has a
window of WINDOW words to either side: quotation marks around it or words that report speech there count as
quotation. The hits' weights by kind (exact, misspelt, quoted) and the text's length (a long text has chance hits)
go into a logistic regression, shrunk towards PRIOR, that gives the score.

Training rows are those with crc32(doc_id) mod 3 other than 1, at most TRAIN_BOUND of each label, the first by a
hash of the id; of copies (estimated word Jaccard of COPY or more) one counts. The lexicon holds at most LEXICON_BOUND
words and STEM_BOUND stems, those that the toxic training rows owe most to. Limits of a score, the same at every
size: a word counts REPEATS times in a text, length up to LONGEST hundred words, and words of 4 to 40 letters can be
misspelt (shorter ones have too many neighbours, longer ones no term within two errors).

Without training rows of both labels nothing is known to be toxic: the lexicon is empty and every score is the
prior's. Null and empty texts have no hits and get a score all the same; very long texts are read whole, one at a
time; a null doc_id is held_out null; repeated rows get equal scores; ties go to the first term; an empty table gives
an empty one; other columns are no inputs and pass through ``keep``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, crc32_of_id, held, trim, written

TRAIN_BOUND = 10_000  # labelled rows of each class
LEXICON_BOUND, STEM_BOUND = 5_000, 1_000
LEAST_ROWS, LEAST_SHARE = 4, 0.01  # toxic rows with a term
LEAST_LIFT, STEM_LIFT = 3.0, 1.6  # log ratios of rates a word
STEM_LENGTHS, ENDINGS = (4, 9), 5
NEIGHBOURS = 10  # benign words near a term that must be spelt right from then on
WINDOW = 6
CUT = 0.7
TABLE_ROWS = 100_000
#: intercept, exact, misspelt, quoted, hundreds of words
PRIOR = np.asarray([-3.0, 1.0, 0.4, 0.2, -0.5])
TIGHTNESS = np.asarray([0.1, 2.0, 8.0, 8.0, 2.0])
LONGEST = 15.0  # hundreds of words that length counts for
REPEATS = 2  # times that one word counts in a text
MINIMA, BAND, COPY = 128, 4, 0.9  # least hashes of a training text; those that find a likely copy; share of equal ones in a copy
FACTORS = np.random.default_rng(7).integers(1 << 62, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
QUOTES = "\"'«»„“”‚‘’‹›`"
#: Fixed words that report or name what somebody else said.
REPORTS = frozenset("said says called calling wrote quote quoted quoting word term dit disait appelé sagte nannte zitat dijo llamó cita".split())
_LEET = str.maketrans("013457@$", "oieastas")


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of a lexicon times the Levenshtein automata of its terms, made deterministic as it is used."""

    MOVES = 100_000  # kept at a time; states are shared

    def __init__(self, terms: list[str], strict: frozenset = frozenset()):
        self.terms = terms
        self.limits = [0 if t in strict else errors_allowed(t) for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.allowed: list[int] = [0]
        for number, term in enumerate(terms):
            node, limit = 0, self.limits[number]
            for c in term:
                self.allowed[node] = max(self.allowed[node], limit)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.allowed.append(0)
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], limit)
            self.ends[node] = number
        self._reset()

    def _reset(self) -> None:
        """Forget all states but the first: numbers of frozensets, their moves and what they accept."""
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.made = 0
        self.start = self._number(self._closed({0: 0}))

    def _number(self, state: frozenset) -> int:
        """The number of a state; -1 of the dead one."""
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            found = [(e, self.ends[node]) for node, e in state if self.ends[node] >= 0 and e <= self.limits[self.ends[node]]]
            self.accepts.append(min(found)[::-1] if found else None)
        return self.numbers[state]

    def _closed(self, states: dict[int, int]) -> frozenset:
        """Fewest errors by trie node, with terms' letters left out."""
        todo = list(states)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                if (e := states[node] + 1) <= self.allowed[child] and e < states.get(child, 9):
                    states[child] = e
                    todo.append(child)
        return frozenset(states.items())

    def _move(self, state: frozenset, c: str) -> frozenset:
        after: dict[int, int] = {}
        for node, e in state:
            if e < after.get(node, 9) - 1 and e + 1 <= self.allowed[node]:
                after[node] = e + 1
            for letter, child in self.children[node].items():
                n = e + (letter != c)
                if n <= self.allowed[child] and n < after.get(child, 9):
                    after[child] = n
        return self._closed(after)

    def find(self, word: str) -> tuple[int, int] | None:
        """(term number, errors) of the nearest term, the first of these; None if none is near enough."""
        state, moves = self.start, self.moves
        for c in word:
            after = moves[state].get(c)
            if after is None:
                old = self.sets[state]
                if self.made >= self.MOVES:
                    self._reset()
                    moves, state = self.moves, self._number(old)
                after = moves[state][c] = self._number(self._move(old, c))
                self.made += 1
            if after < 0:
                return None
            state = after
        return self.accepts[state]


def plain(chunk: str) -> str:
    """A chunk between spaces as the lexicon spells words: lower case, no marks at or between letters, digits read as letters."""
    word = chunk.lower()
    if word.isalpha():
        return word
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    word = word[first:last]
    if word.isalpha() or not any(map(str.isalpha, word)):
        return word if word.isalpha() else ""
    return "".join(filter(str.isalpha, word.translate(_LEET)))


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    stems: dict[str, float] = field(default_factory=dict)
    benign: frozenset = frozenset()
    strict: frozenset = frozenset()
    coefficients: list[float] = field(default_factory=lambda: PRIOR.tolist())


class Scorer:
    """A worker's tables for one model."""

    def __init__(self, model: Model):
        self.model = model
        self.exact = dict(zip(model.terms, model.weights))
        self.automaton = Automaton(model.terms, model.strict)
        self.sizes = sorted({len(x) for x in model.stems}, reverse=True)
        self.table: dict[str, tuple[float, int] | None] = {}

    def look(self, chunk: str) -> tuple[float, int] | None:
        """Weight and errors of a chunk's term; None if it is none."""
        word = plain(chunk)
        found = None
        if word in self.exact:
            found = (self.exact[word], 0)
        elif stem := next((x for n in self.sizes if (x := word[:n]) in self.model.stems), None):
            found = (self.model.stems[stem], 0)
        elif 4 <= len(word) <= 40 and word not in self.model.benign and (near := self.automaton.find(word)):
            found = (self.model.weights[near[0]], near[1])
        if len(self.table) >= TABLE_ROWS:
            self.table.clear()
        self.table[chunk] = found
        return found

    def hits(self, text: str | None) -> tuple[list[str], list[tuple[int, float, int]]]:
        """The chunks of a text, and (place, weight, errors) of each hit."""
        chunks, table, out = (text or "").split(), self.table, []
        for i, chunk in enumerate(chunks):
            found = table[chunk] if chunk in table else self.look(chunk)
            if found:
                out.append((i, *found))
        return chunks, out

    def quoted(self, chunks: list[str], at: int) -> bool:
        before, after = chunks[max(0, at - WINDOW) : at], chunks[at + 1 : at + 1 + WINDOW]
        opens = chunks[at][0] in QUOTES or any(c[0] in QUOTES for c in before)
        closes = chunks[at].rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(c.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for c in after)
        return (opens and closes) or any(plain(c) in REPORTS for c in before)

    def features(self, text: str | None) -> list[float]:
        """1, weight of exact, misspelt and quoted hits, hundreds of words."""
        return self._features(*self.hits(text))

    def _features(self, chunks: list[str], hits: list[tuple[int, float, int]]) -> list[float]:
        sums, seen = [0.0, 0.0, 0.0], Counter()
        for at, weight, errors in hits:
            word = chunks[at].lower()
            seen[word] += 1
            if seen[word] > REPEATS:
                continue
            sums[2 if self.quoted(chunks, at) else 1 if errors else 0] += weight
        return [1.0, *sums, min(LONGEST, len(chunks) / 100)]

    def score(self, text: str | None) -> float:
        return self.judged(text)[0]

    def judged(self, text: str | None) -> tuple[float, int]:
        """Score and number of hits, from one pass."""
        chunks, hits = self.hits(text)
        z = sum(a * b for a, b in zip(self.model.coefficients, self._features(chunks, hits)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(hits)


def scorer(model: Model) -> Scorer:
    """The worker's scorer of a model."""
    mark = zlib.crc32(repr((model.terms, model.weights, model.stems, sorted(model.strict), sorted(model.benign), model.coefficients)).encode())
    return held(f"scorer {mark}", lambda: Scorer(model))


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights under a normal prior around PRIOR, by Newton's method with halved steps."""

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + (TIGHTNESS * (w - PRIOR) ** 2).sum() / 2)

    w, now = PRIOR.copy(), loss(PRIOR)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(TIGHTNESS), x.T @ (y - p) - TIGHTNESS * (w - PRIOR))
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if now - after < 1e-9:
            break
        w, now = w + step, after
    w[1:4] = np.maximum(w[1:4], 0)
    w[4] = min(w[4], 0)
    return w.tolist()


def sketch(words: set[str]) -> bytes:
    """The least hash of the words by each of MINIMA hash functions."""
    hashes = np.asarray([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[i : i + 4096, None] * FACTORS) >> np.uint64(32)).min(0))
    return least.astype("<u4").tobytes()


def _unlike(rows: DataFrame, label: dict[int, int]) -> dict[int, int]:
    """The training rows with one of each group of copies, the smallest id; texts are copies where COPY of their minima agree."""
    known = rows.sparkSession.sparkContext.broadcast(label)

    def run(batches):
        for b in batches:
            out = [(x, sketch(set((t.as_py() or "").lower().split()))) for x, t in zip(b.column(0).to_pylist(), b.column(1)) if x in known.value]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["doc_id", "minima"])

    found = rows.mapInArrow(run, "doc_id long, minima binary").groupBy("doc_id").agg(F.min("minima").alias("minima")).collect()
    found = sorted((r["doc_id"], bytes(r["minima"])) for r in found)
    table, kept, bands = np.empty((len(found), MINIMA), "<u4"), {}, {}
    for x, raw in found:
        here = table[len(kept)] = np.frombuffer(raw, "<u4")
        keys = [(label[x], i, raw[4 * i : 4 * (i + BAND)]) for i in range(0, MINIMA, BAND)]
        near = list({n for k in keys for n in bands.get(k, ())})
        if near and (table[near] == here).mean(1).max() >= COPY:
            continue
        for k in keys:
            bands.setdefault(k, []).append(len(kept))
        kept[x] = label[x]
    return kept


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", bound: int = TRAIN_BOUND) -> Model:
    spark = docs.sparkSession
    train = labels.where(crc32_of_id(F.col("doc_id")) % 3 != 1)
    label = {x: 1 for x in bounded_ids(train.where("toxic = 1"), bound)}
    label |= {x: 0 for x in bounded_ids(train.where("toxic = 0"), bound) if x not in label}
    if not 0 < sum(label.values()) < len(label):
        return Model()
    # the bounded training rows are taken out of the corpus once
    ids = spark.createDataFrame(sorted(label.items()), "doc_id long, label int")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).join(F.broadcast(ids), "doc_id")
    rows = written(rows.withColumn("mark", F.xxhash64("text")).dropDuplicates(["doc_id", "mark"]).select("doc_id", "text"), "training")
    label = _unlike(rows, label)
    known = spark.sparkContext.broadcast(label)

    def words(batches):
        for b in batches:
            found: dict[str, list[int]] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1)):
                if (y := known.value.get(x)) is not None:
                    for w, n in Counter(map(plain, (t.as_py() or "").split())).items():
                        counts = found.setdefault(w if 3 <= len(w) <= 40 else "", [0, 0, 0, 0])
                        counts[y] += 1
                        counts[2 + y] += min(n, REPEATS) if w else n
            n = list(found.values())
            arrays = [pa.array([v[i] for v in n], pa.int64()) for i in (1, 0, 3, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *arrays], ["word", "toxic", "clean", "toxic_n", "clean_n"])

    n_toxic = sum(label.values())
    model = Model()
    if 0 < n_toxic < len(label):
        counted = rows.mapInArrow(words, "word string, toxic long, clean long, toxic_n long, clean_n long")
        totals = [F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_n", "clean_n")]
        counts = written(counted.groupBy("word").agg(*totals), "toxic-words")
        in_toxic, in_clean = (x or 0 for x in counts.agg(F.sum("toxic_n"), F.sum("clean_n")).first())
        lift = F.log((F.col("toxic_n") + 0.5) / (in_toxic + 1)) - F.log((F.col("clean_n") + 0.5) / (in_clean + 1))
        least = max(LEAST_ROWS, LEAST_SHARE * n_toxic)
        terms = counts.where("word <> ''").where(F.col("toxic") >= least).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
        low, high = STEM_LENGTHS
        ends = counts.where(F.length("word") >= low).select(F.explode(F.expr(f"transform(sequence({low}, least({high}, length(word))), n -> substring(word, 1, n))")).alias("stem"), "toxic", "clean", "toxic_n", "clean_n")
        stems = ends.groupBy("stem").agg(*totals, F.count(F.when(F.col("toxic_n") > 0, 1)).alias("endings")).where(F.col("toxic") >= 2 * least)
        stems = stems.where(F.col("endings") >= ENDINGS).withColumn("lift", lift).where(F.col("lift") >= STEM_LIFT)
        gain = F.col("lift") * F.col("toxic_n")
        for r in stems.orderBy(F.desc(gain), F.desc(F.length("stem")), "stem").limit(STEM_BOUND).collect():
            if not any(r["stem"].startswith(x) or x.startswith(r["stem"]) for x in model.stems):
                model.stems[r["stem"]] = float(r["lift"])
        for r in terms.orderBy(F.desc(gain), "word").limit(LEXICON_BOUND).collect():
            if not any(r["word"].startswith(x) for x in model.stems):
                model.terms.append(r["word"])
                model.weights.append(float(r["lift"]))
        known_terms, sent = set(model.terms), spark.sparkContext.broadcast(model.terms)

        def alike(batches):
            automaton = Automaton(sent.value)
            for b in batches:
                near = [None if w in known_terms else automaton.find(w) for w in b.column(0).to_pylist()]
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array([n and automaton.terms[n[0]] for n in near], pa.string())], ["word", "term"])
                yield out.filter(out.column(1).is_valid())

        near = counts.where("clean > 0 and word <> ''").select("word").mapInArrow(alike, "word string, term string").collect()
        model.strict = frozenset(t for t, n in Counter(r["term"] for r in near).items() if n > NEIGHBOURS)
        model.benign = frozenset(r["word"] for r in near if r["term"] not in model.strict)
        current = spark.sparkContext.broadcast(model)

        def features(batches):
            s = scorer(current.value)
            for b in batches:
                out = [(known.value[x], *s.features(t.as_py())) for x, t in zip(b.column(0).to_pylist(), b.column(1)) if x in known.value]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.float64()) for i in range(6)], list("yabcde"))

        data = rows.mapInArrow(features, "y double, a double, b double, c double, d double, e double").collect()
        table_ = np.asarray(sorted(map(tuple, data)), float).reshape(-1, 6)
        if len(table_):
            model.coefficients = logistic(table_[:, 1:], table_[:, 0])
        for sent_out in (sent, current):
            sent_out.unpersist()
    known.unpersist()
    trim()  # the driver's
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", cut: float = CUT, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits; with ``keep`` the rows of ``docs`` that aren't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def clean(batches):
        s = scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([s.score(t.as_py()) < cut for t in b.column(place)], pa.bool_()))

    def run(batches):
        s = scorer(shared.value)
        for b in batches:
            judged = [s.judged(t.as_py()) for t in b.column(1)]
            scores = [x for x, _ in judged]
            held_out = [None if x is None else zlib.crc32(str(x).encode()) % 3 == 1 for x in b.column(0).to_pylist()]
            arrays = [b.column(0), pa.array(held_out, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(x >= cut) for x in scores], pa.int32()), pa.array([n for _, n in judged], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted", "n_hits"])

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return score(docs, fit(docs, labels, text, key), text, key)
