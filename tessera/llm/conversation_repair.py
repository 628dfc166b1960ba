"""Conversation structure repair: error-correcting Earley parsing of the roles of a conversation.

The grammar is weighted and left-linear, so that every chart item starts at the first turn and a column holds one item for each
nonterminal: ``empty``, after a system turn, after a user turn, after an assistant turn. Productions scan a turn (kept, or
with another role), delete one, or insert one without a turn. An item retains its least (cost, audit): the audit as the item it
came from and what was added, and a rank among the audits of its column, which is all that later comparisons need:
audits of one column end in a turn's edit and have as many of these each, so none is the beginning of another. The chart is complete
when a nonterminal that accepts holds all turns; the items back from it give the repair.

Rows are put in order by turn (nulls first; ties by role, then by a hash of the text). What the parser needs of a turn
is one letter; turns stream through the task of their conversation in sorted order, and their texts again once the edits are
known, so that a task holds a letter and four small numbers for each turn of its longest conversation and never its texts. A
conversation's hash runs over its text from first to last, which is why its rows can't be dealt to several tasks.

Nulls count as one space (a null role has a space as its initial, a null text is blank); rows with a null conv_id are one
conversation; repeated rows are duplicates; a very long text is read whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .digest import starts_of

WHITE = " \t\n\x0b\x0c\r"
# costs of the edits; what a truncated turn adds if it isn't deleted
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
# nonterminals, and the productions (from, role scanned, to); those that accept
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = [(EMPTY, "s", SYSTEM), (EMPTY, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT)]
ACCEPT = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
KEPT_PATTERNS, SHORT = 20_000, 64


class _Column:
    """A chart column: for each nonterminal the (cost, rank, inserts) of its best item, or None."""

    def __init__(self, items):
        self.items = items

    def close(self) -> "_Column":
        """Predict and complete by productions that insert a role without a turn, until no item improves."""
        items, changed = list(self.items), True
        while changed:
            changed = False
            for start, role, end in GRAMMAR:
                if items[start] and role != "s":
                    cost, rank, tail, back = items[start]
                    new = (cost + INSERT, rank, tail + "I", back)
                    if items[end] is None or new[:3] < items[end][:3]:
                        items[end], changed = new, True
        return _Column(items)


def _edits(turn: str) -> list[tuple[str, int, int, int]]:
    """(edit, cost, from, to) that may take a turn: ``d`` must be deleted, capitals are truncated, other initials are ``x``."""
    out = [("D", DELETE, n, n) for n in range(4)]
    if turn != "d":
        more = CUT * turn.isupper()
        for start, role, end in GRAMMAR:
            if turn.lower() == role:
                out.append(("K", more, start, end))
            elif role != "s":
                out.append(("R", more + RENAME, start, end))
    return out


EDITS = {t: _edits(t) for t in "suaxSUAXd"}


def parse(turns: str) -> tuple[int, str]:
    """The least cost and, of the audits of that cost, the least in ASCII."""
    column, chart = _Column([(0, 0, "", None), None, None, None]).close(), []
    for turn in turns:
        scanned: list = [None] * 4
        for edit, cost, start, end in EDITS[turn]:
            if item := column.items[start]:
                new = (item[0] + cost, item[1], item[2] + edit, item[3])
                if scanned[end] is None or new[:3] < scanned[end][:3]:
                    scanned[end] = new
        order = sorted({i[1:3] for i in scanned if i})
        chart.append([i and (i[3], i[2]) for i in scanned])
        column = _Column([i and (i[0], order.index(i[1:3]), "", n) for n, i in enumerate(scanned)]).close()
    cost, _, tail, back = min((column.items[n] for n in ACCEPT if column.items[n]), key=lambda i: i[:3])
    audit = [tail]
    for before in reversed(chart):
        back, added = before[back]
        audit.append(added)
    return cost, "".join(reversed(audit))


_known: dict[str, tuple[int, str]] = {}


def repaired_roles(turns: str) -> tuple[int, str]:
    """``parse``; short patterns of turns are kept, KEPT_PATTERNS at most."""
    if len(turns) > SHORT:
        return parse(turns)
    if turns not in _known:
        if len(_known) >= KEPT_PATTERNS:
            _known.clear()
        _known[turns] = parse(turns)
    return _known[turns]


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def cut_short(text: Column) -> Column:
    """Whether the last character that isn't white space is none of ``.!?``."""
    return ~F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1).isin(".", "!", "?")


def _texts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, gone, role, text and mark (a hash of role and text) in the stated reading of nulls."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = turns["gone"] if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), gone.alias("gone"), role.alias("role"), text.alias("text"))
    return rows.withColumn("mark", F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)))


def _segments(batches):
    """(whether a conversation begins, slice) of sorted batches: a slice has rows of one conversation."""
    last = ()
    for b in batches:
        starts = starts_of(b, 1).tolist()
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            conv = (b.column(0)[s].as_py(),)
            yield conv != last, b.slice(s, e - s)
            last = conv


class _Turns:
    """What is kept of the turns of a conversation read so far."""

    def __init__(self, conv):
        self.conv, self.letters = conv, bytearray()
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.initial = None

    def add(self, turn, initial, fault) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        letter = initial if initial in ("s", "u", "a") else "x"
        if fault:
            self.faults[fault] += 1
            letter = letter.upper() if fault == "t" else "d"
        self.letters += letter.encode()

    def report(self) -> list:
        cost, audit = repaired_roles(self.letters.decode())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [self.conv, gaps, *self.faults.values(), self.illegal, cost, audit]


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_REPORT = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in REPORT)


def _batch(rows: list[list], like: pa.DataType, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([like, *kinds])], ["conv_id", *names])


def parsed(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation; rows that are ``gone`` only name it."""
    rows = _texts(turns)
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "mark").orderBy(F.col("turn").asc_nulls_first())) > 1
    small = rows.select("conv_id", "gone", "turn", "role", "mark", blank(F.col("text")).alias("blank"), cut_short(F.col("text")).alias("cut")).withColumn("again", again)
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), "t")
    ordered = small.withColumn("fault", fault).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "again")
    ordered = ordered.select("conv_id", "gone", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    kinds = [pa.int64()] * 6 + [pa.string()]

    def run(batches):
        state, done, like = None, [], None
        for new, b in _segments(batches):
            like = b.schema.types[0]
            if new:
                if state:
                    done.append(state.report())
                state = _Turns(b.column(0)[0].as_py())
            for gone, turn, initial, fault in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if not gone:
                    state.add(turn, initial, fault)
            if len(done) >= 1000:
                yield _batch(done, like, REPORT, kinds)
                done = []
        if state:
            yield _batch([*done, state.report()], like, REPORT, kinds)

    return ordered.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_REPORT}")


class _Repair:
    """Applies an audit to the turns of a conversation, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, None

    def _next(self) -> str:
        return "a" if self.last == "u" else "u"

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.last = self._next()
            yield ROLES[self.last], "", "I"

    def turn(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.last = self._next()
            yield ROLES[self.last], text, "R"
        elif edit == "K":
            self.last = role[0]
            yield role, text, "K"


def _walked(turns: DataFrame) -> DataFrame:
    """Each conversation's report, then its turns in order, with the texts: what ``repaired`` and ``report`` read."""
    rows = _texts(turns).where("not gone")
    body = rows.select("conv_id", F.lit(1).alias("head"), "turn", "role", "mark", "text", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in REPORT])
    heads = parsed(turns).select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("text"), *REPORT)
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "mark")
    return ordered.select("conv_id", "head", "role", "text", *REPORT)


def _rows_of(batches):
    """(conv_id, its type, report or None, repaired rows): a conversation's report comes first and alone, its last inserts at the end."""
    repair, conv, like = None, None, None
    for new, b in _segments(batches):
        like = b.schema.types[0]
        if new:
            if repair:
                yield conv, like, None, list(repair.inserts())
            conv = b.column(0)[0].as_py()
            head = [b.column(4 + i)[0].as_py() for i in range(len(REPORT))]
            repair, b = _Repair(head[-1]), b.slice(1)
            yield conv, like, head, []
        rows = [out for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) for out in repair.turn(role, text)]
        yield conv, like, None, rows
    if repair:
        yield conv, like, None, list(repair.inserts())


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text and edit (K kept, R with another role, I inserted) of the repaired turns."""

    def run(batches):
        position = 0
        for conv, like, head, rows in _rows_of(batches):
            position = 0 if head else position
            if rows:
                out = [[conv, position + i, *r] for i, r in enumerate(rows)]
                position += len(rows)
                yield _batch(out, like, ["position", "role", "text", "edit"], [pa.int64(), *[pa.string()] * 3])

    return _walked(turns).mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, role string, text string, edit string")


def report(turns: DataFrame) -> DataFrame:
    """What ``parsed`` gives, and the SHA-256 of the repaired ``role:text`` lines joined by newlines (of nothing if none is left)."""

    def run(batches):
        done, digest, empty, like = [], None, True, None
        for conv, like, head, rows in _rows_of(batches):
            if head:
                if digest:
                    done[-1].append(digest.hexdigest())
                if len(done) >= 1000:
                    yield _batch(done, like, [*REPORT, "repaired_sha256"], kinds)
                    done = []
                done.append([conv, *head])
                digest, empty = hashlib.sha256(), True
            for role, text, _edit in rows:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if digest:
            done[-1].append(digest.hexdigest())
            yield _batch(done, like, [*REPORT, "repaired_sha256"], kinds)

    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return _walked(turns).mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_REPORT}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: of the crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes its role user."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def damage_report(spark, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations")))
