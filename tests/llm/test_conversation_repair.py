"""Conversation repair against all edit sequences, the report against a plain reading, awkward rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessera.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
NONE = hashlib.sha256(b"").hexdigest()


def cheapest(turns):
    """(cost, audit) by uniform-cost search over whole audits; no item is merged with another."""
    heap, limit, found = [(0, "", 0, "")], None, []
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            limit = cost
            found.append(audit)
        if audit.endswith("III") or not re.fullmatch("s?(ua)*u?", out):
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", at, out + r))
        if at < len(turns):
            t = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
            if t != "d":
                more = 5 * t.isupper()
                if t.lower() in "sua":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, out + t.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, out + r))
    return limit, min(found)


def test_parse_is_the_cheapest_and_least():
    rng = random.Random(11)
    for n in range(5):
        for _ in range(40):
            turns = "".join(rng.choice("suaxSUAXd") for _ in range(n))
            assert cr.parse(turns) == cheapest(turns), turns


def test_long_conversation_is_linear():
    cost, audit = cr.parse("sua" + "ua" * 30_000)
    assert cost == 0 and audit == "K" * 60_003


def test_memory_of_patterns_is_bounded(monkeypatch):
    monkeypatch.setattr(cr, "KEPT_PATTERNS", 3)
    for t in ("u", "ua", "a", "au", "s"):
        assert cr.repaired_roles(t) == cr.parse(t)
    assert len(cr._known) <= 3


def plain_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            name = ":".join(" " if v is None else str(v) for v in (conv, turn))
            kind = zlib.crc32(name.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        letters, seen, faults = "", set(), [0, 0, 0]
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not bare:
                faults[0], letter = faults[0] + 1, "d"
            elif (role, text) in seen:
                faults[1], letter = faults[1] + 1, "d"
            elif bare[-1] not in ".!?":
                faults[2], letter = faults[2] + 1, letter.upper()
            seen.add((role, text))
            letters += letter
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = cheapest(letters)
        lines, last, at = [], None, 0
        for edit in audit:
            role, text = ("assistant" if last == "u" else "user"), ""
            if edit != "I":
                text, at = kept[at][2], at + 1
                role = kept[at - 1][1] if edit == "K" else role
            if edit != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_report_equals_plain_reading(spark):
    rng, rows = random.Random(5), []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant"])
            rows.append((conv, turn, role, rng.choice([f"said {turn}.", "same!", "open", "", None, "over ", "done. \r\n", f"long {conv}?"])))
    rows += [(None, None, "user", "no key."), (None, 3, "assistant", "ok."), (77, None, "user", "a."), (77, None, None, None)]
    frame = spark.createDataFrame(rows, TURNS)
    got = reported(cr.report(cr.damaged(frame)))
    assert got == plain_report(rows)


def test_registered_query_over_the_given_table(spark):
    from tessera.llm.queries import QUERIES

    got = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001")
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(got) == plain_report(table)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "well?"), (1, 2, "assistant", "yes."), (1, 3, "assistant", "yes."), (2, 0, "assistant", "alone."), (3, 0, "user", " ")]
    got = cr.repaired(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "position").collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    report = reported(cr.report(spark.createDataFrame(rows, TURNS)))
    assert report[1][6] == "DKKD" and by[1] == [("user", "well?", "K"), ("assistant", "yes.", "K")]
    assert report[2][5:7] == (2, "D") and 2 not in by
    assert report[3][5:] == (2, "D", NONE) and 3 not in by


def test_awkward_tables(spark):
    rows = [(1, 0, "user", "x" * 60_000 + "."), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, None, "text.")]
    frame = spark.createDataFrame(rows, TURNS)
    more = frame.selectExpr("*", "1 as head", "2 as mark", "3 as audit", "4 as again", "5 as blank", "6 as times")
    assert reported(cr.report(cr.damaged(more))) == reported(cr.report(cr.damaged(frame))) == plain_report(rows)
    empty = spark.createDataFrame([], TURNS)
    assert cr.report(cr.damaged(empty)).count() == 0 and cr.repaired(empty).count() == 0
    gone = spark.createDataFrame([(9, 0, "user", "a.", True)], TURNS + ", gone boolean")
    assert reported(cr.report(gone)) == {9: (0, 0, 0, 0, 0, 0, "", NONE)}


def test_string_keys(spark):
    rows = [("a", 0, "user", "x."), ("a", 1, "assistant", "y."), (None, 0, "user", "z.")]
    got = reported(cr.report(spark.createDataFrame(rows, TURNS.replace("conv_id long", "conv_id string"))))
    assert got["a"][6] == "KK" and got[None][5:7] == (2, "D")


@pytest.mark.parametrize("turns,audit", [("", ""), ("ua", "KK"), ("sua", "KKK"), ("aua", "DKK"), ("uu", "KR"), ("x", "D"), ("u", "D"), ("suaxua", "KKKDKK")])
def test_known_repairs(turns, audit):
    assert cr.parse(turns)[1] == audit
