"""Conversation repair against a plain alignment with every target length."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

from hypothesis import given, settings, strategies as st

from tidemark.llm import conversation as C
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, here int"


def plain_alignment(rows):
    """``(cost, audit)`` over all targets; ``rows`` are (role initial, must go, truncated)."""

    @lru_cache(maxsize=None)
    def best(i, target):
        found = [] if i < len(rows) or target else [(0, "")]
        if i < len(rows):
            role, must_go, truncated = rows[i]
            cost, audit = best(i + 1, target)
            found.append((cost + 4, "D" + audit))
            if target and not must_go and (role == target[0] or target[0] != "s"):
                cost, audit = best(i + 1, target[1:])
                keeps = role == target[0]
                found.append((cost + 3 * truncated + (0 if keeps else 3), ("K" if keeps else "R") + audit))
        if target and target[0] != "s":
            cost, audit = best(i, target[1:])
            found.append((cost + 3, "I" + audit))
        return min(found, default=(10**9, ""))

    pairs = ["ua" * p for p in range(len(rows) + 2)]
    return min(best(0, t) for t in [*pairs, *("s" + p for p in pairs[1:])])


ROLES = {"u": 0, "a": 1, "s": 2, "x": 3}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("uuaasx"), st.sampled_from("...dt")), max_size=9))
def test_alignment_equals_the_plain_one(rows):
    codes = bytes(ROLES[r] | {".": 0, "d": 4, "t": 8}[f] for r, f in rows)
    assert C.align(codes) == plain_alignment(tuple((r, f == "d", f == "t") for r, f in rows))


def test_long_conversations_keep_few_rows_in_memory():
    codes = bytes([0, 0, 1, 1] * 400 + [2, 0, 4, 8, 1] * 300)
    cost, audit = C.align(codes)
    assert len(audit) - audit.count("I") == len(codes) and cost > 0
    assert C.align(bytes([0, 1] * 10_000)) == (0, "K" * 20_000)
    assert C.align(bytes([0] * 4_000)) == (6_000, "KR" * 2_000)


def brute(rows):
    """The whole operator in plain Python: rows are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        talk = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            talk += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in talk:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain_alignment(tuple((r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(talk, faults)))
        length = len(audit) - audit.count("D")
        target, lines, rest = iter("s" * (length % 2) + "ua" * (length // 2)), [], iter(talk)
        for edit in audit:
            row = None if edit == "I" else next(rest)
            if edit != "D":
                initial = next(target)
                role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[initial]
                lines.append(f"{role}:{row[2] if row else ''}")
        turns = [t for t, _, _ in talk if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_matches_brute_force(spark):
    rows = table(spark, SF, "conversations")
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
    got = C.repair(C.damaged(rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == len(want) and collected(got) == want


def test_odd_conversations(spark):
    rows = [
        (None, None, None, None, "x", 1), (None, 3, "user", "Hm.", "x", 1), (1, None, "system", "S.", "x", 1), (1, None, "user", "", "x", 1),
        (1, 7, "", "a ", "x", 1), (1, 2, "user", "Same.", "x", 1), (1, 2, "user", "Same.", "x", 1), (1, 2, "assistant", "Same.", "x", 1),
        (2, 0, "assistant", "x" * 100_000, "x", 1), (3, -5, "system", "Only.", "x", 1), (1 << 60, 9, "tool", "Long id!", "x", 1),
        *[(4, t, "user", f"Question {t}?", "x", 1) for t in range(0, 40, 2)], *[(c, 0, "user", "Drop?", "x", 1) for c in range(100, 160)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:4] for r in rows])
    assert collected(C.repair(C.damaged(df))) == want
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert nothing in want.values()
    assert C.repair(C.damaged(df.limit(0))).count() == 0
