"""Conversation structure repair by Wagner-Fischer alignment with every feasible length of the alternating grammar.

A repaired conversation reads ``(s?(ua)+)?``: optionally a system turn, then user and assistant in turn, or nothing. So a
target string is fixed by its length: even lengths alternate, odd ones (three or more) have an ``s`` in front. All of them
end alike, which lets one Wagner-Fischer matrix serve every length: entry ``[i][k]`` is the least cost of turning the rows
from ``i`` on into the last ``k`` characters. A Ukkonen band keeps of each row only entries that can still lie on a script
no dearer than the incumbent, the cost of the best script found by one forward pass over the grammar's states. All lengths
that reach the least cost are traced back together; at every edit those with the lesser initial go on, so the audit is the
ASCII-least of all cheapest scripts. Rows of the matrix are kept at intervals and recomputed for the trace, so a long
conversation needs memory for a few of them.

In Spark, rows carry only codes and digests until the scripts are known. Both passes over a conversation read its rows in
order from a sorted partition one by one: the first holds one byte a row, the second applies the script to the texts and
feeds them into the digest. A conversation of any length is thus never gathered with its texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
_FAR = 1 << 40
_BLANK = r"\x20\x09-\x0D"
# A row's code: its role (0 user, 1 assistant, 2 system, 3 other) and its fault (0 none, 4 must go, 8 truncated).
_MUST_GO, _TRUNCATED = 4, 8
_AUDIT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_OUT = _AUDIT + ", repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, here)``: the rows after damage; a dropped one stays with ``here`` false.

    Null role and text, and null parts of the damage key, read as one space. The repeated row comes twice.
    """

    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    hit = rows.select(*ids, spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(key) % 20).alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    here = F.col("_hit") != 0
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), here.alias("here"), copies.alias("_copy")).drop("_copy")


def _order() -> list[Column]:
    """Rows of a conversation: by turn, null first; within a turn by role, then digest of the text, copies together."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``digest`` of the text and without the text: initial of the role, blank, ended, repeat."""
    solid = f"[^{_BLANK}]"
    flagged = rows.select(
        "conv_id", "turn", "role", "here", F.sha2("text", 256).alias("digest"),
        (~F.col("text").rlike(solid)).alias("blank"), F.col("text").rlike(rf"[.!?][{_BLANK}]*\z").alias("ended"),
    )
    same = Window.partitionBy("conv_id", "here", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    return flagged.withColumn("repeat", F.row_number().over(same) > 1)


def _costs(code: int) -> tuple[int, int, int]:
    """What a row costs deleted, kept in place and reroled."""
    if code & _MUST_GO:
        return DELETE, _FAR, _FAR
    extra = UNFINISHED if code & _TRUNCATED else 0
    return DELETE, extra, REROLE + extra


def _forward(codes: bytes) -> tuple[np.ndarray, int]:
    """Least cost of the rows before each place with an even or an odd number of characters still to come, and the least
    cost of a whole script. An ``s`` must be kept, before any other character, and a pair must follow it."""
    out = np.full((len(codes) + 1, 2), _FAR, np.int64)
    none, system, even, odd = 0, _FAR, _FAR, INSERT
    out[0] = none, odd
    for i, code in enumerate(codes):
        drop, keep, rerole = _costs(code)
        role = code & 3
        user, assistant = keep if role == 0 else rerole, keep if role == 1 else rerole
        even, odd = min(even + drop, odd + assistant), min(odd + drop, min(none, system, even) + user)
        system = min(system + drop, none + keep if role == 2 else _FAR)
        none += drop
        even = min(even, odd + INSERT)
        odd = min(odd, min(none, system, even) + INSERT)
        out[i + 1] = min(none, system, even), odd
    return out, min(none, even)


class _Matrix:
    """The banded matrix of one conversation: per row ``i`` the first ``k`` of the band, plain and ``s``-pending costs.

    The plain entry is the cost of making the last ``k`` characters; the pending one, of making an ``s`` and then them.
    """

    def __init__(self, codes: bytes):
        n = len(codes)
        self.codes = codes
        self.before, self.limit = _forward(codes)
        most = self.limit // INSERT + 2
        last = INSERT * np.arange(most + 1, dtype=np.int64)
        self.step = max(8, math.isqrt(n))
        row = self._cut(n, 0, last, np.full(most + 1, _FAR, np.int64))
        self.kept = {n: row}
        for i in range(n - 1, -1, -1):
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row
        self.segment: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        self.segment_at = -1

    def _cut(self, i: int, low: int, plain: np.ndarray, pending: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The band of a row: entries outside its outermost useful ones are dropped."""
        ahead = self.before[i, (low + np.arange(len(plain))) & 1]
        deleted = DELETE * i
        useful = np.flatnonzero((plain + ahead <= self.limit) | (pending + deleted <= self.limit))
        if not len(useful):
            return low, plain[:0], pending[:0]
        first, end = int(useful[0]), int(useful[-1]) + 1
        return low + first, plain[first:end], pending[first:end]

    def _above(self, i: int, row: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        low, below, pending_below = row
        drop, keep, rerole = _costs(self.codes[i])
        role = self.codes[i] & 3
        # Room for one more character made of this row and for as many inserted ones as the incumbent allows.
        spare = self.limit - int(self.before[i].min()) - int(below.min(initial=_FAR))
        size = len(below) + 1 + max(0, spare) // INSERT
        plain, pending = np.full(size, _FAR, np.int64), np.full(size, _FAR, np.int64)
        plain[: len(below)] = below + drop
        made = np.where((low + 1 + np.arange(len(below))) & 1, keep if role == 1 else rerole, keep if role == 0 else rerole)
        plain[1 : len(below) + 1] = np.minimum(plain[1 : len(below) + 1], below + made)
        slope = INSERT * np.arange(size, dtype=np.int64)
        plain = np.minimum.accumulate(plain - slope) + slope
        pending[: len(below)] = pending_below + drop
        if role == 2:
            after = low + np.arange(len(below))
            pairs = (after % 2 == 0) & (after >= 2)
            pending[: len(below)] = np.minimum(pending[: len(below)], np.where(pairs, below + keep, _FAR))
        return self._cut(i, low, np.minimum(plain, _FAR), np.minimum(pending, _FAR))

    def row(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Row ``i``, recomputed from the next kept one."""
        if i in self.kept:
            return self.kept[i]
        if i // self.step != self.segment_at:
            self.segment_at = i // self.step
            at = min((self.segment_at + 1) * self.step, len(self.codes))
            row, self.segment = self.kept[at], {}
            for j in range(at - 1, self.segment_at * self.step, -1):
                row = self.segment[j] = self._above(j, row)
        return self.segment[i]

    def cost(self, i: int, k: int, pending: bool) -> int:
        low, *both = self.row(i)
        values = both[pending]
        return int(values[k - low]) if 0 <= k - low < len(values) else _FAR


def align(codes: bytes) -> tuple[int, str]:
    """Least cost over all target lengths and the ASCII-least audit of the scripts that reach it."""
    matrix, n = _Matrix(codes), len(codes)
    low, plain, pending = matrix.row(0)
    lengths = low + np.arange(len(plain))
    least = int(min(plain[lengths % 2 == 0].min(initial=_FAR), pending.min(initial=_FAR)))
    # Places (row, characters to come, s to come) of the scripts that share the audit so far.
    places = {(0, int(k), False) for k in lengths[(plain == least) & (lengths % 2 == 0)]}
    places |= {(0, int(k), True) for k in lengths[pending == least]}
    audit = []
    while (n, 0, False) not in places:
        moves: dict[str, set[tuple[int, int, bool]]] = {}
        for i, k, waits in places:
            here = matrix.cost(i, k, waits)
            if i < n:
                drop, keep, rerole = _costs(codes[i])
                if matrix.cost(i + 1, k, waits) + drop == here:
                    moves.setdefault("D", set()).add((i + 1, k, waits))
                if waits:
                    if codes[i] & 3 == 2 and matrix.cost(i + 1, k, False) + keep == here:
                        moves.setdefault("K", set()).add((i + 1, k, False))
                elif k:
                    fits = codes[i] & 3 == k % 2
                    if matrix.cost(i + 1, k - 1, False) + (keep if fits else rerole) == here:
                        moves.setdefault("K" if fits else "R", set()).add((i + 1, k - 1, False))
            if k and not waits and matrix.cost(i, k - 1, False) + INSERT == here:
                moves.setdefault("I", set()).add((i, k - 1, False))
        letter = min(moves)
        audit.append(letter)
        places = moves[letter]
    return least, "".join(audit)


@lru_cache(maxsize=1 << 16)
def _align_short(codes: bytes) -> tuple[int, str]:
    return align(codes)


def _target(length: int) -> Iterator[str]:
    """Initials of the target of this length."""
    if length % 2:
        yield "s"
    for _ in range(length // 2):
        yield "u"
        yield "a"


class _Conversation:
    """Counts of one conversation, row by row in order."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.role = None

    def add(self, turn: int | None, role: str, blank: bool, ended: bool, repeat: bool) -> None:
        initial = role[:1]
        code = {"u": 0, "a": 1, "s": 2}.get(initial, 3)
        if blank:
            self.blank += 1
            code |= _MUST_GO
        elif repeat:
            self.duplicate += 1
            code |= _MUST_GO
        elif not ended:
            self.truncated += 1
            code |= _TRUNCATED
        if self.codes and self.role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = initial
        self.codes.append(code)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        codes = bytes(self.codes)
        cost, audit = (_align_short if len(codes) <= 32 else align)(codes)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=schema)


_AUDIT_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_OUT_ARROW = _AUDIT_ARROW.append(pa.field("repaired_sha256", pa.string()))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, talk, rows = None, None, []
    for batch in batches:
        for conv, turn, role, here, blank, ended, repeat in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if talk is None or conv != current:
                if talk is not None:
                    rows.append((current, *talk.result()))
                current, talk = conv, _Conversation()
            if here:
                talk.add(turn, role, blank, ended, repeat)
        yield _table(rows, _AUDIT_ARROW)
        rows = []
    if talk is not None:
        yield _table([(current, *talk.result())], _AUDIT_ARROW)


class _Repair:
    """Applies an audit to the rows of its conversation, as they come, and hashes the repaired lines."""

    def __init__(self, counts: tuple):
        self.counts, self.audit = counts, counts[-1]
        self.at, self.lines, self.sha = 0, 0, hashlib.sha256()
        self.roles = _target(len(self.audit) - self.audit.count("D"))

    def _write(self, line: str) -> None:
        self.sha.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write({"u": "user", "a": "assistant"}[next(self.roles)] + ":")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        initial = next(self.roles)
        self._write(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")

    def result(self) -> tuple:
        self._insert()
        return (*self.counts, self.sha.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        for is_text, role, text, *counts in zip(*columns):
            if is_text:
                repair.add(role, text)
                continue
            if repair is not None:
                rows.append(repair.result())
            repair = _Repair(tuple(counts))
        yield _table(rows, _OUT_ARROW)
        rows = []
    if repair is not None:
        yield _table([repair.result()], _OUT_ARROW)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of the damaged ``rows``: counts of faults, least cost and audit."""
    ordered = coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_order(), "repeat")
    return ordered.select("conv_id", "turn", "role", "here", "blank", "ended", "repeat").mapInArrow(_audit, _AUDIT)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, here): counts, cost, audit, digest of the repair.

    A row is blank without a character other than blanks, else a duplicate if role and text came before, else truncated if
    its last such character ends no sentence. Null conv_ids are one conversation. Rows of one turn are ordered by role and
    digest of the text. A conversation of which nothing is left has zeros, an empty audit and the digest of the empty
    string. Columns other than these five are not read. An empty table gives no rows.
    """
    found = audits(rows)
    # Each conversation's script comes in front of its texts.
    names = found.columns
    scripts = found.select(
        F.lit(False).alias("is_text"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
        F.lit("").alias("text"), *names,
    )
    texts = rows.where("here").select(
        F.lit(True).alias("is_text"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", "conv_id",
        *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "conv_id"],
    )
    both = scripts.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_text", *_order())
    return both.select("is_text", "role", "text", *names).mapInArrow(_repair, _OUT)
