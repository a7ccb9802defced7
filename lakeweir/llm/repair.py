r"""Conversation structure repair: the cheapest edits that make a conversation read system?, then user and assistant in turn.

Rows are dealt by conversation and sorted within it by turn (nulls first, then role and text), and a task reads them once, in
Arrow batches of bounded size, carrying the state of the conversation at hand from batch to batch: the four states of the
form (nothing, system, user, assistant given), each with the least cost to get there, where its edits stand among those of
the others in ASCII order, and the running SHA-256 of what they would give. So a conversation is never gathered, whatever its
length. Which edit led to each state is a byte a state and row; these backpointers, and the digests of rows seen, go to a
task's unlinked scratch files in Spark's spill folders once they are many. The conversation's end traces the bytes back.

Edits and costs: (K)eep 0, (R)erole to user or assistant 2, (D)elete 3, (I)nsert an empty user or assistant row 2; a
truncated row that is not deleted adds 1, and blank and repeated rows must be deleted. Edits are told apart by their letters
alone: in each state a letter leads to one state only. Equal costs go to the edits that come first in ASCII order. Two
strings of edits with equally many rows behind them differ in their last row's letter or before, or in the inserts after it;
so the strings of the four states are kept as a rank (of what ends in the last row's letter) and a number of inserts.

Defined results: null roles and texts are one space; null turns sort first and count for no gap; null conversation ids are one
conversation; rows that tie in turn are in order of role and text, so equal rows are adjacent; an empty table gives an empty
result; extra columns are not read. Rows marked as gone count for nothing, but their conversation is reported.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweir.llm.common import bounded_batches

#: What a user or assistant row is called when it is made, by state.
NAMES = {2: "user", 3: "assistant"}
#: The state after an insert or rerole, by state: nothing or system or assistant given: user; user given: assistant.
NEXT = (2, 2, 3, 2)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = frozenset(("su", "ua", "au"))
_BLANKS, _ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
_SPILL, _RUN, _RUNS = 1 << 20, 1 << 17, 8
_LETTERS = "DKR"


def _scratch():
    """An unlinked file in a folder that Spark spills to."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return tempfile.TemporaryFile(dir=folders[0] if os.path.isdir(folders[0]) else None)


class Pointers:
    """Four bytes a row, read back from the last: held up to _SPILL bytes, then in a file."""

    def __init__(self):
        self.held, self.file, self.spilled = bytearray(), None, 0

    def add(self, four: bytes) -> None:
        self.held += four
        if len(self.held) >= _SPILL:
            self.file = self.file or _scratch()
            self.file.write(self.held)
            self.spilled += len(self.held)
            self.held = bytearray()

    def backwards(self) -> Iterator[bytes]:
        yield from (self.held[i : i + 4] for i in range(len(self.held) - 4, -1, -4))
        end = self.spilled
        while end:
            start = max(0, end - _SPILL)
            self.file.seek(start)
            block = self.file.read(end - start)
            yield from (block[i : i + 4] for i in range(len(block) - 4, -1, -4))
            end = start


class Seen:
    """The 128-bit digests of rows so far: a set up to _RUN, then sorted runs in files, merged when they are _RUNS."""

    def __init__(self):
        self.now, self.runs = set(), []

    @staticmethod
    def _held(run: np.ndarray, digest: bytes) -> bool:
        value = np.frombuffer(digest, ">u8").astype(np.uint64)
        left, right = np.searchsorted(run["a"], value[0], "left"), np.searchsorted(run["a"], value[0], "right")
        return bool((run["b"][left:right] == value[1]).any())

    def add(self, digest: bytes) -> bool:
        """Whether the digest is new."""
        if digest in self.now or any(self._held(run, digest) for run in self.runs):
            return False
        self.now.add(digest)
        if len(self.now) >= _RUN:
            self._spill()
        return True

    def _spill(self) -> None:
        whole = np.frombuffer(b"".join(self.now), ">u8").astype(np.uint64).reshape(-1, 2)
        parts = [(whole[:, 0], whole[:, 1])]
        if len(self.runs) + 1 >= _RUNS:
            parts += [(run["a"], run["b"]) for run in self.runs]
            self.runs = []
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(a, kind="stable")
        run = {}
        for name, values in (("a", a[order]), ("b", b[order])):
            file = _scratch()
            values.tofile(file)
            file.flush()
            run[name] = np.memmap(file, np.uint64, "r", shape=values.shape)
        self.runs.append(run)
        self.now = set()


class Conversation:
    """One conversation while its rows go by."""

    def __init__(self, key):
        self.key, self.first, self.last, self.turns = key, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before, self.seen, self.pointers = None, Seen(), Pointers()
        # state -> cost, rank of its edits up to the last row, digest of what they give
        self.states: dict[int, tuple] = {0: (0, 0, hashlib.sha256())}

    def _inserted(self) -> dict[int, tuple]:
        """The states after any inserts: cost, rank, number of inserts, state before them."""
        found = {x: (cost, rank, 0, x) for x, (cost, rank, _) in self.states.items()}
        for _ in range(2):
            for x, (cost, rank, n, origin) in list(found.items()):
                made = (cost + INSERT, rank, n + 1, origin)
                if NEXT[x] not in found or made[:3] < found[NEXT[x]][:3]:
                    found[NEXT[x]] = made
        return found

    def _digest(self, origin: int, inserts: int, row: str | None):
        """The running digest of a state, after inserts and perhaps a row; shared where nothing is added."""
        digest = self.states[origin][2]
        added, state = [], origin
        for _ in range(inserts):
            state = NEXT[state]
            added.append(f"{NAMES[state]}:")
        if row is not None:
            added.append(row)
        if added:
            digest = digest.copy()
            digest.update((("\n" if origin else "") + "\n".join(added)).encode())
        return digest

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        said = text.rstrip(_BLANKS)
        fresh = self.seen.add(hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest())
        blank, cut = not said, not said.endswith(_ENDS)
        self.blank += blank
        self.duplicate += not blank and not fresh
        self.truncated += (lost := not blank and fresh and cut)
        stays = not blank and fresh
        best: dict[int, tuple] = {}
        for x, (cost, rank, inserts, origin) in self._inserted().items():
            edits = [(0, x, DELETE)]
            if stays:
                if initial == "s" and x == 0:
                    edits.append((1, 1, KEEP + lost))
                elif initial == "u" and x != 2:
                    edits.append((1, 2, KEEP + lost))
                elif initial == "a" and x == 2:
                    edits.append((1, 3, KEEP + lost))
                edits.append((2, NEXT[x], REROLE + lost))
            for edit, to, more in edits:
                made = (cost + more, (rank, "I" * inserts + _LETTERS[edit]), edit, inserts, origin)
                if to not in best or made[:2] < best[to][:2]:
                    best[to] = made
        ranks = {name: i for i, name in enumerate(sorted({b[1] for b in best.values()}))}
        states, codes = {}, bytearray(b"\xff" * 4)
        for to, (cost, name, edit, inserts, origin) in best.items():
            row = None if edit == 0 else f"{role if edit == 1 else NAMES[to]}:{text}"
            states[to] = (cost, ranks[name], self._digest(origin, inserts, row))
            codes[to] = origin | inserts << 2 | edit << 4
        self.states = states
        self.pointers.add(codes)

    def result(self) -> tuple:
        ends = self._inserted()
        state = min((x for x in (0, 3) if x in ends), key=lambda x: ends[x][:3])
        cost, _, inserts, origin = ends[state]
        digest = self._digest(origin, inserts, None).hexdigest()
        edits, state = bytearray(b"I" * inserts), origin
        for codes in self.pointers.backwards():
            code = codes[state]
            edits += _LETTERS[code >> 4].encode() + b"I" * (code >> 2 & 3)
            state = code & 3
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, edits[::-1].decode(), digest)


_RESULT = {"key": "string", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}


def _frame(rows: list[tuple], columns) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=object) for i, name in enumerate(columns)})


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, done = None, []
    for frame in frames:
        for key, turn, role, text, gone in zip(frame["_conv"], frame["_turn"], frame["_role"], frame["_text"], frame["_gone"], strict=True):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.result())
                now = Conversation(key)
            if not gone:
                now.add(None if turn is None else int(turn), role, text)
        if done:
            yield _frame(done, _RESULT)
            done = []
    if now is not None:
        yield _frame([now.result()], _RESULT)


def _sorted(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """_conv, _turn (as text, as pandas has no whole numbers with nulls), _role, _text and _gone, by conversation and turn."""
    own = rows.select(rows[conv].alias("_conv"), rows[turn].cast("bigint").alias("_turn"), F.coalesce(rows[role], F.lit(" ")).alias("_role"), F.coalesce(rows[text], F.lit(" ")).alias("_text"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("_gone"))
    dealt = own.repartition("_conv").sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text")
    return dealt.select(F.col("_conv").cast("string").alias("_conv"), F.col("_turn").cast("string").alias("_turn"), "_role", "_text", "_gone")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """One row a conversation: its gaps and faults, the cost of its repair, the edits (audit) and the digest of what they give."""
    kind = rows.schema[conv].dataType
    ordered = bounded_batches(_sorted(rows, conv, turn, role, text, gone))
    found = ordered.mapInPandas(_repaired, ", ".join(f"{n} {t}" for n, t in _RESULT.items()))
    return found.select(F.col("key").cast(kind).alias(conv), *list(_RESULT)[1:])


_ROWS = "key string, position bigint, role string, text string, edit string"


def _applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired rows, from rows that are led by their conversation's edits (as the text of a row without a role)."""
    key, audit, at, state, position = None, "", 0, 0, 0
    for frame in frames:
        out = []

        def insert() -> None:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                at, state, position = at + 1, NEXT[state], position + 1
                out.append((key, position, NAMES[state], "", "I"))

        for conv, role, text in zip(frame["_conv"], frame["_role"], frame["_text"], strict=True):
            if role is None:
                key, audit, at, state, position = conv, text, 0, 0, 0
                insert()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                state, position = 1 if edit == "K" and role[:1] == "s" else NEXT[state], position + 1
                out.append((key, position, role if edit == "K" else NAMES[state], text, edit))
            insert()
        yield _frame(out, ("key", "position", "role", "text", "edit"))


def repaired_rows(rows: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: conv, position (from 1), role, text and edit of each row that stays or is made.

    repairs is what repair() gives for rows. A conversation's edits are dealt to it as its first row, so they need no join.
    """
    kind = rows.schema[conv].dataType
    own = rows.select(rows[conv].alias("_conv"), F.lit(1).alias("_order"), rows[turn].cast("bigint").alias("_turn"), F.coalesce(rows[role], F.lit(" ")).alias("_role"), F.coalesce(rows[text], F.lit(" ")).alias("_text"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("_gone"))
    own = own.filter(~F.col("_gone")).drop("_gone")
    led = repairs.select(repairs[conv].alias("_conv"), F.lit(0).alias("_order"), F.lit(None).cast("bigint").alias("_turn"), F.lit(None).cast("string").alias("_role"), F.col("audit").alias("_text"))
    dealt = own.unionByName(led).repartition("_conv").sortWithinPartitions("_conv", "_order", F.col("_turn").asc_nulls_first(), "_role", "_text")
    made = bounded_batches(dealt.select(F.col("_conv").cast("string").alias("_conv"), "_role", "_text")).mapInPandas(_applied, _ROWS)
    return made.select(F.col("key").cast(kind).alias(conv), "position", "role", "text", "edit")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows as a test of repairs: by the crc32 of conv:turn, one row in twenty is lost (_gone), emptied, left without ends of sentences, said twice or given to the user."""
    named = F.concat(F.coalesce(rows[conv].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(rows[turn].cast("string"), F.lit(" ")))
    case, whole = F.crc32(named.cast("binary")) % 20, F.coalesce(rows[text], F.lit(" "))
    out = rows.select(
        rows[conv].alias(conv), rows[turn].alias(turn), F.when(case == 4, "user").otherwise(F.coalesce(rows[role], F.lit(" "))).alias(role),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole).alias(text), (case == 0).alias("_gone"), F.when(case == 3, 2).otherwise(1).alias("_times"),
    )
    return out.select(conv, turn, role, text, "_gone", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("col")
