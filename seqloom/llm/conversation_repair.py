"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A legal conversation is empty, or an optional system row followed by one or more
pairs of a user and an assistant row. Edits of a row: keep (free), change its role to
user or assistant, delete; rows with an empty text can be inserted anywhere. Blank and
repeated rows have to go, and a truncated row that stays costs extra.

The rows of a conversation meet in one task in the order of their turns and stream
through it; nothing of a conversation but a few numbers is held. Three local sorts, none of
which moves rows between tasks:

1. by (role, text, turn): a row equal to the one before it is a repeat;
2. backwards by turn: the cost of the cheapest rest is carried for each of the four states
   that the rows before may have led to, and each row gets one byte of backpointers (two bits
   a state: the first edit of the cheapest rest);
3. forwards by turn: the backpointers lead through the conversation.

The byte travels with its row through Spark's sort, which spills, so a giant conversation needs
no more memory than a short one, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
#: Costs of the edits; a truncated row that is not deleted adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED_COST = 2, 3, 2, 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits in ASCII order of their initials, so the smaller number wins a tie.
EDITS = "DIKR"
_D, _I, _K, _R = range(4)
#: States: nothing yet, after system, after user, after assistant; and what may follow in each.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The role that a changed or inserted row takes in a state, and the state that follows.
_MADE = ("u", "u", "a", "u")
_AFTER = (2, 2, 3, 2)
_NAMES = {"u": "user", "a": "assistant"}
#: Costs of the rest after the last row: legal, a pair is missing, an assistant is missing, legal.
_END = (0, 2 * INSERT, INSERT, 0)
_LONG = (1 << 63) - 1


def backward_step(rest: tuple[int, int, int, int], initial: str, fault: int) -> tuple[tuple[int, int, int, int], int]:
    """Costs before a row from the costs after it, and the row's backpointers.

    Costs come relative to the smallest one, so there are few different arguments.
    """
    own = []
    for state in range(4):
        options = [(DELETE + rest[state], _D)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            if initial in _NEXT[state]:
                options.append((extra + rest[_NEXT[state][initial]], _K))
            options.append((extra + REROLE + rest[_AFTER[state]], _R))
        own.append(min(options))
    # an insertion before the row; one leads from 2 to 3 and back, which two of them never pay for
    best = [min(own[s], (INSERT + own[_AFTER[s]][0], _I)) for s in range(4)]
    pointers = sum(edit << (2 * s) for s, (_, edit) in enumerate(best))
    return tuple(cost for cost, _ in best), pointers


def forward_edits(state: int, pointers: int) -> tuple[str, int]:
    """The edits at a row (insertions before it, then its own) and the state after an insertion run."""
    edits = ""
    while (edit := pointers >> (2 * state) & 3) == _I:
        edits += "I"
        state = _AFTER[state]
    return edits + EDITS[edit], state


def _prepared(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return rows.withColumn("fault", fault.cast("int"))


def _mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, role, text): those equal to the row before become duplicates (blank ones stay blank)."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(n) for n in ("conv_id", "role", "text")]
        same = pa.array([before == tuple(k[0].as_py() for k in keys)])
        if b.num_rows > 1:
            equal = [
                pc.or_(pc.fill_null(pc.equal(k[1:], k[:-1]), False), pc.and_(pc.is_null(k[1:]), pc.is_null(k[:-1]))) for k in keys
            ]
            same = pa.concat_arrays([same, pc.and_(pc.and_(equal[0], equal[1]), equal[2])])
        before = tuple(k[-1].as_py() for k in keys)
        fault = b.column("fault")
        repeated = pc.and_(same, pc.not_equal(fault, BLANK))
        fault = pc.if_else(repeated, pa.scalar(DUPLICATE, pa.int32()), fault)
        yield pa.RecordBatch.from_arrays([fault if n == "fault" else b.column(n) for n in b.schema.names], names=b.schema.names)


def _point_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from the last to the first: adds ``left`` (rows after it), ``cost`` and ``pointers``."""
    step = lru_cache(maxsize=1 << 16)(backward_step)  # here, as a cache of the module would not reach the workers by value
    current, rest, base, left = object(), _END, 0, 0
    for b in batches:
        lefts, costs, bytes_ = [], [], []
        for conv, role, fault in zip(
            b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("fault").to_pylist(), strict=True
        ):
            if conv != current:
                current, rest, base, left = conv, _END, 0, 0
            rest, pointers = step(rest, role[:1], fault)
            lefts.append(left)
            bytes_.append(pointers)
            costs.append(base + rest[0])
            low = min(rest)
            rest, base, left = tuple(c - low for c in rest), base + low, left + 1
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(lefts, pa.int64()), pa.array(costs, pa.int64()), pa.array(bytes_, pa.int32())],
            names=[*b.schema.names, "left", "cost", "pointers"],
        )


class _Report:
    """What is counted over the rows of a conversation as they were."""

    def __init__(self, cost: int):
        self.cost, self.faults, self.illegal = cost, [0] * 4, 0
        self.low = self.high = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, role: str, fault: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def row(self) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _LONG)
        return {
            "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": self.cost,
        }


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EDITED = (
    "conv_id long, position long, turn long, fault int, edit string, role string, text string, last boolean, "
    f"report struct<{','.join(f'{n}:long' for n in _REPORT)}>"
)
_EDITED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("fault", pa.int32()), ("edit", pa.string()),
    ("role", pa.string()), ("text", pa.string()), ("last", pa.bool_()), ("report", pa.struct([(n, pa.int64()) for n in _REPORT])),
])
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 20


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of a conversation from the first to the last: one dict per edit."""
    report, state, position = None, 0, 0
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "left", "cost", "pointers")]
        for conv, turn, role, text, fault, left, cost, pointers in zip(*cols, strict=True):
            if report is None:
                report, state, position = _Report(cost), 0, 0
            report.add(turn, role, fault)
            edits, made = forward_edits(state, pointers)
            for _ in edits[:-1]:
                yield _row(conv, position, None, None, "I", _NAMES[_MADE[state]], "")
                state, position = _AFTER[state], position + 1
            state = made
            if edits[-1] == "D":
                yield_ = _row(conv, position, turn, fault, "D", None, None)
            elif edits[-1] == "K":
                yield_ = _row(conv, position, turn, fault, "K", role, text)
                state = _NEXT[state][role[:1]]
            else:
                yield_ = _row(conv, position, turn, fault, "R", _NAMES[_MADE[state]], text)
                state = _AFTER[state]
            position += 1
            if left:
                yield yield_
                continue
            while state in (1, 2):  # what the end still lacks
                yield yield_
                yield_ = _row(conv, position, None, None, "I", _NAMES[_MADE[state]], "")
                state, position = _AFTER[state], position + 1
            yield yield_ | {"last": True, "report": report.row()}
            report = None


def _row(conv, position, turn, fault, edit, role, text) -> dict:
    return {
        "conv_id": conv, "position": position, "turn": turn, "fault": fault, "edit": edit, "role": role, "text": text,
        "last": False, "report": None,
    }


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    for row in _edits(batches):
        rows.append(row)
        chars += len(row["text"] or "")
        if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(rows, schema=_EDITED_ARROW)
            rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_EDITED_ARROW)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, in order: one row per edit.

    Columns: ``conv_id``, ``position`` (of the edit), ``turn`` and ``fault`` of the row edited (null for an
    insertion; faults: 0 sound, 1 blank, 2 duplicate, 3 truncated, the first that holds), ``edit`` (D, I, K
    or R), the ``role`` and ``text`` that stay (null where deleted), ``last``, and on a conversation's last
    edit the ``report``: turn gaps, faults, illegal neighbours and cost. Of several cheapest ways, the one
    with the ASCII-least edit initials is taken; it determines the repaired rows.

    Rows are taken by (turn, role, text), null turns first, so ties and repeated rows give one defined
    result. A null role or text counts as one space; rows with a null conv_id form a conversation of their
    own. A role is known by its first character, and a row with an empty role cannot be kept as it is. The
    number of missing turns is clamped to the largest long. Other columns are ignored; an empty table gives
    no rows. The edits of a conversation follow one another in the output.

    One shuffle, by conv_id. A conversation is one task's work, whatever its share of the rows: its sorts
    spill, and memory holds one Arrow batch.
    """
    kept = "conv_id long, turn long, role string, text string, fault int"
    gathered = _prepared(conversations).repartition("conv_id")
    marked = gathered.sortWithinPartitions("conv_id", "role", "text", "turn").mapInArrow(_mark_repeats, kept)
    backwards = marked.sortWithinPartitions(
        "conv_id", *(F.col(c).desc_nulls_last() for c in ("turn", "role", "text")), (F.col("fault") == DUPLICATE).desc()
    ).mapInArrow(_point_back, f"{kept}, left long, cost long, pointers int")
    return backwards.sortWithinPartitions("conv_id", F.col("left").desc()).mapInArrow(_edit_batches, EDITED)


DIGESTS = f"conv_id long, {', '.join(f'{n} long' for n in _REPORT)}, audit string, repaired_sha256 string"


def repair_digests(edits: DataFrame) -> DataFrame:
    """Per conversation: the report, ``audit`` (edit initials) and ``repaired_sha256`` (``role:text``, joined by newlines).

    Runs in the stage of ``repair_conversations`` and streams its output; SHA-256 of an ordered text is a
    chain. Held per conversation: a character per edit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, some = [], hashlib.sha256(), False
        for b in batches:
            out = []
            for row in b.to_pylist():
                audit.append(row["edit"])
                if row["edit"] != "D":
                    digest.update((("\n" if some else "") + f"{row['role']}:{row['text']}").encode())
                    some = True
                if row["last"]:
                    out.append((row["conv_id"], *(row["report"][n] for n in _REPORT), "".join(audit), digest.hexdigest()))
                    audit, digest, some = [], hashlib.sha256(), False
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            cols = zip(*out, strict=True) if out else [[]] * 9
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return edits.mapInArrow(run, DIGESTS)
