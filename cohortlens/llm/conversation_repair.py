"""Conversation structure repair: the cheapest edits that give a legal sequence of roles.

A conversation's rows are kept, given another role, deleted, or joined by inserted empty rows
so that the role initials match ``(s?(ua)+)?``. Nodes of the search are (rows consumed, state):
nothing emitted, after the system row, after a user row, after an assistant row. A cost DP from
the end gives the cheapest completion of every node; the arcs that keep to it are the optimal
ones. Their nodes are then ranked by the least audit string (the edits' initials) of 1, 2, 4, ...
letters: a node's rank for twice the length is the rank of the pair (its rank, the rank of the
node that its pointer reaches), and pointers double with it. The ranks pick each node's best
arc (by letter, then by the target's rank) and the doubled pointers spell the least path. The
legal next role is fixed by the state, so arcs of one node bear different letters and the least
audit string fixes the path.

Rows are ordered by turn (nulls first), then role and text hash, and cut into blocks of at most
``BLOCK_ROWS`` rows of one conversation; only narrow columns (flags, hashes) take part until the
end. A block gives its 4 x 4 matrix of least costs between states; a conversation's cost to go
at the end of each block follows from the matrices of the later blocks; every block is then solved on
its own for each of its four entry states. The last pass streams the texts in order beside the
solved blocks. So a conversation that holds a third of all rows is searched by many tasks, and
the one task that must hash its text in order keeps only a running digest and the audit.

A row's first fault counts: ``blank`` (no character but ASCII white space), ``duplicate`` (role and
text, by SHA-256, seen earlier in the conversation), ``truncated`` (the last such character ends no
sentence). Equal rows of one turn are counted before the shuffle, not carried one by one.

Defined cases: null role or text is one blank, so such a text is a blank row and such a role is
no legal one; null conv_ids are one conversation; equal turns are ordered by role and text hash;
a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty
table gives an empty result; only the four named columns are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, slices

BLOCK_ROWS = 4096
FAR = 1 << 60
SHORT, SHORT_CODES = 40, 20_000  # blocks of at most SHORT rows are solved once per task and row codes

# Fixed values of the repair: costs, and the states with the initials that may follow them.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that an edit may give next
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, **{(s, "u" if t == USER else "a"): t for s, t in ADDED.items()}}
LEGAL_PAIRS = ("su", "ua", "au")
LAST = (START, ASSISTANT)  # states in which a conversation may end
LETTERS = "DIKR"
WHITE = r"[\x20\x09-\x0D]"


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, 2: repeated) after the fixed damage."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    kind = F.crc32(F.concat_ws(":", *words).cast("binary")) % 20
    raw = F.coalesce(F.col(text), F.lit(" "))
    return conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(raw, "[.!?]", "")).otherwise(raw).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """One narrow row per distinct (conv_id, turn, role, text), in order: copies, initial, fault of
    the first copy (``blank`` and ``duplicate`` rows must go), in range partitions.

    ``first`` says whether role and text occur in no earlier turn of the conversation."""
    bare = F.regexp_replace("text", WHITE, "")
    narrow = rows.select(
        "conv_id", "turn", F.when(F.col("copies") > 0, F.col("role")).alias("role"), _text_hash(F.when(F.col("copies") > 0, F.col("text"))).alias("hash"),
        F.length(bare).alias("_n"), F.substring(bare, -1, 1).alias("_end"), "copies",
    ).select(
        "conv_id", "turn", "role", "hash", "copies", (F.col("_n") == 0).alias("blank"),
        ((F.col("_n") > 0) & ~F.col("_end").isin(".", "!", "?")).alias("open"),
    )
    held = narrow.groupBy("conv_id", "turn", "role", "hash").agg(
        F.sum("copies").cast("bigint").alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))  # nulls first
    earliest = held.where("copies > 0").groupBy("conv_id", "role", "hash").agg(F.min(place).alias("_first"))
    marked = held.alias("h").join(
        earliest.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("hash").alias("_h"), "_first"),
        F.col("h.conv_id").eqNullSafe(F.col("_c")) & (F.col("h.role") == F.col("_r")) & (F.col("h.hash") == F.col("_h")), "left")
    return marked.select(
        "conv_id", "turn", "role", "hash", "copies", "blank", "open", (place == F.col("_first")).alias("first"),
    ).repartitionByRange("conv_id", "turn", "role", "hash").sortWithinPartitions("conv_id", "turn", "role", "hash")


# --- one block -----------------------------------------------------------------------------
# A block's rows are a string: "-" a row that must go, else the initial of the role, upper case
# for a truncated row; "." stands for any other initial ("," if truncated).


def row_code(initial: str, forced: bool, truncated: bool) -> str:
    if forced:
        return "-"
    if initial not in ("s", "u", "a"):
        return "," if truncated else "."
    return initial.upper() if truncated else initial


@lru_cache(maxsize=64)
def arcs(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits that consume a row: (letter, next state, cost)."""
    out = [("D", state, DELETE)]
    if code != "-":
        late = TRUNCATED if code.isupper() or code == "," else 0
        if (kept := KEPT.get((state, code.lower()))) is not None:
            out.append(("K", kept, KEEP + late))
        out.append(("R", ADDED[state], REROLE + late))
    return out


def costs_to_go(codes: str, end: Sequence[int]) -> list[list[int]]:
    """Least cost from (i, state) to the block's end, given the cost of going on from each state there."""
    def with_inserts(cost: Sequence[int]) -> list[int]:
        cost = list(cost)
        for _ in range(3):  # a chain of inserts visits a state at most once
            for s, t in ADDED.items():
                cost[s] = min(cost[s], cost[t] + INSERT)
        return cost

    table = [with_inserts(end)]
    for code in reversed(codes):
        ahead = table[-1]
        table.append(with_inserts([min(ahead[t] + c for _, t, c in arcs(code, s)) for s in range(4)]))
    return table[::-1]


def cost_matrix(codes: str) -> list[int]:
    """Least costs from each state at the block's start to each state at its end, row by row."""
    columns = [costs_to_go(codes, tuple(0 if s == e else FAR for s in range(4)))[0] for e in range(4)]
    return [min(FAR, columns[e][s]) for s in range(4) for e in range(4)]


def least_paths(codes: str, end: tuple[int, ...]) -> list[tuple[str, int]]:
    """For each entry state the least audit string among the cheapest paths, and the exit state.

    Node (i, s) has number 4 * i + s; the four exits are behind them."""
    cost = costs_to_go(codes, end)
    n = 4 * (len(codes) + 1)
    source, letter, target = [], [], []
    for i in range(len(codes) + 1):
        for s in range(4):
            here = cost[i][s]
            if here >= FAR:
                continue
            for mark, t, price in arcs(codes[i], s) if i < len(codes) else []:
                if cost[i + 1][t] + price == here:
                    source.append(4 * i + s), letter.append(mark), target.append(4 * (i + 1) + t)
            if cost[i][ADDED[s]] + INSERT == here:
                source.append(4 * i + s), letter.append("I"), target.append(4 * i + ADDED[s])
            if i == len(codes) and end[s] == here:
                source.append(4 * i + s), letter.append(""), target.append(n + s)
    src, dst = np.array(source, np.int64), np.array(target, np.int64)
    mark = np.array([1 + LETTERS.index(x) if x else 0 for x in letter], np.int64)

    def choose(order: tuple) -> np.ndarray:
        """Each node's arc that is first in ``order`` (-1: none)."""
        by = np.lexsort((*order[::-1], src))
        best = np.full(n + 4, -1, np.int64)
        heads = by[np.append(True, np.diff(src[by]) > 0)] if len(by) else by
        best[src[heads]] = heads
        return best

    def follow(best: np.ndarray) -> np.ndarray:
        step = np.arange(n + 4)
        step[best >= 0] = dst[best[best >= 0]]
        return step

    best = choose((mark,))
    rank = np.where(best >= 0, mark[best], 0) if len(src) else np.zeros(n + 4, np.int64)
    pointer, length = follow(best), 1
    # audits have at most a letter per row and three inserts between two rows
    while length < 4 * (len(codes) + 1) + 4:
        rank = np.unique(rank * (n + 5) + rank[pointer], return_inverse=True)[1]
        pointer, length = pointer[pointer], 2 * length
    best = choose((mark, rank[dst])) if len(src) else best
    pointers, length = [follow(best)], 1
    while length < 4 * (len(codes) + 1) + 4:
        pointers.append(pointers[-1][pointers[-1]])
        length *= 2
    out = []
    for s in range(4):
        path = np.array([s], np.int64)
        for pointer in pointers:  # nodes 0 .. 2**k - 1 of the path give the next 2**k
            path = np.concatenate([path, pointer[path]])
        spelled = best[path]
        marks = mark[spelled[spelled >= 0]] if len(src) else np.zeros(0, np.int64)
        exit_state = int(path[-1]) - n
        out.append(("".join(LETTERS[m - 1] for m in marks.tolist() if m), exit_state if exit_state >= 0 else -1))
    return out


# --- blocks of a conversation --------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
BLOCK_FIELDS = (
    "block long, codes string, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
    "first_turn bigint, last_turn bigint, first_initial string, last_initial string, has_rows boolean"
)


def _units(row: dict) -> Iterator[tuple]:
    """(turn, initial, fault, forced, truncated) of each copy of a row."""
    initial = (row["role"] or "")[:1]
    for copy in range(row["copies"]):
        fault = "blank" if row["blank"] else "duplicate" if copy or not row["first"] else "truncated" if row["open"] else None
        yield row["turn"], initial, fault, fault in ("blank", "duplicate"), fault == "truncated"


def _summary(block: int, units: list[tuple], matrices: Callable) -> dict:
    codes = "".join(row_code(initial, forced, late) for _, initial, _, forced, late in units)
    initials = [u[1] for u in units]
    turns = [u[0] for u in units if u[0] is not None]
    out = {"block": block, "codes": codes, "matrix": (matrices if len(codes) <= SHORT else cost_matrix)(codes), "has_rows": bool(units)}
    out |= {c: sum(u[2] == c for u in units) for c in COUNTS[:3]}
    out["illegal"] = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
    out["turns"] = len(set(turns))
    out |= {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}
    return out | {"first_initial": initials[0] if units else None, "last_initial": initials[-1] if units else None}


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(batches):
        yield from batch.to_pylist()


def blocks_of(ordered: DataFrame) -> DataFrame:
    """Summaries of the blocks of ordered rows, numbered in the order of the rows."""
    schema = T.StructType([ordered.schema["conv_id"], *T._parse_datatype_string(BLOCK_FIELDS).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found, matrices = 0, [], lru_cache(SHORT_CODES)(cost_matrix)
        for conv, rows in groupby(_rows_of(batches), key=lambda r: r["conv_id"]):
            units, empty = [], True
            for row in rows:
                for unit in _units(row):
                    units.append(unit)
                    if len(units) == BLOCK_ROWS:
                        found.append({"conv_id": conv, **_summary((row["part"] << 40) + number, units, matrices)})
                        number, units, empty = number + 1, [], False
                part = row["part"]
            if units or empty:
                found.append({"conv_id": conv, **_summary((part << 40) + number, units, matrices)})
                number += 1
            if len(found) >= 500:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return ordered.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(cut, schema)


def with_cost_ahead(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``ahead``: the least cost from each state at a block's end to the end of its
    conversation (a running vector over the blocks from the last; one block is held at a time)."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("ahead", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ahead = object(), []
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, ahead = row["conv_id"], [0 if s in LAST else FAR for s in range(4)]
                out.append({**row, "ahead": ahead})
                m = row["matrix"]
                ahead = [min(FAR, min(m[4 * s + e] + ahead[e] for e in range(4))) for s in range(4)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc()).mapInArrow(run, schema)


def solved(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the least audit and the exit state for each entry state."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("exits", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(SHORT_CODES)(least_paths)
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                paths = (known if len(row["codes"]) <= SHORT else least_paths)(row["codes"], tuple(row["ahead"]))
                out.append({**row, "audits": [a for a, _ in paths], "exits": [e for _, e in paths]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return blocks.repartition("block").mapInArrow(solve, schema)


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, n_repaired bigint"


class _Conversation:
    """Running state of one conversation: first its solved blocks pass by, then its texts."""

    def __init__(self, conv):
        self.conv, self.cost = conv, None
        self.totals = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.entry = self.state = START  # before the next block; after the last edit
        self.codes, self.audit = [], []
        self.edits: Iterator[tuple[str, str]] | None = None
        self.digest, self.repaired = hashlib.sha256(), 0

    def add_block(self, row: dict) -> None:
        if self.cost is None:
            self.cost = min(m + ahead for m, ahead in zip(row["matrix"][:4], row["ahead"]))
        self.codes.append(row["codes"])
        self.audit.append(row["audits"][self.entry])
        self.entry = row["exits"][self.entry]
        for c in COUNTS:
            self.totals[c] += row[c]
        if row["has_rows"]:
            if self.last_initial is not None:
                self.totals["illegal"] += self.last_initial + row["first_initial"] not in LEGAL_PAIRS
            self.last_initial = row["last_initial"]
        if row["first_turn"] is not None:
            self.totals["turns"] -= self.last_turn == row["first_turn"]
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]

    def _edits(self) -> Iterator[tuple[str, str]]:
        """(letter, code of the row that it consumes) in order."""
        for codes, letters in zip(self.codes, self.audit):
            rows = iter(codes)
            for letter in letters:
                yield letter, "" if letter == "I" else next(rows)

    def _emit(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.repaired else ''}{role}:{text}".encode())
        self.repaired += 1

    def add_text(self, role: str | None, text: str) -> None:
        """Apply the edits up to the one that consumes this row (None: the edits behind all rows)."""
        if self.edits is None:
            self.edits = self._edits()
        for letter, code in self.edits:
            if letter == "K":
                self.state = KEPT[self.state, code.lower()]
                self._emit(role, text)
            elif letter != "D":
                self.state = ADDED[self.state]
                self._emit(ROLE[self.state], text if letter == "R" else "")
            if letter != "I":
                return

    def result(self) -> dict:
        self.add_text(None, "")
        gaps = self.last_turn - self.first_turn + 1 - self.totals["turns"] if self.first_turn is not None else 0
        return {
            "conv_id": self.conv, "gaps": gaps, **{c: self.totals[c] for c in COUNTS[:4]}, "cost": self.cost,
            "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(), "n_repaired": self.repaired,
        }


def repair_rows(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, copies; copies 0 keeps the conv_id
    only): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired."""
    blocks = cut_lineage(blocks_of(ordered_rows(rows)))
    paths = solved(with_cost_ahead(blocks))
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("block"), "turn", "role", _text_hash(F.col("text")).alias("hash"), "text", "copies",
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in paths.schema.fields[2:]))
    both = paths.select(
        "conv_id", F.lit(0).alias("kind"), "block", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("copies"), *paths.columns[2:],
    ).unionByName(texts)
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(RESULT).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []
        for row in _rows_of(batches):
            if current is None or current.conv != row["conv_id"]:
                if current is not None:
                    out.append(current.result())
                current = _Conversation(row["conv_id"])
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if row["kind"] == 0:
                current.add_block(row)
            else:
                for _ in range(row["copies"]):
                    current.add_text(row["role"], row["text"])
        if current is not None:
            out.append(current.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block", "turn", "role", "hash")
    return in_order.mapInArrow(run, schema)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair_rows`` of conversations as they are (no damage)."""
    return repair_rows(conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.lit(1).alias("copies")))
