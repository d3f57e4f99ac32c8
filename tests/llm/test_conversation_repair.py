"""Conversation repair against a search over all edit sequences in plain Python."""
import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

import cases
from cohortlens.llm import conversation_repair as cr
from cohortlens.llm.queries import op13_conversation_repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, BLOCK string, copies string, audit int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) over all edit sequences."""
    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            cost, audit, lines = best(i, NEXT[state], inserted + 1)
            out.append((cost + 5, "I" + audit, (NAME[NEXT[state]] + ":", *lines)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            out.append((cost + 2, "D" + audit, lines))
            if marks[i] not in ("blank", "duplicate"):
                late = 5 * (marks[i] == "truncated")
                if role[:1] == NEXT[state] or (state == "" and role[:1] == "s"):
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    out.append((cost + late, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(i + 1, NEXT[state], 0)
                out.append((cost + late + 1, "R" + audit, (f"{NAME[NEXT[state]]}:{text}", *lines)))
        return min(out) if out else (10**9, "", ())

    return best(0, "", 0)


def brute(original, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in original}:
        part = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        marks = faults(part)
        turns = {r[1] for r in part if r[1] is not None}
        cost, audit, lines = cheapest(part, marks) if part else (0, "", ())
        initials = [r[2][:1] for r in part]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(n, seed, longest=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "ulan", "", None, " "])
            text = rng.choice(["Yes.", "No!", "so on", "Yes. ", "", None, " \t", "why? -", "Ja.\n", "ok?"])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None, 1]), role, text))
    rows += [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ah."), (None, None, None, None)]
    return rows + [r for r in rows if rng.random() < 0.1]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [4096, 3])
def test_registered_query_against_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block)
    rows = conversations(250, 3)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert cases.as_rows(op13_conversation_repair(spark, str(tmp_path)), COLUMNS) == brute(rows, damage(rows))


def test_undamaged_rows_and_real_ones(spark):
    rows = [r for r in conversations(80, 5)]
    want = brute(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert cases.as_rows(cr.repair(frame(spark, rows)), COLUMNS) == want


def test_one_conversation_over_many_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_ROWS", 16)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"No {t}.", "Same.", f"cut {t}"])) for t in range(400)]
    rows += [(1, 7, "user", "Same.")] * 50 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    import sys

    sys.setrecursionlimit(10_000)
    got = cases.as_rows(cr.repair(frame(spark, rows)), COLUMNS)
    assert got == brute(rows, rows)


def test_ranks_agree_with_all_paths():
    rng = random.Random(1)
    for _ in range(300):
        codes = "".join(rng.choice("suaUAS-.,") for _ in range(rng.randint(0, 7)))
        rows = [(0, i, {"u": "user", "a": "assistant", "s": "system"}.get(c.lower(), "tool"), str(i)) for i, c in enumerate(codes)]
        marks = ["blank" if c == "-" else "truncated" if c.isupper() or c == "," else None for c in codes]
        end = tuple(0 if s in cr.LAST else cr.FAR for s in range(4))
        cost, audit, _ = cheapest(rows, marks)
        assert (cr.costs_to_go(codes, end)[0][cr.START], cr.least_paths(codes, end)[cr.START][0]) == (cost, audit), codes


def test_all_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = cr.repair_rows(cr.damaged(frame(spark, [(gone, 0, "user", "Hi.")]))).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair(frame(spark, [])).count() == 0
