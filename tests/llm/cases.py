"""Small awkward tables and brute-force results shared by the operator tests."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

# Names that the operators use for columns of their own.
CLASHING = {"n": 1, "start": "x", "score": 0.5, "ids": [1], "_items": "y", "_starts": 2, "kept": True, "cls": 3, "_toxicity": 1.0, "_gone": 4, "_dedup_id": 5, "part": 6, "label": 7}
DOC_SCHEMA = "doc_id bigint, text string, n int, start string, score double, ids array<int>, _items string, _starts int, kept boolean, cls int, _toxicity double, _gone int, _dedup_id int, part int, label int"

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "nur", "pe", "só", "tau") for b in ("ra", "ben", "dix", "fol", "gü", "hem", "jy", "kos", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, blanks, copies, near copies, shared passages, a very long text and repeated rows."""
    rng = random.Random(5)
    base, passage, line = prose(rng, 120), prose(rng, 45), prose(rng, 24)
    words = base.split(" ")
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n"), (4, "Solo"), (5, "solo"), (6, "solo "), (7, base), (8, base.upper()), (9, base + "\n"),
        (10, base), (10, base), (11, prose(rng, 30_000)), (12, passage + " " + prose(rng, 40)), (13, prose(rng, 25) + "\n" + passage),
        (14, " ".join([line] * 5)), (None, base), (None, None), (15, "a" * 5000), (16, "两 只 老虎   x"), (17, "tab\tand  blanks \n\n end "),
        (18, "it's 12 o'clock, <|endoftext|> isn't it?"), (19, "\0 odd \0\0 bytes"),
    ]
    for i in range(40):
        near = list(words)
        for at in rng.sample(range(len(near)), i % 9):
            near[at] = rng.choice(VOCABULARY)
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, line + "\n" + prose(rng, 30 + i)) for i in range(30)]
    rows += [(300 + i, prose(rng, rng.randint(1, 60))) for i in range(20)]
    return rows


def documents(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(i, t, *CLASHING.values()) for i, t in rows], DOC_SCHEMA).repartition(3)


def as_rows(df, columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


WHITE = re.compile(r"[\x20\x09-\x0D]")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def copies(rows) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()) for _, _, i in members]
    return sorted(out, key=repr)


def shingles(text, k) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < k else (tuple(words[a:a + k]) for a in range(len(words) - k + 1)))


def near_components(rows, k) -> dict[int, int]:
    """Component per non-null doc_id."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            common = len(s & t)
            if s and 100 * common >= 80 * (len(s) + len(t) - common) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {x: low if c == high else c for x, c in label.items()}
    return label


def repeats(rows, window=20) -> dict:
    """(n_words, n_removed, kept text) per doc_id; the rows' ids are distinct."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for a in range(len(words) - window + 1):
            w = tuple(words[a:a + window])
            if w in seen:
                gone.update(range(a, a + window))
            seen.add(w)
        out[i] = (len(words), len(gone), " ".join(w for a, w in enumerate(words) if a not in gone))
    return out


def contamination(rows, items, n=13) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for item, t in items:
        w = word.findall(lower(t or ""))
        for a in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[a:a + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, found = word.findall(lower(t or "")), set(), set()
        for size in {len(g) for g in grams}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in grams:
                    hit.update(range(a, a + size))
                    found |= grams[tuple(w[a:a + size])]
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def crc(text) -> int:
    return zlib.crc32((text or "").encode())


