import datetime as dt

from cohortlens.operators import memory as mem

SCHEMA = ("memory_id string, user_id string, ts timestamp, interaction_type string, content map<string,string>, "
          "context map<string,string>, outcome map<string,string>, consented boolean, emotional_state string, "
          "products_mentioned array<string>, actions_taken array<string>")
NOW = "2025-01-02 00:00:00"


def entry(mid, user, content, context, consented, products=(), outcome=None):
    return (mid, user, dt.datetime(2025, 1, 1), "query", content, context, outcome or {}, consented, None, list(products), [])


def notes():
    """Five notes of three people; one was written without consent."""
    return [
        entry("n-1", "ines", {"topic": "lost parcel"}, {"contact_method": "phone"}, True, ["courier", "courier", "courier", "courier"]),
        entry("n-2", "ines", {"topic": "invoice copy"}, {}, True, ["archive"]),
        entry("n-3", "jonas", {"topic": "lost parcel"}, {"contact_method": "letter"}, True),
        entry("n-4", "jonas", {"topic": "lost parcel again"}, {}, False, ["courier"]),
        entry("n-5", "karla", {"topic": "opening hours"}, {}, True),
    ]


def test_searches_see_own_consented_notes_until_forgotten(spark):
    saved = mem.save(spark.createDataFrame(notes(), SCHEMA), as_of=NOW)
    assert [(r["memory_id"], r["reason"]) for r in saved["rejected"].collect()] == [("n-4", mem.CONSENT_REFUSAL)]
    asked = spark.createDataFrame([(7, "ines", "parcel"), (8, "jonas", "parcel lost"), (9, "lars", "parcel")], "query_id int, user_id string, query string")

    def found(rows):
        return sorted((r["query_id"], r["rank"], r["memory_id"]) for r in mem.search(mem.decode(rows), asked, as_of=NOW)["results"].collect())

    assert found(saved["stored"]) == [(7, 1, "n-1"), (7, 2, "n-2"), (8, 1, "n-3")]
    out = mem.forget(saved["stored"], spark.createDataFrame([("jonas",), ("lars",)], "user_id string"), as_of=NOW)
    assert {r["user_id"]: r["deleted_memory_count"] for r in out["deleted"].collect()} == {"jonas": 1, "lars": 0}
    assert found(out["remaining"]) == [(7, 1, "n-1"), (7, 2, "n-2")]


def test_interest_raises_eligible_offers_up_to_a_bound(spark):
    profiles = mem.build_profiles(mem.decode(mem.save(spark.createDataFrame(notes(), SCHEMA), as_of=NOW)["stored"]), as_of=NOW)
    counts = {r["user_id"]: r["product_interest_counts"] for r in profiles.collect()}
    assert counts["ines"] == {"courier": 4, "archive": 1} and counts["karla"] == {}
    offers = [("ines", "archive", True), ("ines", "courier", True), ("ines", "boxes", None), ("karla", "courier", True), ("ines", "archive-plus", False)]
    ranked = mem.rerank(spark.createDataFrame(offers, "user_id string, product string, eligible boolean"), profiles).collect()
    assert {(r["user_id"], r["product"]): (r["memory_rank_adjustment"], r["rank"]) for r in ranked} == {
        ("ines", "courier"): (mem.MAX_ADJUSTMENT, 1), ("ines", "archive"): (1, 2), ("ines", "archive-plus"): (0, 3), ("ines", "boxes"): (0, 4), ("karla", "courier"): (0, 1)}
    blocked = spark.createDataFrame([("ines", "courier", False)], "user_id string, product string, eligible boolean")
    assert mem.rerank(blocked, profiles).first()["memory_rank_adjustment"] == 0


def test_encrypted_payload_round_trip(spark):
    entries = spark.createDataFrame([entry("m1", "user-a", {"topic": "card"}, {}, True, ["card"])], SCHEMA)
    key = "0123456789abcdef"
    stored = mem.save(entries, as_of=NOW, key=key, key_id="k1")["stored"]
    assert "card" not in stored.collect()[0]["payload"]
    back = mem.decode(stored, key=key).collect()[0]
    assert back["content"] == {"topic": "card"} and back["products_mentioned"] == ["card"]


def test_search_top_k_matches_scoring_rule(spark):
    rows = [entry(f"m{i}", "u", {"topic": "loan" if i % 4 == 0 else "other"}, {}, True) for i in range(30)]
    entries = spark.createDataFrame(rows, SCHEMA)
    dec = mem.decode(mem.save(entries, as_of=NOW)["stored"])
    q = spark.createDataFrame([(1, "u", "loan please")], "query_id int, user_id string, query string")
    res = mem.search(dec, q, limit=10, as_of=NOW)["results"].orderBy("rank").collect()
    loans = sorted(f"m{i}" for i in range(30) if i % 4 == 0)
    others = sorted(f"m{i}" for i in range(30) if i % 4 != 0)
    assert [r["memory_id"] for r in res] == (loans + others)[:10]


def test_search_over_blocks_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["loan", "card", "savings", "mortgage", "chat", "email", "branch", "fees", "rate", "alert"]
    rows = []
    for i in range(120):
        text = " ".join(rng.sample(words, rng.randint(1, 4)))
        rows.append((f"m{i:03d}", f"u{i % 3}", dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.choice([0, 0, rng.randint(0, 200)])), "q",
                     {"topic": rng.choice(["user", "assistant"]), "text": text}, {"contact_method": rng.choice(["chat", "email"])},
                     {}, True, None, rng.choice([["card"], [], ["card", "savings"]]), []))
    dec = mem.decode(mem.save(spark.createDataFrame(rows, SCHEMA), as_of=NOW)["stored"]).cache()
    qs = [(j, f"u{j % 4}", " ".join(rng.sample(words + ["topic", "text", "user", "nowhere"], 3)) if j else "") for j in range(16)]
    q = spark.createDataFrame(qs, "query_id int, user_id string, query string")
    now, want = dt.datetime.fromisoformat(NOW), {}
    for j, user, text in qs:
        scored = []
        for m in rows:
            if m[1] == user:
                own = set("content context products".split()) | {w for d in (m[4], m[5]) for k, v in d.items() for w in [k, *v.split()]} | set(m[9])
                age = max(0.0, (now - m[2]).total_seconds() / 86400)
                scored.append((-(10 * len(own & set(text.split())) + 1 / (1 + age)), m[0]))
        want |= {(j, r): m for r, (_, m) in enumerate(sorted(scored)[:7], 1)}
    for block in (4096, 9, 1):
        got = {(r["query_id"], r["rank"]): r["memory_id"] for r in mem.search(dec, q, limit=7, as_of=NOW, block_rows=block)["results"].collect()}
        assert got == want, block


def test_blocks_of_many_queries_are_copied_and_answer_the_same(spark):
    import random

    rng = random.Random(7)
    words = ["loan", "card", "savings", "mortgage", "chat", "email", "branch", "fees"]
    rows = [entry(f"m{i:02d}", f"u{i % 2}", {"text": " ".join(rng.sample(words, 3))}, {}, True) for i in range(40)]
    dec = mem.decode(mem.save(spark.createDataFrame(rows, SCHEMA), as_of=NOW)["stored"]).cache()
    q = spark.createDataFrame([(j, f"u{j % 3}", " ".join(rng.sample(words, 3))) for j in range(30)], "query_id int, user_id string, query string")

    def found(**sizes):
        return sorted(map(tuple, mem.search(dec, q, limit=4, as_of=NOW, **sizes)["results"].collect()))

    whole = found()
    assert len(whole) == 20 * 4 and found(part_queries=3) == whole and found(block_rows=7, part_queries=3) == whole


def test_other_blocks_give_only_what_reaches_the_floor():
    rng = __import__("random").Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(rng.random(), f"m{i:03d}", rng.sample(words, rng.randint(1, 290))) for i in range(200)]
    asked = rng.sample(words, 280) + ["nowhere"]  # more shared tokens than a byte counts
    scored = sorted(((-len(set(own) & set(asked)), -age, m) for age, m, own in rows))
    want = [(m, -age, -n) for n, age, m in scored if n]
    index = mem._BlockIndex(list(rows))
    assert index.best(asked, 12, None) == want[:12] and index.best(asked, 500, None) == want
    floor = 10.0 * want[5][2] + want[5][1]
    assert index.best(asked, 12, floor) == want[:6]
    assert index.best(asked[:3], 12, 31.5) == [] and index.best(["nowhere"], 12, None) == []
