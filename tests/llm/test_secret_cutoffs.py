"""Many ordinary strings of a length must not silence the random ones."""
import random

from cohortlens.llm import secrets
from cohortlens.llm.common import prepare

import cases

WORDS = (
    "the order of a customer is in this table and other people have their own account with total values from last year "
    "quick brown foxes jump over lazy dogs while my big zebra vexed jack and wolves hiked up from quiz night by bus mp3 h2o 3rd x86 b2b 7th").split()
LOWER_ALNUM = secrets.LOWER + secrets.DIGITS


def test_a_hot_source_of_template_ids_leaves_keys_found(spark):
    prepare(spark)
    rng = random.Random(3)
    keys = ["".join(rng.choice(LOWER_ALNUM) for _ in range(20)) for _ in range(60)]
    ids = []
    while len(ids) < 600:
        parts = "".join(rng.choice(["order", "total", "account", "customer", "table", "year"]) for _ in range(4))[:16]
        ids.append(parts + f"{rng.randrange(10000):04d}")
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + f" {k}") for i, k in enumerate(keys + ids)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(cases.documents(spark, rows)).collect()}
    texts = dict(rows)
    found = sum(f"random:{texts[i].index(k)}:{len(texts[i])}" in got[i] for i, k in enumerate(keys))
    wrong = sum("random" in got[len(keys) + i] for i in range(len(ids)))
    assert found >= 0.75 * len(keys) and wrong <= 0.1 * found


def test_cut_off_rises_with_ordinary_strings(spark):
    rng = random.Random(5)
    prose = [(i, " ".join(rng.choice(WORDS) for _ in range(200))) for i in range(50)]
    keys = ["".join(rng.choice(LOWER_ALNUM) for _ in range(22)) for _ in range(40)]
    plain = ["ordertotalcustomer" + f"{i:04d}" for i in range(2000)]

    def cut(strings):
        docs = cases.documents(spark, prose + [(100, " ".join(strings))])
        return secrets.cut_offs(docs, "text", secrets.text_rates(docs, "text"))["lower_alnum:8"]

    assert cut(keys) < cut(keys + plain) < 60
