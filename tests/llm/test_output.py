"""Token files, shards, packages and sentence pieces."""
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import sentence_pieces, sharding, token_output, warc_zip
from cohortlens.llm.common import prepare, scratch_path

import cases

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return cases.documents(spark).cache()


# ---------------------------------------------------------------- token files
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files_round_trip(spark, docs, name):
    path, file = scratch_path(spark, "token-test"), public_tokenizers.path(name)
    token_output.write_token_files(docs, path, file, 2)
    got = sorted(token_output.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(file)
    want = sorted(((i is not None, i or 0, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in cases.awkward_texts()), key=lambda w: w[:2])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [i if known else None for known, i, _ in want]
    ids = {}
    for r in got:
        ids.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    for i, found in ids.items():
        assert sorted(found) == sorted(x for known, j, x in want if (j if known else None) == i)


def test_variable_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_output.vbyte_encode(values)
        assert len(control) == -(-n // 4) and (token_output.vbyte_decode(control, data, n) == values).all()
    control, data = token_output.vbyte_encode(np.array([7, 300, 70_000, 1 << 24]))
    assert (control, len(data)) == (bytes([0b11100100]), 10)
    with pytest.raises(ValueError):
        token_output.vbyte_decode(control, data[:-1], 4)


def test_many_documents_are_coded_at_once():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, top, n) for n, top in ((0, 1), (5, 200), (4, 70_000), (1, 1 << 25), (0, 1), (9, 300))]
    counts = np.array([len(d) for d in docs])
    pairs = token_output.vbyte_encode_many(np.concatenate(docs), counts)
    assert pairs == [token_output.vbyte_encode(d) for d in docs]
    controls, datas = map(list, zip(*pairs))
    assert (token_output.vbyte_decode_many(controls, datas, counts) == np.concatenate(docs)).all()
    datas[1], datas[2] = datas[1] + datas[2][:1], datas[2][1:]
    with pytest.raises(ValueError):
        token_output.vbyte_decode_many(controls, datas, counts)


def test_letters_of_many_parts_go_to_the_model_once(monkeypatch):
    import pyarrow as pa

    file = public_tokenizers.path("byte_bpe_50k.json")
    with open(file, encoding="utf-8") as f:
        encoder = token_output.MemoEncoder(f.read(), "<u2")
    asked, model = [], encoder._model
    monkeypatch.setattr(encoder, "_model", lambda pieces: (asked.extend(pieces), model(pieces))[1])
    text = "zorvik zorvik, (zorvik) zorvik. zorvik?!\nzorvik\nzorvik; élan élan, élan."
    ids = Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(pa.array([text]))[0], "<u2").tolist() == ids
    assert [asked.count(p) for p in (" zorvik", "zorvik", " élan")] == [1, 1, 1]


def test_memo_gives_the_library_s_ids():
    import pyarrow as pa

    file = public_tokenizers.path("byte_bpe_50k.json")
    with open(file, encoding="utf-8") as f:
        encoder = token_output.MemoEncoder(f.read(), "<u2", limit=50)
    plain, rng = Tokenizer.from_file(file), random.Random(0)
    pieces = ["a", "Bc", " ", "\n", " ", "\t", ".", "'s", "7", "é", "-", "\0", " x", ",", "ü.", "“", " ", "　", "…", "®,"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        for t, raw in zip(part, encoder.encode(pa.array(part))):
            assert np.frombuffer(raw, "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_common_parts_are_learnt_once_though_the_memo_overflows(monkeypatch):
    import pyarrow as pa

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_output.MemoEncoder(f.read(), "<u2", limit=60)
    learnt, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda parts: (learnt.extend(parts), learn(parts))[1])
    rng = random.Random(1)
    for _ in range(20):
        rare = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(40)]
        encoder.encode(pa.array([f"x the of, and\nor {' '.join(rare)}"]))
    assert [learnt.count(p) for p in ("the", "of,", "and", "\nor")] == [1, 1, 1, 1]


def test_many_pieces_in_one_call_of_the_model():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    encoder = token_output.MemoEncoder(text, "<u2")
    rng = random.Random(2)
    pieces = [" " + "".join(rng.choices("aeiounthsé漢ß", k=rng.randint(1, 40))) for _ in range(450)]
    spec = json.loads(text)
    spec["model"]["ignore_merges"] = True  # whole words first: pieces go to the model one by one
    for encoder in (encoder, token_output.MemoEncoder(json.dumps(spec), "<u2")):
        one_by_one = [[t.id for t in encoder.tokenizer.model.tokenize(encoder._mapped(p))] for p in pieces]
        assert [np.frombuffer(raw, "<u2").tolist() for raw in encoder._model(pieces)] == one_by_one
    assert token_output.MemoEncoder(text, "<u2").mark and not encoder.mark


# ---------------------------------------------------------------- shards
def md5_key(i) -> int:
    import hashlib

    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


def test_shards_follow_the_key_and_grow_by_one(spark, docs):
    rows = sharding.shard_documents(docs, 8, rows_per_block=3).collect()
    texts = cases.awkward_texts()
    assert len(rows) == len(texts)
    for r in rows:
        key = md5_key(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (cases.jump(key, 8), cases.jump(key, 9))
        assert r["grown_shard"] in (r["shard"], 8)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, cases.crc(t)) for _, t in texts)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_jump_hash_against_the_loop(spark):
    ids = spark.range(3000).select(F.col("id"), *[sharding.jump_hash(F.col("id"), n).alias(f"s{n}") for n in (1, 2, 13)]).collect()
    assert all(r[f"s{n}"] == cases.jump(md5_key(r["id"]), n) for r in ids for n in (1, 2, 13))
    counts = np.bincount([r["s13"] for r in ids], minlength=13)
    assert counts.min() > 160 and counts.max() < 300
    with pytest.raises(ValueError):
        sharding.jump_hash(F.lit(1), 0)
    assert sharding.shard_documents(cases.documents(spark, [])).count() == 0


# ---------------------------------------------------------------- packages
PAGES = [(1, "http://a/ü x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c\r\nX: y", None), (4, "d", ""), (5, "e", "é" * 30_000), (6, "f", "<p>one</p>"), (6, "f", "<p>one</p>"), (None, "g", "<p>two</p>"), (8, "h", "line\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("package_bytes, min_bytes", [(32_000_000, 0), (1, 0), (300, 1)])
def test_packages_round_trip(spark, package_bytes, min_bytes):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, winner int")
    packages = warc_zip.write_packages(pages, scratch_path(spark, "package-test"), min_bytes=min_bytes, package_bytes=package_bytes)
    index = warc_zip.read_index(packages)
    got = warc_zip.read_records(index).collect()
    assert len(got) == len(PAGES)
    winners = {}
    for k, _, html in PAGES:
        if k is not None and len((html or "").encode()) >= min_bytes:
            winners[html or ""] = max(winners.get(html or "", 0), k)
    texts = {k: (html or "") for k, _, html in PAGES}
    for r in got:
        payload = texts[r["page_id"]].encode()
        keep = winners.get(texts[r["page_id"]], r["page_id"])
        revisit = keep != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc_zip.payload_digest(payload))
        assert (r["record_type"], r["refers_to"]) == (("revisit", keep) if revisit else ("response", None))
        assert (None if r["payload"] is None else bytes(r["payload"])) == (None if revisit else payload)
    few = warc_zip.read_records(index.where("page_id in (5, 8)")).collect()
    assert {r["page_id"] for r in few} == {5, 8}


def test_no_pages(spark):
    packages = warc_zip.write_packages(spark.createDataFrame([], "page_id bigint, url string, html string"), scratch_path(spark, "package-test"))
    assert warc_zip.read_records(warc_zip.read_index(packages)).count() == 0


def directory_of(path):
    raw = path.read_bytes()
    return warc_zip.read_directory(lambda n, at: raw[at:at + n], len(raw)), lambda n, at: raw[at:at + n]


def test_zip64_directories(tmp_path, monkeypatch):
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}", "")
    assert len(directory_of(many)[0]) == 66_000
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    big = tmp_path / "big.zip"
    with zipfile.ZipFile(big, "w") as z:
        z.writestr("é/first", b"x" * 50)
        z.writestr("second", b"y" * 70, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK"
    members, read_at = directory_of(big)
    assert [(m.name, m.size) for m in members] == [("é/first", 50), ("second", 70)]
    assert read_at(50, warc_zip.stored_offset(read_at, members[0])) == b"x" * 50
    with pytest.raises(ValueError):
        warc_zip.stored_offset(read_at, members[1])
    with pytest.raises(ValueError):
        warc_zip.read_directory(lambda n, at: b"no zip"[at:at + n], 6)


# ---------------------------------------------------------------- sentence pieces
def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number: int, value: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_pieces: bool) -> bytes:
    """A hand-written unigram model file (fixture, not trained)."""
    import struct

    def piece(text: str, score: float, kind: int) -> bytes:
        return field(1, field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))

    rng = random.Random(3)
    texts = sorted({"▁", *"abcdefgü", *("▁" * (rng.random() < 0.4) + "".join(rng.choice("abcdefgü") for _ in range(rng.randint(2, 5))) for _ in range(150))})
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if byte_pieces:
        out += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    out += b"".join(piece(t, -rng.uniform(2, 4) - len(t) * 0.6, 1) for t in texts)
    trainer = varint(3 << 3) + varint(1) + (varint(35 << 3) + varint(1) if byte_pieces else b"")
    return out + field(2, trainer) + field(3, field(1, b"identity"))


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_unigram_ids_equal_the_library_s(byte_pieces):
    model = sentence_pieces.PieceModel(unigram_model(byte_pieces))
    rng = random.Random(7)
    words = sorted({"▁" * rng.randint(0, 2) + "".join(rng.choice("abcdefgüxy" if rng.random() < 0.2 else "abcdefgü") for _ in range(rng.randint(1, 14))) for _ in range(800)})
    marked = sorted({model.sp.normalize(w.replace("▁", " ")) for w in words})
    same = 0
    for word, ids in zip(marked, model.segment(marked)):
        want = model.sp.encode(word.removeprefix("▁").replace("▁", " "))
        assert model.decode(ids) == model.decode(want)
        # the library adds in single precision, so paths of equal score may differ
        assert ids == want or abs(sum(model.sp.get_score(i) for i in ids) - sum(model.sp.get_score(i) for i in want)) < 1e-4
        same += ids == want
    assert same > 0.97 * len(marked)


def test_shared_prefixes_change_nothing():
    model = sentence_pieces.PieceModel(sentence_pieces.load_model(public_tokenizers.path("piece_bpe_32k.model")))
    words = sorted({w for _, t in cases.awkward_texts() if t and len(t) < 9000 for w in model.words(t)})
    assert model.segment(words) == [model.segment([w])[0] for w in words]


def test_pieces_round_trip(spark, docs):
    model = sentence_pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentence_pieces.encode(docs, model, check=True)
    assert coded.count() == len(cases.awkward_texts()) and coded.where("not decoded_ok").count() == 0
    back = sentence_pieces.decode(coded, model).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert sentence_pieces.encode(cases.documents(spark, []), model).count() == 0
    assert sorted(coded.columns) == sorted([*docs.columns, "decoded_ok"])
