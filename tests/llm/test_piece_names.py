"""Column names of the sentence-piece operator."""
import pytest

from cohortlens.llm import sentence_pieces
from cohortlens.llm.common import prepare

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_columns_that_differ_in_case_stay(spark):
    prepare(spark)
    model = sentence_pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "one two", "x", False, "y"), (2, None, None, None, None)], "doc_id int, text string, IDS string, Decoded_OK boolean, DECODED string")
    coded = sentence_pieces.encode(docs, model, check=True)
    assert coded.columns == [*docs.columns, "ids_", "decoded_ok_"]
    back = sentence_pieces.decode(coded, model, ids="ids_")
    rows = {r["doc_id"]: r.asDict() for r in back.collect()}
    assert (rows[1]["IDS"], rows[1]["Decoded_OK"], rows[1]["DECODED"]) == ("x", False, "y")
    assert rows[1]["decoded_"] == "one two" and rows[1]["decoded_ok_"] and rows[2]["decoded_"] == ""
