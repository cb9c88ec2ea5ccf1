import os

import pytest

from siltstone.llm import bpe
from siltstone.llm.queries import vocabulary_path

PATH = vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", " ", "Hello world's  end \n\n\t x", "aaaaaaaaaaaaaaaaaaaaaaa aaa", "漢字かな交じり文。" * 20, "<|endoftext|> 1234567", "é̂ ​\U0001f600\x00", "ab" * 500, "https://a.b/c?d=e&f", None]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.load_vocabulary(PATH))


def test_against_the_reference_tokenizer(encoder):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(PATH)
    known.encode_special_tokens = True
    want = lambda t: known.encode(t or "", add_special_tokens=False).ids
    assert encoder.encode(TEXTS) == [want(t) for t in TEXTS]

    @settings(max_examples=40, deadline=None)
    @given(st.lists(st.text(max_size=30), max_size=5))
    def check(texts):
        assert encoder.encode(texts) == [want(t) for t in texts]

    check()


def test_ids_decode_to_the_text(encoder):
    import json

    model = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    letters = {i: t for t, i in model.items()}
    byte_of = bpe._byte_letters()
    for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
        assert bytes(byte_of[c] for i in ids for c in letters[i]).decode() == (text or "")


def test_documents(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df, PATH).collect()}
    assert got[0] == [] and got[9] == [] and len(got) == len(TEXTS) and got[2][0] == 15496
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_decoded_documents_are_the_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    encoded = bpe.encode_documents(docs, PATH)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in bpe.decode_documents(odd, PATH).collect()} == {(1, ""), (2, "")}
    with pytest.raises(Exception, match="without a token"):
        bpe.decode_documents(spark.createDataFrame([(1, [10_000_000])], odd.schema), PATH).collect()
    assert bpe.decode_documents(odd.limit(0), PATH).count() == 0
