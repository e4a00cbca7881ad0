import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scenegrain.llm import tokens as T


@pytest.fixture(scope="module")
def pair():
    with open(T.vocabulary_path(), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return T.Vocabulary(raw), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(pair, text):
    assert pair[0].encode_all([text]) == [pair[1].encode_ordinary(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=12))
def test_any_tokens_in_a_row(pair, ids):
    text = b"".join(pair[0].bytes_of[i] for i in ids).decode("utf-8", "replace")
    assert pair[0].encode_all([text]) == [pair[1].encode_ordinary(text)]


@pytest.mark.parametrize("text", ["a" * 200_000, "あ漢" * 20_000, "<|endoftext|>", " \r\n\t ", "don't WON'T I'll", "é́‍👩‍👩‍👧", "1234567890" * 50, "x" * 17 + " " * 99])
def test_corners(pair, text):
    assert pair[0].encode_all([text])[0] == pair[1].encode_ordinary(text)
    assert b"".join(pair[0].bytes_of[i] for i in pair[0].encode_all([text])[0]).decode() == text


def test_table(spark, pair):
    df = spark.createDataFrame([(1, "a b", "clash"), (1, "a b", "clash"), (2, "", "x"), (3, None, "x"), (None, "c", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0), r.ids) for r in T.encode(df).select("doc_id", "ids").collect())
    e = pair[1].encode_ordinary
    assert got == sorted([(1, e("a b")), (1, e("a b")), (2, []), (3, []), (0, e("c"))])
    assert T.encode(df.limit(0)).count() == 0
    assert [r.n for r in T.encode(df.filter("doc_id = 3"), column="n", only_count=True).collect()] == [0]


def test_memo_is_only_a_memo(pair, monkeypatch):
    v = T.Vocabulary.__new__(T.Vocabulary)
    v.__dict__.update(pair[0].__dict__, words={}, pairs={})
    monkeypatch.setattr(T.Vocabulary, "MEMO", 3)
    texts = [f"word{i} unbelievable{i} §{i}" for i in range(2000)]
    assert v.encode_all(texts) == pair[1].encode_ordinary_batch(texts)


def test_batches_of_long_texts_are_cut():
    import pyarrow as pa

    texts = ["a" * 5, None, "", "b" * 50, "c" * 4, "d" * 6, "é" * 5, None]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(8))], names=["text", "i"])
    parts = [p.column(1).to_pylist() for p in T.bounded(b, "text", 10)]
    assert parts == [[0, 1, 2], [3], [4, 5], [6, 7]] and [p.num_rows for p in T.bounded(b.slice(0, 0), "text")] == []
