import pytest

from eventloom.llm import tokens

TEXTS = ["", None, "   ", "Hello  world\r\n\tx", "naïve 😀👩‍👩‍👧 末 \u0000 �", "<|endoftext|> is text", "a" * 300_000, "q1 " * 300_000, "  \n\n x\n\n\ny  z", "İ ǅ ﬁ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_tokens string, ids array<int>")


def test_ids_and_round_trip(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    plain.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokens.token_ids(docs).collect()}
    assert got == {i: plain.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == [] and 50256 not in got[5]
    back = {r.doc_id: r.text for r in tokens.decode(tokens.token_ids(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {i: len(x) for i, x in got.items()}


def test_offsets_cover_the_text(docs):
    for r in tokens.token_offsets(docs).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text)
            assert all(a <= b and b - 1 <= c <= b for a, b, c in zip(r.starts, r.ends, r.starts[1:]))


def test_same_ids_as_the_rank_file(spark, data):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokens.FOLDER}/{tokens.TOKENIZER}.tiktoken", "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokens.token_ids(docs).collect():
        assert r.ids == other.encode_ordinary(text[r.doc_id])


def test_decode_of_broken_lists(spark):
    df = spark.createDataFrame([(1, [10_000_000]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(df).collect()} == {1: "�", 2: None, 3: ""}
    assert tokens.token_ids(df.selectExpr("doc_id", "'a' as text").limit(0)).count() == 0
