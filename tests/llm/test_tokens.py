"""Bit planes and the BPE tree: exact round trips and the tokenizer libraries as reference."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import common, op01_bitplanes as planes, op10_bpe_tree as tree

ENC = tree.encoder(public_tokenizers.path(tree.RANKS), public_tokenizers.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})
HF = Tokenizer.from_file(public_tokenizers.path(planes.TOKENIZER))
HF.encode_special_tokens = True

MIXED = st.text(alphabet=st.sampled_from("aabethst  \n\t\x1f\x85'.,!?019éñß漢字\U0001f600"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_tree_equals_tiktoken(text):
    ids = ENC.encode(text)
    assert ids.tolist() == TIK.encode_ordinary(text)
    assert ENC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40), st.binary(max_size=40))
def test_the_product_is_associative(a, b, c):
    x, y, z = map(ENC.merge, (a, b, c))
    assert ENC.join(ENC.join(x, y), z) == ENC.join(x, ENC.join(y, z)) == ENC.merge(a + b + c)
    assert ENC.join((), x) == x == ENC.join(x, ())


def test_long_matches():
    for text in ("a" * 30_000, "the" * 9_000, "\n" * 5_000, "é" * 4_000):
        assert ENC.encode(text).tolist() == TIK.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, max_size=4))
def test_chunks_equal_whole_texts(texts):
    tok = planes.tokenizer(public_tokenizers.path(planes.TOKENIZER))
    assert [np.frombuffer(g, tok.kind).tolist() for g in tok.encode(texts)] == [HF.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y, <|endoftext|>5. z  <|endoftext|>\n<|endoftext|> ", "one two<|endoftext|>. two <|endoftext|><|endoftext|>", "<|endoftext |> <|endoftext|"])
def test_special_tokens_as_the_library_finds_them(text):
    plain = Tokenizer.from_file(public_tokenizers.path(planes.TOKENIZER))
    tok = planes.ChunkTokenizer(public_tokenizers.path(planes.TOKENIZER))
    for texts in ([text], [text, "one two", text + " " + text]):
        assert [np.frombuffer(g, tok.kind).tolist() for g in tok.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_parts_are_not_encoded_again(monkeypatch):
    """Lines and closing signs of a chunk are parts, so new combinations of known ones cost no call of the library."""
    plain = Tokenizer.from_file(public_tokenizers.path(planes.TOKENIZER))
    tok = planes.ChunkTokenizer(public_tokenizers.path(planes.TOKENIZER))
    tok.encode(["one two\nthree.", "a three!?\nfour"])
    monkeypatch.setattr(tok, "model", None)
    texts = ["one two.\nthree two\nfour!?", "one three\nfour."]
    assert [np.frombuffer(g, tok.kind).tolist() for g in tok.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("limit", [2, 40, 500_000])
def test_forgotten_parts_are_encoded_again(limit):
    plain = Tokenizer.from_file(public_tokenizers.path(planes.TOKENIZER))
    tok = planes.ChunkTokenizer(public_tokenizers.path(planes.TOKENIZER), limit)
    rng = random.Random(3)
    signs = [" ", " ", "\n", "\t", "\x85", "'s", "a", "B", "é", ".", ",", "#$", "1", "²", "日", "😀", "ab", "<|endoftext|>"]
    for _ in range(30):
        texts = ["".join(rng.choices(signs, k=rng.randrange(15))) for _ in range(20)] + ["", None]
        assert [np.frombuffer(g, tok.kind).tolist() for g in tok.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(kind, width):
    ids = np.random.default_rng(1).integers(0, 1 << 16, 1001)
    payload, sizes = planes.to_planes(ids, width, kind)
    assert len(sizes) == width * (8 if kind == "bit" else 1)
    assert planes.from_planes(payload, sizes, 1001, width, kind).tolist() == ids.tolist()


def test_crc_of_parts():
    data = bytes(range(256)) * 9
    parts = [data[:5], b"", data[5:700], data[700:]]
    assert planes.crc32_concat([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files(spark, tmp_path, kind):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "ton", "é", "  ", "x!"]) for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "word " * 4000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, shard int, payload string").repartition(5)
    folder = str(tmp_path / "ids")
    planes.write(docs, folder, block=64, planes=kind)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.documents(folder, spark).collect()}
    start, stream = 0, []
    for k, t in sorted(rows):
        ids = HF.encode(t or "", add_special_tokens=False).ids + [planes.END_ID]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    index = spark.read.parquet(f"{folder}/index").orderBy("start").collect()
    blocks = {(r.shard, r.chunk): r.ids for r in planes.blocks(folder, spark).collect()}
    assert sum((blocks[r.shard, r.chunk] for r in index), []) == stream
    assert all(r.n_ids <= 64 for r in index)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert planes.encode_write_read(empty).count() == 0
    assert tree.digests(tree.encode_decode(empty)).count() == 0
    odd = spark.createDataFrame([(1, None), (None, "a b"), (1, ""), (1, "")], "doc_id long, text string")
    assert sorted(r.start for r in planes.encode_write_read(odd).collect()) == [0, 3, 4, 5]
    got = sorted((str(r.doc_id), r.n_tokens) for r in tree.digests(tree.encode_decode(odd)).collect())
    assert got == [("1", 0), ("1", 0), ("1", 0), ("None", 2)]


def test_steps_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "c"]})
    assert [b.num_rows for b in common.steps(iter([batch]), "text", 20)] == [2, 1, 1]
