"""The compiled tokenizer against the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import op11_token_transducer as op

PATH = public_tokenizers.path(op.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = op.Transducer(PATH)

PARTS = st.sampled_from([
    *"abehst123!.'-_\n\t\r\x0b\x1c\x85\xa0 　éß漢́Ⅷ²᠎​\x00\U0001f600", " ", "  ", " the", "tion", "'s", "'re", "'r", "'ve", "'v", "'ll", "'l", "'d", "'S",
    "<|endoftext|>", "<|endof", "text|>", "aaaa", "----"])
TEXTS = st.lists(PARTS, max_size=30).map("".join)


def expected(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4), st.sampled_from([1, 2, 5, 64, 512]))
def test_counts_equal_the_library(texts, longest):
    assert op.Counter(MACHINE, longest=longest)(texts) == expected(texts)


@settings(max_examples=150, deadline=None)
@given(TEXTS.filter(bool), st.integers(1, 6))
def test_prefix_scan_equals_reading_on(text, longest):
    symbols = op.symbols_of([text], MACHINE.special)
    starts, sure = op.chunk_starts(symbols, longest)
    maps = op.state_maps(MACHINE, symbols, starts, sure, MACHINE.cut)
    state, total = MACHINE.states[MACHINE.cut], 0
    for k, m in enumerate(op.prefix_scan(maps)):
        for s in symbols[starts[k]:starts[k] + longest].tolist():
            state, gain = MACHINE.step(state, s)
            total += gain
        assert m[MACHINE.cut] == (MACHINE.number(state), total)
    assert total == expected([text])[0]


def test_composition_is_associative():
    f, g, h = {0: (1, 2), 1: (1, 3)}, {1: (2, -1)}, {2: (0, 5), 3: (1, 1)}
    assert op.compose(op.compose(f, g), h) == op.compose(f, op.compose(g, h)) == {0: (0, 6), 1: (0, 7)}


def test_every_class_of_character():
    text = [f"a{chr(c)}1 {chr(c)}" for c in range(0, 0x3100)]
    assert op.Counter(MACHINE)(text) == expected(text)


@pytest.mark.parametrize("text", ["a" * 40_000, "ab" * 20_000, "-" * 30_001, " " * 20_001, "the" * 9_000, "\n" * 7_001, "é" * 4_000, "漢字" * 4_000, "' " * 5_000, "it's 'real' we'll " * 4_000])
def test_long_matches(text):
    assert op.Counter(MACHINE)([text, None, text + "x"]) == expected([text, None, text + "x"])


def test_full_tables_change_no_count():
    texts = ["Some words to be read, again and again", "once more: words read 'twice'", None, ""]
    small = op.Counter(op.Transducer(PATH, limit=10), limit=3)
    for _ in range(3):
        assert small(texts) == expected(texts)


def test_query_edges(spark):
    long = "Wörter und words, " * 60_000
    rows = [(1, "It's <|endoftext|> here", 5), (2, None, 6), (3, "", 7), (None, "null key", 8), (5, long, 9), (6, "same", 1), (6, "same", 1), (7, "a" * 513, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint").withColumn("key", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op.token_counts(docs).collect()}
    want = expected([r[1] for r in rows])
    assert got == {(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, want)}
    assert op.token_counts(docs).count() == len(rows)
    assert op.token_counts(docs.limit(0)).collect() == []
    assert [c for c, _ in op.token_counts(docs).dtypes] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_limit_is_a_strict_bound(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id bigint, text string")
    assert {r.doc_id: r.over_limit for r in op.token_counts(docs, limit=3).collect()} == {1: False, 2: True}
