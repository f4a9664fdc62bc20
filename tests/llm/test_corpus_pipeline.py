"""The pipeline's stages on their own input, and the registered queries against their SQL."""

import hashlib

import duckdb
import pytest
from test_duplicates import plain_fingerprint, plain_words
from test_text_models import plain_score
from test_tokens import TIK

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import op04_toxicity, queries
from tallyloom.llm.common import importable

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*cols).collect()), key=repr) == want


def test_stages(spark):
    importable(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == COLUMNS, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_duplicates", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    done = corpus_pipeline.run(spark, DATA)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < done.count() <= before


def test_stages_take_odd_rows(spark):
    importable(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    odd = spark.createDataFrame([(1, None, None, None, None, 0.0), (2, "", "en", "s", 0, 0.0), (None, "é" * 80, "fr", "s", 80, 0.0), (3, "é" * 80, "fr", "s", 80, 0.0), (3, "é" * 80, "fr", "s", 80, 0.0)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DATA).count() <= docs.count()


def test_groups_keep_one(spark):
    importable(spark)
    text = "one two three four five six seven eight nine ten"
    rows = [(k, text, "en", "s", len(text)) for k in (8, 3, 5)] + [(9, "something else entirely, in other words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()) == [3, 9]


def plain_pipeline(docs, items, model):
    """All five stages in plain Python, each on what the one before kept; (doc_id, n_tokens, ids hash, bytes hash)."""
    docs = [(k, t) for k, t in docs if plain_score(model, t or "") < op04_toxicity.CUTOFF]
    prints = {k: plain_fingerprint(t) for k, t in docs}
    near = {k: [j for j in prints if (prints[j] ^ prints[k]).bit_count() <= 3] for k in prints}
    first: dict = {}
    for k in sorted(near):
        todo = [] if k in first else [k]
        while todo:
            j = todo.pop()
            if j not in first:
                first[j] = k
                todo += near[j]
    docs = [(k, t) for k, t in docs if first[k] == k]
    seen, kept = set(), []
    for k, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(raw[i:i + 100])
        kept.append((k, bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")))
    windows: dict = {}
    for _, it in items:
        ws = plain_words(it)
        n = min(13, len(ws))
        for s in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(ws[s:s + n]))
    out = []
    for k, t in kept:
        ws, hit = plain_words(t), set()
        for n, some in windows.items():
            for p in range(len(ws) - n + 1):
                if tuple(ws[p:p + n]) in some:
                    hit.update(range(p, p + n))
        if not (hit and 20 * len(hit) >= len(ws)):
            ids = TIK.encode_ordinary(t)
            out.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TIK.decode_bytes(ids)).hexdigest()))
    return sorted(out)


def test_pipeline_equals_plain_stages(spark):
    importable(spark)
    docs, labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = op04_toxicity.train(docs, labels)
    want = plain_pipeline([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], model)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and 0 < len(got) < docs.count()
