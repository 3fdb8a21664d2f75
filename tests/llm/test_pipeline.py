"""The pipeline and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_operators import brute_bands, brute_chunks, brute_kept, brute_quality, brute_verdict
from veriset.llm import queries


def test_stages_agree_with_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == columns and dict(tables[-1].dtypes) == dict(docs.dtypes)
    rows = [sorted(t.collect(), key=lambda r: r.doc_id) for t in tables]

    bands = brute_bands((r.lang, r.text) for r in rows[0])
    kept = [r.doc_id for r in rows[0] if not brute_quality(r.text)[5] and brute_verdict(r.lang, r.text, bands) == "ok"]
    assert [r.doc_id for r in rows[1]] == kept

    seen = set()
    for before, after in zip(rows[1], rows[2], strict=True):
        chunks = ["".join(c) for c in brute_chunks(before.text)]
        again = []
        for c in chunks:
            again.append(c in seen)
            seen.add(c)
        alone = [len(c) == 1 for c in brute_chunks(before.text)]
        cut = [g and (not one or a or b) for g, one, a, b in zip(again, alone, [*again[1:], False], [False, *again], strict=False)]
        assert after.text == "".join(c for c, gone in zip(chunks, cut, strict=True) if not gone) and after.n_chars == len(after.text)

    assert [r.doc_id for r in rows[3]] == sorted(brute_kept([(r.doc_id, r.text) for r in rows[2]], corpus_pipeline.SHINGLE))

    assert {tuple(r) for r in rows[4]} <= {tuple(r) for r in rows[3]}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    wanted = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids for r in rows[4]}
    assert [r.doc_id for r in rows[5]] == [r.doc_id for r in rows[4]]
    assert all(r.ids == wanted[r.doc_id] and r.n_tokens == len(r.ids) for r in rows[5])


def test_run_gives_what_the_stages_give(spark, folder):
    found = entry.queries()["pipeline"](spark, folder)
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and found.count() > 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = entry.queries()[name](spark, folder)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_one_query_per_operator():
    assert [sum(n.startswith(f"op{i}_") for n in entry.queries()) for i in range(1, 14)] == [1] * 13
