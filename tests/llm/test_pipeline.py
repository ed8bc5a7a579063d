"""The pipeline's stages, each held on its own input against oracle SQL or a brute-force version."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from placeloom.llm import mixing
from placeloom.llm.common import scratch
from placeloom.llm.line_dedup import OP2_SQL
from placeloom.llm.quality_rules import OP9_SQL
from tests.compare import ROOT
from tests.llm.brute import WORD, near, sha
from tests.llm.test_text_ops import _tiktoken

SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The input and the output of each stage, as lists of rows, and the columns of each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, SF), "test")
        out.append((docs.columns, docs.collect()))
    return out


def sql_rows(sql, rows, columns):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame([tuple(r) for r in rows], columns=columns)
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.register("f", frame)
    con.execute("INSERT INTO documents SELECT doc_id, text, lang, source, n_chars FROM f")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def test_columns(tables):
    assert all(columns == tables[0][0] for columns, _ in tables[:-1])
    assert tables[-1][0] == [*tables[0][0], "ids", "n_tokens"]


def test_quality_stage(tables):
    want = {x["doc_id"] for x in sql_rows(OP9_SQL, tables[0][1], tables[0][0]) if x["kept"]}
    assert sorted(map(tuple, tables[1][1])) == sorted(tuple(x) for x in tables[0][1] if x.doc_id in want)


def test_line_stage(tables):
    want = {x["doc_id"]: x["text_sha256"] for x in sql_rows(OP2_SQL, tables[1][1], tables[1][0])}
    assert {x.doc_id: sha(x.text) for x in tables[2][1]} == want and len(tables[2][1]) == len(tables[1][1])
    assert all(x.n_chars == len(x.text) for x in tables[2][1])


def test_near_stage(tables):
    found = near([(x.doc_id, x.text) for x in tables[2][1]], 5, 80)
    assert sorted(map(tuple, tables[3][1])) == sorted(tuple(x) for x in tables[2][1] if found[x.doc_id][1] == x.doc_id)


def test_mixing_stage(spark, tables):
    columns, rows = tables[3]
    size = Counter()
    for x in rows:
        size[x.source] += len(WORD.findall(x.text))
    taken, of = Counter(), {x.doc_id: x for x in rows}
    for x in tables[4][1]:
        words = WORD.findall(x.text)
        taken[x.source] += len(words)
        assert words == WORD.findall(of[x.doc_id].text)[: len(words)] and x.source == of[x.doc_id].source
    sizes = spark.createDataFrame(list(size.items()), "source string, size long")
    want = {x.source: round(x.target) for x in mixing.source_targets(sizes).collect()}
    assert dict(taken) == {s: t for s, t in want.items() if t}


def test_bpe_stage(tables):
    plain = _tiktoken()
    assert sorted(tuple(x)[:-2] for x in tables[5][1]) == sorted(map(tuple, tables[4][1]))
    for x in tables[5][1]:
        assert list(x.ids) == plain.encode_ordinary(x.text) and x.n_tokens == len(x.ids) and plain.decode(x.ids) == x.text


def test_run(spark, tables):
    assert Counter(x.doc_id for x in corpus_pipeline.run(spark, SF).collect()) == Counter(x.doc_id for x in tables[5][1])
