"""All operators and stages over tables with nulls, repeats, long texts and columns whose names clash, and over empty ones."""

import pytest

import corpus_pipeline
from placeloom.llm import byte_bpe, chat, exact, fill_in_middle, filter_audit, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, suffix_dedup
from placeloom.llm.common import replace_columns

CLASHING = (
    "_rest _known _drop _left _id _spot _part _at _mine _source _all _target _whole _cut _cut_size _cut_words _words _copy _key _kept _common _chars _slot _shard _rank _bytes h cell bucket link key rep component node a b x y "
    "row_key spans start end gram run off p n wanted many size taken target source_size ids decoded n_tokens n_words kept group_size keep_id text_sha256 slot shard n_lines n_dropped line leaf template token grade features example context closing turns t"
).split()
LONG = "Ein langer Satz steht hier und bleibt da. " * 3000
TEXTS = [None, "", " \n ", "one two three", "one two three", LONG, LONG, LONG[:-1], "the cat sat on the mat and " * 4, "line one is here now\nline two is here now\n" * 3]
ROWS = [(i if i % 4 else None, t, "en" if i % 3 else None, "s" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS * 2)] + [(1, "same id, other text", None, None, 1)] * 2


@pytest.fixture(scope="module", params=["full", "empty"])
def docs(spark, request):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if request.param == "full" else [], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


WHOLE = {
    "exact": lambda d: exact.exact_dedup(d)[0], "lines": line_dedup.drop_recurring_lines, "near": near_dedup.near_duplicates, "suffix": suffix_dedup.remove_repeats, "encode": byte_bpe.encode_documents,
    "digests": byte_bpe.token_digests, "round trip": lambda d: byte_bpe.decode_documents(byte_bpe.encode_documents(d)), "shards": sharding.assign_shards, "rules": lambda d: quality_rules.judged(quality_rules.measured(d)),
    "fill": fill_in_middle.transform_documents, "fill digests": fill_in_middle.transform_digests, "masks": filter_audit.masks,
    "mix": lambda d: mixing.mix(s := replace_columns(d, size=mixing.n_words(d["text"])), mixing.source_targets(s)), "score": lambda d: quality_classifier.score_documents(d, quality_classifier.fit([], quality_classifier.np.zeros(0, int))),
}


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_has_a_result(docs, name):
    assert len(WHOLE[name](docs).collect()) == docs.count()


def test_stages(spark, docs):
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, None)
        rows = after.collect()
        assert after.columns == columns or name == "byte bpe"
        assert len(rows) <= n or name in ("mixing", "byte bpe")


def test_conversations(docs):
    from pyspark.sql import functions as F

    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.when(F.col("source") == "s", "assistant").alias("role"), "text", *(c for c in CLASHING if c != "turns"))
    out = chat.format_conversations(turns).collect()
    assert (len(out) > 0) == (docs.count() > 0)
    assert sum(x.target is not None for x in out) == turns.filter("role = 'assistant'").count()
