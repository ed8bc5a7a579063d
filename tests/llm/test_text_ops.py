import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from placeloom.llm import byte_bpe, chat, mixing, quality_classifier, quality_rules, queries, sharding
from tests.compare import ROOT
from tests.llm.brute import WORD, ordinal_loss, permutation_fill, sha


def _tiktoken():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _odd_texts():
    r = random.Random(5)
    pieces = ["hello", " world", "'s", "'LL", "  ", "\n", "\t ", " \n ", "\x1c", " \x1d ", " ", " x", "é", "日本語", "١٢٣", "😀", "a" * 70, "123456", "###", "<|endoftext|>", "́", "\r\n", "the", " the", "ß"]
    texts = [None, "", " ", "  ", "a", " a  b ", "x" * 5000, "ab" * 3000, " " * 300, "\n" * 99]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    return texts + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x4E00, 0x9000), r.randrange(0x1F300, 0x1F700)))) for _ in range(60)) for _ in range(200)]


def test_bpe_equals_tiktoken(spark):
    texts, plain = _odd_texts(), _tiktoken()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {x.doc_id: x for x in byte_bpe.encode_documents(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert list(out[i].ids) == plain.encode_ordinary(t or ""), repr(t)
    back = {x.doc_id: bytes(x.decoded) for x in byte_bpe.decode_documents(byte_bpe.encode_documents(df)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_on_documents(spark):
    table = {x.doc_id: x.text for x in spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").collect()}
    plain = _tiktoken()
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in queries.QUERIES["op6_byte_bpe"](spark, f"{ROOT}/sf0.01").collect()}
    assert got == {d: (len(ids := plain.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for d, t in table.items()}


def test_bpe_round_trip_and_chunks(spark, monkeypatch):
    texts, plain = _odd_texts(), _tiktoken()
    df = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, _rest int").coalesce(1)
    out = byte_bpe.round_trip(df)
    assert out.columns == ["doc_id", "text", "_rest", "ids", "n_tokens"]
    for x in out.collect():
        assert x.text == texts[x.doc_id] and x._rest == x.doc_id and list(x.ids) == plain.encode_ordinary(x.text or "") and x.n_tokens == len(x.ids)


def test_bpe_cases(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2), (1, "a b", None, None), (None, None, None, None)], "doc_id long, text string, ids string, N_TOKENS int")
    out = byte_bpe.encode_documents(df)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"] and out.count() == 3
    assert byte_bpe.encode_documents(df.limit(0)).count() == 0


def test_bpe_cache_turns(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 10)
    c = byte_bpe.Codec(byte_bpe.vocabulary_path(), byte_bpe._pattern())
    texts = [f"word{i} again {i % 3} and again" for i in range(50)]
    assert list(c.encode(texts)) == [_tiktoken().encode_ordinary(t) for t in texts]


def test_mixing_is_near_target(spark):
    rows = [(i, "w " * (i % 40), ("a", "b", "c", None)[min(3, i % 7)], "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    sized = df.withColumn("size", mixing.n_words(df["text"]))
    targets = mixing.source_targets(sized.select("source", "size"))
    out = mixing.mix(sized, targets, part_rows=50).collect()
    assert len(out) == 2000
    for s in ("a", "b", "c", None):
        own = [x for x in out if x.source == s]
        assert sum(x.taken for x in own) == round(own[0].target) and own[0].target <= 2 * own[0].source_size + 1e-6
        assert all(0 <= x.taken <= 2 * x.size for x in own)
    assert sum(x.target for x in {x.source: x for x in out}.values()) == pytest.approx(1.5 * sum(x.size for x in out))
    assert sorted((x.doc_id, x.taken) for x in mixing.mix(sized, targets, part_rows=50).collect()) == sorted((x.doc_id, x.taken) for x in out)


def test_mixing_cases(spark):
    df = spark.createDataFrame([(1, None, None), (1, "", None), (None, " ", "s")], "doc_id long, text string, source string")
    sized = df.withColumn("size", mixing.n_words(df["text"]))
    out = mixing.mix(sized, mixing.source_targets(sized.select("source", "size"))).collect()
    assert [x.taken for x in out] == [0, 0, 0]
    assert mixing.mix(sized.limit(0), mixing.source_targets(sized.limit(0).select("source", "size"))).count() == 0


def test_mixed_documents_have_the_words_taken(spark):
    docs = spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet")
    sized = docs.withColumn("size", mixing.n_words(docs["text"]))
    taken = {x.doc_id: x.taken for x in mixing.mix(sized, mixing.source_targets(sized.select("source", "size"))).collect()}
    out = mixing.mixed_documents(docs)
    got = dict.fromkeys(taken, 0)
    for x in out.collect():
        got[x.doc_id] += len(WORD.findall(x.text or ""))
        assert x.n_chars == len(x.text)
    assert out.columns == docs.columns and got == taken


def test_sharding(spark):
    names = tuple(f"s{i}" for i in range(7))
    table = sharding.lookup_table(names, 1009)
    counts = [table.count(i) for i in range(7)]
    assert sum(counts) == 1009 and max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    df = spark.createDataFrame([(i % 50, "t", "clash") for i in range(500)] + [(None, None, None)] * 2, "doc_id long, text string, shard string")
    out = sharding.assign_shards(df, shards=names, slots=1009).collect()
    assert len(out) == 502 and all(len({x.shard for x in out if x.doc_id == d}) == 1 for d in {x.doc_id for x in out})
    assert all(names[table[x.slot]] == x.shard for x in out)


def test_sharding_against_whole_permutations(spark):
    import struct

    import xxhash

    names = tuple(f"node-{i}" for i in range(5))
    table = permutation_fill(names, 499)
    assert [names[i] for i in sharding.lookup_table(names, 499)] == table
    ids = [0, 1, -7, 2**40, *range(100, 400)]
    out = sharding.assign_shards(spark.createDataFrame([(i,) for i in ids], "doc_id long"), shards=names, slots=499).collect()
    for x in out:
        slot = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", x.doc_id), seed=42)))[0] % 499
        assert (x.slot, x.shard) == (slot, table[slot])


def test_sharding_on_documents(spark):
    out = queries.QUERIES["op7_sharding"](spark, f"{ROOT}/sf0.01").collect()
    rows = {x.doc_id: x.text for x in spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").collect()}
    table = sharding.lookup_table(sharding.SHARDS)
    assert {x.doc_id: x.n_bytes for x in out} == {d: len((t or "").encode()) for d, t in rows.items()}
    assert all(x.shard == sharding.SHARDS[table[x.slot]] for x in out) and len({x.shard for x in out}) == 64


def test_write_shards(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), shards=("a", "b", "c"), slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def test_classifier_held_out(spark):
    docs = spark.read.parquet(f"{ROOT}/sf0.1/documents.parquet")
    grades = quality_classifier.graded(spark.read.parquet(f"{ROOT}/sf0.1/labels.parquet"))
    train, held = grades.filter("pmod(xxhash64(doc_id), 5) > 0"), grades.filter("pmod(xxhash64(doc_id), 5) = 0")
    model = quality_classifier.fit(*quality_classifier.training_rows(docs, train))
    assert (np.diff(model.thresholds) > 0).all()
    scored = quality_classifier.score_documents(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    right = sum((x.grade == 2) == x.kept for x in scored) / len(scored)
    assert len(scored) > 500 and right > 0.85, right
    good, bad = [x.expected_grade for x in scored if x.grade == 2], [x.expected_grade for x in scored if x.grade == 0]
    assert np.mean(good) > np.mean(bad) + 0.5
    assert all(0 <= x.expected_grade <= 2 and 0 <= x.tail_probability <= 1 for x in scored)


def test_classifier_slopes_and_fit_against_a_plain_model():
    r = np.random.default_rng(1)
    score, grades, cuts = r.normal(size=40), r.integers(0, 3, 40), np.array([-0.7, 0.9])
    loss, of_score, by_cut = quality_classifier.likelihood(cuts, score, grades)
    plain = lambda s, c: [ordinal_loss([x], c, [[0]], [g]) for x, g in zip(s, grades)]
    assert loss == pytest.approx(plain(score, cuts))
    step = 1e-6
    assert of_score == pytest.approx((np.array(plain(score + step, cuts)) - plain(score - step, cuts)) / (2 * step), abs=1e-4)
    for k in range(2):
        move = step * np.eye(2)[k]
        assert by_cut[:, k] == pytest.approx((np.array(plain(score, cuts + move)) - plain(score, cuts - move)) / (2 * step), abs=1e-4)
    # A few features; a plain descent by differences finds how good a fit can be.
    true, n = np.array([2.0, -1.5, 0.5, 0.0, 1.0]), 400
    rows = [np.flatnonzero(r.random(5) < 0.5) for _ in range(n)]
    noise = r.logistic(size=n)
    y = np.array([int(np.searchsorted([-0.5, 1.0], true[x].sum() + e)) for x, e in zip(rows, noise)])
    at = np.concatenate([np.zeros(5), [-0.5, 0.5]])
    of = lambda v: ordinal_loss(v[:5], v[5:], rows, y)
    for _ in range(150):
        at = at - 2.0 * np.array([(of(at + 1e-5 * e) - of(at - 1e-5 * e)) / 2e-5 for e in np.eye(7)])
    model = quality_classifier.fit(rows, y, epochs=60, lasso=0.0, min_rows=1)
    assert ordinal_loss(model.weights, model.thresholds, rows, y) < of(at) + 0.01
    assert model.weights[:5] == pytest.approx(at[:5], abs=0.35) and not model.weights[5:].any()
    for x in rows[:20]:
        tails = 1 / (1 + np.exp(-(sum(model.weights[f] for f in x) - model.thresholds)))
        p = model.probabilities(np.array([model.score(x)]))[0]
        assert p[-1] == pytest.approx(tails[1]) and p @ [0, 1, 2] == pytest.approx(tails.sum())


def test_classifier_takes_any_ids(spark):
    docs = spark.createDataFrame([(f"d{i % 7}", f"text {i}") for i in range(20)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 0) for i in range(7)], "doc_id string, quality int, toxic int")
    first, again = (quality_classifier.training_rows(docs, quality_classifier.graded(labels), max_rows=5) for _ in range(2))
    assert len(first[0]) == 5 and all((a == b).all() for a, b in zip(first[0], again[0])) and (first[1] == again[1]).all()


def test_classifier_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (3, None, None), (None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(x) for x in quality_classifier.graded(labels).collect()) == [(1, 0), (2, 1), (4, 2)]
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "good words", 3), (2, "good words", 3)], "doc_id long, text string, grade int")
    model = quality_classifier.fit(*quality_classifier.training_rows(docs, quality_classifier.graded(labels).limit(0)))
    out = quality_classifier.score_documents(docs, model).collect()
    assert len(out) == 4 and all(x.expected_grade == pytest.approx(1.0) for x in out)
    assert quality_classifier.score_documents(docs.limit(0), model).count() == 0
    rows, grades = quality_classifier.training_rows(docs, quality_classifier.graded(labels), max_rows=1)
    assert len(rows) == len(grades) == 1


def test_rules_cases(spark):
    good = " ".join(f"the{i % 7} of a w{i}" for i in range(40))
    again = " ".join("one two three four five six seven eight nine".split() * 5)
    rows = [(1, good, "en", 1), (1, good, "en", 1), (2, None, "en", None), (3, again, "en", 1), (4, good, None, 1), (None, good, "xx", 1), (5, "a\n\na\n \na", "fr", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    out = quality_rules.judged(quality_rules.measured(df)).collect()
    assert len(out) == 7
    by = {x.doc_id: x for x in out}
    assert by[2].n_words == 0 and by[2].base_failed and by[3].n_repeat_words == 45 and by[3].base_failed and by[5].n_dup_lines == 2
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 1, 1, 4]
    assert quality_rules.keep_good(df.limit(0)).count() == 0


def test_rules_judge_each_language_by_itself(spark):
    r = random.Random(3)
    italian, japanese = "la casa sul mare dove vivono molti amici di una volta".split(), "これは 日本語 文章 です 東京 から 大阪 まで 電車 行きます".split()
    text = lambda words: " ".join(r.choice(words) + r.choice(words) for _ in range(80))
    rows = [(i, text((italian, japanese)[i % 2]), ("it", "ja")[i % 2]) for i in range(60)]
    rows += [(60, "#### 0123 4567 " * 3 + " ".join(f"{i}#{i * 7}" for i in range(90)), "it"), (61, text(japanese), "it")]
    rows += [(70 + i, text((italian, japanese)[i % 2]), None) for i in range(40)] + [(200 + i, text((italian, japanese)[i > 0]), "rare") for i in range(3)]
    out = quality_rules.judged(quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()
    assert len(out) == len(rows) and not any(x.base_failed or x.n_words < quality_rules.GUARD_WORDS for x in out)
    assert sorted(x.doc_id for x in out if not x.kept) == [60, 61]
    frame = pd.DataFrame([*rows, (300, None, "it"), (301, "", None)], columns=["doc_id", "text", "lang"])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.execute("INSERT INTO documents SELECT doc_id, text, lang FROM frame")
    assert {x[0] for x in con.execute(f"SELECT doc_id FROM ({quality_rules.OP9_SQL}) WHERE NOT kept").fetchall()} == {60, 61, 300, 301}


def test_rules_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{ROOT}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/sf0.1/labels.parquet").filter("quality = 1 AND toxic = 0")
    judged = quality_rules.judged(quality_rules.measured(docs)).filter("NOT base_failed").join(labels, "doc_id", "left_semi")
    n, kept = judged.count(), judged.filter("kept").count()
    assert n > 2000 and kept > 0.99 * n
    junk = spark.read.parquet(f"{ROOT}/sf0.1/labels.parquet").filter("quality = 0")
    assert quality_rules.keep_good(docs).join(junk, "doc_id", "left_semi").count() < 0.1 * junk.count()


def test_chat_escapes_and_expands(spark):
    texts = ["plain", chat.PLANTED, "␛n <| ␛l\n", "", None, "␛␛e<|<|im_start|>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(2, 0, "user\nx<|", "alone"), (3, None, None, None), (3, None, None, None), (None, 1, "assistant", "hi")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, target string")
    out = chat.format_conversations(df)
    got = {(x.conv_id, x.example): x for x in out.collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (None, 1)}
    assert got[2, 1].target is None and got[1, 2].context.count(chat.START) == 4
    back = {(x.conv_id, x.example): [(t.role, t.text) for t in x.turns] for x in out.select("conv_id", "example", chat.read_turns(chat.F.concat("context", chat.F.coalesce("target", chat.F.lit("")), "closing")).alias("turns")).collect()}
    assert back[1, 3] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(texts)]
    assert back[2, 1] == [("user\nx<|", "alone")] and back[3, 1] == [("", "")] * 2
    assert chat.format_conversations(df.limit(0)).count() == 0
