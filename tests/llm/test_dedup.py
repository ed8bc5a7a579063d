import random

import pytest

from placeloom.llm import exact, line_dedup, near_dedup, queries, suffix_dedup
from tests.compare import ROOT, check
from tests.llm.brute import SPACE, near, repeats, sha

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi nu pe ra si to ve zu".split() for b in "ban del fin gor hum jat".split()]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def prose(random_, n):
    return " ".join(random_.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t", "one", "One", "one two", "ab c", "a bc", "a b", " ", "x\x1cy", "ß ẞ K"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    check(queries.QUERIES[name](spark, f"{ROOT}/sf0.001"), queries.ORACLE_SQL[name], f"{ROOT}/sf0.001")


def test_exact_small_buckets_and_cases(spark):
    r = random.Random(1)
    base = [prose(r, 5) for _ in range(60)]
    texts = ODD + base + [x.replace(" ", "  ") for x in base[:30]] + base[:10]
    out, index = exact.exact_dedup(docs(spark, texts), capacity=4)
    got = {x.doc_id: x for x in out.collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(SPACE.sub("", t or ""), []).append(i)
    assert len(got) == len(texts)
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, sha(key))
    sizes = [x["count"] for x in index.groupBy("bucket").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 4


def test_exact_nulls_and_repeated_ids(spark):
    rows = [(None, "a", 1), (None, "a", 2), (3, "a ", 3), (4, "b", 4), (4, "b", 5)]
    out = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, h int"))[0].collect()
    assert sorted((x.doc_id or -1, x.keep_id, x.kept, x.group_size) for x in out) == [(-1, 3, False, 3)] * 2 + [(3, 3, True, 3)] + [(4, 4, True, 2)] * 2
    assert exact.exact_dedup(docs(spark, []))[0].count() == 0


def test_exact_directory_doubles(spark):
    # 30 keys that agree in their 24 leading bits, 20 spread ones and, at the other end, one alone.
    keys = sorted({(7 << 39) + i * (65_537 << 16) for i in range(30)} | {(i << 58) + i for i in range(-10, 10)} | {-1})
    buckets, began = exact.directory(spark.createDataFrame([(k,) for k in keys], "h long"), 3)
    found = buckets.collect()
    assert max(x.n_keys for x in found) <= 3 and max(x.depth for x in found) > 24 > 2 * began
    assert len({x.depth for x in found}) > 3
    for k in keys:
        (own,) = [x for x in found if x.low <= k <= x.high]
        assert own.n_keys == sum(own.low <= j <= own.high for j in keys) and own.bucket == own.low


def test_exact_colliding_texts_are_a_chain(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda c: F.shiftleft(F.length(c).cast("long"), 60))
    texts = ["ab", "ba", "a b", "c", " c", "ba", "abc"]
    out, index = exact.exact_dedup(docs(spark, texts), capacity=1)
    got = {x.doc_id: (x.keep_id, x.group_size, x.text_sha256) for x in out.collect()}
    monkeypatch.undo()
    assert got == {0: (2, 2, sha("ab")), 2: (2, 2, sha("ab")), 1: (1, 2, sha("ba")), 5: (1, 2, sha("ba")), 3: (4, 2, sha("c")), 4: (4, 2, sha("c")), 6: (6, 1, sha("abc"))}
    assert sorted((x.h >> 60, x.link) for x in index.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_exact_hot_copies_and_text_ids(spark):
    rows = [(f"d{i:03d}", ("same text ", "same  text", "other", None)[i % 4]) for i in range(200)] + [(None, "same  text")]
    for copies in (10, 1000):
        out = exact.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"), copies=copies)[0].collect()
        got = {(x.text_sha256, x.keep_id, x.group_size) for x in out}
        assert got == {(sha("sametext"), "d000", 101), (sha("other"), "d002", 50), (sha(""), "d003", 50)}
        assert len(out) == 201 and sum(x.kept for x in out) == 3


def _near_texts():
    r = random.Random(2)
    texts = list(ODD)
    for _ in range(12):
        words = prose(r, 80).split()
        texts.append(" ".join(words))
        for _ in range(6):
            changed = list(words)
            for _ in range(r.randint(0, 5)):
                changed[r.randrange(len(changed))] = r.choice(WORDS)
            texts.append(" ".join(changed))
            words = changed if r.random() < 0.5 else words
    texts += [prose(r, n) for n in (1, 2, 3, 4, 30, 3000)] + texts[-20:-15]
    return texts + ["One  TWO", "one two"]


@pytest.mark.parametrize("size,percent,centres", [(3, 85, 2), (5, 80, 2), (3, 85, 0)])
def test_near_against_all_pairs(spark, size, percent, centres):
    texts = _near_texts()
    out = near_dedup.near_duplicates(docs(spark, texts), size, percent, centres).collect()
    want = near(list(enumerate(texts)), size, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)
    assert any(c != d for d, (_, c) in want.items())


def test_near_bucket_of_documents_that_share_too_little(spark):
    """Many documents with one passage and ends of their own: one bucket, no links, and hardly a pair to compare."""
    r = random.Random(9)
    shared = prose(r, 400)
    texts = [f"{shared} " + " ".join(f"w{i}x{j}" for j in range(90)) for i in range(60)] + [f"{shared} w0x0 " + " ".join(f"w0x{j}" for j in range(1, 89))]
    df = docs(spark, texts)
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, 3, 85, 0).collect()} == {d: c for d, (_, c) in near(list(enumerate(texts)), 3, 85).items()}
    found = [(i, t) for i, t in enumerate(texts)]
    sets = spark.createDataFrame([(i, [int(x) for x in near_dedup.shingles(t, 3).view("int64")]) for i, t in found], "doc_id long, found array<long>").selectExpr("*", "cast(size(found) as long) AS n")
    rare = near_dedup._rarest(sets, sets.selectExpr("doc_id AS rep", "doc_id AS component"), 85)
    pairs = rare.alias("x").join(rare.alias("y"), "e").filter("x.rep < y.rep").select("x.rep", "y.rep").distinct().collect()
    assert [tuple(p) for p in pairs] == [(0, 60)]


def slots(n, seed=4):
    """Pages of one template: passages of it between 12 slots, each filled from ten values; much is shared, and rare things, too."""
    r = random.Random(seed)
    fixed = [[f"f{k}x{j}" for j in range(7)] for k in range(12)]
    return [" ".join(w for k in range(12) for w in (*fixed[k], f"v{k}y{r.randrange(10)}")) for _ in range(n)]


@pytest.mark.parametrize("n", [250, 500])
def test_near_bucket_of_one_template(spark, n):
    """What shares rare elements but not enough of all is refused in the join: pairs that leave it grow no faster than documents."""
    texts = slots(n)
    texts += [texts[0].replace("f3x2", "other"), texts[1].replace("f5x5", "another")]
    rows = []
    for i, t in enumerate(texts):
        found = near_dedup.shingles(t, 3)
        rows.append((i, found.view("int64").tolist(), len(found), near_dedup.sketch(found).tolist()))
    sets = spark.createDataFrame(rows, "doc_id long, found array<long>, n long, sketch array<long>")
    rare = near_dedup._rarest(sets, sets.selectExpr("doc_id AS rep", "doc_id AS component"), 85, ("sketch",))
    pairs = {(x.rep, x.o) for x in near_dedup._pairs_of(rare, 85).collect()}
    assert {(0, n), (1, n + 1)} <= pairs and len(pairs) <= n // 10
    members = rare.select("e", "rep")
    assert members.join(members.withColumnRenamed("rep", "o"), "e").filter("rep < o").select("rep", "o").distinct().count() > n * n // 20
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert got == {d: c for d, (_, c) in near(list(enumerate(texts)), 3, 85).items()}


def test_near_sketch_refuses_no_similar_sets():
    import numpy as np

    r = np.random.default_rng(8)
    for n in (1, 3, 40, 700, 20_000):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - r.integers(0, len(a) + 1)], r.integers(0, 2**63, r.integers(0, n + 1), dtype=np.uint64)]))
            cells = sum(int(v).bit_count() for v in (near_dedup.sketch(a) ^ near_dedup.sketch(b)).view(np.uint64))
            assert cells <= len(np.setxor1d(a, b))


def test_near_on_documents(spark):
    table = spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in queries.QUERIES["op3_minhash_near_dedup"](spark, f"{ROOT}/sf0.01").collect()}
    assert got == near([(x.doc_id, x.text) for x in table.collect()], 3, 85)


def test_near_cases(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f g", "k", 1), (1, "a b c d e f g", "k", 1), (2, "a b c d e f g", None, None), (None, "a b c d e f g", None, 5), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string, component int")
    kept = near_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [1, 1, 4]


def _repeat_texts(span):
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("abcdefghij ké") for _ in range(n))
    shared = [letters(n) for n in (span - 1, span, span + 1, 3 * span)]
    texts = [None, "", "short", letters(5 * span), "a" * (3 * span), "ab" * span + letters(10)]
    for i in range(12):
        texts.append(letters(r.randint(0, span)) + shared[i % 4] + letters(r.randint(0, span)))
    texts.append(shared[3][:span + 7] + letters(3) + shared[3][5:] + letters(9) + shared[3][5 : span + 20])
    return texts + [texts[3], texts[3][: 2 * span]]


@pytest.mark.parametrize("many", [20_000, 1])
def test_repeats_against_all_strings(spark, many):
    span = 40
    texts = _repeat_texts(span)
    out = suffix_dedup.remove_repeats(docs(spark, texts), span, gram=13, many_runs=many).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, sha(bytes(x.kept))) for x in out}
    assert got == repeats(list(enumerate(texts)), span)


def test_repeats_across_pieces(spark, monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh") for _ in range(3000))
    texts = [text, text[1000:2200] + "zz" + text[:37]]
    raw = text.encode()
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    suffix_dedup._powers.cache_clear()
    pieces = list(suffix_dedup.runs(raw, 40, 13))
    suffix_dedup._powers.cache_clear()
    assert sorted(x for _, a, b, _ in pieces for x in range(a, b + 1)) == list(range(3000 - 39))
    monkeypatch.undo()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, sha(bytes(x.kept))) for x in suffix_dedup.remove_repeats(docs(spark, texts), 40, gram=13).collect()}
    assert got == repeats(list(enumerate(texts)), 40)


def test_repeats_on_documents(spark):
    table = spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in queries.QUERIES["op4_suffix_array_dedup"](spark, f"{ROOT}/sf0.001").collect()}
    assert got == repeats([(x.doc_id, x.text) for x in table.collect()], 400)


def test_repeats_cases(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    rows = [(None, long, 1), (None, long, 1), (5, "x" + long, 2), (5, None, 2)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted((x.doc_id or -1, x.n_bytes, x.n_bytes - x.n_removed) for x in out) == [(-1, 900, 0), (-1, 900, 0), (5, 0, 0), (5, 901, 1)]


def test_query_shows_what_is_left_of_planted_passages(spark, tmp_path):
    """Of passages of over 50 words in three documents each, those of 400 bytes or more are gone; all else stays, in any language."""
    r = random.Random(8)
    words = lambda n, letters, size: " ".join("".join(r.choice(letters) for _ in range(size)) for _ in range(n))
    english, french = "abcdefghijklmnop", "abcdeéèçêuonrtl"
    passages = [words(n, letters, size) for letters in (english, french) for n, size in ((55, 8), (120, 5), (51, 3))]
    texts, left = [None, ""], ["", ""]
    for i, passage in enumerate(passages * 3):
        # A letter of its own on either side, so that the passage alone is repeated.
        before, after = words(80, english, 6) + chr(65 + i), chr(65 + i) + words(30, french, 6)
        texts.append(before + passage + after)
        left.append(before + after if len(passage.encode()) >= 400 else texts[-1])
    assert sum(x != (y or "") for x, y in zip(left, texts)) == 12
    clean = [words(300, letters, 6) for letters in (english, french) for _ in range(4)]
    # Repeated up to the first byte of two characters; their second bytes, which stay, are no characters.
    cut = words(60, english, 8)
    texts += [*clean, f"X{cut}é.", f"Y{cut}è,"]
    left += [*clean, "X\ufffd.", "Y\ufffd,"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.QUERIES["op4_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in got.items()} == repeats(list(enumerate(texts)), 400)
    assert {i: x.text for i, x in got.items()} == dict(enumerate(left))


def test_lines_templates_and_cases(spark):
    notice = "Printed on page {} of volume {} by the old press"
    bodies = [f"Chapter about {WORDS[i]} and {WORDS[i + 1]} here\n{notice.format(i, i * 3)}\n\nok" for i in range(8)]
    texts = bodies + [None, "", "\n", "only one line of its own"]
    out = {x.doc_id: x for x in line_dedup.drop_recurring_lines(docs(spark, texts)).collect()}
    assert len(out) == len(texts)
    assert out[0].text == bodies[0] and out[0].n_dropped == 0
    for i in range(1, 8):
        assert (out[i].text, out[i].n_lines, out[i].n_dropped) == ("\n".join(x for j, x in enumerate(bodies[i].split("\n")) if j != 1), 4, 1) or out[i].n_dropped == 2
    assert (out[8].text, out[8].n_lines, out[9].text, out[10].text, out[11].n_dropped) == (None, 0, "", "\n", 0)


@pytest.mark.parametrize("copies", [100, 10_000])
def test_lines_word_fields_at_any_size(spark, copies):
    r = random.Random(copies)
    names = [a + b for a in WORDS for b in WORDS[:5]]
    line = "This notice was written by {} for the readers of {} in their own town"
    texts = [f"{line.format(r.choice(names), r.choice(names))}\nBody w{i}x of its own" for i in range(copies)]
    out = {x.doc_id: x for x in line_dedup.drop_recurring_lines(docs(spark, texts)).select("doc_id", "text", "n_dropped").collect()}
    kept = [d for d, x in out.items() if "This notice" in x.text]
    assert len(out) == copies and 0 in kept and len(kept) <= 0.02 * copies


def test_lines_of_a_long_document(spark):
    """Thousands of recurring lines in one document, each once more in five others."""
    lines = [f"this is line w{a}{b} of the long list" for a in WORDS for b in WORDS[:20]]
    long = "\n".join(lines + [f"own line {i} x{i}" for i in range(50)])
    rest = ["\n".join(lines[i::5]) for i in range(5) for _ in range(5)]
    out = {x.doc_id: x for x in line_dedup.drop_recurring_lines(docs(spark, rest + [long])).collect()}
    # Digits make fields, so all these lines are one template, which only the first document keeps.
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == out[i].n_lines for i in range(1, 25))
    assert out[25].n_lines == len(lines) + 50 and "of the long list" not in out[25].text


def test_lines_keep_columns(spark):
    rows = [(i, f"the same long line stands here again\nbody {i}", "x", i) for i in range(6)] + [(None, "the same long line stands here again", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _drop string, n_lines int")
    out = line_dedup.drop_recurring_lines(df.drop("_drop"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert line_dedup.drop_recurring_lines(docs(spark, [])).count() == 0
    got = {x.doc_id: x.text for x in out.collect()}
    assert got[0] == rows[0][1] and got[5] == "body 5" and got[None] == ""
