"""The filter audit, nearest neighbours and fill-in-middle against plain versions."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from placeloom.llm import filter_audit, nearest, queries
from placeloom.llm import fill_in_middle as fim
from tests.compare import ROOT, check
from tests.llm.brute import WORD, sha

CLASH = ("part", "mask", "n", "good", "toxic", "rep", "ids", "vector", "leaves", "_n", "_asked", "form", "output", "score", "rank", "key")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    check(queries.QUERIES[name](spark, f"{ROOT}/sf0.01"), queries.ORACLE_SQL[name], f"{ROOT}/sf0.01")


# The filter audit.


def fails(doc_id, text, rows):
    words = WORD.findall(text)
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return found + "E" * any((t or "") == text and i is not None and (doc_id is None or i < doc_id) for i, _, t in rows)


def plain_audit(rows, labels):
    """(part, order, step) -> counts; every order is applied to every document, one filter after the other."""
    out = {}
    failing = [(d, lang or "", fails(d, t or "", rows)) for d, lang, t in rows]
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in range(2))
    for part in {p for _, p, _ in failing}:
        own = [(d, f) for d, p, f in failing if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audit_rows(seed, n=300):
    r = random.Random(seed)
    texts = [None, "", " ", "A", "short text", "x " * 300, " ".join(f"w{i}" for i in range(250)), "SHOUT " * 60, "a | b", "é " * 201, " ".join(f"W{i}$" for i in range(220)), "long " * 20000]
    return [(r.choice([None, *range(40)]) if i % 5 == 0 else 100 + r.randrange(2 * n), r.choice(["en", "fr", None, ""]), r.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("chars", [filter_audit.CHAIN_CHARS, 50])
def test_audit_equals_plain(spark, monkeypatch, chars):
    monkeypatch.setattr(filter_audit, "CHAIN_CHARS", chars)
    rows = audit_rows(1)
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 700, 3)] + [(3, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*x, *CLASH[:5]) for x in rows], "doc_id long, lang string, text string, part string, mask string, n string, good string, toxic string").repartition(5)
    out = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(x.part, x.filter_order, x.step): list(x[3:]) for x in out} == plain_audit(rows, labels)
    assert len(out) == 600 * 3


def test_audit_chains_collisions(spark):
    """Different texts of one fingerprint are told apart; of a hot text one entry travels from a map task."""
    entries = list(filter_audit._send([(9, "same", i) for i in (*range(1000, 0, -1), 5, 1)]))
    assert [x for x in entries if x[1][0] is not None] == [(9, ("same", 1))] and len(entries) == 1001
    rows = [(7, t, i) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])] + [(7, "a", 0), (7, "c", None)]
    for cut in range(len(rows) + 1):  # in two map tasks
        sent = [*filter_audit._send(rows[:cut]), *filter_audit._send(rows[cut:])]
        assert sorted(filter_audit._own(sorted(sent, key=lambda e: e[0])), key=str) == [(2, 7), (4, 7), (5, 7), (None, 7)]


def test_audit_with_one_fingerprint_for_all(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda text: filter_audit.F.length(text) * 0 + filter_audit.F.lit(-3).cast("long"))
    rows = [(i, lang, t) for i, (_, lang, t) in enumerate(audit_rows(2, 60))]
    out = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {(x.part, x.filter_order, x.step): list(x[3:]) for x in out} == plain_audit(rows, [])


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert {(x.part, x.kept) for x in filter_audit.audit(one, labels).collect() if x.step == 5} == {("", 0)}


# Nearest neighbours.


def plain_nearest(rows, by, k):
    """query -> [(score, vec_id)]: exact, by comparing everything with everything."""
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in rows:
        if i % by == 0:
            out[i] = sorted(((-float(sum(a * b for a, b in zip(v, w))), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
    return out


def found(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x["rank"])):
        out.setdefault(x.query_id, []).append((-x.score, x.vec_id))
        assert x["rank"] == len(out[x.query_id])
    return out


def test_nearest_recall_on_embeddings(spark):
    at = f"{ROOT}/sf0.1"
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    true, got = plain_nearest(rows, 20, 20), found(queries.QUERIES["op12_nearest_neighbours"](spark, at))
    assert got.keys() == true.keys() and all(len(x) == 20 for x in got.values())
    assert sum(len({j for _, j in got[q]} & {j for _, j in true[q]}) for q in true) >= 0.9 * sum(map(len, true.values()))
    vectors = dict(rows)
    for q, near in got.items():
        assert near == sorted(near) and all(s == pytest.approx(-float(np.dot(np.float64(vectors[q]), np.float64(vectors[j]))), abs=1e-12) for s, j in near)


def test_nearest_hot_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 8)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 5)
    monkeypatch.setattr(nearest, "CHUNK_QUERIES", 3)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-9, 10, 6) * (1 + i % 3)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(150)]  # a third of all rows are equal
    rows += [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1080, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (40, rows[40][1])]
    rows += [(1120, [1.0, 1.0]), (1121, [2.0, 1.0])]
    df = spark.createDataFrame([(*x, *CLASH[:3]) for x in rows], "vec_id long, vector array<double>, part string, mask string, n string").repartition(4)
    got = found(nearest.nearest(df, df["vec_id"] % 20 == 0, k=7, recall=1.0))
    true = plain_nearest(rows, 20, 7)
    assert got.keys() == true.keys() and got[1120] == true[1120] == [(-3.0, 1121)]
    assert all(len(got[q]) == len(true[q]) for q in true)
    same = sum(got[q] == true[q] for q in true)
    assert same >= 0.9 * len(true), (same, len(true))
    for q in range(300, 450, 20):  # ties by id among the copies
        assert got[q] == true[q]


def test_nearest_with_few_rows(spark):
    kind = "vec_id long, vector array<float>"
    none = spark.createDataFrame([], kind)
    assert nearest.nearest(none, none["vec_id"] == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], kind)
    assert nearest.nearest(one, one["vec_id"] == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (5, [-1.0, 0.5]), (7, [1.0, 2.0])], kind)
    assert found(nearest.nearest(two, two["vec_id"] == 0)) == {0: [(-5.0, 7), (0.0, 5)]}
    assert nearest.nearest(two, two["vec_id"] == 1).count() == 0


def test_shared_queue_is_best_first():
    """Leaves come in the order of their distances over all trees, and a full budget reaches all of them."""
    r = np.random.default_rng(4)
    sample = r.normal(size=(500, 5))
    forest = nearest.fit(sample, float(np.linalg.norm(sample, axis=1).max()), 500, trees=3, leaf_rows=20)
    leaves = forest.leaves(sample)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=2**forest.depth) for t in range(3)])
    assert sizes.sum() == 1500 and sizes.max() < 60
    shadows = forest.shadows(sample[:1])[0]

    def far(t, node):
        total, at = 0.0, 0
        for level in range(forest.depth):
            side = node >> (forest.depth - 1 - level) & 1
            gap = shadows[t, level] - forest.thresholds[t, 2**level - 1 + at]
            total += gap * gap * (side != (gap > 0))
            at = 2 * at + side
        return total

    order = forest.search(shadows, sizes, 1500)
    assert len(order) >= np.count_nonzero(sizes) and len(set(order)) == len(order)
    apart = [far(*x) for x in order]
    assert np.allclose(apart, sorted(apart))
    assert sum(sizes[x] for x in forest.search(shadows, sizes, 200)[:-1]) < 200


# Fill-in-middle.

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
ODD = [None, "", "a", " ", "<", "a<P>b", "<S>", "x<M", "P>", "<P", "Kelvin", "ſ long s", "日本語 text", "😀" * 50, "a" * 10000, "ab1" * 5000, "\r\n\t\x00", "<<S><P", "word " * 3000, "é" * 4096 + "a" * 4096, "a" * 4095 + "b" * 4097 + " c"]


def plain_fill(doc_id, text):
    units, h = UNIT.findall(text), fim.draws(doc_id)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_equals_plain_and_comes_back():
    r = random.Random(6)
    texts = ODD + ["".join(r.choice(["ab", "c", " ", "<", ">", "P", "S", "é", "\n", "1"]) for _ in range(r.randrange(60))) for _ in range(800)] + ["".join(r.choice(["word", " ", ", ", "x" * 300]) for _ in range(6000)) for _ in range(5)]
    forms = set()
    for i, t in enumerate(texts):
        f = fim.fill_in_middle(i, t)
        assert (f.n, f.form, f.prefix_chars, f.middle_chars, f.output) == plain_fill(i, t or ""), (i, t)
        assert fim.restore(f.output, f.form) == (t or "")
        forms.add(f.form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 3, 7])
def test_ropes_split_anywhere(size):
    for text in ("", "abc def", "ab", "  a1b2  ccc", "xx<yy>zz é日a"):
        units = UNIT.findall(text)
        whole = fim.rope(text, size)
        assert (str(whole), whole.units, whole.points) == (text, len(units), len(text))
        for k in range(len(units) + 2):
            a, b = fim.split_units(whole, k)
            assert (str(a), str(b), a.units, b.units) == ("".join(units[:k]), "".join(units[k:]), min(k, len(units)), max(0, len(units) - k))
        for k in range(len(text) + 2):
            a, b = fim.split_points(whole, k)
            assert (str(a), str(b), a.points, a.units + b.units) == (text[:k], text[k:], min(k, len(text)), len(units))


def test_fill_cases(spark):
    rows = [(i if i % 3 else None, t, i, "clash") for i, t in enumerate(ODD * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, form string")
    out = fim.transform_documents(df)
    assert out.columns == ["doc_id", "text", "at", "n", "form", "prefix_chars", "middle_chars", "output"]
    for x in out.collect():
        assert (x.text, x.doc_id) == (rows[x["at"]][1], rows[x["at"]][0]) and fim.restore(x.output, x.form) == (x.text or "")
    digests = {x["at"]: x for x in fim.transform_digests(df).collect()}
    assert all(digests[i].restored_sha256 == sha(t or "") for i, (_, t, *_) in enumerate(rows)) and len(digests) == len(rows)
    assert fim.transform_documents(df.limit(0)).count() == 0 and fim.transform_digests(df.limit(0)).count() == 0
