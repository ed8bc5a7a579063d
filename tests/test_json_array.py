import json
import random

import pytest

from placeloom.sources import json_array, places


@pytest.fixture(params=["150b", "128m"])
def ranges(spark, request):
    """Byte ranges of an element or two, and the usual ones."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def objects(n, seed=3):
    r = random.Random(seed)
    bits = ['"', "\\", "]", "[", "}", "{", ",", '",', "\\\"", "]}", "\n", "é", "名", "a", " ", ":"]
    make = lambda k: "".join(r.choice(bits) for _ in range(r.randrange(k)))
    return [{"id": i, "name": None if r.random() < 0.1 else make(200 if r.random() < 0.05 else 12), "tags": [make(5) for _ in range(r.randrange(4))], "more": {"x": {"y": [[make(6)]]}}} for i in range(n)]


SCHEMA = "id long, name string, tags array<string>"


def expected(items, *folders):
    return [(*folders, i, x["id"], x["name"], x["tags"]) for i, x in enumerate(items)]


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_one_array(spark, tmp_path, ranges, indent):
    items = objects(90)
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=False))
    found = places.read_json_array(spark, str(tmp_path / "a.json"), SCHEMA)
    assert sorted(map(tuple, found.collect())) == expected(items)
    if ranges == "150b":
        assert json_array._pieces(spark, str(tmp_path / "a.json"))[0].select("start").distinct().count() > 50


def test_several_files_and_folders(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(json_array, "RANGES", 0)  # pieces go to the tasks of their ranges
    want = []
    for city, n in (("a", 20), ("b", 1), ("c", 0)):
        (tmp_path / f"city={city}").mkdir()
        items = objects(n, seed=n)
        (tmp_path / f"city={city}" / "x.json").write_text("﻿" * (city == "a") + json.dumps(items))
        want += expected(items, city)
    (tmp_path / "city=c" / "blank.json").write_text(" \n")
    got = places.read_json_array(spark, str(tmp_path), SCHEMA)
    assert got.columns == ["city", "ord", "id", "name", "tags"] and sorted(map(tuple, got.collect())) == want


def test_odd_elements(spark, tmp_path, ranges):
    (tmp_path / "x.json").write_text(' [ null , {"id": 1, "name": "[,]", "other": {}}, 7, [1, [2, 3]], "a,]", {"id": "no number"}, {} ] \n')
    got = sorted(map(tuple, places.read_json_array(spark, str(tmp_path), SCHEMA).collect()))
    assert got == [(i, 1 if i == 1 else None, "[,]" if i == 1 else None, None) for i in range(7)]


def test_no_array_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "name": "x"}')
    with pytest.raises(Exception, match="one JSON array"):
        places.read_json_array(spark, str(tmp_path), SCHEMA).collect()


def test_written_arrays_are_json_in_order(spark, tmp_path, ranges):
    items = [(("a", "b", None)[i % 3], (i * 7) % 20, f'x"],[{i}\n', None) for i in range(60)]
    df = spark.createDataFrame(items, "part string, k long, name string, void string").repartition(5)
    json_array.write(df, str(tmp_path / "out"), "part", "k")
    files = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").glob("part=*/*.txt")}
    assert sorted(files) == ["part=__HIVE_DEFAULT_PARTITION__", "part=a", "part=b"]
    for part in ("a", "b"):
        mine = sorted((k, json.dumps({"k": k, "name": n})) for p, k, n, _ in items if p == part)
        assert [(x["k"], json.dumps(x)) for x in files[f"part={part}"]] == mine
    back = places.read_json_array(spark, str(tmp_path / "out"), "k long, name string").collect()
    assert len(back) == 60 and {(x.part, x.k, x.name) for x in back} == {x[:3] for x in items}
