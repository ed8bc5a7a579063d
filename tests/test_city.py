"""All stages of a small city, through the command line and the functions behind it."""

import json

from placeloom import config
from placeloom.__main__ import main
from placeloom.plans import city as stages
from placeloom.sources.places import read_eval_set


def test_stages(spark, tmp_path, capsys):
    root, settings, found = (tmp_path / x for x in ("data", "cities", "places"))
    settings.mkdir(), found.mkdir()
    (settings / "x.yaml").write_text("name: X\nspatial: {urban_districts: [D0]}\ncore_spots: {历史人文: [楼]}\ncategory_words: [园]\ntransport_hubs: [站]\nstay_districts: [区, 无]\n", encoding="utf-8")
    place = lambda i, name: {"id": str(i), "name": name, "adname": "D0", "location": f"114.{i},30.{i}", "type": "风景名胜;公园", "business": {"rating": "4.5"}, "photos": [{"url": "u"}]}
    (found / "楼.json").write_text(json.dumps([place(1, "黄鹤楼"), place(2, "黄鹤楼东门")], ensure_ascii=False), encoding="utf-8")
    (found / "园.json").write_text(json.dumps([place(2, "黄鹤楼东门"), place(3, "植物园"), place(4, "停车场")], ensure_ascii=False), encoding="utf-8")
    common = ["--city", "x", "--config", str(settings), "--root", str(root)]
    for stage, more in (("crawl", ["--places", str(found)]), ("clean", []), ("tag", []), ("tag", []), ("build", [])):
        main([stage, *common, *more])
    city = config.load_cities(str(settings))["x"]
    at = city.paths(str(root))
    assert sorted(x.name for x in spark.read.parquet(at["clean"]).collect()) == ["植物园", "黄鹤楼", "黄鹤楼东门"]
    assert spark.read.parquet(at["tagged"]).count() == 3
    kb = {x.group: x for x in spark.read.parquet(at["kb"]).collect()}
    assert set(kb) == {"黄鹤楼", "植物园"} and len(kb["黄鹤楼"].embedding) == 64 and "黄鹤楼" in kb["黄鹤楼"].text
    assert not stages.build_stage(spark, city, str(root))
    cases = tmp_path / "eval.json"
    cases.write_text(json.dumps({"city": "x", "city_name": "X", "cases": [{"id": "c1", "query": kb["植物园"].text, "type": "single", "difficulty": "easy", "expected_names": ["植物园"], "must_not_include": []}, {"id": "c2", "profile": {"interests": ["历史人文"]}, "type": "single", "difficulty": "hard", "expected_names": ["none"]}]}, ensure_ascii=False), encoding="utf-8")
    got = {x.case_id: x for x in stages.eval_stage(spark, city, str(root), read_eval_set(spark, str(cases)), 2).collect()}
    assert got["c1"].hit == 1.0 and got["c1"].rr == 1.0 and got["c2"].hit == 0.0
    assert json.loads(spark.read.json(at["report"]).first().overall)["all"]["n"] == 2
    main(["eval", *common, "--cases", str(cases), "--top_k", "1"])
    main(["search", *common, "--query", "植物园", "--top_k", "1"])
    assert "overall" in capsys.readouterr().out
    results = spark.createDataFrame([("站", 0, "站", "114,30"), ("区", 0, "别", "bad")], "anchor string, ord long, name string, location string")
    assert stages.load_anchors(spark, city, str(root)).count() == 0
    stages.anchor_stage(spark, city, str(root), results)
    assert [x.name for x in stages.load_anchors(spark, city, str(root)).collect()] == ["站"]


def test_chinese_queries_share_parts_of_runs(spark, tmp_path, capsys):
    from placeloom.operators import index

    root, settings, found = (tmp_path / x for x in ("data", "cities", "places"))
    settings.mkdir(), found.mkdir()
    (settings / "y.yaml").write_text("name: Y\nspatial: {urban_districts: [D0]}\ncategory_words: [园]\n", encoding="utf-8")
    names = "黄鹤楼 植物园 听涛景区 木兰草原 归元禅寺 昙华林 江汉关 晴川阁".split()
    (found / "园.json").write_text(json.dumps([{"id": str(i), "name": n, "adname": "D0", "location": f"114.{i},30.{i}", "type": "风景名胜"} for i, n in enumerate(names)], ensure_ascii=False), encoding="utf-8")
    common = ["--city", "y", "--config", str(settings), "--root", str(root)]
    for stage, more in (("crawl", ["--places", str(found)]), ("clean", []), ("tag", []), ("build", [])):
        main([stage, *common, *more])
    city = config.load_cities(str(settings))["y"]
    at = city.paths(str(root))
    # The query and the text share a part of a run of ideographs: found by pairs, not by whole runs.
    asked = spark.createDataFrame([(0, "想去听涛的湖边")], "query_id long, query string")
    assert [x.id for x in stages.search_city(spark, city, str(root), asked, 1, "bm25").collect()] == ["2"]
    whole = str(tmp_path / "whole")
    index.bm25_index(spark.read.parquet(at["kb"])).write(whole)
    assert index.Bm25Index.read(spark, at["index"]).bigrams and not index.Bm25Index.read(spark, whole).bigrams
    assert index.bm25_scores(index.Bm25Index.read(spark, whole), asked).count() == 0
    assert [x.position for x in sorted(spark.read.parquet(at["kb"]).collect(), key=lambda x: int(x.id))] == list(range(8))


def test_pages_that_fail_are_recorded(spark, tmp_path):
    from placeloom.sources import search_api

    def fetch(keyword, region, size, page):
        if keyword == "b" and page == 2:
            raise OSError("gone")
        return [{"id": f"{keyword}{page}{i}", "name": keyword} for i in range(size if page < 3 else 0)]

    strict = search_api.with_retries(fetch, sleep=lambda s: None, strict=True)
    city = config.City("x", "X", "X", config.Spatial(("D",)), {"g": ("a", "b")}, core_pages=(2, 4))
    rows = [p for _, p in search_api.fetch_pages(strict, "b", "X", 2, 4)]
    assert [x.get("id") for x in rows] == ["b10", "b11", None] and "gone" in rows[-1][search_api.MISS]
    quick = lambda keyword, *rest: [] if keyword == "a" else 1 / 0
    search_api.PAUSE_S, pause = 0.0, search_api.PAUSE_S
    try:
        got = search_api.crawl(spark, city, quick).collect()
    finally:
        search_api.PAUSE_S = pause
    assert [(x._source_keyword, x.place) for x in got] == [("b", None)] and "division" in got[0]._missed


def test_vocabulary_file(tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        config.load_vocabulary(str(tmp_path / "none.yaml"))
    at = tmp_path / "schema.yaml"
    at.write_text("interest_tags: [甲]\nbehavior_tags: [乙, 丙]\ncrowd_to_tags: {丁: {乙: 2.0}}\ntext_template: '{name}'\n", encoding="utf-8")
    words = config.load_vocabulary(str(at))
    assert words.interests == ("甲",) and words.behaviors == ("乙", "丙") and words.crowd["丁"]["乙"] == 2.0 and words.template == "{name}"
    at.write_text("interest_tags: [甲]\n", encoding="utf-8")
    with pytest.raises(ValueError, match="behavior_tags"):
        config.load_vocabulary(str(at))


SCHEMA = """
poi:
  id: {type: string, required: true, stage: crawl, usage: [system]}
  name: {type: string, required: true, stage: crawl, usage: [embed]}
  location: {type: string, required: true, stage: crawl, usage: [compute]}
  rating: {type: float, stage: clean, usage: [filter]}
  address: {type: string, required: true, stage: clean, usage: display}
  tags: {type: string, required: true, stage: tag, usage: [embed, filter]}
interest_tags: [自然]
behavior_tags: [散步]
crowd_to_tags: {一个人: {散步: 1.0}}
text_template: "名{name}签{tags}"
"""


def test_schema_file_and_dictionary_on_the_real_path(spark, tmp_path):
    from placeloom.operators import index

    root, settings, found = (tmp_path / x for x in ("data", "cities", "places"))
    settings.mkdir(), found.mkdir()
    (settings / "z.yaml").write_text("name: Z\nspatial: {urban_districts: [D0]}\ncategory_words: [园]\n", encoding="utf-8")
    (tmp_path / "schema.yaml").write_text(SCHEMA, encoding="utf-8")
    (tmp_path / "words.txt").write_text("听涛 5\n涛景 1\n景区 9\n木兰 4\n草原 4\n", encoding="utf-8")
    rows = [{"id": str(i), "name": n, "adname": "D0", "address": a, "location": f"114.{i},30.{i}", "type": "风景名胜"} for i, (n, a) in enumerate([("听涛景区", "a"), ("木兰草原", "b"), ("昙华林", " "), ("江汉关", "c")])]
    (found / "园.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    common = ["--city", "z", "--config", str(settings), "--root", str(root), "--schema", str(tmp_path / "schema.yaml")]
    for stage, more in (("crawl", ["--places", str(found)]), ("clean", []), ("clean", []), ("tag", []), ("build", ["--dictionary", str(tmp_path / "words.txt")])):
        main([stage, *common, *more])
    city = config.load_cities(str(settings))["z"]
    at = city.paths(str(root))
    assert [(x.name, x._reasons) for x in spark.read.parquet(f"{at['clean']}_rejected").collect()] == [("昙华林", ["address: missing"])]
    assert {x.name for x in spark.read.parquet(at["clean"]).collect()} == {"听涛景区", "木兰草原", "江汉关"}
    assert all(x.text.startswith("名") for x in spark.read.parquet(at["kb"]).collect())
    made = index.Bm25Index.read(spark, at["index"])
    assert {"听涛", "景区", "木兰", "草原"} <= {x.term for x in made.terms.collect()} and made.lexicon.count() == 5
    asked = spark.createDataFrame([(0, "想去听涛的湖边")], "query_id long, query string")
    assert [x.id for x in stages.search_city(spark, city, str(root), asked, 1, "bm25").collect()] == ["0"]


def test_contract_kinds(spark):
    import pytest

    from placeloom.functions import contract

    for wrong in ({"type": "text"}, {"stage": "never"}, {"usage": ["show"]}):
        with pytest.raises(ValueError):
            contract.contract_from({"poi": {"a": wrong}})
    kinds = contract.contract_from({"poi": {k.replace("[string]", ""): {"type": k} for k in contract.KINDS} | {"later": {"required": True, "stage": "build", "usage": "embed"}}})
    df = spark.createDataFrame([("a", "1.5", "7", "True", ["x"]), (None, None, None, None, None), ("", " ", "", "", []), ("b", "x", "1.5", "yes", [None])], "string string, float string, int string, bool string, list array<string>")
    got = [x._reasons for x in contract.judged(df, kinds, "tag").collect()]
    assert got == [[], [], [], ["float: not a float", "int: not a int", "bool: not a bool", "list: not a list[string]"]]
    typed = spark.createDataFrame([(1, 1, 1.0, 1, 1)], "string int, float int, int double, bool int, list int")
    assert contract.judged(typed, kinds, "tag").first()._reasons == ["string: not a string", "int: not a int", "bool: not a bool", "list: not a list[string]"]
    assert contract.judged(typed, kinds, "build").first()._reasons[-1] == "later: missing" and contract.judged(df.limit(0), kinds, "build").count() == 0
    with pytest.raises(ValueError, match="string"):
        contract.check_template("{later} {string}", kinds)
    with pytest.raises(FileNotFoundError):
        contract.load_contract("/nowhere.yaml")
