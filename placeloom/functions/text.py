"""Text, array and JSON functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.config import BEHAVIORS, DEFAULT_STYLE, GENERIC_TYPES, INTERESTS
from placeloom.schema import NO_COORDINATE, NO_RATING

#: A decimal number as Python's float() reads it, underscores between digits included; no infinities.
NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def strip(text: Column) -> Column:
    """Without white space, line feeds included, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_nonempty(*texts: Column) -> Column:
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is a substring; False for null."""
    if not words:
        return F.lit(False)
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(False))


def contains_any_of(text: Column, words: Column) -> Column:
    """The same for an array column of words."""
    return F.coalesce(F.exists(words, lambda w: F.contains(text, w)), F.lit(False))


def to_float(raw: Column, default: float = NO_RATING) -> Column:
    """The number a text spells, else ``default``."""
    return F.coalesce(F.when(raw.rlike(NUMBER), F.replace(F.trim(raw), F.lit("_")).try_cast("double")), F.lit(default))


def parse_rating(raw: Column) -> Column:
    return to_float(raw, NO_RATING)


def photo_urls(photos: Column) -> Column:
    """The non-empty urls of an array of structs; an empty array for null."""
    return F.coalesce(F.filter(F.transform(photos, lambda p: p["url"]), lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))


def split_tags(raw: Column) -> Column:
    """The trimmed, non-empty parts between ASCII or full-width commas."""
    parts = F.split(F.replace(or_empty(raw), F.lit("，"), F.lit(",")), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def parse_level(raw: Column) -> Column:
    """The first digit followed by an A, as in 5A; else empty."""
    return or_empty(F.regexp_extract(raw, r"\dA", 0))


def display_name(name: Column) -> Column:
    """Without parenthesised parts (ASCII or full-width, not nested ones); the name itself if nothing is left."""
    short = strip(F.regexp_replace(name, r"[（(][^（）()]*[）)]", ""))
    return F.when(short == "", name).otherwise(short)


def clean_type(raw: Column, generic: Sequence[str] = GENERIC_TYPES) -> Column:
    """Distinct type words in order, without generic ones, joined by commas."""
    parts = F.transform(F.split(F.replace(or_empty(raw), F.lit("|"), F.lit(";")), ";"), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.isin(*generic))), ",")


def parse_location(raw: Column) -> Column:
    """struct(lat, lng) of "lng,lat"; both the sentinel unless there are two numbers."""
    parts = F.split(or_empty(raw), ",")
    lng, lat = (F.when(F.get(parts, F.lit(i)).rlike(NUMBER), F.replace(F.trim(F.get(parts, F.lit(i))), F.lit("_")).try_cast("double")) for i in (0, 1))
    good = (F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull()
    none = F.lit(NO_COORDINATE)
    return F.struct(F.when(good, lat).otherwise(none).alias("lat"), F.when(good, lng).otherwise(none).alias("lng"))


def valid_coordinate(lat: Column, lng: Column) -> Column:
    return (lat != NO_COORDINATE) & (lng != NO_COORDINATE)


def alias_text(aliases: Column) -> Column:
    return F.when(F.size(aliases) > 0, F.concat(F.lit("（又称："), F.array_join(aliases, "、"), F.lit("）"))).otherwise("")


def build_text(template: str, **slots: Column) -> Column:
    """The template with its {slots} filled, stripped; a template with an unknown slot gives 【景点名称】 and the name."""
    import string

    parts: list[Column] = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            if slot not in slots:
                return F.concat(F.lit("【景点名称】"), slots["name"])
            parts.append(or_empty(slots[slot]))
    return strip(F.concat(*parts))


def tokens(text: Column, bigrams: bool = False) -> Column:
    """Lower-case runs of letters and digits; with ``bigrams``, runs of CJK ideographs become overlapping pairs."""
    words = F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if not bigrams:
        return words

    def pairs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1))
        return F.when(w.rlike(r"^\p{IsHan}+$"), F.transform(starts, lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array(w))

    apart = F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(r"\p{IsHan}+|[^\p{IsHan}]+"), F.lit(0)))
    return F.flatten(F.transform(F.flatten(apart), pairs))


def strip_city(query: Column, city: Column) -> Column:
    """The query without the city's name; the query itself if nothing else is in it."""
    rest = F.trim(F.when(city == "", query).otherwise(F.replace(query, city, F.lit(""))))
    return F.when(rest == "", query).otherwise(rest)


def query_text(interests: Column, city: Column) -> Column:
    """The interests, or the city and 景点 if there are none."""
    return F.coalesce(F.nullif(F.array_join(interests, " "), F.lit("")), F.concat(city, F.lit(" 景点")))


TAG_JSON = "struct<is_attraction:string,tags:string,behaviors:string,description:string>"


def parse_tag_json(raw: Column) -> Column:
    """struct(is_attraction, tags, behaviors, description) of a model's answer.

    Code fences are dropped; whatever isn't a JSON object counts as (true, "", "", ""); the texts
    of what isn't an attraction are blanked.
    """
    body = strip(F.replace(F.replace(or_empty(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    is_object = body.startswith("{") & F.get_json_object(body, "$").isNotNull()
    field = lambda name: F.get_json_object(body, f"$.{name}")
    flag = F.coalesce(F.lower(field("is_attraction")).isin("true", "1", "yes"), F.lit(True))
    flag = F.when(is_object, flag).otherwise(True)
    said = lambda name: F.when(is_object & flag, strip(or_empty(field(name)))).otherwise("")
    return F.struct(flag.alias("is_attraction"), *(said(c).alias(c) for c in ("tags", "behaviors", "description")))


def tag_system_prompt(interests: Sequence[str] = INTERESTS, behaviors: Sequence[str] = BEHAVIORS) -> str:
    """What a tagging model is told first: the fields, the words to choose from and the form of the answer."""
    return "\n".join((
        "你负责给城市地点打标签。根据名称、类型、地址、评分和景区等级，只返回一个 JSON 对象，不加代码块，也不加其他文字。",
        "is_attraction：值得专程游览的地方为 true；单店、学校、医院、写字楼、住宅、交通工具，以及景点内部的子设施为 false，此时其余字段都是空字符串。",
        f"tags：只从这些词里选 1 到 3 个，用英文逗号分隔：{' / '.join(interests)}",
        f"behaviors：只从这些词里选 2 到 5 个，用英文逗号分隔，要有依据：{' / '.join(behaviors)}",
        "description：一句 20 到 40 字的介绍，只写给出的信息和公认的常识，不写价格、时间、活动和不确定的称号。",
        '格式：{"is_attraction": true, "tags": "…", "behaviors": "…", "description": "…"}',
    ))


#: What each style asks of a day's text.
STYLE_NOTES = {
    "综合": "本方案求均衡：兴趣、路程和时间兼顾，节奏适中。",
    "口碑": "本方案重口碑：评分和等级高的地方优先，但不要念评分。",
    "悠闲": "本方案求悠闲：节奏放慢，多留空闲。",
}


def day_system_prompt(style: str | None, notes: Mapping[str, str] = STYLE_NOTES, default: str = DEFAULT_STYLE) -> str:
    """What a writing model is told first; an unknown style has the default one's note."""
    return "\n".join((
        "你是旅行规划师，为用户写行程中某一天的文案，语气口语、简洁。",
        "只写列出的景点，每个都要出现，不增、不减、不换，只安排先后和时间；路线以住宿地为中心，不写到站信息。",
        "写成一段话，说明先后、大致时间和理由；不写天数开头，不用标题、列表和 JSON。",
        notes.get(style, notes[default]),
    ))


# The two prompts below are held to the form that models and stored answers expect.
def tag_prompt(name: Column, kind: Column, address: Column, rating: Column, level: Column) -> Column:
    """What a tagging model is told about a place."""
    level = F.when(or_empty(level) == "", "无").otherwise(level)
    return F.concat(F.lit("名称："), or_empty(name), F.lit("\n类型："), or_empty(kind), F.lit("\n地址："), or_empty(address), F.lit("\n评分："), or_empty(rating.cast("string")), F.lit("\n景区等级："), level)


def day_lines(stops: Column) -> Column:
    """Numbered lines of an array of structs (display_name, name, aliases, tags, description)."""

    def line(p: Column, i: Column) -> Column:
        aliases = F.when(F.size(F.coalesce(p["aliases"], F.array().cast("array<string>"))) > 0, F.concat(F.lit("（含 "), F.array_join(p["aliases"], "/"), F.lit("）"))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), first_nonempty(p["display_name"], p["name"]), aliases, F.lit(" | "), or_empty(p["tags"]), F.lit(" | "), or_empty(p["description"]))

    return F.array_join(F.transform(stops, line), "\n")


def day_prompt(city: Column, interests: Column, companion: Column, days: Column, stay: Column, day_name: Column, stops: Column) -> Column:
    """What a writing model is told about one day."""
    wishes = F.coalesce(F.nullif(F.array_join(interests, "、"), F.lit("")), F.lit("不限"))
    return F.concat(
        F.lit("【用户需求】\n城市："), city, F.lit("\n兴趣偏好："), wishes, F.lit("\n同行人："), companion, F.lit("\n行程共 "), days.cast("string"), F.lit(" 天，这是其中："), day_name,
        F.lit("\n住宿地："), stay, F.lit("\n\n【本日景点】（共 "), F.size(stops).cast("string"), F.lit(" 个，必须全部出现，不得增删）\n"), day_lines(stops), F.lit("\n\n请写 "), day_name, F.lit(" 这一天的行程文案。"),
    )


def mentioned(name: Column, text: Column) -> Column:
    """Whether a text names a place, in full or by its first three characters; an empty name always is."""
    return (or_empty(name) == "") | F.contains(text, name) | ((F.length(name) >= 3) & F.contains(text, F.substring(name, 1, 3)))
