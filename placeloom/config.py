"""Settings of a city and the shared vocabularies, validated when a plan is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

# Words, weights and limits that results depend on.
GENERIC_TYPES = ("风景名胜", "风景名胜相关", "公园广场", "餐饮相关", "购物服务", "购物相关场所", "科教文化服务", "其他", "地名地址信息", "交通地名", "自然地名")
INTERESTS = ("历史人文", "自然风光", "美食探店", "购物休闲", "夜生活")
BEHAVIORS = ("散步", "拍照", "看展", "赏景", "逛街", "美食", "研学", "遛娃", "热闹", "安静", "文艺", "夜游")
CROWD_WEIGHTS = {
    "情侣": {"文艺": 3.0, "夜游": 2.5, "安静": 2.0, "拍照": 1.0, "散步": 1.0, "赏景": 1.0, "美食": 1.0, "逛街": 0.5},
    "朋友": {"夜游": 2.0, "热闹": 1.5, "美食": 1.5, "逛街": 1.0, "拍照": 0.8, "赏景": 0.5, "文艺": 0.5},
    "亲子": {"遛娃": 3.0, "研学": 2.5, "看展": 2.0, "热闹": 1.0, "散步": 1.0, "赏景": 0.8, "美食": 0.8},
    "独行": {"文艺": 3.0, "安静": 2.5, "看展": 2.0, "拍照": 1.0, "赏景": 1.0, "散步": 1.0},
    "家庭": {"遛娃": 2.5, "散步": 1.5, "赏景": 1.5, "美食": 1.5, "逛街": 1.0, "拍照": 1.0, "安静": 0.8},
}
HARD_NAMES = ("停车场", "售票处", "游客中心", "服务中心", "安检", "地铁站", "公交站", "出入口", "派出所", "公共厕所", "卫生间")
HARD_TYPES = ("地铁站", "公交车站", "停车场", "售票处", "公共厕所", "住宿服务")
SOFT_TYPES = ("学校", "科教文化服务", "政府机关", "公司企业", "商务住宅", "金融保险")
EXEMPT_WORDS = ("博物馆", "纪念馆", "旧址", "遗址", "故居", "公园", "大学", "学院", "寺", "庙", "塔", "楼", "景区", "风景区", "文化", "艺术")
SUB_FACILITY = ("殿", "堂", "亭", "塔", "楼", "院", "阁", "池", "林", "台", "宫", "像", "雕像", "铜像")
BRAND_STORE = r"\(.*(店|分店|特许).*\)"
TEXT_TEMPLATE = "{name}{aliases}，位于{city}{district}。类型：{clean_type}，属于{tags}类，可以{behaviors}。\n{description}"
MAX_POIS = 400
RRF_K, VECTOR_WEIGHT, BM25_WEIGHT, VECTOR_POOL, BM25_POOL = 60, 1.0, 0.3, 5, 2
RECALL_LEAST, RECALL_A_DAY, RECALL_MOST = 40, 20, 120
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EARTH_KM, KM_A_DEGREE = 6371.0, 111.32


@dataclass(frozen=True)
class Style:
    """Weights of the six terms of a base score, and the stops of a day."""

    rating: float
    interest: float
    random: float
    core: float
    behavior: float
    level: float
    target: int


# The three styles; the second locks 5A places.
STYLES = {
    "综合": Style(0.15, 0.10, 0.15, 0.30, 0.30, 0.00, 5),
    "口碑": Style(0.25, 0.05, 0.10, 0.30, 0.15, 0.15, 5),
    "悠闲": Style(0.10, 0.10, 0.25, 0.25, 0.30, 0.00, 4),
}
DEFAULT_STYLE, LOCKING_STYLE = "综合", "口碑"


@dataclass(frozen=True)
class CleanRules:
    """Word lists of the rule chain, each matched as a substring."""

    hard_names: tuple[str, ...] = HARD_NAMES
    hard_types: tuple[str, ...] = HARD_TYPES
    soft_types: tuple[str, ...] = SOFT_TYPES
    exempt_words: tuple[str, ...] = EXEMPT_WORDS
    brand_store: str | None = BRAND_STORE
    sub_facility: tuple[str, ...] = SUB_FACILITY
    local: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spatial:
    """Limits of the clustering; ``urban_districts`` has no default."""

    urban_districts: tuple[str, ...]
    cluster_k: int = 12
    max_size: int = 5
    max_km: float = 8.0
    min_points: int = 6
    correction_rounds: int = 10
    fill_rounds: int = 30
    seed: int = 42

    def __post_init__(self):
        if not self.urban_districts:
            raise ValueError("urban_districts must not be empty")


@dataclass(frozen=True)
class Groups:
    """Manual grouping of names: canonical name -> members, and names never merged."""

    members: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    no_merge: tuple[str, ...] = ()

    def canonical_of(self) -> dict[str, str]:
        """member -> canonical name, chains followed to their end; a cycle stops where it closes."""
        direct = {m: c for c, ms in self.members.items() for m in ms}
        return {m: follow(direct, m) for m in direct}


def follow(direct: Mapping[str, str], name: str) -> str:
    seen = {name}
    while (after := direct.get(name)) is not None and after not in seen:
        seen.add(after)
        name = after
    return name


@dataclass(frozen=True)
class City:
    key: str
    name: str
    region: str
    spatial: Spatial
    core_spots: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    category_words: tuple[str, ...] = ()
    transport_hubs: tuple[str, ...] = ()
    stay_districts: tuple[str, ...] = ()
    groups: Groups = Groups()
    rules: CleanRules = CleanRules()
    max_pois: int = MAX_POIS
    core_pages: tuple[int, int] = (5, 1)
    category_pages: tuple[int, int] = (20, 2)

    @property
    def core_flat(self) -> frozenset[str]:
        return frozenset(w for words in self.core_spots.values() for w in words)

    def paths(self, root: str) -> dict[str, str]:
        """Where the tables of this city live below ``root``."""
        at = {"raw": "raw/{}_pois", "raw_anchors": "raw/{}_anchors", "clean": "processed/{}_clean", "anchors": "processed/{}_anchors_clean", "tagged": "tagged/{}_tagged", "kb": "kb/{}", "index": "index/{}", "report": "eval/{}_report"}
        return {k: f"{root}/{v.format(self.key)}" for k, v in at.items()}


def city_from(key: str, raw: Mapping) -> City:
    """A city from a parsed YAML file."""
    rules, spatial, groups, crawl = (raw.get(k) or {} for k in ("clean_rules", "spatial", "poi_groups", "crawl"))
    words = lambda name, default: tuple(rules[name]) if name in rules else default
    pages = lambda kind, default: tuple(crawl.get(f"{kind}_{k}", d) for k, d in zip(("page_size", "max_pages"), default))
    known = {"cluster_k": "cluster_k", "max_size": "max_size", "max_dist": "max_km", "min_pts_per_day": "min_points"}
    return City(
        key=key, name=raw["name"], region=raw.get("region", raw["name"]),
        spatial=Spatial(tuple(spatial.get("urban_districts") or ()), **{ours: spatial[theirs] for theirs, ours in known.items() if theirs in spatial}),
        core_spots={k: tuple(v) for k, v in (raw.get("core_spots") or {}).items()},
        category_words=tuple(raw.get("category_words") or ()), transport_hubs=tuple(raw.get("transport_hubs") or ()), stay_districts=tuple(raw.get("stay_districts") or ()),
        groups=Groups({k: tuple(v) for k, v in groups.items() if k != "no_merge"}, tuple(groups.get("no_merge") or ())),
        rules=CleanRules(words("hard_exclude_names", HARD_NAMES), words("hard_exclude_types", HARD_TYPES), words("soft_exclude_types", SOFT_TYPES), words("soft_exempt_keywords", EXEMPT_WORDS), rules.get("brand_store_pattern", BRAND_STORE), words("sub_facility_suffixes", SUB_FACILITY), words("local_exclude", ())),
        max_pois=(raw.get("limits") or {}).get("max_pois", MAX_POIS), core_pages=pages("core", (5, 1)), category_pages=pages("category", (20, 2)),
    )


def load_cities(folder: str) -> dict[str, City]:
    """All cities of <folder>/*.yaml in order of name, files that begin with _ left out; an error if there is none."""
    import yaml

    files = [p for p in sorted(Path(folder).glob("*.yaml")) if not p.name.startswith("_")]
    if not files:
        raise FileNotFoundError(f"no city files in {folder}")
    return {p.stem: city_from(p.stem, yaml.safe_load(p.read_text(encoding="utf-8"))) for p in files}


def city_config(cities: Mapping[str, City], key: str) -> City:
    if key not in cities:
        raise KeyError(f"unknown city {key}; known: {', '.join(cities)}")
    return cities[key]


@dataclass(frozen=True)
class Vocabulary:
    """The words that tags, companions and texts are made of."""

    interests: tuple[str, ...] = INTERESTS
    behaviors: tuple[str, ...] = BEHAVIORS
    crowd: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: CROWD_WEIGHTS)
    template: str = TEXT_TEMPLATE


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a YAML file; an error if the file or one of its four entries is missing."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no vocabulary file {path}")
    raw = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    for name in ("interest_tags", "behavior_tags", "crowd_to_tags", "text_template"):
        if not raw.get(name):
            raise ValueError(f"{path} has no {name}")
    return Vocabulary(tuple(raw["interest_tags"]), tuple(raw["behavior_tags"]), raw["crowd_to_tags"], raw["text_template"])
