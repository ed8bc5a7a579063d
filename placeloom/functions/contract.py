"""The field contract of places: which fields a stage must have made, of what kind, and what they are used for, as expressions over a table.

A contract is the ``poi`` part of a YAML file: field -> type, required, stage, usage. Rows are routed by it
to good ones and to bad ones with their reasons, without a pass of its own: everything is one projection.

Defined cases: a field of a later stage isn't looked at; columns that the contract doesn't name are left alone; a text of white space only
counts as missing; a column that isn't there misses in every row; a null that isn't required is right for any kind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, NumericType, StringType

from placeloom.functions.text import NUMBER, strip

#: The names that contract files use.
STAGES = ("crawl", "clean", "tag", "build")
KINDS = ("string", "float", "int", "bool", "list[string]")
USES = ("filter", "embed", "display", "compute", "system")
REASONS = "_reasons"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool
    stage: str
    usage: tuple[str, ...]


def contract_from(raw: Mapping) -> tuple[Field, ...]:
    """The fields of a parsed file; an error names what isn't a known kind, stage or use."""
    fields = []
    for name, given in (raw.get("poi") or {}).items():
        use = given.get("usage") or ()
        f = Field(name, given.get("type", "string"), bool(given.get("required")), given.get("stage", STAGES[0]), (use,) if isinstance(use, str) else tuple(use))
        for value, known in ((f.kind, KINDS), (f.stage, STAGES), *((u, USES) for u in f.usage)):
            if value not in known:
                raise ValueError(f"field {name}: {value} isn't one of {', '.join(known)}")
        fields.append(f)
    return tuple(fields)


def load_contract(path: str) -> tuple[Field, ...]:
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(f"no contract file {path}")
    return contract_from(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def upto(contract: Sequence[Field], stage: str) -> list[Field]:
    """The fields that must be there once ``stage`` is done."""
    return [f for f in contract if STAGES.index(f.stage) <= STAGES.index(stage)]


def used_for(contract: Sequence[Field], use: str) -> list[str]:
    return [f.name for f in contract if use in f.usage]


def check_template(template: str, contract: Sequence[Field], derived: Sequence[str] = ("aliases",)) -> None:
    """An error if a text template has a slot that isn't a field to embed (or one that building derives)."""
    import string

    known = {*used_for(contract, "embed"), *derived}
    if strange := [slot for _, slot, _, _ in string.Formatter().parse(template) if slot is not None and slot not in known]:
        raise ValueError(f"the text template has {', '.join(strange)}, which the contract doesn't embed")


def _misses(value: Column, of: DataType) -> Column:
    return value.isNull() | (strip(value) == "") if isinstance(of, StringType) else value.isNull()


def _wrong(value: Column, of: DataType, kind: str) -> Column:
    """Whether a value that isn't missing is of another kind."""
    text = isinstance(of, StringType)
    if kind in ("float", "int"):
        whole = r"^\s*[+-]?\d+\s*$"
        return ~value.rlike(NUMBER if kind == "float" else whole) if text else F.lit(not isinstance(of, NumericType if kind == "float" else IntegralType))
    if kind == "bool":
        return ~(F.lower(strip(value)).isin("true", "false") if text else F.lit(isinstance(of, BooleanType)))
    if kind == "list[string]":
        return F.exists(value, lambda x: x.isNull()) if isinstance(of, ArrayType) and isinstance(of.elementType, StringType) else F.lit(True)
    return F.lit(not text)


def judged(rows: DataFrame, contract: Sequence[Field], stage: str) -> DataFrame:
    """``rows`` with _reasons: "field: missing" or "field: not a kind", in the order of the contract; empty for good rows."""
    kinds = {f.name: f.dataType for f in rows.schema}
    found = []
    for f in upto(contract, stage):
        if f.name not in kinds:
            found += [F.lit(f"{f.name}: missing")] if f.required else []
            continue
        value, of = F.col(f.name), kinds[f.name]
        wrong = F.when(~_misses(value, of) & _wrong(value, of, f.kind), f"{f.name}: not a {f.kind}")
        found.append(F.when(_misses(value, of), f"{f.name}: missing").otherwise(wrong) if f.required else wrong)
    reasons = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return rows.withColumn(REASONS, reasons)


def route(rows: DataFrame, contract: Sequence[Field], stage: str) -> tuple[DataFrame, DataFrame]:
    """The good rows as they are, and the others with their reasons."""
    seen = judged(rows, contract, stage)
    return seen.filter(F.size(REASONS) == 0).drop(REASONS), seen.filter(F.size(REASONS) > 0)


def reason_counts(bad: DataFrame) -> DataFrame:
    """reason, n."""
    return bad.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
