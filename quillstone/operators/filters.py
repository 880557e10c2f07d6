"""Filter specifications: a small, serialisable query form that compiles to one boolean Column.

Predicates are two-valued: none matches a null or an empty array, and a negation matches every row
that its operand doesn't, null rows among them. Compiled forms keep to what Parquet scans can push down.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
EARTH_MILES = 3958.76


class UnsupportedPredicate(ValueError):
    """A predicate that this table or mode doesn't answer."""


@dataclass(frozen=True)
class Field:
    """A declared field. type: keyword, text, integer, float, boolean, date or geo (struct of lat, lon)."""

    name: str
    type: str = "keyword"
    multi: bool = False
    description: str = ""

    @property
    def spark_type(self) -> T.DataType:
        one = {
            "keyword": T.StringType(), "text": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
            "geo": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
        }[self.type]
        return T.ArrayType(one) if self.multi else one


Catalog = Mapping[str, Field]


def catalog(*fields: Field) -> dict[str, Field]:
    return {f.name: f for f in fields}


def schema_of(fields: Catalog) -> T.StructType:
    """The declared schema, with descriptions as column metadata."""
    return T.StructType([T.StructField(f.name, f.spark_type, True, {"description": f.description, "multi": f.multi}) for f in fields.values()])


@dataclass(frozen=True)
class Term:
    field: str
    value: Any


@dataclass(frozen=True)
class Terms:
    field: str
    values: tuple


@dataclass(frozen=True)
class Range:
    field: str
    min: Any = None
    max: Any = None


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class Not:
    predicate: Predicate


@dataclass(frozen=True)
class Text:
    query: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Geo:
    field: str
    lat: float
    lon: float
    miles: float


Predicate = Term | Terms | Range | Exists | Not | Text | Geo
_KINDS = {"term": Term, "terms": Terms, "range": Range, "exists": Exists, "not": Not, "text": Text, "geo": Geo}


@dataclass(frozen=True)
class FilterSpec:
    """All of `all`, and any of `any` unless that is empty. sort: (field, "asc" | "desc") or none."""

    all: tuple[Predicate, ...] = ()
    any: tuple[Predicate, ...] = ()
    sort: tuple[str, str] | None = None
    version: int = VERSION


def _to_json(p: Predicate) -> dict:
    kind = next(k for k, c in _KINDS.items() if isinstance(p, c))
    out = {"kind": kind}
    for name, value in vars(p).items():
        out[name] = _to_json(value) if isinstance(p, Not) else list(value) if isinstance(value, tuple) else value
    return out


def _from_json(d: Mapping) -> Predicate:
    d = dict(d)
    cls = _KINDS.get(d.pop("kind", None))
    if cls is None:
        raise ValueError("a predicate needs one of the kinds " + ", ".join(_KINDS))
    if cls is Not:
        return Not(_from_json(d["predicate"]))
    try:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
    except TypeError as e:
        raise ValueError(f"bad {cls.__name__.lower()} predicate: {e}") from None


def dumps(spec: FilterSpec) -> str:
    return json.dumps({"version": spec.version, "all": [_to_json(p) for p in spec.all], "any": [_to_json(p) for p in spec.any], "sort": spec.sort and list(spec.sort)})


def loads(text: str) -> FilterSpec:
    d = json.loads(text)
    if d.get("version", VERSION) != VERSION:
        raise ValueError(f"unknown version {d['version']}")
    return FilterSpec(tuple(map(_from_json, d.get("all", ()))), tuple(map(_from_json, d.get("any", ()))), tuple(d["sort"]) if d.get("sort") else None)


def validate(spec: FilterSpec, fields: Catalog, nl: bool = False) -> None:
    """Raise unless all fields exist and predicates suit them. nl: what a language model may ask for:
    term, terms, range on floats, exists, and one level of not."""

    def check(p: Predicate, depth: int) -> None:
        if isinstance(p, Not):
            if nl and depth:
                raise ValueError("a negation of a negation")
            check(p.predicate, depth + 1)
            return
        for name in p.fields if isinstance(p, Text) else (p.field,):
            if name not in fields:
                raise ValueError(f"unknown field {name}")
        if isinstance(p, Range):
            f = fields[p.field]
            if f.multi or f.type not in ("integer", "float", "date") or nl and f.type != "float":
                raise ValueError(f"no range on {p.field}")
        if isinstance(p, Geo) and fields[p.field].type != "geo" or nl and isinstance(p, Geo | Text):
            raise ValueError("predicate not allowed here")

    for p in (*spec.all, *spec.any):
        check(p, 0)
    if spec.sort and (spec.sort[0] not in fields or spec.sort[1] not in ("asc", "desc")):
        raise ValueError(f"can't sort by {spec.sort}")


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _literal(f: Field, value: Any) -> Column:
    """A literal of the field's type; ANSI comparisons of other types may throw."""
    if f.type in ("keyword", "text"):
        value = str(value).lower() if isinstance(value, bool) else str(value)
    elif f.type == "integer" and isinstance(value, float) and value.is_integer():
        value = int(value)
    if f.type == "integer" and isinstance(value, float):
        return F.lit(value)
    return F.lit(value).cast(f.spark_type.elementType if f.multi else f.spark_type)


def _array(name: str) -> Column:
    return F.coalesce(_col(name), F.array())


def miles_between(point: Column, lat: float, lon: float) -> Column:
    """Great-circle distance of a struct of lat and lon from a place."""
    a = F.pow(F.sin(F.radians(point.lat - lat) / 2), 2) + F.cos(F.radians(point.lat)) * F.cos(F.radians(F.lit(lat))) * F.pow(F.sin(F.radians(point.lon - lon) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def compile_predicate(p: Predicate, fields: Catalog, text: str = "contains") -> Column:
    """text: "contains" (any field holds the query, whatever its case), "tokens" (any word of the query
    is a word of a field), or "unsupported"."""
    no = F.lit(False)
    if isinstance(p, Not):
        return ~compile_predicate(p.predicate, fields, text)
    if isinstance(p, Text):
        if text == "unsupported":
            raise UnsupportedPredicate("text search is off for this table")
        if not p.fields:
            return no
        if text == "contains":
            each = [F.col(f"`{n}`").isNotNull() & F.coalesce(F.contains(F.lower(_col(n)), F.lower(F.lit(p.query))), no) for n in p.fields]
        else:
            words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
            each = [F.coalesce(F.arrays_overlap(words(_col(n)), words(F.lit(p.query))), no) for n in p.fields]
        return reduce(or_, each)
    f, c = fields[p.field], _col(p.field)
    if isinstance(p, Term):
        if f.multi:
            return F.coalesce(F.array_contains(_array(p.field), _literal(f, p.value)), no)
        return c.eqNullSafe(_literal(f, p.value)) if p.value is not None else no
    if isinstance(p, Terms):
        values = [_literal(f, v) for v in p.values if v is not None]
        if not values:
            return no
        if f.multi:
            return F.coalesce(F.arrays_overlap(_array(p.field), F.array(*values)), no)
        return c.isNotNull() & c.isin(*values)
    if isinstance(p, Range):
        if f.multi:
            raise UnsupportedPredicate(f"no range on {p.field}, which has several values")
        bounds = [c.isNotNull()]
        if p.min is not None:
            bounds.append(c >= _literal(f, p.min))
        if p.max is not None:
            bounds.append(c <= _literal(f, p.max))
        return reduce(and_, bounds)
    if isinstance(p, Exists):
        return F.size(_array(p.field)) > 0 if f.multi else c.isNotNull()
    # a box first, which is cheap to compute; not across the poles or the date line, where it is left out
    degrees = p.miles / 69.0
    near = c.isNotNull() & c.lat.isNotNull() & c.lon.isNotNull()
    if abs(p.lat) + degrees < 89:
        near = near & c.lat.between(p.lat - degrees * 1.01, p.lat + degrees * 1.01)
    return near & F.coalesce(miles_between(c, p.lat, p.lon) <= p.miles, no)


def compile_spec(spec: FilterSpec, fields: Catalog, text: str = "contains") -> Column:
    every = reduce(and_, [compile_predicate(p, fields, text) for p in spec.all], F.lit(True))
    if not spec.any:
        return every
    some = reduce(or_, [compile_predicate(p, fields, text) for p in spec.any])
    return every & some if spec.all else some


# what a user sees of a specification


def field_label(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in name.split("_"))


def predicate_label(p: Predicate) -> str:
    if isinstance(p, Not):
        return "NOT " + predicate_label(p.predicate)
    if isinstance(p, Text):
        return f'"{p.query}"'
    name = field_label(p.field)
    if isinstance(p, Term):
        return f"{name}: {p.value}"
    if isinstance(p, Terms):
        rest = len(p.values) - 2
        return f"{name}: {', '.join(map(str, p.values[:2]))}" + (f" +{rest}" if rest > 0 else "")
    if isinstance(p, Range):
        bounds = [f"{sign} {v}" for sign, v in (("≥", p.min), ("≤", p.max)) if v is not None]
        return f"{name} {' and '.join(bounds)}"
    return f"Has {name}" if isinstance(p, Exists) else f"{name} within {p.miles}mi"


@dataclass(frozen=True)
class Chip:
    id: str
    label: str
    expanded: tuple[str, ...] = field(default=())


def build_chips(spec: FilterSpec) -> list[Chip]:
    """A chip for each predicate of `all`, and one for the whole of `any`; long value lists expand."""

    def values(p: Predicate) -> tuple[str, ...]:
        return tuple(map(str, p.values)) if isinstance(p, Terms) and len(p.values) > 2 else ()

    chips = [Chip(f"all-{i}", predicate_label(p), values(p)) for i, p in enumerate(spec.all)]
    if spec.any:
        labels = tuple(map(predicate_label, spec.any))
        chips.append(Chip("any-group", "Any of: " + " · ".join(labels), labels if len(labels) > 2 else ()))
    return chips


def remove_chip(spec: FilterSpec, chip_id: str) -> FilterSpec:
    if chip_id == "any-group":
        return replace(spec, any=())
    at = int(chip_id.removeprefix("all-"))
    return replace(spec, all=spec.all[:at] + spec.all[at + 1 :])


def next_sort(now: tuple[str, str] | None, name: str) -> tuple[str, str] | None:
    """What a click on a column's header does: descending, ascending, none."""
    if now is None or now[0] != name:
        return name, "desc"
    return (name, "asc") if now[1] == "desc" else None
