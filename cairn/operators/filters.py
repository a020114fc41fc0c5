"""The filter language over map features: a shareable query string, a Column predicate, faceted counts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.regions import country_of
from cairn.vocab import COUNTRIES, ERAS, ID, ID_LENGTH, MARKS, MATERIALS, NO_STRUCTURE, STATUSES, STRUCTURES, VERIFICATIONS

#: Set-valued terms: their parameter, column and vocabulary. A set of None holds every value, an empty one no value.
SETS = {"status": ("status", "s", STATUSES), "kind": ("kind", "k", STRUCTURES), "verification": ("ver", "v", VERIFICATIONS)}
FACETS = {"status": "s", "kind": "k", "verification": "v", "region": "r"}
MOST_SIGHTS, SIGHT_KM = 12, (20, 40, 60)
FIRST_YEAR, LAST_YEAR = 1850, 2100
DEFAULT_ERA, DEFAULT_OPACITY = "lookouts", 85


@dataclass(frozen=True)
class Filters:
    """Terms of a conjunctive filter."""

    status: frozenset[str] | None = None
    kind: frozenset[str] | None = None
    verification: frozenset[str] | None = None
    rentable: bool = False
    registered: bool = False
    region: str | None = None
    country: str | None = None
    mine: frozenset[str] | None = None
    design: str | None = None
    material: str | None = None
    no_structure: bool = False
    approximate: bool = True


@dataclass(frozen=True)
class State:
    """A view that a link can hold: the filters, and what is shown of what they let through."""

    filters: Filters = field(default_factory=Filters)
    view: tuple[float, float, float] | None = None  # zoom, lat, lon
    selected: str | None = None
    base: str = "map"
    era: str = DEFAULT_ERA
    opacity: int = DEFAULT_OPACITY  # per cent
    year: int | None = None
    year_maybe: bool = False
    sights: tuple[str, ...] = ()
    sight_km: int | None = None


def matches(f: Filters, leave_out: str = "") -> Column:
    """The predicate of a filter, without the term named in leave_out and without `mine`, which needs a join: see apply.

    A null value is in no set. Kinds without a structure have a switch of their own and aren't asked for in the set of kinds.
    """
    bare = F.coalesce(F.col("k").isin(*NO_STRUCTURE), F.lit(False))
    parts: list[Column] = [F.lit(True) if f.no_structure else ~bare]
    for name, (_, col, _) in SETS.items():
        wanted = getattr(f, name)
        if wanted is not None and name != leave_out:
            has = F.col(col).isin(*sorted(wanted)) if wanted else F.lit(False)
            parts.append(bare | has if name == "kind" else has)
    if not f.approximate:
        parts.append(F.coalesce("ap", F.lit(0)) != 1)
    if f.rentable:
        parts.append(F.col("rt") == 1)
    if f.registered:
        parts.append(F.col("rg") == 1)
    if leave_out != "region":
        if f.region:
            parts.append(F.col("r") == f.region)
        if f.country:
            parts.append(F.coalesce(F.col("cc"), country_of(F.col("r")), F.lit("US")) == f.country)
    if f.design:
        parts.append(F.length("d") > 0 if f.design == "any" else F.array_contains(F.split("d", r"\|"), f.design))
    if f.material:
        parts.append(F.col("m") == f.material)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return F.coalesce(out, F.lit(False))


def _mine(features: DataFrame, f: Filters, marks: DataFrame | None) -> DataFrame:
    if not f.mine:
        return features
    if marks is None:
        return features.where(F.lit(False))
    wanted = marks.where(F.col("mark").isin(*sorted(f.mine))).select(F.col("id").alias("i")).distinct()
    return features.join(wanted, "i", "left_semi")


def apply(features: DataFrame, f: Filters, marks: DataFrame | None = None) -> DataFrame:
    """The features a filter lets through. marks(id, mark): a user's list, which `mine` asks for; without a list nothing is mine."""
    return _mine(features.where(matches(f)), f, marks)


def facet_counts(features: DataFrame, f: Filters, facets: Iterable[str] = tuple(FACETS), marks: DataFrame | None = None) -> DataFrame:
    """(facet, value, n): for each facet its values' counts under all other terms (region also sets country aside). One scan."""
    each = F.array(*[F.struct(F.lit(x).alias("facet"), F.col(FACETS[x]).alias("value"), matches(f, x).alias("ok")) for x in facets])
    return _mine(features, f, marks).select(F.inline(each)).where("ok and value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def active_count(f: Filters) -> int:
    """How many terms differ from their default; region and country are one, an empty `mine` is none."""
    plain = Filters()
    names = ("status", "kind", "verification", "design", "material", "rentable", "registered", "no_structure", "approximate")
    return sum(getattr(f, n) != getattr(plain, n) for n in names) + bool(f.region or f.country) + bool(f.mine)


def toggle(current: frozenset[str] | None, value: str, on: bool, every: tuple[str, ...]) -> frozenset[str] | None:
    """A set with a value switched; the full set is written None."""
    now = set(every) if current is None else set(current)
    (now.add if on else now.discard)(value)
    return None if now == set(every) else frozenset(now)


def is_id(value: str) -> bool:
    return len(value) <= ID_LENGTH and re.fullmatch(ID, value) is not None


def _number(text: str | None, low: float, high: float) -> float | None:
    try:
        n = float(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return n if math.isfinite(n) and low <= n <= high else None


def _whole(text: str | None, low: int, high: int) -> int | None:
    n = _number(text, low, high)
    return int(n) if n is not None and n == int(n) else None


def _view(text: str) -> tuple[float, float, float] | None:
    parts = text.split("/")
    if len(parts) != 3:
        return None
    got = [_number(x, low, high) for x, (low, high) in zip(parts, ((0, 22), (-85, 85), (-180, 180)), strict=True)]
    return None if None in got else (got[0], got[1], got[2])  # type: ignore[return-value]


def parse(query: str) -> State:
    """The state of a query string. What isn't understood is dropped, never an error; a region beats a country, the first of a repeated parameter the others."""
    q: dict[str, str] = {}
    for k, v in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        q.setdefault(k, v)
    f = Filters()
    for name, (parameter, _, vocab) in SETS.items():
        if parameter in q:
            got = frozenset(x.strip() for x in q[parameter].split(",")) & set(vocab)
            f = replace(f, **{name: frozenset() if q[parameter] == "none" else None if not got or got == set(vocab) else got})
    region, country = q.get("state", "").upper(), q.get("country", "").upper()
    if re.fullmatch("[A-Z]{2}", region):
        f = replace(f, region=region)
    elif country in COUNTRIES:
        f = replace(f, country=country)
    mine = frozenset(q.get("mine", "").split(",")) & set(MARKS)
    f = replace(f, mine=mine or None, rentable=q.get("rent") == "1", registered=q.get("reg") == "1", no_structure=q.get("ns") == "1", approximate=q.get("ap") != "0")
    if re.fullmatch("[a-z0-9_]{1,40}", q.get("design", "")):
        f = replace(f, design=q["design"])
    if q.get("mat") in MATERIALS:
        f = replace(f, material=q["mat"])
    year = _whole(q.get("yr"), FIRST_YEAR, LAST_YEAR)
    opacity = _number(q.get("op"), 10, 100)
    return State(
        f,
        view=_view(q.get("at", "")),
        selected=q["t"] if is_id(q.get("t", "")) else None,
        base=q["base"] if q.get("base") in ("topo", "old") else "map",
        era=q["era"] if q.get("era") in ERAS else DEFAULT_ERA,
        opacity=DEFAULT_OPACITY if opacity is None else math.floor(opacity + 0.5),
        year=year,
        year_maybe=year is not None and q.get("yrm") == "1",
        sights=tuple(dict.fromkeys(x for x in q.get("vs", "").split(",") if is_id(x)))[:MOST_SIGHTS],
        sight_km=_whole(q.get("vr"), 0, 100) if _whole(q.get("vr"), 0, 100) in SIGHT_KM else None,
    )


def _short(n: float, digits: int) -> str:
    text = f"{n:.{digits}f}".rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def serialize(state: State) -> str:
    """The canonical query string of a state: defaults left out, values in the vocabulary's order, `none` for an empty set."""
    f, out = state.filters, []
    if state.view:
        out.append(("at", "/".join(_short(n, d) for n, d in zip(state.view, (2, 4, 4), strict=True))))
    out.append(("t", state.selected))
    for name, (parameter, _, vocab) in SETS.items():
        got = getattr(f, name)
        if got is not None:
            out.append((parameter, ",".join([*(v for v in vocab if v in got), *sorted(got - set(vocab))]) or "none"))
    out += [("rent", "1" if f.rentable else None), ("reg", "1" if f.registered else None), ("state", f.region), ("country", None if f.region else f.country)]
    out += [("mine", ",".join(m for m in MARKS if m in (f.mine or ()))), ("design", f.design), ("mat", f.material), ("ns", "1" if f.no_structure else None), ("ap", None if f.approximate else "0")]
    old = state.base == "old"
    out += [("base", None if state.base == "map" else state.base), ("era", state.era if old and state.era != DEFAULT_ERA else None), ("op", str(state.opacity) if old and state.opacity != DEFAULT_OPACITY else None)]
    out += [("yr", None if state.year is None else str(state.year)), ("yrm", "1" if state.year is not None and state.year_maybe else None)]
    out += [("vs", ",".join(state.sights)), ("vr", str(state.sight_km) if state.sights and state.sight_km else None)]
    return "&".join(f"{k}={quote_plus(v, safe=',/')}" for k, v in out if v)
