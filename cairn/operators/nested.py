"""Nested source records as flat tables whose rows name their record and their parent.

Typed nesting (events, registers, rental) is unnested by Spark itself. The open `extra` payload is text: batches of it go
through a structural index (functions.jsonindex), from whose spans linked rows are made. Broken payloads hold nothing.
All tables are one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.jsonindex import SCALAR, STRING, JsonIndex
from cairn.session import plain

LINK = "record_id bigint, child string, pos int, sub_pos int"


def _list(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array())


def _link(child: str, pos: Column, sub: Column) -> Column:
    return F.struct(F.lit(child).alias("child"), pos.cast("int").alias("pos"), sub.cast("int").alias("sub_pos"))


def typed_links(df: DataFrame, key: str = "record_id") -> DataFrame:
    """(record_id, child, pos, sub_pos) of registers, events, their urls, rentals and their rules; null elements give no row."""
    none, zero = F.lit(-1), F.lit(0)
    links = F.concat(
        F.transform(_list("registers"), lambda x, i: F.when(x.isNotNull(), _link("register", i, none))),
        F.transform(_list("events"), lambda x, i: F.when(x.isNotNull(), _link("event", i, none))),
        F.flatten(F.transform(_list("events"), lambda x, i: F.transform(_list(x.source_urls), lambda u, j: F.when(u.isNotNull(), _link("event_url", i, j))))),
        F.array(F.when(F.col("rental").isNotNull(), _link("rental", zero, none))),
        F.transform(_list("rental.rules"), lambda x, j: F.when(x.isNotNull(), _link("rental_rule", zero, j))),
    )
    return df.select(F.col(key).alias("record_id"), F.inline(F.filter(links, lambda x: x.isNotNull())))


def _json_rows(df: DataFrame, key: str, column: str, make: Callable[[JsonIndex, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    text = [c.split()[0] for c in schema.split(", ") if c.endswith(" string")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            for frame in make(JsonIndex(b["payload"].tolist()), ids):
                if len(frame):
                    yield plain(frame, text)

    return df.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).alias("payload")).mapInPandas(run, schema)


def _reports(index: JsonIndex) -> np.ndarray:
    found, _ = index.elements(index.at_key(index.root(), "reports"))
    found = found[~index.null(found)]
    return np.sort(found)


def _cites(index: JsonIndex, reports: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cite token, token of its report)"""
    values = index.at_key(reports, "cites")
    cites, of = index.elements(values)
    keep = ~index.null(cites)
    return cites[keep], index.parent[values][of[keep]]


def json_links(df: DataFrame, key: str = "record_id", column: str = "extra") -> DataFrame:
    """(record_id, child, pos, sub_pos) of the reports in `extra` and of their cites; a lone object or number has place 0."""

    def make(index: JsonIndex, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        reports = _reports(index)
        cites, of = _cites(index, reports)
        yield pd.DataFrame({"record_id": ids[index.text[reports]], "child": "report", "pos": index.position(reports), "sub_pos": -1})
        yield pd.DataFrame({"record_id": ids[index.text[cites]], "child": "report_cite", "pos": index.position(of), "sub_pos": index.position(cites)})

    return _json_rows(df, key, column, make, LINK)


def linked_children(df: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per nested child of a record. A null list, a null element and a broken payload give none; repeated records
    give their rows again; an empty table gives an empty one."""
    return typed_links(df, key).unionByName(json_links(df, key))


def _child(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(F.col(key).alias("record_id"), F.posexplode(column).alias("pos", "x")).where("x is not null").select("record_id", "pos", "x.*")


def registers(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Register entries with record and place."""
    return _child(df, key, "registers")


def events(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Dated events with record and place."""
    return _child(df, key, "events").drop("source_urls")


def event_urls(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Urls of events: record, place of the event, place in its list."""
    return df.select(F.col(key).alias("record_id"), F.posexplode("events").alias("pos", "x")).select("record_id", "pos", F.posexplode("x.source_urls").alias("sub_pos", "url")).where("url is not null")


def rentals(df: DataFrame, key: str = "record_id") -> DataFrame:
    """The rental of a record, its rules left out."""
    return df.where("rental is not null").select(F.col(key).alias("record_id"), "rental.*").drop("rules")


def rental_rules(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Rules of rentals with record and place."""
    return df.select(F.col(key).alias("record_id"), F.posexplode("rental.rules").alias("sub_pos", "rule")).where("rule is not null")


def _field(index: JsonIndex, objects: np.ndarray, name: str) -> list[str | None]:
    """The scalar at a key of each object as text, None without one."""
    at = index.at_key(objects, name)
    by = {int(index.parent[t]): index.scalar(t) if index.kind[t] in (STRING, SCALAR) else index.raw(t) for t in at}
    got = [by.get(int(o)) for o in objects]
    return [None if v is None else v if isinstance(v, str) else str(v) for v in got]


def reports(df: DataFrame, key: str = "record_id", column: str = "extra") -> DataFrame:
    """Reports in `extra`: record, place, title, year."""

    def make(index: JsonIndex, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        r = _reports(index)
        yield pd.DataFrame({"record_id": ids[index.text[r]], "pos": index.position(r), "title": _field(index, r, "title"), "year": _field(index, r, "year")})

    return _json_rows(df, key, column, make, "record_id bigint, pos int, title string, year string")


def cites(df: DataFrame, key: str = "record_id", column: str = "extra") -> DataFrame:
    """Cites of reports: record, place of the report, place in its list, page and quote (a lone number is its page)."""

    def make(index: JsonIndex, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        c, of = _cites(index, _reports(index))
        page = [index.raw(t) if k == SCALAR else p for t, k, p in zip(c, index.kind[c], _field(index, c, "page"), strict=True)]
        yield pd.DataFrame({"record_id": ids[index.text[c]], "pos": index.position(of), "sub_pos": index.position(c), "page": page, "quote": _field(index, c, "quote")})

    return _json_rows(df, key, column, make, "record_id bigint, pos int, sub_pos int, page string, quote string")
