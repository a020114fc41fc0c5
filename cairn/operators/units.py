"""One quantity recorded in several units: a hidden Markov model per device tells the unit of every reading.

Hidden state: the unit. A reading's emission weighs what is known of its unit (stated with it, said of its source, implied
by its field's name) and how far its value in that unit lies from the device's level, on the logarithmic scale; staying in
one unit is likelier than switching. Viterbi decodes each device's readings in time order, all devices of a batch at once.
The level is a median, so it needs no smoothing constant; a jump by a unit's factor shows as a switch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairn.functions.quantity import METRES, UNITS, amount, height_in, unit
from cairn.session import plain, whole_groups, written

#: Weight of evidence. What is stated holds against any level or switch, as it is above LEVEL_MOST + 2 * SWITCH; what a source's
#: notes or a field's name say gives way where the level speaks against it and a switch is no dearer.
STATED, NOTED, NAMED = 60.0, 14.0, 10.0
SWITCH, LEVEL_MOST, LEVEL_SIGMA = 2.0, 12.0, 0.08
#: Readings of one device that are decoded in one go; a hotter device is cut by time, and the model's state carried over.
MOST = 4096
_LOG = np.log(np.array([METRES[u] for u in UNITS]))


def _emission(value: np.ndarray, evidence: np.ndarray, weight: np.ndarray, level: np.ndarray | float) -> np.ndarray:
    """Log weight of each reading under each unit."""
    off = np.log(value)[:, None] + _LOG[None, :] - np.reshape(level, (-1, 1))
    against = (evidence[:, None] >= 0) & (evidence[:, None] != np.arange(len(UNITS)))
    return -np.minimum((off / LEVEL_SIGMA) ** 2 / 2, LEVEL_MOST) - np.where(against, weight[:, None], 0.0)


def viterbi(value: np.ndarray, evidence: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """State (number of the unit) of each reading; readings of a device are consecutive, in time order.

    value > 0; evidence: number of the unit the evidence speaks for, -1 for none; weight of the evidence.
    """
    n, k, groups = len(value), len(UNITS), len(lengths)
    state = np.where(evidence >= 0, evidence, 0)
    if not n:
        return state
    first = np.cumsum(lengths) - lengths
    group = np.repeat(np.arange(groups), lengths)
    sure = np.where(evidence >= 0, weight, 0.0)
    for _ in range(2):  # the level from the evidence, then from the decoded units
        log = np.log(value) + _LOG[state]
        # a device's sure readings set its level; without any, all of its readings do
        known = np.bincount(group, sure > 0, groups)[group] > 0
        order = np.lexsort((log, known & (sure <= 0), group))
        count = np.where(known[first], np.bincount(group, sure > 0, groups), lengths).astype(np.int64)
        level = log[order[first + (count - 1) // 2]]
        emit = _emission(value, evidence, weight, level[group])
        best, back = emit.copy(), np.zeros((n, k), np.int8)
        by_length = np.argsort(-lengths, kind="stable")
        longest, ordered = int(lengths.max()), lengths[by_length]
        for step in range(1, longest):
            at = first[by_length[: np.searchsorted(-ordered, -step, side="left")]] + step
            if not len(at):
                break
            before = best[at - 1]
            top = before.argmax(axis=1)
            change = before[np.arange(len(at)), top] - SWITCH
            stay = before >= change[:, None]
            back[at] = np.where(stay, np.arange(k), top[:, None])
            best[at] = emit[at] + np.where(stay, before, change[:, None])
        new = np.zeros(n, np.int64)
        last = first + lengths - 1
        new[last] = best[last].argmax(axis=1)
        for step in range(longest - 1, 0, -1):
            at = first[by_length[: np.searchsorted(-ordered, -step, side="left")]] + step
            new[at - 1] = back[at, new[at]]
        state = new
    return state


def decode(readings: DataFrame, most: int = MOST) -> DataFrame:
    """readings(id, device, ordinal, value, evidence, weight, ...) with `unit` and `metres` of each.

    value must be above 0. device: string; null devices are devices of their own reading. ordinal orders a device's readings (ties by id).
    evidence: a unit's name or null; weight: how much it counts. Other columns come out unchanged. A device with more than
    `most` readings is cut by time: see _decode_long, which gives the same units but for the median, approximate there.
    """
    base = readings.withColumn("device", F.coalesce("device", F.concat(F.lit("\0"), F.col("id").cast("string"))))
    hot = base.groupBy("device").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    rows = (hot.agg(F.sum("_n")).first() or [0])[0] or 0
    schema = StructType([*base.schema.fields]).add("unit", "string").add("metres", "double")
    placed = (base.join(hot.select("device"), "device", "left_anti") if rows else base).repartition("device").sortWithinPartitions("device", "ordinal", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, ("device",)):
            fresh = (b["device"] != b["device"].shift()).to_numpy()
            lengths = np.diff(np.append(np.flatnonzero(fresh), len(b)))
            state = viterbi(b["value"].to_numpy(float), _evidence(b), b["weight"].to_numpy(float), lengths)
            yield _with_unit(b, state)

    short = placed.select(base.columns).mapInPandas(run, schema)
    return short.unionByName(_decode_long(base.join(hot.select("device"), "device"), schema, rows, most)) if rows else short


def _evidence(b: pd.DataFrame) -> np.ndarray:
    return b["evidence"].map({u: i for i, u in enumerate(UNITS)}).fillna(-1).astype(int).to_numpy()


def _with_unit(b: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
    return plain(b.assign(unit=np.array(UNITS, dtype=object)[state], metres=b["value"].to_numpy(float) * np.exp(_LOG[state])))


def _decode_long(readings: DataFrame, schema: StructType, rows: int, most: int) -> DataFrame:
    """decode() of devices with very many readings, each cut by time into segments that tasks decode side by side.

    A segment is summed up as the best score from each first unit to each last one; a device's few segments are then run
    through in order, forwards for the scores at which each begins and backwards for the unit at which each ends; with
    both, every segment decodes as if the device were whole. The level is the device's median, by percentile_approx.
    """
    k = len(UNITS)
    cutup = readings.repartitionByRange(-(-rows // most), "device", "ordinal", "id").withColumn("_part", F.spark_partition_id())
    held = written(cutup)
    names, undecided = schema.names, [*held.columns, "_unit"]
    units = F.array(*map(F.lit, UNITS))
    factor = F.element_at(F.array(*map(F.lit, _LOG.tolist())), F.greatest(F.array_position(units, F.col("_unit")), F.lit(1)).cast("int"))
    sure = F.col("evidence").isNotNull() & (F.col("weight") > 0)
    known = held.withColumn("_unit", F.col("evidence"))
    for last in (False, True):
        log = F.log("value") + factor
        level = known.groupBy("device").agg(F.coalesce(F.percentile_approx(F.when(sure, log), 0.5, 100_000), F.percentile_approx(log, 0.5, 100_000)).alias("_level"))
        levelled = held.join(level, "device")

        def summed(b: pd.DataFrame) -> pd.DataFrame:
            emit = _emission(*_sorted(b))
            best = np.where(np.eye(k, dtype=bool), emit[0][None, :], -np.inf)
            for e in emit[1:]:
                best = e + np.maximum(best, best.max(axis=1, keepdims=True) - SWITCH)
            return pd.DataFrame({"device": b["device"].iloc[:1], "_part": b["_part"].iloc[:1], "best": [best.ravel()]})

        def chained(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("_part", ignore_index=True)
            entry, before = [np.zeros(k)], []
            for best in b["best"]:
                score = (entry[-1][:, None] + np.reshape(best, (k, k))).max(axis=0)
                before.append(score)
                entry.append(np.maximum(score, score.max() - SWITCH))
            ends = [int(before[-1].argmax())]
            for n in range(len(b) - 1, 0, -1):
                first = int((entry[n] + np.reshape(b["best"][n], (k, k))[:, ends[0]]).argmax())
                score = before[n - 1]
                ends.insert(0, first if score[first] >= score.max() - SWITCH else int(score.argmax()))
            return pd.DataFrame({"device": b["device"], "_part": b["_part"], "entry": entry[:-1], "end": ends})

        segments = levelled.groupBy("device", "_part").applyInPandas(summed, "device string, _part int, best array<double>").groupBy("device").applyInPandas(chained, "device string, _part int, entry array<double>, end int")

        def decoded(b: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:  # pickled here, with this round's `last`
            b = b.sort_values(["ordinal", "id"], ignore_index=True)
            emit = _emission(*_sorted(b))
            best, back = emit[0] + np.array(segment["entry"].iloc[0]), np.zeros((len(b), k), np.int8)
            for t in range(1, len(b)):
                top = int(best.argmax())
                change = best[top] - SWITCH
                back[t] = np.where(best >= change, np.arange(k), top)
                best = emit[t] + np.maximum(best, change)
            state = np.zeros(len(b), np.int64)
            state[-1] = segment["end"].iloc[0]
            for t in range(len(b) - 1, 0, -1):
                state[t - 1] = back[t, state[t]]
            out = _with_unit(b, state)
            return out[names] if last else out.rename(columns={"unit": "_unit"})[undecided]

        kind = schema if last else StructType([*held.schema.fields, StructField("_unit", StringType())])
        known = levelled.groupBy("device", "_part").cogroup(segments.groupBy("device", "_part")).applyInPandas(decoded, kind)
    return known


def _sorted(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Values, evidence and weights of a device's readings in order, and its level."""
    b = b.sort_values(["ordinal", "id"])
    return b["value"].to_numpy(float), _evidence(b), b["weight"].to_numpy(float), float(b["_level"].iloc[0])


def payload(extra: Column) -> Column:
    """`extra` as a VARIANT: null if it is missing or broken; a string that holds JSON counts as what it holds."""
    outer = F.try_parse_json(extra)
    return F.when(extra.rlike(r'^\s*"'), F.try_parse_json(F.try_variant_get(outer, "$", "string"))).otherwise(outer)


def _note_unit(notes: Column) -> Column:
    n = F.lower(notes)
    return F.when(n.contains("tens of feet"), "ten_ft").when(n.contains("hundreds of feet"), "hundred_ft").when(n.rlike(r"\b(feet|foot)\b"), "ft").when(n.rlike(r"\bmet(re|er)s?\b"), "m")


def length_readings(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, device, ordinal, quantity, value, evidence, weight): at most one elevation and one height of each record.

    elevation: `elevation_m` if above 0 and at most 20,000, else the text in the payload. height: of the structure, from the
    payload, else from the type. Evidence in this order: a unit stated in the record, the source's notes (elevation_m only),
    the field's own name.
    """
    v = F.col("_v")
    got = lambda path: F.try_variant_get(v, path, "string")
    fields = {"e_unit": "$.elevation_unit", "e_text": "$.elevation_text", "h_ft": "$.height_ft", "h_m": "$.height_m", "h_value": "$.height.value", "h_flat": "$.height", "h_vunit": "$.height.unit", "h_unit": "$.height_unit"}
    notes = sources.groupBy("source").agg(F.max(_note_unit(F.col("notes"))).alias("noted"))
    flat = (
        records.select("record_id", "source", "rec_key", "retrieved_at", "elevation_m", "type_raw", payload(F.col("extra")).alias("_v"))
        .select("record_id", "source", "rec_key", "retrieved_at", "elevation_m", "type_raw", *(got(p).alias(c) for c, p in fields.items()))
        .join(notes, "source", "left")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                text = lambda x: x if isinstance(x, str) else None
                e, source_unit = r.elevation_m, text(r.noted)
                if e is not None and 0 < e <= 20_000:
                    stated = unit(text(r.e_unit))
                    u, w = (stated, STATED) if stated else (source_unit, NOTED) if source_unit else ("m", NAMED)
                    rows.append((r.record_id, "elevation", e, u, w))
                elif (a := amount(text(r.e_text))) and a[0] > 0:
                    u = a[1] or unit(text(r.e_unit))
                    rows.append((r.record_id, "elevation", a[0], u, STATED if u else 0.0))
                for value, stated, named in ((r.h_ft, r.h_unit, "ft"), (r.h_value, r.h_vunit, None), (r.h_flat, r.h_unit, None), (r.h_m, r.h_unit, "m")):
                    if (a := amount(text(value))) and a[0] > 0:
                        u = a[1] or unit(text(stated))
                        rows.append((r.record_id, "height", a[0], u or named, STATED if u else NAMED if named else 0.0))
                        break
                else:
                    if (a := height_in(text(r.type_raw))) and a[0] > 0:
                        rows.append((r.record_id, "height", a[0], a[1], STATED))
            out = pd.DataFrame(rows, columns=["id", "quantity", "value", "evidence", "weight"])
            yield out.merge(b[["record_id", "rec_key", "retrieved_at"]].drop_duplicates("record_id").rename(columns={"record_id": "id", "rec_key": "device", "retrieved_at": "ordinal"}), on="id")[["id", "device", "ordinal", "quantity", "value", "evidence", "weight"]]

    seen = records.schema["retrieved_at"].dataType.simpleString()
    return flat.mapInPandas(run, f"id bigint, device string, ordinal {seen}, quantity string, value double, evidence string, weight double")


def lengths_in_metres(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, quantity, value_m): elevation and height of records in whole metres, rounded half up.

    A record whose value is missing or no number has no row for that quantity. The model's devices are a record key's
    deliveries for one quantity, in the order of their retrieval.
    """
    r = length_readings(records, sources)
    got = decode(r.withColumn("device", F.concat_ws("\1", "device", "quantity")))
    return got.select(F.col("id").alias("record_id"), "quantity", F.floor(F.col("metres") + 0.5).cast("int").alias("value_m"))
