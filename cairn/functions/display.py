"""Values as pages write them, as Columns. Halves round up, as pages do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.geo import wrap360

FOOT, MILE = 0.3048, 1609.344
#: Metres to the floor by kind of structure; towers by side of the longitude; the eye above the floor.
EYE, EAST_OF, EAST_FLOOR, WEST_FLOOR = 1.6, -100.0, 20.0, 9.1
FLOORS = {"ground": 0.9, "two_story": 4.4, "three_story": 7.4, "mobile": 0.9, "rooftop": 4.4, "tree": 15.0, "camp": 0.0, "point": 0.0}
#: haze's distance and most; steps of an axis.
HAZE_M, HAZE_MOST = 42_000.0, 0.9
STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def whole(x: Column) -> Column:
    return F.floor(x + 0.5)


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def length_text(country: Column, metres: Column) -> Column:
    """Feet first in the US, metres first elsewhere; null for no number."""
    feet, m = F.concat(count_text(whole(metres / FOOT)), F.lit(" ft")), F.concat(count_text(whole(metres)), F.lit(" m"))
    both = lambda a, b: F.concat(a, F.lit(" ("), b, F.lit(")"))
    return F.when(metres.isNull() | F.isnan(metres), None).when(F.coalesce(country, F.lit("US")) == "US", both(feet, m)).otherwise(both(m, feet))


def coords_text(lat: Column, lon: Column) -> Column:
    """With real minus signs."""
    return F.replace(F.concat(_fixed(lat, 5), F.lit(", "), _fixed(lon, 5)), F.lit("-"), F.lit("−"))


def date_text(iso: Column) -> Column:
    """3 Oct 2026; what is no date as it is, null for none."""
    part = lambda i: F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})", i)
    month = F.coalesce(F.try_element_at(F.array(*map(F.lit, MONTHS)), F.nullif(part(2), F.lit("00")).cast("int")), part(2))
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat_ws(" ", part(3).cast("int").cast("string"), month, part(1))).when(iso != "", iso)


def distance_text(metres: Column) -> Column:
    """820 m, or 2.4 km (1.5 mi)."""
    tens = whole(metres / 10) * 10
    near = F.concat(count_text(F.when(tens == 0, whole(metres)).otherwise(tens)), F.lit(" m"))
    far = lambda x: F.when(x < 10, _fixed(x, 1)).otherwise(_fixed(x, 0))
    return F.when(metres < 1000, near).otherwise(F.concat(far(metres / 1000), F.lit(" km ("), far(metres / MILE), F.lit(" mi)")))


def azimuth_text(degrees: Column) -> Column:
    """045°"""
    return F.concat(F.lpad(wrap360(whole(degrees)).cast("int").cast("string"), 3, "0"), F.lit("°"))


def quadrant(degrees: Column) -> Column:
    """N 45° E as surveyors say it, in whole degrees; due north and so on."""
    a = wrap360(whole(degrees)).cast("int")
    due = F.when(a == 0, "due north").when(a == 90, "due east").when(a == 180, "due south").when(a == 270, "due west")
    text = lambda ns, x, ew: F.concat(F.lit(f"{ns} "), x.cast("string"), F.lit(f"° {ew}"))
    return F.coalesce(due, F.when(a < 90, text("N", a, "E")).when(a < 180, text("S", 180 - a, "E")).when(a < 270, text("S", a - 180, "W")).otherwise(text("N", 360 - a, "W")))


def half_degree(degrees: Column) -> Column:
    return F.pmod(whole(degrees * 2) / 2, F.lit(360.0))


def floor_m(kind: Column, lon: Column) -> Column:
    """Typical height of the floor for a kind of structure."""
    out = F.lit(None).cast("double")
    for k, m in FLOORS.items():
        out = F.when(kind == k, m).otherwise(out)
    return F.coalesce(out, F.when(lon > EAST_OF, EAST_FLOOR).otherwise(WEST_FLOOR))


def eye_m(kind: Column, height_m: Column, lon: Column) -> Column:
    """Height of the eye: the recorded floor, else a typical one, and the eye above it."""
    return F.coalesce(F.when(height_m > 0, height_m), floor_m(kind, lon)) + EYE


def haze(metres: Column) -> Column:
    return F.least(F.lit(HAZE_MOST), 1 - F.exp(-metres / HAZE_M))


def axis_max(value: Column) -> Column:
    """The next of 1, 1.5, 2 ... 10 times a power of ten that isn't below; 10 for nothing."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    fits = F.filter(F.transform(F.array(*map(F.lit, STEPS)), lambda s: s * step), lambda x: x >= value)
    return F.when(value <= 0, 10.0).otherwise(F.coalesce(F.get(fits, F.lit(0)), 10 * step))


def year_position(year: Column, first: Column, last: Column) -> Column:
    """Per cent along a line of years."""
    return F.when(last <= first, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (year - first) / (last - first) * 100)))
