"""States, provinces and territories, and the local units below them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import fold

#: Codes and English names.
US = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "PR": "Puerto Rico", "VI": "U.S. Virgin Islands", "GU": "Guam", "AS": "American Samoa", "MP": "Northern Mariana Islands", "DC": "District of Columbia",
}
CANADA = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut",
    "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
FRENCH = {
    "BC": "Colombie-Britannique", "NB": "Nouveau-Brunswick", "NL": "Terre-Neuve-et-Labrador", "NS": "Nouvelle-Écosse", "NT": "Territoires du Nord-Ouest", "PE": "Île-du-Prince-Édouard", "QC": "Québec",
}
COUNTRY_NAMES = {"US": "United States", "CA": "Canada"}
#: Words for the kind of a unit, dropped before units are compared.
UNIT_WORDS = (
    "regional district of|regional district|rd|district municipality of|district municipality|district of|district|united counties of|united counties|regional municipality of|regional municipality|"
    "rural municipality of|rural municipality|rm of|municipal district of|municipal district|mrc de|mrc d|mrc|unorganized|unorganised|county of|county|counties|parish|borough|census area|municipality|co"
)
#: Alaska's census areas; its other units are boroughs.
CENSUS_AREAS = (
    "aleutians west", "bethel", "chugach", "copper river", "dillingham", "hoonah-angoon", "kusilvak", "nome", "prince of wales-hyder", "southeast fairbanks", "yukon-koyukuk", "valdez-cordova",
    "wade hampton", "skagway-hoonah-angoon", "wrangell-petersburg", "prince of wales-outer ketchikan",
)

_ALL = US | CANADA


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def country_of(code: Column) -> Column:
    """US or CA for a region's code in any case, null for another."""
    c = F.upper(code)
    return F.when(c.isin(*US), "US").when(c.isin(*CANADA), "CA")


def region_name(code: Column) -> Column:
    """English name of a code; the code itself if it is none, '' for null."""
    return F.coalesce(_look_up(_ALL, F.upper(code)), code, F.lit(""))


def region_with_country(code: Column) -> Column:
    """The name, with the country behind it outside the US."""
    return F.when(country_of(code) == "CA", F.concat(region_name(code), F.lit(", Canada"))).otherwise(region_name(code))


def parse_region(text: Column, country: Column | None = None) -> Column:
    """The code of a region's code or English or French name, null if it is none, or one of another country than the one given."""
    names = {n: c for c, n in _ALL.items()} | {n: c for c, n in FRENCH.items()}
    plain = {"".join(_bare(n)): c for n, c in names.items()}
    t = F.trim(fold(text), F.lit(" .,"))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(t, r"\.", ""), "-", " "))
    short = F.upper(F.regexp_replace(t, r"[. ]", ""))
    code = F.when((F.length(t) == 2) | t.rlike(r"^[a-z]\. ?[a-z]$"), F.when(short.isin(*_ALL), short)).otherwise(_look_up(plain, spaced))
    return code if country is None else F.when(country.isNull() | (country_of(code) == F.upper(country)), code)


def _bare(name: str) -> str:
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return t.replace(".", "").replace("-", " ")


def id_prefix(country: Column, region: Column) -> Column:
    """us-or, ca-on; xx for a missing region."""
    return F.concat_ws("-", F.lower(F.coalesce(country, country_of(region), F.lit("US"))), F.lower(F.coalesce(region, F.lit("xx"))))


def id_folder(tower: Column) -> Column:
    """The folder of an id: the region's part of a US id, country and region of another, xx for what is no id."""
    parts = F.split(tower, "-")
    return F.when(F.size(parts) < 2, "xx").when(parts[0] == "us", parts[1]).when(tower.isNotNull(), F.concat_ws("-", parts[0], parts[1]))


def unit_key(unit: Column) -> Column:
    """A local unit as it is compared: without accents, case, the words for its kind and anything but letters and digits."""
    u = F.regexp_replace(F.replace(fold(unit), F.lit("’"), F.lit("'")), rf"\b({UNIT_WORDS})\b\.?", " ")
    u = F.regexp_replace(F.regexp_replace(u, r"\bste\b\.?", "sainte"), r"\bst\b\.?", "saint")
    return F.nullif(F.regexp_replace(u, "[^a-z0-9]+", ""), F.lit(""))


def unit_label(country: Column, region: Column, county: Column) -> Column:
    """A local unit as a page writes it: with County, Parish, Borough or Census Area in the US, as it is elsewhere; null for none."""
    c, reg = F.trim(county), F.upper(F.coalesce(region, F.lit("")))
    kind = F.when(reg == "LA", "Parish").when(reg == "AK", F.when(fold(c).isin(*CENSUS_AREAS), "Census Area").otherwise("Borough")).otherwise("County")
    named = c.rlike(r"(?i)\b(County|Parish|Borough|Census Area|Municipality|City)$") | c.contains("/")
    foreign = F.upper(F.coalesce(country, country_of(region), F.lit("US"))) != "US"
    return F.when(c != "", F.when(foreign | named, c).otherwise(F.concat(c, F.lit(" "), kind)))
