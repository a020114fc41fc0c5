"""Facts that texts of rentals, registers and stories state, as Columns. What a text doesn't state is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import sentences

#: Number words, and patterns of the phrases that count.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
YEAR_ROUND = r"(?i)available\s+for\s+(?:rent|rental|reservations?)\s+year[- ]round"
SEASON = (
    r"(?i)\b(?:is\s+)?(?:typically\s+|normally\s+|generally\s+|usually\s+)?(?:open|available\s+(?:for|as)?\s*(?:rent|rental|renting|reservations?))\s+(?:from\s+|for\s+)?"
    r"([A-Za-z][A-Za-z0-9,.\-– ]{2,60}?(?:through|thru|to|[-–])\s*[A-Za-z0-9][A-Za-z0-9,.\- ]{1,40}?)(?:[.;]|,\s+(?:however|depending|although)|\s+\()"
)
SLEEPS = r"(?i)(?:sleep[s]?|accommodate[s]?)\s+(?:up\s+to\s+)?(\w+)\s+(?:people|guests|person)"
PERSONS = r"(?i)\b(\d{1,2})[- ](?:person|people|guest)"
PETS = {
    "Not allowed": r"(?i)absolutely no pets|no pets (?:are )?allowed|pets (?:are )?not (?:permitted|allowed)",
    "Allowed on leash": r"(?i)pets? (?:must be |are )?(?:kept )?(?:on (?:a )?leash|leashed)",
    "Service animals only": r"(?i)service animals? only",
    "Allowed": r"(?i)pets? (?:are )?(?:welcome|allowed|permitted)",
}
ELEVATION = r"(?i)(?:elevation of|altitude of|elevation:?)\s*([\d,]{3,6})\s*(?:feet|ft\.?|')"
ELEVATION_AT = r"(?i)\bat\s+([\d,]{4,6})\s*feet\b"
BUILT = r"(?i)(?:was\s+)?(?:built|constructed|erected)\s+(?:in|during(?:\s+the\s+summer\s+of)?)\s+(\d{4})"
OPENED = r"(?i)opened\s+(?:to the public\s+)?for\s+(?:overnight\s+)?rental\s+in\s+(\d{4})"
RULES = {
    "Pack out all trash": r"(?i)pack out (?:their |all )?trash|must pack out",
    "No water or electricity on site": r"(?i)no water (?:or|and) electricity|no water, no electricity",
    "Clean the cabin before leaving": r"(?i)clean the cabin before (?:they )?(?:leav|check)",
    "No open fires / campfires not allowed": r"(?i)no open fires|campfires? (?:are )?not (?:permitted|allowed)",
    "No generators": r"(?i)generators? (?:are )?not (?:permitted|allowed)",
    "No smoking": r"(?i)no smoking",
    "Quiet hours observed": r"(?i)quiet hours",
    "Not ADA accessible": r"(?i)not (?:wheelchair|ADA) accessible",
}
ACCESS = r"(?i)(?:access(?:ed|ible)? (?:by|via)|accessed by|drive directly|high[- ]clearance|four[- ]wheel drive|4wd|4-wheel drive|must (?:hike|ski|snowshoe|snowmobile)|hiking, horseback|not plowed or maintained)"
YEAR, DECADE, CIRCA = r"\b(1[89]\d{2}|20\d{2})\b", r"(?i)\b(1[89]\d0|20\d0)'?s\b", r"(?i)\bcirca\b"
FIRE, DESTROYED = r"(?i)\bfires?\b|\bwildfires?\b|\bburn(?:ed|t)?\b|\barson\b", r"(?i)\beruptions?\b|\bcollapsed\b|\bdestroyed\b|\bdemolished\b"
CLOSURE, MANAGED = r"(?i)closure|closed|unavailable|not available|temporarily", r"(?i)^managed\s+by\s+(.+)$"
DEFINITION, URL, ACCESSED = r"(?md)^\[\^(\d{1,9})\]:[ \t]*(\S.*)$", r"https?://(?:[^\s()<>]|\([^\s()<>]*\))+", r"(?i)(?:accessed|consult[eé]e?(?:\s+le)?)\s+(\d{4}-\d{2}-\d{2})"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def season(text: Column) -> Column:
    """When it is open: `Year-round`, or the range as written."""
    span = F.regexp_replace(F.trim(F.regexp_replace(_first(text, SEASON), r"\s+", " ")), ",+$", "")
    return F.when(text.rlike(YEAR_ROUND), "Year-round").otherwise(span)


def occupancy(text: Column) -> Column:
    """How many it sleeps, in digits or a word up to twelve."""
    word = F.lower(_first(text, SLEEPS))
    digits = F.when(word.rlike(r"^\d{1,9}$"), word.cast("int"))
    spelled = F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), word).cast("int"), F.lit(0))
    return F.coalesce(F.nullif(digits, F.lit(0)), spelled, _first(text, PERSONS).cast("int"))


def pets(text: Column) -> Column:
    """The first of the wordings on pets that fits."""
    return F.coalesce(*[F.when(text.rlike(p), label) for label, p in PETS.items()])


def elevation_ft(text: Column) -> Column:
    """Feet of altitude; digits with or without commas."""
    number = lambda p: F.nullif(F.replace(_first(text, p), F.lit(","), F.lit("")), F.lit("")).cast("double")
    return F.when(_first(text, ELEVATION).isNotNull(), number(ELEVATION)).otherwise(number(ELEVATION_AT))


def built_year(text: Column) -> Column:
    """The last year of building."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(BUILT), F.lit(1)), F.lit(-1)).cast("int")


def opened_year(text: Column) -> Column:
    return _first(text, OPENED).cast("int")


def rules(text: Column) -> Column:
    """House rules in the order of the sentences; each sentence gives the first rule it states that isn't there yet."""
    labels = F.array(*map(F.lit, RULES))

    def step(have: Column, sentence: Column) -> Column:
        fresh = F.filter(labels, lambda label: ~F.array_contains(have, label) & _states(sentence, label))
        return F.concat(have, F.slice(fresh, 1, 1))

    return F.aggregate(sentences(text), F.array().cast("array<string>"), step)


def _states(sentence: Column, label: Column) -> Column:
    out = F.lit(False)
    for name, pattern in RULES.items():
        out = out | ((label == name) & sentence.rlike(pattern))
    return out


def access_note(text: Column) -> Column:
    """The first sentence that says how to get there."""
    return F.trim(F.get(F.filter(sentences(text), lambda s: s.rlike(ACCESS)), F.lit(0)))


def removed_event(text: Column, source: Column) -> Column:
    """STRUCT(year, event, note, from_source) of a register's field on a removal, null without a year: of several years the last; a decade or circa is about."""
    numbers = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda y: y.cast("int"))
    year = F.coalesce(F.array_max(numbers(YEAR)), F.array_max(numbers(DECADE)))
    event = F.when(text.rlike(FIRE), "burned").when(text.rlike(DESTROYED), "destroyed").otherwise("removed")
    about = F.when(text.rlike(CIRCA) | text.rlike(DECADE), F.concat(F.lit(" (about "), year.cast("string"), F.lit(")."))).otherwise(".")
    note = F.concat(F.lit("'Removed' field on "), F.upper(source), F.lit(' detail page: "'), F.trim(text), F.lit('"'), about)
    return F.when(year.isNotNull(), F.struct(year.alias("year"), event.alias("event"), note.alias("note"), source.alias("from_source")))


def bracket_notes(text: Column) -> Column:
    """STRUCT(status_note, manager, notes) of what stands in round brackets: the last closure, the last manager, all that hold a letter."""
    cleaned = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"\s+", " "), r"([A-Za-z])(\d{4})\b", "$1 $2")))
    notes = F.filter(cleaned, lambda n: n.rlike("[A-Za-z]"))
    by = F.try_element_at(F.filter(notes, lambda n: n.rlike(MANAGED)), F.lit(-1))
    closed = F.try_element_at(F.filter(notes, lambda n: n.rlike(CLOSURE) & ~n.rlike(MANAGED)), F.lit(-1))
    return F.struct(closed.alias("status_note"), F.regexp_replace(F.trim(F.regexp_extract(by, MANAGED, 1)), r"\.+$", "").alias("manager"), notes.alias("notes"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def facility_number(url: Column) -> Column:
    """The number of a facility in a booking link."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(host(url) == "recreation.gov", _first(path, r"/(?:camping/campgrounds|camping/campsites|permits|tour)/(\d+)"))


def footnote_sources(text: Column) -> Column:
    """ARRAY<STRUCT(n, title, publisher, url, accessed)> of a text's footnotes in order; brackets in a url must be balanced."""
    whole = F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(0))

    def source(line: Column) -> Column:
        said = F.rtrim(F.regexp_extract(line, DEFINITION, 2))
        title = F.regexp_replace(F.trim(F.substring_index(F.substring_index(said, ", http", 1), " http", 1)), ",+$", "")
        parts = F.transform(F.split(title, ","), lambda p: F.trim(p))
        url = F.regexp_replace(F.nullif(F.regexp_extract(said, URL, 0), F.lit("")), "[.,;]+$", "")
        publisher = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ", "))
        return F.struct(F.regexp_extract(line, DEFINITION, 1).cast("int").alias("n"), parts[0].alias("title"), publisher.alias("publisher"), url.alias("url"), _first(said, ACCESSED).alias("accessed"))

    return F.transform(whole, source)


def cites(text: Column) -> Column:
    """Numbers of the sources a claim names, as typed: a number, a list, or text around them."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,9})"), F.lit(1)), lambda n: n.cast("int"))


def leading_number(text: Column) -> Column:
    return _first(text, r"^\s*(-?\d{1,15}(?:\.\d+)?)").cast("double")


def four_digit_year(text: Column) -> Column:
    return _first(text, r"^(\d{4})").cast("int")


def epoch_year(millis: Column) -> Column:
    return F.year(F.timestamp_millis(millis))
