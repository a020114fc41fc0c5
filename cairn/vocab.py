"""Vocabularies of the domain. Results and the query language depend on them."""

STATUSES = ("standing", "gone", "ruins", "relocated", "replica", "unknown")
#: Kinds of structure, in the order a list offers them.
STRUCTURES = ("tower", "enclosed_tower", "platform", "ground", "two_story", "three_story", "rooftop", "mobile", "unknown")
#: Kinds that are no structure: shown only when asked for.
NO_STRUCTURE = ("camp", "tree", "point")
KINDS = STRUCTURES + NO_STRUCTURE
MATERIALS = ("steel", "wood", "log", "stone", "concrete", "masonry", "mixed")
VERIFICATIONS = ("unverified", "facts", "researched", "verified")
COUNTRIES = ("US", "CA")
MARKS = ("visited", "stayed", "want")
ERAS = ("oldest", "lookouts", "newest")
ERA_YEARS = {"oldest": 1850, "lookouts": 1940, "newest": 2010}
#: Shape of a canonical record's id.
ID = "[a-z]{2}-[a-z0-9]{1,3}-[a-z0-9]+(?:-[a-z0-9]+)*"
ID_LENGTH = 120
#: Events by what they say of the structure's presence.
START_EVENTS = ("built", "rebuilt", "replaced", "moved_in")
END_EVENTS = ("abandoned", "burned", "destroyed", "removed", "relocated", "collapsed")
BUILD_EVENTS = ("built", "rebuilt", "replaced")
FIRST_YEAR, THIS_YEAR = 1800, 2026
