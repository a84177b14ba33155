"""Free spellings of maneuvers and headings brought to their four names each.

Everything is a column expression, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the names of the reference's enumerations
MANEUVERS = ("steady", "pitch", "roll", "yaw")
HEADINGS = ("N", "E", "S", "W")
WORDS = {"N": "NORTH", "E": "EAST", "S": "SOUTH", "W": "WEST"}


def maneuver_name(raw: Column) -> Column:
    """The maneuver a spelling stands for, or null.

    Case, blanks, digits, punctuation and the additions "maneuver" and "leg"
    don't matter; what remains may differ from a name by one edit: a letter
    missing, added, changed, or two neighbouring letters swapped.
    """
    word = F.regexp_replace(F.regexp_replace(F.lower(raw), "maneuver|leg", ""), "[^a-z]", "")
    near = F.lit(None).cast("string")
    for name in reversed(MANEUVERS):
        swapped = F.lit(False)
        for i in range(len(name) - 1):
            swapped = swapped | (word == name[:i] + name[i + 1] + name[i] + name[i + 2 :])
        near = F.when((F.levenshtein(word, F.lit(name)) <= 1) | swapped, name).otherwise(near)
    return F.when(word.isin(*MANEUVERS), word).otherwise(near)


def heading_name(raw: Column) -> Column:
    """The cardinal heading a letter, word or number of degrees stands for, or
    null.  Degrees go to the nearest cardinal; on a tie the earlier of N, E, S,
    W wins.  Intermediate points (NE, SSW) name none of the four."""
    text = F.upper(F.regexp_replace(raw, r"[\s .()]+$|^[\s .()]+", ""))
    word = F.regexp_replace(text, "(BOUND|ERN|WARDS?)$", "")
    number = F.regexp_extract(text, r"^([+-]?[0-9]+(?:\.[0-9]*)?)\s*(?:°|DEG(?:REES?)?\.?)?$", 1)
    degrees = F.pmod(F.when(number != "", number.cast("double")), F.lit(360.0))
    cardinal = (
        F.when((degrees <= 45) | (degrees >= 315), "N").when(degrees <= 135, "E").when(degrees <= 225, "S").when(degrees < 315, "W")
    )
    spelt = F.lit(None).cast("string")
    for letter in HEADINGS:
        spelt = F.when(word.isin(letter, WORDS[letter]), letter).otherwise(spelt)
    return F.coalesce(spelt, cardinal)
