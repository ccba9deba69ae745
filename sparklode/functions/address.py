"""The place that a postal address names, and names out of capitals, as column expressions.

An address is cut at commas and semicolons. The first rule that finds something wins: a part that begins with a city's mark; one that
begins with the mark of another kind of place; one that ends with a kind of place; a part that is a known city; and a district's
name. A place ends where a street, a house or a region begins. Parts with a house's or a street's mark are never places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of cities, of other places, of districts, and of what no place is.
CITY = r"^(г\.?|гор\.|город|city of|c\.)\s+"
PLACE = r"^(с\.|село|пос\.|посёлок|поселок|пгт|рп|дер\.|деревня|ст-ца|станица|хутор|аул|village of|town of)\s+"
SUFFIX = r"\s+(г\.?|город|с\.?|пгт|п\.?|city|town|village)$"
DISTRICT = r"^(г\. ?о\.|городской округ|district of)\s+"
NOT_A_PLACE = r"^(ул\.|улица|пр\.|проспект|пер\.|д\.|дом|кв\.|street|st\.|house|no\.|apt)(\s|$)|(область|край|район|region|county|street|road)$|^[0-9 -]+$"
PLACE_END = r"\s+(ул\.|улица|пр\.|проспект|пер\.|д\.|дом|р-н|район|street|road|house)(\s.*)?$"


def city_of(address: Column, known: Column) -> Column:
    """The place named, in its own case; null if none is. known: an array of city names."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), r"[,;]"), lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).rlike(NOT_A_PLACE))

    def marked(pattern: str) -> Column:
        return F.transform(F.filter(parts, lambda p: F.lower(p).rlike(pattern)), lambda p: F.regexp_replace(p, f"(?iu){pattern}", ""))

    listed = F.filter(parts, lambda p: F.array_contains(F.transform(known, F.lower), F.lower(p)))
    found = F.concat(marked(CITY), marked(PLACE), marked(SUFFIX), listed, marked(DISTRICT))
    return decapitalised(F.get(F.filter(F.transform(found, lambda p: F.trim(F.regexp_replace(p, f"(?iu){PLACE_END}", ""))), lambda p: p != ""), F.lit(0)))


def decapitalised(name: Column) -> Column:
    """A name all in capitals with capitals at the beginnings of its words only, also behind hyphens; other names as they are."""
    shouted = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) > 1)
    words = F.transform(F.split(F.lower(name), " "), lambda w: F.array_join(F.transform(F.split(w, "-"), F.initcap), "-"))
    return F.when(shouted, F.array_join(words, " ")).otherwise(name)
