"""Source addresses as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = r"(?i)^(utm_[^=]*|gclid|fbclid)(=|$)"


def _encoded(text: Column) -> Column:
    """A part of a parameter decoded, if it can be, and encoded anew; letters, digits and `_.-~` stay, a blank is a plus."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(text), text)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _parameter(p: Column) -> Column:
    """name=value in one way of writing; a name alone has an empty value."""
    return F.concat(_encoded(F.substring_index(p, "=", 1)), F.lit("="), _encoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")))


def normalize_url(c: Column | str) -> Column:
    """An address with scheme and host in lower case, without fragment, closing slashes and tracking parameters; the other
    parameters keep their order, blank ones too, and are written in one way of percent-encoding. Null gives an empty text."""
    c = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    bare = F.regexp_replace(c, r"(?s)#.*$", "")
    base = F.regexp_extract(bare, r"(?s)^([^?]*)", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.regexp_replace(F.substr(base, F.length(host) + 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), _parameter), "&")
    return F.concat(F.lower(host), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def launch_id(provider: Column, day: Column, url: Column) -> Column:
    """The identity of an announcement: a hash of the compact JSON array of provider, ISO date and address."""
    return F.concat(F.lit("launch_"), F.substring(F.sha2(F.to_json(F.array(provider, F.date_format(day, "yyyy-MM-dd"), url)), 256), 1, 20))
