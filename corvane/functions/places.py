"""Countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country names as sources write them, with their ISO codes.
COUNTRY_CODES = {
    "united states": "US", "usa": "US", "us": "US", "united states of america": "US", "united kingdom": "GB", "uk": "GB",
    "germany": "DE", "france": "FR", "france, metropolitan": "FR", "singapore": "SG", "canada": "CA", "south korea": "KR",
    "india": "IN", "australia": "AU", "netherlands": "NL", "switzerland": "CH", "china": "CN", "japan": "JP", "sweden": "SE",
    "philippines": "PH", "ireland": "IE", "united arab emirates": "AE", "italy": "IT", "brazil": "BR", "spain": "ES", "morocco": "MA",
    "mexico": "MX", "portugal": "PT", "poland": "PL", "israel": "IL", "south africa": "ZA", "belgium": "BE", "hong kong": "HK",
    "taiwan": "TW", "argentina": "AR", "serbia": "RS", "malaysia": "MY", "new zealand": "NZ", "vietnam": "VN", "ghana": "GH", "egypt": "EG",
    "slovakia": "SK", "colombia": "CO", "turkey": "TR", "nigeria": "NG", "kenya": "KE", "saudi arabia": "SA", "kuwait": "KW",
    "el salvador": "SV", "bangladesh": "BD", "hungary": "HU", "ukraine": "UA", "guatemala": "GT", "lithuania": "LT", "uganda": "UG",
    "norway": "NO", "indonesia": "ID", "costa rica": "CR", "finland": "FI", "romania": "RO", "qatar": "QA", "czechia": "CZ", "peru": "PE",
    "iceland": "IS", "croatia": "HR", "venezuela": "VE", "panama": "PA", "estonia": "EE", "denmark": "DK", "bulgaria": "BG", "gibraltar": "GI",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def country_of_name(name: Column) -> Column:
    """ISO code of a written name; a name that isn't known stays unknown."""
    return lookup(COUNTRY_CODES, F.lower(F.trim(name)))


def country_of_code(code: Column) -> Column:
    """A source's own code in upper case, null if blank."""
    return F.upper(F.nullif(F.trim(code), F.lit("")))
