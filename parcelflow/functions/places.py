"""Column expressions that tell where a planning application or a page belongs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.functions import text as T

#: Counties by authority code.
COUNTIES = {
    "CORKCOCO": "Cork", "CORKCITY": "Cork", "KILDARE": "Kildare", "GALWAYCOCO": "Galway", "GALWAYCITY": "Galway", "MEATH": "Meath",
    "WICKLOW": "Wicklow", "LIMERICK": "Limerick", "WATERFORD": "Waterford", "DONEGAL": "Donegal", "WEXFORD": "Wexford",
    "TIPPERARY": "Tipperary", "KERRY": "Kerry", "MAYO": "Mayo", "CLARE": "Clare", "LOUTH": "Louth", "LAOIS": "Laois",
    "KILKENNY": "Kilkenny", "OFFALY": "Offaly", "CAVAN": "Cavan", "ROSCOMMON": "Roscommon", "WESTMEATH": "Westmeath",
    "MONAGHAN": "Monaghan", "SLIGO": "Sligo", "CARLOW": "Carlow", "LONGFORD": "Longford", "LEITRIM": "Leitrim",
}
#: Authorities of the capital, which localities are not derived for but which have a county all the same.
CAPITAL = {"DUBLINCITY": "Dublin", "FINGAL": "Dublin", "SOUTHDUBLIN": "Dublin", "DLR": "Dublin"}
#: Path parts of authorities that are not their code in lower case.
_PATHS = {"CORKCOCO": "cork", "CORKCITY": "cork-city", "DUBLINCITY": "dublin-city", "SOUTHDUBLIN": "south-dublin", "DLR": "dun-laoghaire-rathdown", "GALWAYCOCO": "galway-county", "GALWAYCITY": "galway-city"}
COUNTY_NAMES = sorted({*COUNTIES.values(), *CAPITAL.values()})
#: The path part of every authority.
PATHS = {code: _PATHS.get(code, code.lower()) for code in COUNTIES | CAPITAL}
#: Authorities whose localities come from a list first, and that list.
LISTED_AUTHORITIES = ("CORKCOCO", "CORKCITY")
LISTED = (
    "Newtownshandrum", "Castletownbere", "Watergrasshill", "Courtmacsherry", "Fountainstown", "Carrigtwohill", "Minane Bridge",
    "Passage West", "Ballinhassig", "Ballinspittle", "Ballyvourney", "Little Island", "Mitchelstown", "Ballincollig", "Carrigaline",
    "Castlemartyr", "Crosshaven", "Rosscarbery", "Skibbereen", "Ballygarvan", "Ballylickey", "Newmarket", "Ringaskiddy", "Timoleague",
    "Whitegate", "Ballycotton", "Ballydehob", "Ballineen", "Charleville", "Clonakilty", "Enniskeane", "Innishannon", "Macroom",
    "Millstreet", "Myrtleville", "Shanagarry", "Belgooly", "Buttevant", "Coachford", "Doneraile", "Dunmanway", "Glanworth", "Kilworth",
    "Rathcormac", "Riverstick", "Allihies", "Aghada", "Bandon", "Bantry", "Blarney", "Boherbue", "Cobh", "Cloyne", "Douglas", "Dripsey",
    "Fermoy", "Freemount", "Glanmire", "Goleen", "Kanturk", "Killeagh", "Kinsale", "Leap", "Liscarroll", "Mallow", "Midleton", "Rylane",
    "Schull", "Tower", "Youghal", "Baltimore", "Banteer",
)


def county_of(authority: Column) -> Column:
    """The county of an authority code; null for those that have none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in COUNTIES.items() for x in pair]), authority)


def authority_county(authority: Column) -> Column:
    """The county that an authority code stands for, the capital's four among them; null for unknown codes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in (COUNTIES | CAPITAL).items() for x in pair]), authority)


def authority_slug(authority: Column) -> Column:
    """The path part of an authority code; null for unknown codes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PATHS.items() for x in pair]), authority)


def authority_of_slug(value: Column) -> Column:
    """The authority code of a path part; null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for code, part in PATHS.items() for x in (part, code)]), value)


def county_authorities(county: Column) -> Column:
    """The authority codes of a county, whatever its case and accents; empty for unknown ones."""
    by_county: dict[str, list[str]] = {}
    for code, name in (COUNTIES | CAPITAL).items():
        by_county.setdefault(name.lower(), []).append(code)
    pairs = [x for name, codes in by_county.items() for x in (F.lit(name), F.array(*map(F.lit, sorted(codes))))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), T.slug(county)), F.array().cast("array<string>"))


def locality(location: Column, ward: Column, authority: Column) -> Column:
    """The locality of an application.

    A listed name within the location, for authorities with a list; else the last comma part that is no
    number, once postcode and county are gone; else the ward without its prefix; else null.
    """
    named = F.regexp_extract(F.coalesce(location, F.lit("")), rf"(?i)\b({'|'.join(LISTED)})\b", 1)
    listed = F.when(authority.isin(*LISTED_AUTHORITIES) & (named != ""), F.initcap(named))
    plain = F.regexp_replace(F.coalesce(T.squeeze(location), F.lit("")), r"(?i)\b[A-Z][0-9]{2}\s?[A-Z0-9]{4}\b", "")
    county, bare = county_of(authority), plain
    for before, after in ((r"(?i)\bcounty\s+", r"\b\.?"), (r"(?i)\bco\.?\s*", r"\b\.?"), (r"(?i),\s*", r"\.?\s*$")):
        bare = F.regexp_replace(bare, F.concat(F.lit(before), county, F.lit(after)), F.lit(""))
    cleaned = F.coalesce(bare, plain)  # without a county there is no pattern, hence null
    parts = F.transform(F.split(cleaned, ","), lambda p: F.regexp_replace(p, r"^[\s.]+|[\s.]+$", ""))
    last = F.try_element_at(F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^\d+$")), F.lit(-1))
    of_ward = F.nullif(F.btrim(F.regexp_replace(F.coalesce(ward, F.lit("")), r"(?i)^(The\s+)?Municipal\s+District(s|\s+of)?\s*:\s*", "")), F.lit(""))
    return F.coalesce(listed, last, of_ward)


def contains_name(location: Column, name: Column) -> Column:
    """Whether a location has the name as whole tokens, whatever the case and blanks; false for nulls and empty names."""
    where, needle = F.lower(T.squeeze(location)), F.lower(T.squeeze(name))
    literal = F.regexp_replace(needle, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.coalesce(F.regexp_like(where, F.concat(F.lit("(^|[^a-z0-9])"), literal, F.lit("(?=$|[^a-z0-9])"))), F.lit(False))


def in_market(location: Column, name: Column, rivals: Column) -> Column:
    """Whether a location has the market's name and none of the rivals' (an array of names)."""
    return contains_name(location, name) & ~F.exists(F.coalesce(rivals, F.array().cast("array<string>")), lambda r: contains_name(location, r))


def is_specific(name: Column, county: Column) -> Column:
    """Whether a locality says more than its county."""
    own = T.slug(F.coalesce(name, F.lit("")))
    return F.coalesce((F.length(own) >= 3) & (own != T.slug(F.coalesce(county, F.lit("")))), F.lit(False))


def page_surface(url: Column) -> Column:
    """`sold` or `planning` for a locality page of either surface, else null."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*|[?#].*$", ""), "/$", "")
    return F.when(path.rlike("^/sold-prices/[^/]+/[^/]+$"), "sold").when(path.rlike("^/planning/[^/]+/areas/[^/]+$"), "planning")


def place_score(rows: Column, recent: Column) -> Column:
    """Twenty for each e-fold of rows, thirty more where the last one is recent."""
    return F.log(F.greatest(rows, F.lit(1)).cast("double")) * 20 + F.when(recent, 30).otherwise(0)
