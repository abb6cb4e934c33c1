"""Where a posting can be worked from: eligibility and preference tiers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that tell places, all without regard to case.
US_SIGNAL = (
    r"\b(?:A[LKZR]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\b"
    r"|\bUSA?\b|\bU\.S\.A?\.?|United States|\bD\.C\."
    r"|Worldwide|\bAnywhere\b|North(?:ern)? America|\bAmericas\b"
)
CANADA_PREFIX = r"^\s*CA-"
FOREIGN_SIGNAL = (
    r"\b(?:UK|United Kingdom|England|Scotland|Ireland|IE|Australia|Japan|India|Germany|DEU|France|Spain|Italy|Netherlands|Belgium|Sweden|SE"
    r"|Norway|Denmark|Finland|Poland|Switzerland|CH|Austria|Portugal|Greece|Turkey|Israel|UAE|Kenya|Nigeria|Egypt|Singapore|Taiwan|China|Hong Kong"
    r"|South Korea|Korea|Indonesia|Malaysia|Thailand|Vietnam|Philippines|Brazil|Argentina|Chile|Colombia|Mexico|Canada|CAN|ON|BC|QC|Uruguay|Peru"
    r"|Ecuador|Venezuela|Bolivia|Paraguay|Europe|EMEA|APAC|LATAM|EU)\b"
    r"|London|Berlin|Paris|Milan|Rome|Munich|Frankfurt|Hamburg|Dublin|Amsterdam|Brussels|Stockholm|Gothenburg|Copenhagen|Oslo|Helsinki|Warsaw"
    r"|Prague|Vienna|Lisbon|Madrid|Barcelona|Z[uü]rich|Geneva|Istanbul|Tel Aviv|Dubai|Abu Dhabi|Nairobi|Lagos|Cairo|Mumbai|Bengaluru|Bangalore"
    r"|Hyderabad|Delhi|Chennai|Pune|Jakarta|Manila|Bangkok|Singapore|Seoul|Tokyo|Osaka|Shanghai|Beijing|Shenzhen|Sydney|Melbourne|Brisbane|Perth"
    r"|Auckland|Toronto|Vancouver|Montreal|Ottawa|Calgary|S[aã]o Paulo|Rio de Janeiro|Buenos Aires|Bogot[aá]|Santiago|Lima|Mexico City|Guadalajara"
)
TARGET_METRO = (
    r"\b(?:Venice|Sarasota|North Port|Osprey|Nokomis|Laurel|Englewood|Siesta Key|Tampa|St\.? ?Petersburg|Saint Petersburg|Clearwater|Bradenton"
    r"|Palmetto|Brandon|Riverview|Largo|Lakeland)\b"
)
CURRENT_BASE = (
    r"\b(?:Chicago|Chicagoland|Evanston|Oak Park|Naperville|Schaumburg|Lemont|Joliet|Elgin|Cicero|Skokie|Arlington Heights|Des Plaines|Orland Park"
    r"|Tinley Park|Bolingbrook|Downers Grove|Elmhurst|Lombard|Wheaton|Oak Brook|Hinsdale|Palatine|Buffalo Grove|Cook County|DuPage County"
    r"|Will County|McHenry County)\b"
)
REMOTE_WORD = r"\bremote\b"

# Tiers, best first.
REMOTE_US, TARGET_METRO_HYBRID, TARGET_METRO_ONSITE, HYBRID_RARE_TRAVEL, CURRENT_BASE_TIER, OTHER_US = range(1, 7)
RARE_TRAVEL_DAYS = 2


def names(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + pattern)


def us_eligible(location: Column) -> Column:
    """False only for a place that is foreign and nowhere American; unknown places stay."""
    return ~names(location, CANADA_PREFIX) & (names(location, US_SIGNAL) | ~names(location, FOREIGN_SIGNAL))


def workplace(value: Column) -> Column:
    """remote, hybrid or onsite; anything else is unknown."""
    return F.when(value.isin("remote", "hybrid", "onsite"), value).otherwise("unknown")


def is_remote(location: Column, remote: Column, place: Column) -> Column:
    flag = F.coalesce(remote, F.lit(False)) | names(location, REMOTE_WORD)
    return F.when(place == "remote", True).when(place.isin("hybrid", "onsite"), False).otherwise(flag)


def location_tier(location: Column, remote: Column, place: Column | None = None, office_days: Column | None = None) -> Column:
    """The preference tier, 1 (remote) to 6 (elsewhere)."""
    place = workplace(place if place is not None else F.lit(None).cast("string"))
    office_days = office_days if office_days is not None else F.lit(None).cast("int")
    hybrid = place == "hybrid"
    return (
        F.when(is_remote(location, remote, place), REMOTE_US)
        .when(names(location, TARGET_METRO) & hybrid, TARGET_METRO_HYBRID)
        .when(names(location, TARGET_METRO), TARGET_METRO_ONSITE)
        .when(hybrid & (office_days <= RARE_TRAVEL_DAYS), HYBRID_RARE_TRAVEL)
        .when(names(location, CURRENT_BASE), CURRENT_BASE_TIER)
        .otherwise(OTHER_US)
    )


def mentions_target_metro(text: Column) -> Column:
    return names(text, TARGET_METRO)
