"""Column expressions for identities, published numbers, names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the parts of an identity.
SEPARATOR = "\u001f"
#: Spellings of one place, without signs (fixed values; the caller may pass others).
ALIASES = {
    "DIYOGYAKARTA": "DIYOGYAKARTA",
    "DAERAHISTIMEWAYOGYAKARTA": "DIYOGYAKARTA",
    "KEPBANGKABELITUNG": "KEPBANGKABELITUNG",
    "KEPULAUANBANGKABELITUNG": "KEPBANGKABELITUNG",
    "KEPRIAU": "KEPULAUANRIAU",
    "DKIJAKARTA": "DKIJAKARTA",
}
#: Area codes: the nation, the first that is an area, and what divides a province's (fixed values).
NATION, FIRST_AREA, PROVINCE = 9999, 1100, 100


def identity(*parts: Column | str) -> Column:
    """First 20 hex digits of the SHA-256 of the parts; null parts count as empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *texts), 256), 1, 20)


def decimal_of(lexeme: Column) -> Column:
    """The number that a published text says, null unless it is finite and has 28 digits before the point at most; ten after it count."""
    return F.trim(lexeme).try_cast("decimal(38,10)")


def decimal_places(lexeme: Column) -> Column:
    """Digits after the point of a published number."""
    return F.length(F.split_part(F.trim(lexeme), F.lit("."), F.lit(2)))


def last_place(places: Column) -> Column:
    """One unit in the last published place, exactly (places 0 to 10)."""
    steps = F.create_map(*(x for p in range(11) for x in (F.lit(p), F.lit("0." + "0" * (p - 1) + "1" if p else "1"))))
    return F.try_element_at(steps, places.cast("int")).cast("decimal(12,10)")


def geo_level(code: Column, non_spatial: bool = True) -> Column:
    """Level of an area code: nation, province, regency, or no area at all."""
    level = F.when(code == NATION, "national")
    if non_spatial:
        level = level.when(code < FIRST_AREA, "non_spatial")
    return level.when(code % PROVINCE == 0, "province").otherwise("regency")


def normalise_name(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """A name without markup, signs and case, in its common spelling."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(name, "<[^>]*>", " ")), "[^A-Z]", "")
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, bare), bare)


def year_of(label: Column) -> Column:
    """The first year from 1900 to 2099 in a label."""
    return F.nullif(F.regexp_extract(label, "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def merge_flags(one: Column, two: Column) -> Column:
    """Flags of both ';' lists, each once, in the order they come."""
    both = F.concat(F.split(F.coalesce(one, F.lit("")), ";"), F.split(F.coalesce(two, F.lit("")), ";"))
    return F.array_join(F.array_distinct(F.filter(both, lambda f: f != "")), ";")


def key_value(text: Column, key: str) -> Column:
    """Digits given for a key in 'key=1;other=2'; null if it is not there."""
    return F.nullif(F.regexp_extract(text, f"(?:^|;){key}=([0-9]+)", 1), F.lit(""))


def changed(value: Column, before: Column) -> Column:
    """Whether a value differs from the one before; the first row has not changed."""
    return F.coalesce(value != before, F.lit(False))


def is_number(lexeme: Column) -> Column:
    return decimal_of(lexeme).isNotNull()
