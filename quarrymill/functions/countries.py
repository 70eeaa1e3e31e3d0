"""Country names, their abbreviations and what a domain says of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# fixed values: abbreviations and other names
ALIASES = {
    "us": "united states", "usa": "united states", "u.s.": "united states", "u.s.a.": "united states", "america": "united states",
    "uk": "united kingdom", "u.k.": "united kingdom", "britain": "united kingdom", "england": "united kingdom",
    "uae": "united arab emirates", "emirates": "united arab emirates",
    "pk": "pakistan", "aus": "australia", "nz": "new zealand", "de": "germany", "fr": "france", "es": "spain", "it": "italy", "nl": "netherlands", "br": "brazil", "mx": "mexico", "ca": "canada",
    "in": "india", "cn": "china", "jp": "japan", "kr": "south korea", "sg": "singapore", "sa": "saudi arabia", "za": "south africa", "ng": "nigeria", "ke": "kenya", "bd": "bangladesh", "lk": "sri lanka", "np": "nepal",
}

# fixed values: endings of domains
TLDS = {
    "pk": "pakistan", "uk": "united kingdom", "de": "germany", "fr": "france", "au": "australia", "nz": "new zealand", "in": "india", "br": "brazil", "mx": "mexico", "ca": "canada", "sg": "singapore",
    "ae": "united arab emirates", "sa": "saudi arabia", "za": "south africa", "ng": "nigeria", "ke": "kenya", "bd": "bangladesh", "lk": "sri lanka", "np": "nepal", "ie": "ireland", "nl": "netherlands",
    "es": "spain", "it": "italy", "ch": "switzerland", "se": "sweden", "no": "norway", "dk": "denmark", "pl": "poland", "tr": "turkey", "eg": "egypt", "id": "indonesia", "my": "malaysia", "ph": "philippines",
    "th": "thailand", "vn": "vietnam", "co": "colombia", "ar": "argentina", "cl": "chile", "ao": "angola",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize(country: Column) -> Column:
    clean = collapse(country)
    return F.coalesce(F.try_element_at(_map(ALIASES), clean), clean)


def name_of(country: str) -> str:
    clean = " ".join(country.lower().split())
    return ALIASES.get(clean, clean)


def hint(domain: Column) -> Column:
    return F.when(domain.contains("."), F.try_element_at(_map(TLDS), F.substring_index(F.lower(domain), ".", -1)))


def mentions(text: Column, target: str) -> Column:
    """The name or any of its abbreviations anywhere in the text, as plain parts of it."""
    name, low = name_of(target), F.lower(text)
    out = low.contains(name)
    for alias, of in ALIASES.items():
        if of == name:
            out = out | low.contains(alias)
    return F.coalesce(out, F.lit(False))


def matches(country: Column, target: str, domain: Column, description: Column) -> Column:
    """The same name, or one within the other; else the text names the target; else the domain's ending does."""
    name = name_of(target)
    if not name:
        return F.lit(True)
    own, end = normalize(F.coalesce(country, F.lit(""))), hint(domain)
    same = (own != "") & (own.contains(name) | F.lit(name).contains(own))
    said = mentions(F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(domain, F.lit(""))), target)
    by_end = F.coalesce(end.contains(name) | F.lit(name).contains(end), F.lit(False))
    return same | said | by_end


def matches_any(country: Column, target: Column, domain: Column, description: Column) -> Column:
    """matches() against a column of countries: abbreviations of a row's own target are looked up, not unrolled."""
    name, own, end = normalize(F.coalesce(target, F.lit(""))), normalize(F.coalesce(country, F.lit(""))), hint(domain)
    low = F.lower(F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(domain, F.lit(""))))
    short = F.try_element_at(_map({name: "|".join(a for a, of in ALIASES.items() if of == name) for name in sorted(set(ALIASES.values()))}), name)
    said = low.contains(name) | F.exists(F.split(F.coalesce(short, F.lit("")), r"\|"), lambda a: (a != "") & low.contains(a))
    same = (own != "") & (own.contains(name) | name.contains(own))
    return (name == "") | same | F.coalesce(said, F.lit(False)) | F.coalesce(end.contains(name) | name.contains(end), F.lit(False))
