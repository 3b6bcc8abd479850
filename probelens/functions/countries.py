"""Countries under their several names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from probelens.functions.text import country_norm

#: a country's short name and the other names it goes by (fixed values)
GROUPS = {
    "united states": ("united states of america", "usa", "us", "america"),
    "united kingdom": ("uk", "great britain", "england", "scotland", "wales", "northern ireland", "united kingdom of great britain and northern ireland"),
    "china": ("people's republic of china", "prc", "mainland china"),
    "taiwan": ("republic of china", "chinese taipei"),
    "russia": ("russian federation",),
    "south korea": ("republic of korea", "korea, south"),
    "north korea": ("democratic people's republic of korea", "dprk", "korea, north"),
    "czech republic": ("czechia",),
    "myanmar": ("burma", "union of myanmar"),
    "netherlands": ("kingdom of the netherlands", "holland"),
    "swaziland": ("eswatini", "kingdom of eswatini"),
    "ivory coast": ("cote d'ivoire", "côte d'ivoire"),
    "east timor": ("timor-leste", "timor leste"),
    "cape verde": ("cabo verde",),
    "democratic republic of the congo": ("dr congo", "drc", "zaire", "congo-kinshasa"),
    "republic of the congo": ("congo-brazzaville", "congo republic"),
    "uae": ("united arab emirates",),
    "vatican city": ("holy see", "vatican"),
    "iran": ("islamic republic of iran",),
    "syria": ("syrian arab republic",),
    "egypt": ("arab republic of egypt",),
    "tanzania": ("united republic of tanzania",),
    "venezuela": ("bolivarian republic of venezuela",),
    "bolivia": ("plurinational state of bolivia",),
    "laos": ("lao people's democratic republic",),
    "vietnam": ("socialist republic of vietnam", "viet nam"),
    "moldova": ("republic of moldova",),
    "macedonia": ("north macedonia",),
    "ireland": ("republic of ireland",),
}
#: what a generated text may call a country (fixed values)
SPOKEN = {
    "united states": ("usa", "us", "united states of america", "america"),
    "united kingdom": ("uk", "england", "scotland", "wales", "great britain", "britain"),
    "russia": ("russian federation",),
    "south korea": ("korea", "republic of korea"),
    "north korea": ("dprk",),
    "czech republic": ("czechia",),
    "myanmar": ("burma",),
    "netherlands": ("holland",),
    "swaziland": ("eswatini",),
    "ivory coast": ("cote divoire",),
    "east timor": ("timorleste",),
    "cape verde": ("cabo verde",),
    "democratic republic of the congo": ("drc", "congo kinshasa", "zaire"),
    "uae": ("united arab emirates",),
    "vatican city": ("vatican", "holy see"),
}


def _plain(name: str) -> str:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz " else " " for c in name.lower()).strip()


def group_of(name: Column) -> Column:
    """The short name of the country that name stands for; the normalised name itself outside the groups."""
    entries = {_plain(a): g for g, names in GROUPS.items() for a in (g, *names)}
    known = F.create_map(*map(F.lit, chain.from_iterable(entries.items())))
    one = country_norm(name)
    return F.coalesce(F.try_element_at(known, one), one)


def spoken(name: Column) -> Column:
    """Other names of a country in generated texts; null where there are none."""
    known = F.create_map(*chain.from_iterable((F.lit(g), F.lit(list(names))) for g, names in SPOKEN.items()))
    return F.try_element_at(known, name)
