"""Person and team names: normal forms, aliases and the keys used to match them."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsloom.functions.parsing import strip, text

# Generational suffixes, in the order they are tried.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")

# Spellings of team names and the full name each stands for.
TEAM_NAME_ALIASES = {
    "atl": "atlanta hawks",
    "atlanta": "atlanta hawks",
    "bos": "boston celtics",
    "boston": "boston celtics",
    "bkn": "brooklyn nets",
    "brk": "brooklyn nets",
    "brooklyn": "brooklyn nets",
    "cha": "charlotte hornets",
    "charlotte": "charlotte hornets",
    "cho": "charlotte hornets",
    "chi": "chicago bulls",
    "chicago": "chicago bulls",
    "cle": "cleveland cavaliers",
    "cleveland": "cleveland cavaliers",
    "dal": "dallas mavericks",
    "dallas": "dallas mavericks",
    "den": "denver nuggets",
    "denver": "denver nuggets",
    "det": "detroit pistons",
    "detroit": "detroit pistons",
    "golden state": "golden state warriors",
    "gs": "golden state warriors",
    "gsw": "golden state warriors",
    "hou": "houston rockets",
    "houston": "houston rockets",
    "ind": "indiana pacers",
    "indiana": "indiana pacers",
    "la clippers": "los angeles clippers",
    "lac": "los angeles clippers",
    "la lakers": "los angeles lakers",
    "lal": "los angeles lakers",
    "mem": "memphis grizzlies",
    "memphis": "memphis grizzlies",
    "mia": "miami heat",
    "miami": "miami heat",
    "mil": "milwaukee bucks",
    "milwaukee": "milwaukee bucks",
    "min": "minnesota timberwolves",
    "minnesota": "minnesota timberwolves",
    "new orleans": "new orleans pelicans",
    "nop": "new orleans pelicans",
    "nor": "new orleans pelicans",
    "new york": "new york knicks",
    "ny": "new york knicks",
    "nyk": "new york knicks",
    "okc": "oklahoma city thunder",
    "oklahoma city": "oklahoma city thunder",
    "orl": "orlando magic",
    "orlando": "orlando magic",
    "phi": "philadelphia 76ers",
    "philadelphia": "philadelphia 76ers",
    "philadelphia sixers": "philadelphia 76ers",
    "pho": "phoenix suns",
    "phoenix": "phoenix suns",
    "phx": "phoenix suns",
    "por": "portland trail blazers",
    "portland": "portland trail blazers",
    "sac": "sacramento kings",
    "sacramento": "sacramento kings",
    "sa": "san antonio spurs",
    "san antonio": "san antonio spurs",
    "sas": "san antonio spurs",
    "tor": "toronto raptors",
    "toronto": "toronto raptors",
    "uta": "utah jazz",
    "utah": "utah jazz",
    "was": "washington wizards",
    "washington": "washington wizards",
}

# Three-letter code of each full team name.
TEAM_ABBREVIATIONS = {
    "atlanta hawks": "ATL",
    "boston celtics": "BOS",
    "brooklyn nets": "BKN",
    "charlotte hornets": "CHA",
    "chicago bulls": "CHI",
    "cleveland cavaliers": "CLE",
    "dallas mavericks": "DAL",
    "denver nuggets": "DEN",
    "detroit pistons": "DET",
    "golden state warriors": "GSW",
    "houston rockets": "HOU",
    "indiana pacers": "IND",
    "los angeles clippers": "LAC",
    "los angeles lakers": "LAL",
    "memphis grizzlies": "MEM",
    "miami heat": "MIA",
    "milwaukee bucks": "MIL",
    "minnesota timberwolves": "MIN",
    "new orleans pelicans": "NOP",
    "new york knicks": "NYK",
    "oklahoma city thunder": "OKC",
    "orlando magic": "ORL",
    "philadelphia 76ers": "PHI",
    "phoenix suns": "PHX",
    "portland trail blazers": "POR",
    "sacramento kings": "SAC",
    "san antonio spurs": "SAS",
    "toronto raptors": "TOR",
    "utah jazz": "UTA",
    "washington wizards": "WAS",
}

# Teams whose roster page name is not the last word of the team name.
ROSTER_PAGE_EXCEPTIONS = {"philadelphia 76ers": "sixers"}


@cache
def _letter_folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility folding to ASCII, derived from the Unicode database.

    Over all of Unicode: characters whose decomposition keeps exactly one ASCII letter or digit go
    into a ``translate`` table; those that keep several (ligatures) become replacements.
    """
    single_from, single_to, several = [], [], []
    for code in range(0x80, 0x110000):
        char = chr(code)
        if not unicodedata.decomposition(char) or char != char.lower():
            continue
        kept = "".join(
            c for c in unicodedata.normalize("NFKD", char) if ord(c) < 128 and c.isalnum()
        ).lower()
        if len(kept) == 1:
            single_from.append(char)
            single_to.append(kept)
        elif len(kept) > 1:
            several.append((char, kept))
    return "".join(single_from), "".join(single_to), tuple(several)


def person_key(name: Column) -> Column:
    """Lower-case ASCII letters and digits of a name, accents folded."""
    chars, folded, ligatures = _letter_folding()
    out = F.lower(strip(name))
    for ligature, letters in ligatures:
        if unicodedata.category(ligature).startswith("L"):
            out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.translate(out, chars, folded), "[^a-z0-9]+", "")


def ascii_person_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def squeeze(value: Column) -> Column:
    return strip(F.regexp_replace(F.lower(value), r"\s+", " "))


def team_key(name: Column) -> Column:
    """Full lower-case team name from any known spelling; unknown names pass through."""
    cleaned = squeeze(F.coalesce(name, F.lit("")))
    return F.coalesce(_lookup(cleaned, TEAM_NAME_ALIASES), cleaned)


def name_words(name: Column) -> Column:
    """Lower-case alphanumeric words of a name."""
    spaced = strip(F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def name_aliases(name: Column) -> Column:
    """Sorted distinct keys of a name: folded, ASCII-words, and without its suffix."""
    cleaned = F.regexp_replace(strip(name), r"[^a-zA-Z0-9\s]", " ")
    words = F.filter(F.split(F.lower(cleaned), r"\s+"), lambda w: w != "")
    has_suffix = (F.size(words) > 0) & F.array_contains(
        F.array(*[F.lit(s) for s in NAME_SUFFIXES]), F.try_element_at(words, F.lit(-1))
    )
    trimmed = F.when(
        has_suffix, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), "")
    ).otherwise(F.lit(""))
    keys = F.array(person_key(name), trimmed, F.array_join(words, ""))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def last_word(name: Column) -> Column:
    """Last word of a name that is not a suffix; empty for no words."""
    words = name_words(name)
    suffixed = F.try_element_at(words, F.lit(-1)).isin(*NAME_SUFFIXES) & (F.size(words) > 1)
    picked = F.when(suffixed, F.try_element_at(words, F.lit(-2))).otherwise(
        F.try_element_at(words, F.lit(-1))
    )
    return F.coalesce(picked, F.lit(""))


def first_initial(name: Column) -> Column:
    return F.coalesce(F.substring(F.try_element_at(name_words(name), F.lit(1)), 1, 1), F.lit(""))


def strip_suffix(key: Column) -> Column:
    """Key without one trailing suffix, when more than two characters remain."""
    raw = F.lower(strip(key))
    out = raw
    for suffix in reversed(NAME_SUFFIXES):
        size = len(suffix)
        ends = raw.endswith(suffix) & (F.length(raw) > size + 2)
        out = F.when(ends, raw.substr(F.lit(1), F.length(raw) - size)).otherwise(out)
    return out


def match_keys(name: Column) -> Column:
    """All keys under which a box-score row may hold this player."""
    aliases = name_aliases(name)
    bases = F.transform(aliases, strip_suffix)
    suffixed = F.flatten(
        F.transform(
            bases,
            lambda b: F.transform(
                F.array(*[F.lit(s) for s in NAME_SUFFIXES]), lambda s: F.concat(b, s)
            ),
        )
    )
    return F.array_distinct(F.concat(aliases, bases, suffixed))


def team_code(name: Column) -> Column:
    """Short team label: known code, else a 2-4 letter name, else the last word's start."""
    raw = text(name)
    full = team_key(raw)
    token = F.replace(raw, F.lit("."), F.lit(""))
    last = F.try_element_at(F.split(full, " "), F.lit(-1))
    return (
        F.when(raw == "", F.lit(""))
        .when(_lookup(full, TEAM_ABBREVIATIONS).isNotNull(), _lookup(full, TEAM_ABBREVIATIONS))
        .when(token.rlike("^[A-Za-z]{2,4}$"), F.upper(token))
        .otherwise(F.upper(F.substring(last, 1, 3)))
    )


def game_label(away: Column, home: Column) -> Column:
    away_code, home_code = team_code(away), team_code(home)
    return F.when(
        (away_code != "") & (home_code != ""), F.concat_ws(" @ ", away_code, home_code)
    ).otherwise(
        F.coalesce(
            F.nullif(away_code, F.lit("")), F.nullif(home_code, F.lit("")), F.lit("unknown_game")
        )
    )


def roster_link(team: Column, player: Column) -> Column:
    """League roster page for known teams, else a search link."""
    full = team_key(team)
    slug = F.coalesce(
        _lookup(full, ROSTER_PAGE_EXCEPTIONS), F.try_element_at(F.split(full, " "), F.lit(-1))
    )
    query = F.url_encode(F.concat(player, F.lit(" "), team, F.lit(" nba")))
    return F.when(
        _lookup(full, TEAM_ABBREVIATIONS).isNotNull(),
        F.concat(F.lit("https://www.nba.com/"), slug, F.lit("/roster")),
    ).otherwise(F.concat(F.lit("https://www.espn.com/search/_/q/"), query))
