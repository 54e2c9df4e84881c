"""Pieces of the SQL twins: written for DuckDB, apart from the Spark expressions they check."""

from .. import dims

SITE = r"regexp_extract(lower(trim({0})), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
PATH = r"(case when regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end)"
QUERY = r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)"
NORM = r"(case when regexp_matches(regexp_replace(trim({0}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/$') then regexp_replace(trim({0}), '#.*$', '') else regexp_replace(regexp_replace(trim({0}), '#.*$', ''), '/$', '') end)"


def site(c: str) -> str:
    return SITE.format(c)


def path(c: str) -> str:
    return PATH.format(c)


def query(c: str) -> str:
    return QUERY.format(c)


def norm(c: str) -> str:
    return NORM.format(c)


def quoted(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words.split())) + "]"


def clean(c: str) -> str:
    """Lower case, Polish letters folded, only a-z, 0-9 and single blanks."""
    return f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({c}, '')), '{dims.FOLD_FROM}', '{dims.FOLD_TO}'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def raw_tokens(c: str, stop: str = dims.TEXT_STOP, least: int = 3) -> str:
    return f"list_filter(string_split({clean(c)}, ' '), lambda t: length(t) >= {least} and not list_contains({quoted(stop)}, t))"


def stem(t: str, suffixes: str = dims.TEXT_SUFFIXES) -> str:
    cases = " ".join(f"when ends_with({t}, '{s}') and length({t}) - {len(s)} >= 3 then left({t}, length({t}) - {len(s)})" for s in suffixes.split())
    return f"(case when length({t}) <= 4 or regexp_matches({t}, '[0-9]') then {t} {cases} else {t} end)"


def tokens(c: str, stop: str = dims.TEXT_STOP, least: int = 3, suffixes: str = dims.TEXT_SUFFIXES) -> str:
    return f"list_transform({raw_tokens(c, stop, least)}, lambda u: {stem('u', suffixes)})"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda w: w <> '')"


def sentences(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[.!?…]+\\s'), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 3)"
