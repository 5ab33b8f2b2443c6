"""Text normalisers (TX01-TX21 of the survey) as column expressions.

The normalisers differ on purpose: keys of one are not keys of another. Only
what Spark lacks (compatibility decomposition and full case folding) is a
vectorised Python function; the rest stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists of the title keys.
FEAT = r"\b(feat|featuring|ft)\.?\b"
LOOSE_WORDS = "original|extended|radio|club|clean|dirty|explicit|instrumental|vocal|dub|edit|mix|remix|remaster|remastered|version"
VERSION_TOKENS = ("club", "clean", "dirty", "dub", "edit", "extended", "instrumental", "live", "master", "mix", "original", "radio", "remaster", "remastered", "remix", "version", "vocal")
ARTIST_STOP = ("and", "the", "feat", "ft", "featuring", "vs", "x")
STREAMING = ("tidal:", "qobuz:", "beatport:", "beatsource:", "soundcloud:")


@F.pandas_udf(T.StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """NFKD, what is not ASCII dropped, lower case. Null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())


@F.pandas_udf(T.StringType())
def unmarked(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; letters of other scripts stay."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding (``ß`` becomes ``ss``)."""
    return s.map(lambda x: None if x is None else x.casefold())


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def spaced(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _alnum(c: Column, join: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", " "), r"\s+", join))


def _and_feat(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), FEAT, " feat ")


def compact_key(c) -> Column:
    """TX01."""
    return _alnum(_and_feat(nfkd_ascii(_text(c))), "")


def compact(c) -> Column:
    """TX05, the spaced form."""
    return _alnum(_and_feat(nfkd_ascii(_text(c))), " ")


def loose_title_key(c, master: bool = True) -> Column:
    """TX02; one of the two lists also has ``master``."""
    words = LOOSE_WORDS + ("|master" if master else "")
    bare = F.regexp_replace(nfkd_ascii(_text(c)), r"[\[(].*?[\])]", " ")
    return _alnum(_and_feat(F.regexp_replace(bare, rf"\b({words})\b", " ")), "")


def safe_title_key(c) -> Column:
    """TX03: only ratings and remasters go."""
    s = F.regexp_replace(_and_feat(nfkd_ascii(_text(c))), r"\b(explicit|clean|dirty)\b", " ")
    return _alnum(F.regexp_replace(s, r"\b(\d{4}\s*)?remaster(ed|ise|ised|ize|ized)?\b", " "), "")


def stem_key(c) -> Column:
    """TX04 on a stem."""
    return _alnum(F.regexp_replace(nfkd_ascii(_text(c)), rf"\b({LOOSE_WORDS})\b", " "), "")


def match_text(c) -> Column:
    """TX06: marks dropped, full case folding, featuring words removed."""
    s = F.replace(casefold(unmarked(_text(c))), F.lit("&"), F.lit(" and "))
    return _alnum(F.regexp_replace(s, FEAT, " "), " ")


def match_key(c) -> Column:
    return F.replace(match_text(c), F.lit(" "), F.lit(""))


def strip_version(c) -> Column:
    """TX07, titles."""
    s = F.regexp_replace(_text(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    return spaced(F.regexp_replace(s, r"(?i)\b(original|extended|radio|club|edit|mix|remaster(?:ed)?)\b", " "))


def split_first(c, sep: str = " - ", suffix: str | None = r"(?i)_processed$") -> Column:
    """TX07 and TX11: struct of artist and title at the first separator, else no artist."""
    s = _text(c)
    if suffix:
        s = F.trim(F.regexp_replace(s, suffix, ""))
    at = F.locate(sep, s)
    return F.struct(F.when(at > 0, F.trim(F.substring(s, F.lit(1), at - 1))).otherwise("").alias("artist"), F.when(at > 0, F.trim(F.substring(s, at + len(sep), F.length(s)))).otherwise(s).alias("title"))


def split_dashed(c) -> Column:
    """TX11: the separator is a dash between white space."""
    parts = F.split(spaced(_text(c)), r"\s+-\s+", 2)
    two = F.size(parts) == 2
    return F.struct(F.when(two, F.trim(parts[0])).otherwise("").alias("artist"), F.when(two, F.trim(F.get(parts, F.lit(1)))).otherwise(parts[0]).alias("title"))


def artist_tokens(c) -> Column:
    """TX08."""
    return F.array_except(F.array_distinct(F.split(match_text(c), " ")), F.array(F.lit(""), *[F.lit(x) for x in ARTIST_STOP]))


# Phrases that identity keys leave out.
_LEFT_OUT = r"(?U)\b(explicit|clean|radio edit|original mix|remaster(?:ed)?|processed_library_root notes?)\b"


def identity_text(c, folded: bool = True, drop: bool = True) -> Column:
    """TX09; ``drop`` replaces odd characters by a space before white space collapses, else they vanish after it."""
    if drop:
        s = casefold(_text(c)) if folded else F.lower(_text(c))
        s = F.regexp_replace(s, _LEFT_OUT, " ")
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "_+", " "), r"(?U)[^\w\s&'+.-]", " "), r"(?U)\s+", " "))
    s = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "_+", " "), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(s, r"(?U)[^\w\s&'+.-]", ""))


def identity_key(artist, title) -> Column:
    """TX10."""
    return F.regexp_replace(F.concat(identity_text(artist), F.lit(" - "), identity_text(title)), "^[ -]+|[ -]+$", "")


def taxonomy_key(c) -> Column:
    """TX12."""
    s = unmarked(spaced(_text(c)))
    s = F.regexp_replace(F.regexp_replace(s, "[&+]", " and "), "['`´’]", "")
    return F.lower(spaced(F.regexp_replace(s, "[^a-zA-Z0-9]+", " ")))


def plain_key(c) -> Column:
    """TX13."""
    return casefold(spaced(_text(c)))


def canonical_stem(c, suffix: str = r"(?i)[_\s]+pn$") -> Column:
    """TX14: suffix off, spaces collapsed, folded; the stem itself if nothing is left."""
    s = spaced(F.regexp_replace(_text(c), suffix, ""))
    return casefold(F.when(s == "", _text(c)).otherwise(s))


def without_particle(name, particle: str = r"(?i)[_\s]pn(?=\.)") -> Column:
    """TX15 on a file name."""
    return F.regexp_replace(_text(name), particle, "")


def slug(c) -> Column:
    """TX16; null where nothing is left (the caller reports it)."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.nullif(s, F.lit(""))


def playlist_uuid(c) -> Column:
    """TX17."""
    return F.nullif(F.lower(F.regexp_extract(_text(c), r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})", 1)), F.lit(""))


def artist_parts(c) -> Column:
    """TX18: all parts."""
    parts = F.split(_text(c), r"(?i)\s*(?:,|&|\+|\bx\b|\bfeat\.?\b|\bft\.?\b)\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def primary_artist(c) -> Column:
    """TX18: the first part, separators between spaces only."""
    return F.nullif(F.trim(F.split(spaced(_text(c)), r"(?i)\s+(?:&|\+|,|x|feat\.?|featuring)\s+", 2)[0]), F.lit(""))


def field_aliases(field: str) -> list[str]:
    """TX19: spellings of an identifier, driver-side metadata."""
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", field)]
    if not words:
        return []
    spell = lambda w: ["".join(w), " ".join(w), "_".join(w)] if w else []
    out = spell(words)
    if words[0] == "src":
        rest = words[1:]
        out += spell(rest)
        if len(rest) > 1 and rest[-1] in ("name", "names", "title"):
            out += spell(rest[:-1])
    out += [f"src{''.join(words)}", f"src_{'_'.join(words)}"]
    return list(dict.fromkeys(x for x in out if x))


def key_variants(name: str) -> list[str]:
    """TX20: spellings of a musical key, most specific first (a minor key comes before its major)."""
    s = name.strip().casefold()
    for old, new in (("♯", "#"), ("♭", "b"), ("sharp", "#"), ("flat", "b"), ("major", ""), ("maj", ""), ("minor", "m"), ("min", "m")):
        s = s.replace(old, new)
    s = re.sub(r"[\s_-]", "", re.sub(r"\(.*?\)", "", s))
    s = re.sub("[^a-g0-9#m/]", "", s)
    out: list[str] = []
    for part in filter(None, s.split("/")):
        m = re.fullmatch("([a-g])([#b]?)m", part)
        out += [part, m[1] + m[2]] if m else [part]
    return sorted(dict.fromkeys(out), key=lambda x: (-len(x), x))


def as_bool(c) -> Column:
    """TX21."""
    return F.lower(F.trim(_text(c))).isin("1", "true", "yes", "y", "on")


def confidence(c) -> Column:
    """TX21: low, medium or high; low if unknown."""
    s = F.lower(F.trim(_text(c)))
    return F.when(s.isin("low", "medium", "high"), s).otherwise("low")


def confidence_rank(c) -> Column:
    return F.when(confidence(c) == "high", 3).when(confidence(c) == "medium", 2).otherwise(1)


@F.pandas_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("version", T.StringType())]))
def split_version(s: pd.Series) -> pd.DataFrame:
    """PF32: bracketed parts with a version word go, and are returned."""
    tokens = frozenset(VERSION_TOKENS)

    def one(x: str | None) -> tuple[str, str]:
        x, gone = x or "", []

        def part(m: re.Match) -> str:
            words = re.split("[^a-z0-9]+", unicodedata.normalize("NFKD", m[1]).encode("ascii", "ignore").decode().lower())
            if tokens.isdisjoint(words):
                return m[0]
            gone.append(m[1].strip())
            return " "

        clean = re.sub(r"\s+", " ", re.sub(r"[\[(]([^\])]+)[\])]", part, x)).strip(" -_")
        return clean or x, "; ".join(gone)

    return pd.DataFrame([one(x) for x in s], columns=["clean", "version"])


def has_version_word(c) -> Column:
    return F.arrays_overlap(F.split(compact(c), " "), F.array(*[F.lit(x) for x in VERSION_TOKENS]))


def clean_genre(c) -> Column:
    """PF31: object representations peeled, cut at a bracket unless that leaves nothing."""
    s = spaced(F.regexp_replace(F.regexp_replace(spaced(_text(c)), r"^<\w+\([^)]*Name=", ""), "[)>]+$", ""))
    head = spaced(F.substring_index(s, "(", 1))
    return F.when(F.contains(s, F.lit("(")) & (head != ""), head).otherwise(s)


def genre_list(c, pattern: str = r"[,;/|]+") -> Column:
    """HB04 and C9: split, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(_text(c), pattern), spaced), lambda x: x != "")


def display_join(c) -> Column:
    """HB05: sorted by lower case, joined."""
    order = F.array_sort(c, lambda x, y: F.when(F.lower(x) < F.lower(y), -1).when(F.lower(x) > F.lower(y), 1).otherwise(0))
    return F.array_join(order, " | ")


def is_streaming(c) -> Column:
    """PF01."""
    return F.lower(F.trim(_text(c))).rlike("^(" + "|".join(x.rstrip(":") for x in STREAMING) + "):")
