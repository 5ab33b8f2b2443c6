"""Paths (PA01-PA07, PA09, PA10, PF02, PF41, WN17, SO09) as column expressions."""

from __future__ import annotations

import ntpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def unquote(c) -> Column:
    """Percent decoding that keeps ``+``; a stray percent sign stays as it is."""
    s = F.regexp_replace(F.replace(_c(c), F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    return F.url_decode(s)


def from_uri(c, host: bool = True) -> Column:
    """PA01 (PA02 without ``host``): a ``file:`` address or a plain path with backslashes."""
    s = F.trim(_c(c))
    rest = F.regexp_replace(s, r"(?i)^file:", "")
    net = F.regexp_extract(rest, "^//([^/]*)", 1)
    path = unquote(F.regexp_replace(F.regexp_replace(rest, "^//[^/]*", ""), "[?#].*$", ""))
    if host:
        path = F.when((net != "") & (F.lower(net) != "localhost"), F.concat(F.lit("//"), net, path)).otherwise(path)
    path = F.regexp_replace(path, "^/([A-Za-z]:)", "$1")
    out = F.when(s.rlike("(?i)^file:"), path).otherwise(unquote(s))
    return F.replace(out, F.lit("/"), F.lit("\\"))


@F.pandas_udf(T.StringType())
def _normpath(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if not x else ntpath.normpath(x).replace("/", "\\").lower())


def normal(c, host: bool = True) -> Column:
    """PA03: dots and double separators collapsed, lower case; empty stays empty."""
    return _normpath(from_uri(c, host))


def forward(c) -> Column:
    """PA04."""
    return F.replace(_c(c), F.lit("\\"), F.lit("/"))


def compare_key(c) -> Column:
    """PA05."""
    return F.lower(F.replace(forward(c), F.lit("\x00"), F.lit("")))


def under(path: Column, root: Column, sep: str = "\\") -> Column:
    """PF02: the root itself or something below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit(sep)))


def name(c) -> Column:
    return F.regexp_extract(_c(c), r"([^\\/]*)$", 1)


def parent(c) -> Column:
    return F.regexp_replace(_c(c), r"[\\/]?[^\\/]*$", "")


def stem(c) -> Column:
    n = name(c)
    return F.when(n.rlike(r"^.+\.[^.]*$"), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)


def extension(c) -> Column:
    return F.lower(F.regexp_extract(name(c), r"^.+(\.[^.]+)$", 1))


def swap_prefix(c, old: str, new: str) -> Column:
    """PA06: null where the path is not under ``old``; the rest keeps its case."""
    s = forward(c)
    a, b = old.replace("\\", "/").rstrip("/"), new.replace("\\", "/").rstrip("/")
    ok = (F.lower(s) == a.lower()) | F.startswith(F.lower(s), F.lit(a.lower() + "/"))
    return F.when(ok, F.concat(F.lit(b), F.substring(s, F.lit(len(a) + 1), F.length(s))))


def in_all_folder(c) -> Column:
    """PF41."""
    return F.array_contains(F.split(F.lower(_c(c)), r"[\\/]"), "_all").cast("int")


def part_after(c, marker: str) -> Column:
    """WN17: the part after a marker folder, else the parent's name."""
    parts = F.split(_c(c), r"[\\/]")
    at = F.array_position(F.transform(parts, F.lower), marker.lower())
    return F.when((at > 0) & (at < F.size(parts) - 1), F.get(parts, at.cast("int"))).otherwise(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))


def prefixes(parts: Column) -> Column:
    """SO09: all prefixes of a path of parts."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))


def free_name(target: Column, order: list[Column], style: str, taken: Column | None = None) -> Column:
    """PA07: the k-th row of a target gets a numbered name.

    ``style`` is ``dup`` (``__dup2``), ``quality`` (`` (CD quality 2)``) or
    ``padded`` (``_001``); ``taken`` counts names that exist already.
    """
    k = F.row_number().over(W.partitionBy(target).orderBy(*order)) + (F.lit(0) if taken is None else taken) - 1
    mark = {"dup": F.concat(F.lit("__dup"), (k + 1).cast("string")), "quality": F.concat(F.lit(" (CD quality "), (k + 1).cast("string"), F.lit(")")), "padded": F.concat(F.lit("_"), F.lpad(k.cast("string"), 3, "0"))}[style]
    return F.when(k == 0, target).otherwise(F.concat(F.regexp_replace(target, r"(\.[^.\\/]*)?$", ""), mark, F.regexp_extract(target, r"(\.[^.\\/]*)?$", 0)))


def signature(path, size, mtime_ns, window) -> Column:
    """PA09."""
    number = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    return F.struct(compare_key(path).alias("path"), number(size).alias("size"), number(mtime_ns).alias("mtime_ns"), number(window).alias("window"))


def conversion(c) -> Column:
    """PA10: target, codec and mode by extension; null where there is none."""
    e, s = extension(c), _c(c)
    same = F.lit("replace_in_place")
    row = lambda t, k, m: F.struct(t.alias("target"), F.lit(k).alias("codec"), m.alias("mode"))
    return F.when(e.isin(".aif", ".aiff"), row(s, "pcm_s16be", same)).when(e == ".wav", row(s, "pcm_s16le", same)).when(e == ".flac", row(s, "flac", same)).when(e == ".m4a", row(F.regexp_replace(s, r"\.[^.]*$", ".aif"), "pcm_s16be", F.lit("m4a_flac_to_aif")))
