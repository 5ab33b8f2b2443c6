"""Numbers, times, hashes, maps and arrays (NU, HB, PF12-PF13, PF34-PF37)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recolith.functions.text import spaced


def _s(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def as_double(c) -> Column:
    """NU01; ``N/A`` and blanks are null."""
    return _s(c).try_cast("double")


def as_long(c) -> Column:
    """NU01: through double, cut towards zero."""
    x = as_double(c)
    return F.when(F.abs(x) < 9.2e18, x.cast("long"))


def parse_int(c) -> Column:
    """NU02: the first digits, 0 to 50000."""
    x = F.regexp_extract(_s(c), r"(\d+)", 1).try_cast("long")
    return F.when(x.between(0, 50000), x)


def parse_year(c) -> Column:
    return F.regexp_extract(_s(c), r"(19\d{2}|20\d{2})", 1).try_cast("int")


def parse_track(c) -> Column:
    x = F.regexp_extract(F.substring_index(F.trim(_s(c)), "/", 1), r"^\s*(\d+)\s*$", 1).try_cast("long")
    return F.when(x.between(0, 9999), x)


def parse_bpm(c) -> Column:
    """Hundredths, half-even, 20 to 400."""
    x = F.replace(F.regexp_extract(_s(c), r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x.between(20, 400), F.bround(x * 100, 0).cast("int"))


def parse_seconds(c) -> Column:
    x = F.trim(_s(c)).try_cast("double")
    return F.when(x > 0, F.bround(x, 0).cast("int"))


def energy(c) -> Column:
    """PF13: 1 to 10, or up to ten stars; empty if neither."""
    s = spaced(_s(c))
    stars = F.regexp_replace(s, r"\s+", "")
    return F.when(s.rlike("^(10|[1-9])$"), s).when(stars.rlike("^[*★]{1,10}$"), F.length(stars).cast("string")).otherwise("")


def energy_from_text(c) -> Column:
    """NU03: the first part that is an energy."""
    s = spaced(_s(c))
    found = F.filter(F.transform(F.split(s, r"\s*[;,/\\-]\s*"), lambda x: energy(F.regexp_replace(x, "[^0-9*★]", ""))), lambda x: x != "")
    stars = F.regexp_replace(s, r"\s+", "")
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))).when(stars.rlike("^[*★]+$"), F.length(stars).cast("string")).otherwise("")


def comment_status(c) -> Column:
    """PF12."""
    s = spaced(_s(c))
    return F.when(s == "", "blank").when(energy(s) != "", "numeric").otherwise("occupied")


def timestamp(c) -> Column:
    """NU04: ISO text; an offset without a colon is repaired, none means UTC (with the session in UTC)."""
    s = F.regexp_replace(F.regexp_replace(F.trim(_s(c)), "Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return s.try_cast("timestamp")


def since(floor: Column, state: Column, argument: Column | None = None) -> Column:
    """NU05: the later of the floor and the argument, or of the floor and the state; compared as times."""
    return F.greatest(floor, state if argument is None else F.coalesce(argument, state))


def overlap_bounds(n_a: Column, n_b: Column, offset: Column) -> Column:
    """NU07: starts in both and length of the overlap when b is shifted by ``offset``."""
    a, b = F.greatest(F.lit(0), -offset), F.greatest(F.lit(0), offset)
    return F.struct(a.alias("a"), b.alias("b"), F.greatest(F.lit(0), F.least(n_a - a, n_b - b)).alias("n"))


def match_score(title_in_keys: Column, stripped_in_keys: Column, key_overlap: Column, shared: Column, remote_tokens: Column) -> Column:
    """NU09 (fixed values 55, 45, 50; 35, 15, 10; 5)."""
    title = F.when(title_in_keys, 55).when(stripped_in_keys, 45).when(key_overlap, 50).otherwise(0)
    artist = F.when(shared > 0, F.least(F.lit(35), F.lit(15) + 10 * shared)).when(remote_tokens == 0, 5).otherwise(0)
    return F.when(title > 0, title + artist).otherwise(0)


def match_status(score: Column) -> Column:
    """PF11."""
    return F.when(score >= 70, "solid").when(score >= 55, "review").otherwise("missing")


def resolver_confidence(source: Column, identity: Column, has_genre: Column) -> tuple[Column, Column]:
    """NU08: score and label (fixed values: source weights)."""
    weights = {"musicbrainz": 0.78, "listenbrainz": 0.82, "lastfm": 0.80, "discogs": 0.86, "spotify_direct": 0.72, "itunes": 0.58, "deezer": 0.55, "theaudiodb": 0.65, "existing_tag": 0.90}
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.coalesce(F.try_element_at(table, source), F.lit(0.5))
    score = F.bround(F.least(F.lit(1.0), identity * w + F.when(has_genre, 0.08).otherwise(0.0)), 4)
    label = F.when(~has_genre, "identity_only").when(score >= 0.78, "high").when(score >= 0.58, "medium").otherwise("low")
    return score, label


def file_hash(content: Column) -> Column:
    """HB01."""
    return F.upper(F.sha2(content, 256))


def text_hash(c: Column) -> Column:
    """HB02."""
    return F.sha1(F.encode(c, "UTF-8"))


def json_object(c: Column) -> Column:
    """HB03: the variant if the text is a JSON object, else null."""
    v = F.try_parse_json(c)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def one_of_key(entries: Column, last: bool = False) -> Column:
    """A map of (key, value) entries; of entries with one key the first (or last) stays, whatever the session's policy."""
    keys = entries["key"]
    own = (lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i) if last else (lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(F.filter(entries, own))


def merge_tags(first: Column, second: Column) -> Column:
    """HB06: maps on folded keys without blanks; the first map wins, and of its keys that fold alike the first."""
    fold = lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))
    tidy = F.filter(F.transform(F.concat(F.map_entries(first), F.map_entries(second)), fold), lambda e: (e["key"] != "") & (e["value"] != "") & e["value"].isNotNull())
    return one_of_key(tidy)


def pick_tag(tags: Column, keys: list[str]) -> Column:
    """PF34: the first of the keys with a value."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(tags, F.lit(k.strip().lower()))), F.lit("")) for k in keys], F.lit(""))


def shingles(a: Column, size: int, step: int) -> Column:
    """HB07: array of (shingle, position)."""
    last = F.size(a) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(F.slice(a, i + 1, F.lit(size)).alias("shingle"), i.alias("pos"))))


def merge_json(left: Column, right: Column) -> Column:
    """HB08: two JSON objects as maps of JSON texts; the right wins, and of a repeated key the last."""
    entries = lambda c: F.coalesce(F.map_entries(F.from_json(c, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    return F.to_json(one_of_key(F.concat(entries(left), entries(right)), last=True))


def changed(old: Column, new: Column, text: bool = True) -> Column:
    """PF35: the new value where it differs (texts without case and spacing); else null."""
    if text:
        n = F.nullif(spaced(_s(new)), F.lit(""))
        return F.when(F.lower(spaced(_s(old))) != F.lower(n), n)
    return F.when(F.coalesce(old, F.lit(0)) != new, new)


def changed_fields(**updates: Column) -> Column:
    """PF36: names of the columns that change, sorted and joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sorted(updates.items())])), ";")


def redact(tags: Column) -> Column:
    """SK14: values of secret-like keys become ``<present>``, or blank if they are blank."""
    secret = lambda k: F.lower(k).rlike("secret|password") | F.lower(k).isin("token", "clientid", "email")
    return F.transform_values(tags, lambda k, v: F.when(secret(k), F.when(F.coalesce(v, F.lit("")) != "", "<present>").otherwise("")).otherwise(v))
