"""Language identification of pages by Bayesian evidence fusion.

The posterior of a language adds, in logarithms: the likelihood of the page's
text under byte trigram models, the likelihood of its declared markup
language, and a prior of its host. The host prior shrinks the host's share of
each language towards its address suffix's, and that towards the global
share. All three levels, and how far declarations agree with texts, are
grouped sums of text posteriors; a page's own part is taken out of the sums
that it is judged by, so a host of one page falls back to its suffix.

Trigram models are fitted on labelled documents: of each language the
``SAMPLE_ROWS`` with the smallest hash of their id, ``SAMPLE_ALL`` rows in all.
The ``LANGUAGES`` most frequent ones are told apart; documents of the others
are one language, ``und``, so a label column of any number of values stays
bounded. Everything else covers all pages. Sums are made per task before they move; rows that join them are
narrow, and AQE may split a host that holds a third of the pages.

Nulls, empty texts and repeated rows: a null ``html`` has no text and no
declaration, a null or unusual ``url`` has host and suffix ``""``; what is
missing adds no evidence. Pages of any length are read whole, in one pass, also
where tags, comments or scripts are never closed. Repeated rows each get a row and count each; of an id's rows each different text is
trained on once, at most ``SAMPLE_ROWS`` texts a language. An
empty table gives an empty table; without labelled documents every page gets
the language ``und`` with probability 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recolith.llm import textops as tx
from recolith.scratch import cut

SLOTS = 1 << 14
SAMPLE_ROWS = 8000
TRIGRAMS = 60  # a page's text weighs as much as so many independent trigrams at most
HOST, SUFFIX = 5.0, 20.0  # pages that the level above counts for
#: Languages told apart, the most frequent ones; documents of others are one language, ``und``.
LANGUAGES = 200
#: Rows of all languages' samples together.
SAMPLE_ALL = 400_000
_OPEN = {kind: re.compile(rb"(?i)<" + kind + rb"\b") for kind in (b"script", b"style")}
_CLOSE = {kind: re.compile(rb"(?i)</" + kind + rb"\s*>") for kind in (b"script", b"style")}
_HTML = re.compile(rb"(?i)<html\b")
_LANG = re.compile(rb"""(?i)\blang\s*=\s*["']?([a-z]{2,3})""")


class _Ends:
    """Where the next closing mark ends, for places that only grow; each byte is looked at once, and not at all when none is left."""

    def __init__(self, found: Iterator[int]):
        self.found, self.next = found, -1

    def after(self, at: int) -> int | None:
        while self.next is not None and self.next <= at:
            self.next = next(self.found, None)
        return self.next


def _each(html: bytes, mark: bytes) -> Iterator[int]:
    at = html.find(mark)
    while at >= 0:
        yield at + len(mark)
        at = html.find(mark, at + 1)


def page_text(html: bytes) -> bytes:
    """The page without scripts, styles, comments and tags, in one pass.

    What is never closed loses only its tag, and a ``<`` without any ``>``
    after it is text.
    """
    tags, comments = _Ends(_each(html, b">")), _Ends(_each(html, b"-->"))
    blocks = {kind: _Ends(m.end() for m in _CLOSE[kind].finditer(html)) for kind in _OPEN}
    out, text, at = [], 0, html.find(b"<")
    while at >= 0:
        end = None
        for kind, opens in _OPEN.items():
            if m := opens.match(html, at):
                end = blocks[kind].after(m.end() + len(kind) + 2)
        if html.startswith(b"<!--", at):
            end = comments.after(at + 6)
        end = tags.after(at) if end is None else end
        if end is None:
            break
        out.append(html[text:at])
        text, at = end, html.find(b"<", end)
    out.append(html[text:])
    return b" ".join(out)


def declared_language(html: bytes) -> str | None:
    """The language that the first ``<html`` tag declares."""
    if not (m := _HTML.search(html)):
        return None
    end = html.find(b">", m.end())
    found = _LANG.search(html[m.end() : end if end >= 0 else len(html)])
    return found[1].decode().lower() if found else None


def trigram_slots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each trigram of letters, marks and single spaces."""
    data = tx.lower(data)
    data = np.where(tx.NOT_ALNUM[data], np.uint8(32), data)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    n = max(0, len(data) - 2)
    a, b, c = (data[i : n + i] for i in range(3))
    ok = np.flatnonzero((row[:n] == row[2:]) & ((a != 32) | (b != 32)) & ((b != 32) | (c != 32)))
    key = a[ok].astype(np.uint32) << np.uint32(16) | b[ok].astype(np.uint32) << np.uint32(8) | c[ok]
    # 24 bits to 14: an odd factor and the product's leading bits.
    return row[ok], (key * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        data, off = tx.column_bytes(b.column("text"))
        langs = np.array(b.column("lang").to_pylist(), object)
        for i, j in tx.slices(off):
            row, slot = trigram_slots(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for lang in set(langs[i:j]):
                own = (langs[i:j] == lang)[row]
                sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                sums[lang] += np.bincount(slot[own], minlength=SLOTS)
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "slot", "c"])


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of trigram slots by language."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.lower(F.trim("lang")).alias("lang"), "text")
    often = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    if len(often) == LANGUAGES:
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(often), F.col("lang")).otherwise("und"))
    sample_rows = max(1, min(sample_rows, SAMPLE_ALL // max(len(often) + 1, 1)))
    ids = rows.select("lang", "id").distinct().withColumn("k", F.xxhash64("id", F.lit(1)))
    share = F.lit(2.0 * sample_rows) / F.col("n")
    # Twice as many as wanted by a bound on the hash, then exactly: no task sees more of a language.
    near = ids.join(F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.col("k") / F.lit(2.0**64) + 0.5 <= share)
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k", "id"))).where(F.col("r") <= sample_rows).select("lang", "id")
    keyed = rows.withColumn("th", F.xxhash64("text"))
    # An id with many rows counts each different text once, and a language keeps to its rows.
    keys = keyed.select("lang", "id", "th").join(F.broadcast(few), ["lang", "id"]).distinct()
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(1)), "id", "th"))).where(F.col("r") <= sample_rows).drop("r")
    texts = keyed.join(F.broadcast(keys), ["lang", "id", "th"]).dropDuplicates(["lang", "id", "th"])
    got = texts.select("lang", "text").mapInArrow(_train, "lang string, slot long, c long").groupBy("lang", "slot").agg(F.sum("c").alias("c")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    c = np.zeros((len(langs), SLOTS))
    c[[langs.index(x) for x in got["lang"]], got["slot"].to_numpy(np.int64)] = got["c"].to_numpy(float)
    c += 0.5
    return langs, np.log(c / c.sum(axis=1, keepdims=True)) if langs else c


def text_posteriors(data: np.ndarray, off: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log likelihoods by row and language, tempered to ``TRIGRAMS`` trigrams."""
    row, slot = trigram_slots(data, off)
    n = len(off) - 1
    like = np.stack([np.bincount(row, x[slot], n) for x in logs], axis=1)
    count = np.bincount(row, minlength=n)
    like *= (np.minimum(count, TRIGRAMS) / np.maximum(count, 1))[:, None]
    return like - like.max(axis=1, keepdims=True)


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for b in batches:
            raw, at = tx.column_bytes(b.column("html"))
            for i, j in tx.slices(at):
                html = [raw[x:y].tobytes() for x, y in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                declared, texts = [declared_language(x) for x in html], [page_text(x) for x in html]
                data, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts]))
                like = text_posteriors(data, off, logs)
                like = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(logs)), pa.array(like.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(i, j - i), b.column("url").slice(i, j - i), pa.array(declared, pa.string()), like], names=["page_id", "url", "declared", "loglike"])

    return run


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, host, suffix, declared, text_lang, lang, probability`` of every page."""
    langs, logs = fit_languages(docs)
    k = len(langs)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    suffix = F.regexp_extract(host, r"([^.]*)$", 1)
    if not k:
        return base.select("page_id", host.alias("host"), suffix.alias("suffix"), F.lit(None).cast("string").alias("declared"), F.lit("und").alias("text_lang"), F.lit("und").alias("lang"), F.lit(1.0).alias("probability"))
    shared = pages.sparkSession.sparkContext.broadcast(logs)
    rows = base.mapInArrow(_read(shared), "page_id long, url string, declared string, loglike array<double>")
    mass = F.aggregate(F.transform("loglike", F.exp), F.lit(0.0), lambda a, x: a + x)
    rows = cut(rows.select("page_id", host.alias("host"), suffix.alias("suffix"), "declared", "loglike", F.transform("loglike", lambda x: F.exp(x) / mass).alias("p")), "pages")

    def sums(by: str, name: str) -> DataFrame:
        return rows.groupBy(by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(name))

    whole = rows.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)]).first()
    share = F.array(*[F.lit((x + 1.0) / (sum(whole) + k)) for x in whole])
    kinds = rows.where("declared is not null").select("declared").distinct().count()
    told = rows.where("declared is not null").agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)]).first()
    all_ = F.array(*[F.lit(float(x)) for x in told])

    def at(arr: str | F.Column, i: F.Column) -> F.Column:
        return F.element_at(arr, i + 1)

    def less(arr: str) -> F.Column:
        """A sum without the row's own part."""
        return F.transform(arr, lambda x, i: F.greatest(x - at("p", i), F.lit(0.0)))

    def total(arr: F.Column) -> F.Column:
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)

    out = rows.join(sums("suffix", "s_sum"), "suffix").join(sums("host", "h_sum"), "host").join(sums("declared", "d_sum"), "declared", "left")
    out = out.withColumns({"s_sum": less("s_sum"), "h_sum": less("h_sum")}).withColumn("share", share).withColumn("told", all_)
    out = out.withColumn("s_n", total(F.col("s_sum"))).withColumn("h_n", total(F.col("h_sum")))
    out = out.withColumn("s_prior", F.transform("s_sum", lambda x, i: (x + SUFFIX * at("share", i)) / (F.col("s_n") + SUFFIX)))
    out = out.withColumn("h_prior", F.transform("h_sum", lambda x, i: (x + HOST * at("s_prior", i)) / (F.col("h_n") + HOST)))
    say = F.when(F.col("d_sum").isNull(), F.lit(0.0))
    post = F.transform("loglike", lambda x, i: x + F.log(at("h_prior", i)) + say.otherwise(F.log((F.greatest(at("d_sum", i) - at("p", i), F.lit(0.0)) + 0.5) / (F.greatest(at("told", i) - at("p", i), F.lit(0.0)) + 0.5 * (kinds + 1)))))
    out = out.withColumn("post", post).withColumn("top", F.array_max("post"))
    out = out.withColumn("sum", total(F.transform("post", lambda x: F.exp(x - F.col("top")))))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda arr: F.element_at(names, F.array_position(arr, F.array_max(arr)).cast("int"))
    return out.select("page_id", "host", "suffix", "declared", pick(F.col("loglike")).alias("text_lang"), pick(F.col("post")).alias("lang"), (F.lit(1.0) / F.col("sum")).alias("probability"))
