"""Keyword-stuffed and link-list pages by their rank-frequency curves.

The prose of a language is its own rank-frequency curve: the words of all its distinct
texts, each text one unit, ranked by a window; the first RANKS words keep their
frequency, the others share the rest. A page's words, with links, tags and numbers
brought to their shapes, give its divergence from the language whose prose it is nearest
to, and its frequency spectrum (how many words occur f times). SQL windows turn spectra
into ranks, and a weighted line through log rank and log frequency gives slope and
residual. All are held against the pages of that language and of comparable length, each
distinct text once. The spread is measured on the side of the median where spam is not.

Pages of a known language are flagged if their divergence, slope or residual is extreme;
pages without prose of their own language (rare languages, letters lost to a wrong
encoding) if their own curve is off the norm of their length. Only flagged pages can be
spam. The check of their lines that follows knows speech by the curves alone: words of
the upper ranks of prose that pages near its norm use far more than pages far from it.

Defined cases: null, empty and blank texts are never spam; labels of language are only
used to build curves, so null or wrong ones change nothing for their page; a language
needs MIN_PAGES distinct texts, and one in MAX_LANGUAGES of all, for a curve of its own; a
length with fewer distinct texts borrows the norm of all languages, then that of the
nearest length; without any norm every page is flagged; equal frequencies share their mean
rank; copies are judged alike, and once; very long texts are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.spamlines import spam_share
from tramline.session import checkpointed, written

#: Words of a language's curve that keep their own frequency.
RANKS = 2000
#: Ranks whose words may be words of speech, and how many times more pages near the norm use them than pages far from it.
SPEECH_RANKS, SPEECH_RATIO = 400, 3.0
#: Distinct pages that a norm needs; languages that may have a curve (bounds what goes to the tasks: RANKS words each).
MIN_PAGES, MAX_LANGUAGES = 30, 1000
#: Spreads off the norm beyond which a page is flagged: divergence and shape of a known language, shape of an unknown one.
FAR, FAR_SHAPE, FAR_UNKNOWN = 1.5, 3.0, 1.0
#: Up to and from here a page is near prose and far from it, when words of speech are told.
NEAR, OUT = 1.0, 6.0
#: A page that has a word more than FEW times and OFTEN times as much as prose does may have stuffed it.
FEW, OFTEN = 5, 5.0
#: A language's norm of divergence for a length holds if it is at most so many times that of all languages; else spam makes most of it.
LIKE_ALL = 1.5
#: A page is of a known language if so much of its words is among the ranked ones, and no more are links and tags.
KNOWN, MOST_LINKS = 0.25, 0.75
#: Ranks up to which the mass of a page's own most frequent words is compared.
CUTS = (1, 2, 4, 8, 16, 32, 64)
#: Codes that stand for no one language.
NO_LANGUAGE = ("", "und", "mul", "zxx", "mis")
UNIT = 1_000_000
_SITE = re.compile(r"\w[.,\])]{1,3}\w{1,63}/|//|www|\[url|href|\]\(", re.I)
_EDGE = " \t.,;:!?|•·*♪\"'()[]<>«»-–—…/¿¡"
ID = ["_a", "_b"]
_SHAPED = ("<link>", "<tag>", "<number>")


class _Shapes(dict):
    """Word as written in lower case -> the word, or the shape of a link, tag or number; empty if nothing is left."""

    def __missing__(self, w: str) -> str:
        if w.isalpha() and "www" not in w and "href" not in w:
            out = w
        elif len(w) > 3 and _SITE.search(w):
            out = "<link>"
        elif w[0] == "#":
            out = "<tag>"
        elif out := w.strip(_EDGE):
            out = "<number>" if any(map(str.isdigit, out)) else out
        if len(self) > 200_000:  # starts anew, with the same results
            self.clear()
        if len(w) < 64:
            self[w] = out
        return out


_shapes = _Shapes()


def words_of(text: str) -> Counter:
    """How often the words of a page occur, in lower case and without numbers and times of cues; links, tags and numbers as shapes."""
    lines = [x for x in text.lower().splitlines() if "-->" not in x and not x.strip().isdigit()]
    counts = Counter(map(_shapes.__getitem__, " ".join(lines).split()))
    counts.pop("", None)
    return counts


def _id(text: Column) -> list[Column]:
    """Two hashes of a text: 128 bits stand for it."""
    return [F.xxhash64(F.lit(i), text).alias(c) for i, c in enumerate(ID)]


def distinct_pages(df: DataFrame, text: str, lang: str) -> DataFrame:
    """_a, _b, lang, text of the distinct texts with something in them, as a table in the shared folder; copies are dropped before the shuffle."""
    pages = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("trim(text) <> ''").distinct()
    return written(pages.select(*_id(F.col("text")), "lang", "text"))


class Prose:
    """Curves of the languages for the tasks: words with the languages that rank them and by how much their log frequency there is above that of a word outside."""

    def __init__(self, langs: list[str], outside: list[float], curves: list[dict[str, float]]):
        self.langs, self.outside = langs, np.array(outside)
        self.shapes = [[s for s in _SHAPED if s in c] for c in curves]
        ranked: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(curves):
            for w, q in c.items():
                ranked.setdefault(w, []).append((i, q - outside[i]))
        self.row = {w: k for k, w in enumerate(ranked)}
        self.start = np.cumsum([0, *map(len, ranked.values())])
        self.lang = np.array([i for v in ranked.values() for i, _ in v], np.int64)
        self.above = np.array([q for v in ranked.values() for _, q in v])

    def nearest(self, counts: Counter) -> tuple[int, float, float]:
        """(language whose prose the page is likeliest to be or -1, divergence from its prose, share of the plain words that it ranks, 0 on a page of links)."""
        if not self.langs or not counts:
            return -1, 0.0, 0.0
        c = np.fromiter(counts.values(), np.float64, len(counts))
        rows = np.fromiter(map(self.row.get, counts, repeat(-1)), np.int64, len(counts))
        n, known = c.sum(), rows >= 0
        rows, times = rows[known], c[known]
        size = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        lang, times = self.lang[at], np.repeat(times, size)
        log_q = n * self.outside + np.bincount(lang, times * self.above[at], len(self.langs))
        best = int(log_q.argmax())
        off = float(((c * np.log(c)).sum() - log_q[best]) / n - math.log(n))
        if counts["<link>"] + counts["<tag>"] > MOST_LINKS * n:
            return best, off, 0.0
        plain = n - sum(counts[s] for s in _SHAPED)
        ranked = times[lang == best].sum() - sum(counts[s] for s in self.shapes[best])
        return best, off, float(ranked / plain) if plain else 1.0


def _by_word(pages: DataFrame, given: list[str], label) -> DataFrame:
    """Sums of page-wise word shares by label(row values and the page's words) and word; a row without a word counts the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass: dict[tuple, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, w, v) for k, words in mass.items() for w, v in words.items()]
            mass.clear()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "side", "word", "mass"])

        for b in batches:
            for *row, text in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                counts = words_of(text)
                if not counts or (k := label(*row, counts)) is None:
                    continue
                if (words := mass.get(k)) is None:
                    words = mass[k] = Counter()
                unit = UNIT // sum(counts.values())
                words[None] += 1
                for w, c in counts.items():
                    words[w] += unit * c
            if sum(map(len, mass.values())) > 300_000:  # a state that outgrows the task's share is sent on and merged later
                yield flush()
        yield flush()

    rows = pages.select(*given, "text").mapInArrow(run, "lang string, side int, word string, mass long")
    return rows.groupBy("lang", "side", "word").agg(F.sum("mass").alias("mass"))


def prose_of(pages: DataFrame) -> Prose:
    """The curve of each language from the distinct texts labelled so; MAX_LANGUAGES times RANKS rows at most come back."""
    by = checkpointed(_by_word(pages, ["lang"], lambda lang, _: None if lang is None or lang.strip().lower() in NO_LANGUAGE else (lang, 0)))
    whole = by.agg(F.sum(F.when(F.col("word").isNull(), F.col("mass")))).first()[0] or 0
    sized = by.groupBy("lang").agg(F.sum(F.when(F.col("word").isNull(), F.col("mass"))).alias("pages"), F.count("word").alias("n_words"), F.sum(F.when(F.col("word").isNotNull(), F.col("mass"))).alias("total"))
    sized = sized.filter((F.col("pages") >= MIN_PAGES) & (F.col("pages") * MAX_LANGUAGES >= whole))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("mass").desc(), "word"))
    top = by.filter("word is not null").withColumn("rank", rank).filter(F.col("rank") <= RANKS)
    rows = top.join(sized, "lang").select("lang", "word", "mass", "n_words", "total").collect()
    langs = sorted({r.lang for r in rows})
    at, outside, words = {x: i for i, x in enumerate(langs)}, [0.0] * len(langs), [{} for _ in langs]
    kept: Counter = Counter()
    for r in rows:
        kept[r.lang] += r.mass
        words[at[r.lang]][r.word] = math.log(max(r.mass, 1) / r.total)
    for r in rows:  # what the ranked words leave, evenly over the others, and no less than a millionth
        outside[at[r.lang]] = math.log(max((r.total - kept[r.lang]) / r.total / max(1, r.n_words - RANKS), 1 / UNIT))
    return Prose(langs, outside, words)


def spectra(pages: DataFrame, prose: Prose) -> DataFrame:
    """_a, _b, lang (nearest, null if unknown), n_words, divergence and spectrum (freq, n_at) of every page with words."""
    sent = pages.sparkSession.sparkContext.broadcast(prose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        kind = pa.list_(pa.struct([("freq", pa.int32()), ("n_at", pa.int32())]))
        for b in batches:
            lang, total, off, spectrum = [], [], [], []
            for t in b.column(2).to_pylist():
                counts = words_of(t)
                i, d, known = p.nearest(counts)
                lang.append(p.langs[i] if i >= 0 and known >= KNOWN else None)
                total.append(sum(counts.values()))
                off.append(d)
                spectrum.append([{"freq": f, "n_at": n} for f, n in Counter(counts.values()).items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(total, pa.int32()), pa.array(off, pa.float64()), pa.array(spectrum, kind)], [*ID, "lang", "n_words", "divergence", "spectrum"])

    rows = pages.select(*ID, "text").mapInArrow(run, "_a long, _b long, lang string, n_words int, divergence double, spectrum array<struct<freq:int,n_at:int>>")
    return rows.filter("n_words > 0")


def curves(spectrum: DataFrame) -> DataFrame:
    """_a, _b, lang, n_words, size (log2 of the words), divergence, slope, residual and the mass in the first ranks of each page's own curve."""
    keep = [*ID, "lang", "n_words", "divergence"]
    runs = spectrum.dropDuplicates(ID).select(*keep, F.explode("spectrum").alias("s")).select(*keep, "s.freq", "s.n_at")
    upto = F.sum("n_at").over(Window.partitionBy(*ID).orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n_at"))
    x, y, w = F.log((F.col("lo") + 1 + F.col("hi")) / 2.0), F.log("freq"), F.col("n_at")
    mass = [F.sum(F.col("freq") * F.least(F.greatest(F.lit(c) - F.col("lo"), F.lit(0)), F.col("n_at"))).alias(f"c{c}") for c in CUTS]
    moments = {"w": w, "wx": w * x, "wy": w * y, "wxx": w * x * x, "wxy": w * x * y, "wyy": w * y * y}
    sums = runs.groupBy(*keep).agg(*(F.sum(v).alias(k) for k, v in moments.items()), *mass)
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("wxx", "wx", "wx"), ("wxy", "wx", "wy"), ("wyy", "wy", "wy")))
    fit = sums.withColumn("slope", F.when(sxx > 1e-9, sxy / sxx).otherwise(0.0)).withColumn("residual", F.sqrt(F.greatest(syy - F.col("slope") * sxy, F.lit(0.0)) / F.col("w")))
    parts = [(F.col(f"c{c}") - (F.col(f"c{b}") if b else 0)) / F.col("n_words") for b, c in zip((0, *CUTS), CUTS, strict=False)]
    return fit.select(*keep, F.floor(F.log2("n_words")).cast("int").alias("size"), "slope", "residual", F.array(*parts, 1 - F.col(f"c{CUTS[-1]}") / F.col("n_words")).alias("mass"))


def _norms(fits: DataFrame, by: list[str]) -> DataFrame:
    """Quantiles of the measures and mean mass per rank band in each cell; map-side combined."""
    q = lambda c: F.percentile_approx(c, F.array(*map(F.lit, (0.16, 0.5, 0.84))), 1000).alias(c)
    bands = [F.avg(F.col("mass")[i]).alias(f"q{i}") for i in range(len(CUTS) + 1)]
    cells = fits.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.struct(q("divergence"), q("slope"), q("residual")).alias("_q"), *bands)
    norm = F.struct("_q.*", *(b for b in (f"q{i}" for i in range(len(CUTS) + 1))))
    return cells.select(*by, F.when(F.col("_n") >= MIN_PAGES, norm).alias("norm"))


def deviations(fits: DataFrame) -> DataFrame:
    """The pages with the spreads by which divergence, slope, residual and mass are off the norm of language and length; null without any norm."""
    # Cells are at most MAX_LANGUAGES languages times some 60 binary orders of length, a norm is 17 numbers.
    own = _norms(fits.filter("lang is not null"), ["lang", "size"]).filter("norm is not null").select(F.col("lang").alias("_lang"), F.col("size").alias("_size"), F.col("norm").alias("own"))
    every = _norms(fits, ["size"])
    back, on = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("size").rowsBetween(0, Window.unboundedFollowing)
    every = every.select("size", F.coalesce(F.last("norm", ignorenulls=True).over(back), F.first("norm", ignorenulls=True).over(on)).alias("every"))
    f = fits.join(F.broadcast(own), (F.col("lang") == F.col("_lang")) & (F.col("size") == F.col("_size")), "left").join(F.broadcast(every), "size", "left")
    alike = F.col("own.divergence")[1] <= LIKE_ALL * F.col("every.divergence")[1]
    f = f.withColumn("norm", F.when(F.col("own").isNotNull() & F.coalesce(alike, F.lit(True)), F.col("own")).otherwise(F.col("every"))).drop("own", "every", "_lang", "_size")
    lo, mid, hi = (lambda c, i=i: F.col(f"norm.{c}")[i] for i in range(3))
    # Spam diverges upwards, so the lower side tells prose's spread; of a shape the narrower side.
    off = F.greatest(mid("divergence") - lo("divergence"), F.lit(1e-3))
    side = lambda c: F.greatest(F.least(mid(c) - lo(c), hi(c) - mid(c)), F.lit(1e-3))
    f = f.withColumn("divergence_off", (F.col("divergence") - mid("divergence")) / off)
    for c in ("slope", "residual"):
        f = f.withColumn(f"{c}_off", (F.col(c) - mid(c)) / side(c))
    part = lambda i: F.greatest(F.col("mass")[i], F.lit(1e-4))
    bent = reduce(Column.__add__, (part(i) * F.log(part(i) / F.greatest(F.col(f"norm.q{i}"), F.lit(1e-4))) for i in range(len(CUTS) + 1)))
    return f.select(*ID, "lang", "size", "n_words", "divergence", "divergence_off", "slope_off", "residual_off", F.when(F.col("norm").isNotNull(), bent).alias("bent"))


def _flags(d: DataFrame) -> DataFrame:
    """Adds bent_off, and flagged where a page may be spam."""
    usual = d.groupBy("size").agg(F.percentile_approx("bent", F.array(F.lit(0.16), F.lit(0.5)), 1000).alias("_u"))
    d = d.join(F.broadcast(usual), "size", "left").withColumn("bent_off", (F.col("bent") - F.col("_u")[1]) / F.greatest(F.col("_u")[1] - F.col("_u")[0], F.lit(1e-3)))
    shape = lambda far: (F.abs("slope_off") > far) | (F.abs("residual_off") > far)
    known = (F.col("divergence_off") > FAR) | shape(FAR_SHAPE)
    unknown = shape(FAR_UNKNOWN) | (F.col("bent_off") > FAR_UNKNOWN)
    flag = F.coalesce(F.when(F.col("lang").isNotNull(), known).otherwise(unknown), F.lit(True))
    return d.withColumn("flagged", flag).select(*ID, "lang", "n_words", "divergence_off", "slope_off", "residual_off", "bent_off", "flagged")


def speech_of(pages: DataFrame, prose: Prose, d: DataFrame) -> dict[str, dict[str, float]]:
    """Words of speech by language, with their share of a page of prose: at most SPEECH_RANKS each, in use near the norm of prose and seldom far from it.

    The norms are read off the pages' deviations: one row per language and length goes to the tasks.
    """
    ends = d.filter("lang is not null").groupBy("lang", "size").agg(F.max(F.when(F.col("divergence_off") <= NEAR, F.col("divergence"))).alias("near"), F.min(F.when(F.col("divergence_off") > OUT, F.col("divergence"))).alias("far")).collect()
    sent = pages.sparkSession.sparkContext.broadcast((prose, {(r.lang, r.size): (r.near, r.far) for r in ends}))

    def side(counts: Counter) -> tuple[str, int] | None:
        p, cells = sent.value
        i, off, known = p.nearest(counts)
        if i < 0 or known < KNOWN:
            return None
        lang = p.langs[i]
        near, far = cells.get((lang, sum(counts.values()).bit_length() - 1), (None, None))
        return (lang, 0) if near is not None and off <= near else (lang, 1) if far is not None and off >= far else None

    by = checkpointed(_by_word(pages, [], side))
    n = by.filter("word is null").select("lang", "side", F.col("mass").alias("n"))
    rate = by.filter("word is not null and left(word, 1) <> '<'").join(F.broadcast(n), ["lang", "side"]).withColumn("rate", F.col("mass") / F.col("n"))
    rate = rate.groupBy("lang", "word").agg(F.sum(F.when(F.col("side") == 0, F.col("rate")).otherwise(0.0)).alias("near"), F.sum(F.when(F.col("side") == 1, F.col("rate")).otherwise(0.0)).alias("far"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("near").desc(), "word"))
    kept = rate.withColumn("rank", rank).filter((F.col("rank") <= SPEECH_RANKS) & (F.col("near") > 0) & (F.col("near") >= SPEECH_RATIO * F.col("far")))
    out: dict[str, dict[str, float]] = {}
    for r in kept.select("lang", "word", "near").collect():
        out.setdefault(r.lang, {})[r.word] = r.near / UNIT
    return out


def speech_on(text: str, speech: dict[str, float], words: frozenset | None = None) -> frozenset:
    """Words that show speech on this page: not those that it repeats OFTEN times as much as prose does; words are all of speech."""
    counts = words_of(text)
    n = sum(counts.values())
    stuffed = {w for w, c in counts.items() if c > FEW and w in speech and c > OFTEN * speech[w] * n}
    words = frozenset(speech) if words is None else words
    return words - stuffed if stuffed else words


@dataclass
class Judged:
    """Distinct pages, their deviations with flags, and the words of speech by language."""

    pages: DataFrame
    flags: DataFrame
    speech: dict[str, dict[str, float]]


def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> Judged:
    """Curves of prose and pages, and which pages are flagged."""
    pages = distinct_pages(df, text, lang)
    prose = prose_of(pages)
    fits = checkpointed(curves(spectra(pages, prose)))
    d = checkpointed(deviations(fits))
    speech = speech_of(pages, prose, d) if prose.langs else {}
    return Judged(pages, checkpointed(_flags(d)), speech)


def flagged(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Pages with an extreme curve, or without any norm: key, n_words and the deviations."""
    flags = judge(df, text, lang).flags.filter("flagged").drop("flagged", "lang")
    return df.select(key, *_id(F.col(text).cast("string"))).join(flags, ID).drop(*ID)


def found(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key and share of the flagged pages of which more than half are keywords, links or product tags."""
    j = judge(df, text, lang)
    sent = df.sparkSession.sparkContext.broadcast(j.speech)
    suspects = j.flags.filter("flagged").select(*ID, F.col("lang").alias("_lang"))
    # 40 bytes a page at most; beyond 32 MB both sides shuffle.
    suspects = F.broadcast(suspects) if suspects.count() * 40 < 32 << 20 else suspects

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {x: (s, frozenset(s)) for x, s in sent.value.items()}
        for b in batches:
            share = [spam_share(t, speech_on(t, *words.get(x, ({}, frozenset()))), x is not None) for x, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64())], [*ID, "share"])

    checked = j.pages.select(*ID, "text").join(suspects, ID).select(*ID, "_lang", "text").mapInArrow(run, "_a long, _b long, share double").filter("share > 0.5").dropDuplicates(ID)
    spam = checkpointed(checked)
    spam = F.broadcast(spam) if spam.count() * 24 < 32 << 20 else spam
    return df.select(key, *_id(F.col(text).cast("string"))).join(spam, ID).select(key, "share")
