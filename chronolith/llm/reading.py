"""Reading level of pages: a Rasch-style scale of documents and words.

Main text: lines that recur over many different pages (menus, notices,
footers, error messages) are found by corpus counts and left out; what remains
is prose if it has enough words, few figures and function words, and English if
a character model fitted to the ``lang`` labels says so.

Scale: page d has a level t_d, word w a difficulty b_w and a frequency a_w; an
occurrence in d is w with probability

    p(w | t_d) = exp(a_w + b_w t_d) / sum over v of exp(a_v + b_v t_d),

the nominal form of the Rasch model: the log-odds of two words move with the
level by the difference of their difficulties.  Words too rare for a parameter
of their own are one word for each length, so every occurrence takes part.

A page may quote: with probability QUOTED one of its stretches of STRETCH words
has a level of its own.  With normal priors on levels and difficulties this
is one objective, the log posterior

    sum over d of [ -t_d^2 / 2 + sum over stretches s of
        log( (1 - QUOTED) p(s | t_d) + QUOTED * integral of p(s | u) N(u; 0, 1) du ) ] - RIDGE / 2 sum of b_w^2

(the integral by Laplace's method).  Alternating optimisation: given the words,
a level is found by reweighting the page's stretches; given the levels, each
word's difficulty by Newton steps on a lower bound of the objective.  A round
is one pass over the pages, each task sending a sum for each word and a
histogram of levels; fit() tells the objective after each round.

Bands: cut points on the level are fitted to the grades of the graded documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.words import words
from chronolith.session import written

GRADES = ("easy", "middle", "hard")
#: Function words of English: running prose has them, lists of things don't.
_EN = frozenset(
    b"""the of and to in is was a that for it with as on at by be this are we from or an not but they he she his her had has
    have were which no you i if then so too can been who""".split()
)
#: A line is boilerplate if it stands on pages of at least this share of all contexts (and at least 5).
LINE_SHARE = 0.002
#: Words of a prose page at least, share of function words at least, share of words with figures at most.
MIN_WORDS, MIN_ENGLISH, MAX_FIGURES = 40, 0.015, 0.3
#: Words in a stretch, and the share of stretches that are expected to be of another level than their page.
STRETCH, QUOTED = 15, 0.1
#: Precision of the prior of a difficulty.
RIDGE = 5.0
#: Levels at which the sum over all words is tabulated.
GRID = np.linspace(-6.0, 6.0, 241)
#: Buckets of character triples, labels of languages, and how many labelled pages the language model is fitted to.
TRIPLES, LABELLED = 1 << 14, 20_000
#: A word's hash ends with its length, so that rare words of a length can be told.
LENGTHS = 32


def _lines(text: str) -> list[str]:
    return [x for x in (y.strip() for y in text.split("\n")) if x]


def _hash(x: str | bytes) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def _word(x: bytes) -> int:
    return (_hash(x) & ~(LENGTHS - 1)) | min(len(x), LENGTHS - 1)


def boilerplate(documents: DataFrame, text: str = "text", share: float = LINE_SHARE) -> np.ndarray:
    """Sorted hashes of lines that stand on many different pages.

    A line counts once for each different longest line it shares a page with,
    so the text of a page that is mirrored a thousand times counts once.  At
    most (mean lines a page) / share lines can reach the threshold, which
    bounds what comes to the driver.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, context = [], []
            for t in b.column(0).to_pylist():
                ls = set(_lines(t)) if t else ()
                at.append([_hash(x) for x in ls])
                context.append(_hash(max(ls, key=lambda x: (len(x), x))) if ls else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.list_(pa.int64())), pa.array(context, pa.int64())], names=["lines", "context"]
            )

    per = written(
        documents.select(text).where(f"{text} IS NOT NULL AND {text} <> ''").mapInArrow(hashed, "lines array<long>, context long"),
        "page-lines"
    )
    least = max(5, share * per.count())
    frequent = per.select(F.explode("lines").alias("line")).groupBy("line").count().where(F.col("count") >= least).select("line")
    pairs = per.select(F.explode("lines").alias("line"), "context").join(frequent, "line").distinct()
    got = pairs.groupBy("line").count().where(F.col("count") >= least).select("line").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64))


# language ------------------------------------------------------------------------------------


def _main(text: str, boiler: set[int]) -> str:
    return "\n".join(x for x in _lines(text) if _hash(x) not in boiler)


_NO_LETTER = re.compile(r"[\W\d_]+")


def triples(text: str) -> np.ndarray:
    """Buckets of the character triples (in bytes) of a text's letters, words parted by one space."""
    a = np.frombuffer(f" {_NO_LETTER.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    return (((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435769)) >> np.uint32(32 - TRIPLES.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Languages:
    """Naive Bayes over character triples: log-probabilities by label; without labels every text is taken."""

    labels: list[str]
    weight: np.ndarray

    def is_english(self, text: str) -> bool:
        if "en" not in self.labels:
            return not self.labels
        score = self.weight[:, triples(text)].sum(axis=1)
        return self.labels[int(score.argmax())] == "en"


def language_model(
    documents: DataFrame, boiler: np.ndarray, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    labelled: int = LABELLED
) -> Languages:
    """Fitted to the main texts of about ``labelled`` labelled pages, drawn by a hash of their id.

    A label is the first two letters of ``lang``; labels of fewer than 1 % of the
    sample are left out, wrong ones only blur the counts.  Each page counts with
    its share of every triple, so long pages don't outweigh short ones."""
    label = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2})([^a-z]|$)", 1)
    some = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), label.alias("label")).where("label <> '' AND text <> ''")
    n = some.count()
    if n > labelled:
        some = some.where(F.pmod(F.xxhash64(F.lit("labelled"), "id"), F.lit(1 << 30)) < int(labelled / n * (1 << 30)))
    shared = documents.sparkSession.sparkContext.broadcast(boiler)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, sums, pages = set(shared.value.tolist()), {}, {}
        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = triples(_main(t, lines))
                if len(at):
                    sums[name] = sums.get(name, 0) + np.bincount(at, minlength=TRIPLES) / len(at)
                    pages[name] = pages.get(name, 0) + 1
        for name, total in sums.items():
            at = np.flatnonzero(total)
            values = [
                pa.array([name] * (len(at) + 1)), pa.array([*at.tolist(), -1], pa.int32()),
                pa.array([*total[at].tolist(), float(pages[name])])
            ]
            yield pa.RecordBatch.from_arrays(values, names=["label", "triple", "n"])

    sums = some.select("text", "label").mapInArrow(
        count, "label string, triple int, n double"
    ).groupBy("label", "triple").agg(F.sum("n").alias("n")).toArrow()
    label_of, triple, n_of = np.array(sums.column(0).to_pylist(), object), sums.column(1).to_numpy(), sums.column(2).to_numpy()
    pages = dict(zip(label_of[triple < 0], n_of[triple < 0]))
    known = sorted(x for x, k in pages.items() if k >= 0.01 * sum(pages.values()))
    weight = np.zeros((len(known), TRIPLES))
    for i, x in enumerate(known):
        of = (label_of == x) & (triple >= 0)
        weight[i, triple[of]] = n_of[of]
        share = weight[i] / max(weight[i].sum(), 1e-12)
        weight[i] = np.log(0.999 * share + 0.001 / TRIPLES)
    return Languages(known, weight)


# main text -----------------------------------------------------------------------------------


def main_words(text: str | None, boiler: set[int], languages: Languages | None = None) -> list[bytes] | None:
    """The words of the main text if it is running English prose, else None."""
    if not text:
        return None
    main = _main(text, boiler)
    w = words(main)
    plain = [x for x in w if x.isalpha()]
    n = len(plain)
    if n < MIN_WORDS or len(w) - n > MAX_FIGURES * len(w):
        return None
    if sum(x in _EN for x in plain) < MIN_ENGLISH * n or (languages and not languages.is_english(main)):
        return None
    return plain


def prose(
    documents: DataFrame, boiler: np.ndarray, languages: Languages | None = None, doc_id: str = "doc_id",
    text: str = "text"
) -> DataFrame:
    """(doc_id, occurrences, start): all words (hashes, in order) of each page of English prose and its mean word length."""
    shared = documents.sparkSession.sparkContext.broadcast((boiler, languages))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, model = set(shared.value[0].tolist()), shared.value[1]
        known: dict[bytes, int] = {}
        for b in batches:
            ids, found, start = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = main_words(t, lines, model)
                if w is None or i is None:
                    continue
                w = [x for x in w if len(x) > 1]
                if len(known) > 200_000:
                    known.clear()
                ids.append(i)
                found.append([known[x] if x in known else known.setdefault(x, _word(x)) for x in w])
                start.append(sum(map(len, w)) / max(1, len(w)))
            arrays = [pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(start, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "occurrences", "start"])

    return documents.select(doc_id, text).mapInArrow(read, "doc_id long, occurrences array<long>, start double")


def vocabulary(pages: DataFrame, min_df: float = 0.0005) -> np.ndarray:
    """Sorted hashes of the words with a parameter of their own: on at least ``min_df`` of the pages, and on 3.

    At most (mean distinct words a page) / min_df words.  The others are pooled by
    their length, which keeps their occurrences in the model."""
    n = pages.count()
    each = pages.select(F.explode(F.array_distinct("occurrences")).alias("w")).groupBy("w").count()
    return np.sort(each.where(F.col("count") >= max(3, min_df * n)).select("w").toArrow().column(0).to_numpy().astype(np.int64))


def numbered(pages: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(doc_id, at, start): occurrences as places in the vocabulary, pooled ones after it."""
    shared = pages.sparkSession.sparkContext.broadcast(vocab)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            col = b.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(v, flat)
            own = v[np.minimum(at, len(v) - 1)] == flat if len(v) else np.zeros(len(flat), bool)
            at = np.where(own, at, len(v) + (flat & (LENGTHS - 1))).astype(np.int32)
            off = np.asarray(col.offsets) - np.asarray(col.offsets)[0]
            arrays = [b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(at)), b.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "at", "start"])

    return pages.select("doc_id", "occurrences", "start").mapInArrow(number, "doc_id long, at array<int>, start double")


# the scale -----------------------------------------------------------------------------------


@dataclass
class Scale:
    """Word parameters, the tables of their sum over the levels of GRID, and how the fit went."""

    a: np.ndarray
    b: np.ndarray
    log_z: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    spread: np.ndarray = field(default=None)
    #: (round, objective of an occurrence before the round's word step, greatest change of a difficulty in it)
    history: list[tuple[int, float, float]] = field(default_factory=list)
    converged: bool = False

    def tabulate(self) -> Scale:
        """log Z and its first two derivatives by level: mean and variance of the difficulty of a word drawn there."""
        z, m, v = (np.zeros(len(GRID)) for _ in range(3))
        top = np.full(len(GRID), -np.inf)
        for c in range(0, len(self.a), 4096):
            top = np.maximum(top, (self.a[c : c + 4096, None] + self.b[c : c + 4096, None] * GRID).max(axis=0, initial=-np.inf))
        for c in range(0, len(self.a), 4096):
            b = self.b[c : c + 4096]
            p = np.exp(self.a[c : c + 4096, None] + b[:, None] * GRID - top)
            z, m, v = z + p.sum(axis=0), m + b @ p, v + (b * b) @ p
        self.log_z, self.mean = np.log(z) + top, m / z
        self.spread = np.maximum(v / z - self.mean**2, 1e-6)
        return self

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.interp(t, GRID, self.log_z), np.interp(t, GRID, self.spread)

    def level(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The level at which n words have that total difficulty, drawn to 0 by the prior: n mean(t) + t = total.

        The left side grows with t; the root is bisected on GRID and interpolated."""
        side = lambda i: n * self.mean[i] + GRID[i]
        lo, hi = np.zeros(len(total), int), np.full(len(total), len(GRID) - 1)
        for _ in range(len(GRID).bit_length()):
            mid = (lo + hi) // 2
            below = side(mid) <= total
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        low, high = side(lo), side(np.minimum(lo + 1, len(GRID) - 1))
        part = np.clip((total - low) / np.where(high > low, high - low, 1), 0, 1)
        return GRID[lo] + part * (GRID[1] - GRID[0]) * (lo + 1 < len(GRID))


@dataclass
class Read:
    """Pages of a batch, their stretches, and what the scale says of them."""

    at: np.ndarray  # word of each occurrence
    stretch: np.ndarray  # stretch of each occurrence
    page: np.ndarray  # page of each stretch
    n: np.ndarray  # occurrences of each stretch
    level: np.ndarray  # of each page
    own: np.ndarray  # of each stretch by itself
    held: np.ndarray  # probability that a stretch is of its page's level
    objective: float


def _cut(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    col = batch.column(batch.schema.get_field_index("at"))
    at, off = col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.offsets)
    size = np.diff(off)
    parts = -(-size // STRETCH)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    stretch = np.repeat(np.cumsum(parts) - parts, size) + place // STRETCH
    page = np.repeat(np.arange(len(size)), parts)
    return at, stretch, page, np.bincount(stretch, minlength=len(page)).astype(float), len(size)


def read(batch: pa.RecordBatch, scale: Scale, rounds: int = 3) -> Read:
    """The levels of a batch's pages: from the middle one of their stretches on, stretches of another level weigh less."""
    at, stretch, page, n, k = _cut(batch)
    total = np.bincount(stretch, weights=scale.b[at], minlength=len(page))
    own = scale.level(total, n)
    z, v = scale.at(own)
    apart = np.log(QUOTED) + total * own - n * z - own**2 / 2 - np.log(n * v + 1) / 2
    parts = np.bincount(page, minlength=k)
    order = np.lexsort((own, page))
    t = np.zeros(k)
    some = np.flatnonzero(parts)
    t[some] = own[order[(np.cumsum(parts) - parts)[some] + parts[some] // 2]]
    for _ in range(rounds):
        with_page = np.log(1 - QUOTED) + total * t[page] - n * np.interp(t, GRID, scale.log_z)[page]
        held = 1 / (1 + np.exp(np.clip(apart - with_page, -50, 50)))
        t = scale.level(np.bincount(page, held * total, k), np.bincount(page, held * n, k))
    with_page = np.log(1 - QUOTED) + total * t[page] - n * np.interp(t, GRID, scale.log_z)[page]
    held = 1 / (1 + np.exp(np.clip(apart - with_page, -50, 50)))
    objective = np.logaddexp(apart, with_page).sum() + scale.a[at].sum() - (t**2).sum() / 2
    return Read(at, stretch, page, n, t, own, held, float(objective))


def _binned(t: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by level, shared between the two neighbouring points of GRID."""
    x = np.clip((t - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1)
    i = np.minimum(x.astype(int), len(GRID) - 2)
    return np.bincount(i, weight * (i + 1 - x), len(GRID)) + np.bincount(i + 1, weight * (x - i), len(GRID))


def _pass(pages: DataFrame, scale: Scale | None, size: int, mean: float, sd: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One round over all pages: occurrences and sum of levels by word, occurrences by level, the objective."""
    shared = pages.sparkSession.sparkContext.broadcast(scale)

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = shared.value
        n, s, g, objective = np.zeros(size), np.zeros(size), np.zeros(len(GRID)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sc is None:  # first levels: by word length
                at, stretch, page, count, _ = _cut(batch)
                start = (batch.column(batch.schema.get_field_index("start")).to_numpy(zero_copy_only=False) - mean) / sd
                level = np.clip(start, -3, 3)[page]
                g += _binned(level, count)
            else:
                r = read(batch, sc)
                at, stretch, level = r.at, r.stretch, r.held * r.level[r.page] + (1 - r.held) * r.own
                g += _binned(r.level[r.page], r.held * r.n) + _binned(r.own, (1 - r.held) * r.n)
                objective += r.objective
            n += np.bincount(at, minlength=size)
            s += np.bincount(at, weights=level[stretch], minlength=size)
        some = np.flatnonzero(n)
        bins = -2 - np.arange(len(GRID))
        keys = np.concatenate((some, bins, [-1]))
        values = [np.concatenate((n[some], g, [objective])), np.concatenate((s[some], np.zeros(len(g) + 1)))]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(v) for v in values)], names=["w", "n", "s"])

    out = pages.select("at", "start").mapInArrow(half, "w long, n double, s double")
    got = out.groupBy("w").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    w, n, s = (got.column(k).to_numpy() for k in range(3))
    shared.unpersist()
    count, total, bins = np.zeros(size), np.zeros(size), np.zeros(len(GRID))
    own = w >= 0
    count[w[own]], total[w[own]] = n[own], s[own]
    bins[-2 - w[w <= -2]] = n[w <= -2]
    return count, total, bins, float(n[w == -1].sum())


def _word_step(scale: Scale, count: np.ndarray, total: np.ndarray, bins: np.ndarray, steps: int = 3) -> float:
    """Newton steps on each word's difficulty; its frequency follows.  The greatest change.

    log Z is bounded by its tangent at the present words, which parts the
    objective by words and keeps it from falling."""
    before = scale.b.copy()
    mass = np.log(np.maximum(bins, 1e-300)) - scale.log_z
    for c in range(0, len(count), 4096):
        part = slice(c, c + 4096)
        b = scale.b[part].copy()
        for _ in range(steps):
            p = mass + b[:, None] * GRID
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            m = p @ GRID
            v = np.maximum(p @ GRID**2 - m**2, 0)
            b += np.clip((total[part] - count[part] * m - RIDGE * b) / (count[part] * v + RIDGE), -0.5, 0.5)
        p = mass + b[:, None] * GRID
        top = p.max(axis=1)
        scale.b[part] = b
        scale.a[part] = np.log(np.maximum(count[part], 1e-3)) - top - np.log(np.exp(p - top[:, None]).sum(axis=1))
    scale.tabulate()
    return float(np.abs(scale.b - before).max(initial=0))


def fit(pages: DataFrame, size: int, rounds: int = 30, tolerance: float = 3e-4) -> Scale:
    """The scale of numbered pages with ``size`` words, by alternating optimisation over all of them.

    Ends when a round adds less than ``tolerance`` to the objective of an
    occurrence (converged), or after ``rounds``."""
    mean, sd = pages.agg(F.avg("start"), F.stddev_pop("start")).first()
    scale = Scale(np.zeros(size), np.zeros(size)).tabulate()
    if mean is None:
        return scale
    count, total, bins, _ = _pass(pages, None, size, mean, max(sd or 0.0, 1e-9))
    scale.a = np.log(np.maximum(count, 1e-3))
    moved = _word_step(scale.tabulate(), count, total, bins)
    last = -np.inf
    for i in range(1, rounds + 1):
        count, total, bins, objective = _pass(pages, scale, size, mean, sd)
        now = float((objective - RIDGE / 2 * float(scale.b @ scale.b)) / max(count.sum(), 1))
        scale.history.append((i, now, moved))
        if now - last < tolerance:
            scale.converged = True
            break
        last = now
        moved = _word_step(scale, count, total, bins)
    return scale


def levels(pages: DataFrame, scale: Scale) -> DataFrame:
    """(doc_id, level): the fitted level of every page; one without words has the prior's, 0."""
    shared = pages.sparkSession.sparkContext.broadcast(scale)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = read(batch, shared.value).level if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level, pa.float64())], names=["doc_id", "level"])

    return pages.select("doc_id", "at").mapInArrow(rate, "doc_id long, level double")


# bands ---------------------------------------------------------------------------------------


def votes_of(graded: DataFrame) -> DataFrame:
    """Each different (doc_id, rater, grade) is a vote."""
    votes = graded.select("doc_id", "rater", F.lower(F.trim("grade")).alias("grade"))
    return votes.where(F.col("grade").isin(*GRADES)).distinct()


def cuts(rated: DataFrame, graded: DataFrame) -> tuple[bool, list[tuple[float, str]]]:
    """Whether the axis runs downwards, and (upper cut, grade) in its order, the last cut being infinite.

    Between neighbouring grades the cut lies midway between their median
    levels, which a few raters who disagree don't move.  Grades nobody gave get no
    band; with no grade at all there are no bands.
    """
    middle = rated.join(votes_of(graded), "doc_id").groupBy("grade").agg(F.percentile_approx("level", 0.5, 10_000).alias("m"))
    med = {r["grade"]: r["m"] for r in middle.collect()}
    known = [g for g in GRADES if g in med]
    down = len(known) > 1 and med[known[-1]] < med[known[0]]
    sign = -1 if down else 1
    known.sort(key=lambda g: sign * med[g])
    tops = [(sign * med[a] + sign * med[b]) / 2 for a, b in zip(known, known[1:])]
    return down, list(zip([*tops, float("inf")][: len(known)], known))


def banded(scored: DataFrame, graded: DataFrame) -> DataFrame:
    """(doc_id, level, band) of levels, the level turned so that it grows with difficulty."""
    down, steps = cuts(scored, graded)
    level = -F.col("level") if down else F.col("level")
    band = F.lit(None).cast("string")
    for top, g in reversed(steps):
        band = F.lit(g) if top == float("inf") else F.when(level < top, g).otherwise(band)
    return scored.select("doc_id", level.alias("level"), band.alias("band"))


def scaled(documents: DataFrame) -> tuple[DataFrame, Scale]:
    """(doc_id, level) of every page whose main text is English prose, and the scale.

    documents: (doc_id, text[, lang]); without ``lang``, or labels in it, language is not looked at."""
    boiler = boilerplate(documents)
    languages = language_model(documents, boiler) if "lang" in documents.columns else None
    pages = written(prose(documents, boiler, languages), "pages")
    vocab = vocabulary(pages)
    known = written(numbered(pages, vocab), "numbered")
    scale = fit(known, len(vocab) + LENGTHS)
    return written(levels(known, scale), "levels"), scale


def rated(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """(doc_id, level, band): every page whose main text is English prose.

    Null, empty, foreign, list and error pages are left out, and pages without
    an id.  Repeated rows give repeated results.  Without grades band is null.
    """
    return banded(scaled(documents)[0], graded)


def held_out(scored: DataFrame, graded: DataFrame) -> DataFrame:
    """(grade, band, n): grades of one half of the graded pages against bands whose cuts were fitted to the other half."""
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    rest = banded(scored, graded.where(half == 0)).join(votes_of(graded.where(half == 1)), "doc_id")
    return rest.groupBy("grade", "band").agg(F.count(F.lit(1)).alias("n"))
