"""Evaluation passages in a training corpus.

Method: suffix arrays.  Each partition of the corpus is a shard.  Its texts
become word numbers (of the words that occur in the evaluation items; all
others are 0 and match nothing), and all their suffixes are sorted, to the depth
of the longest item.  Every suffix of every item is looked up by binary search;
the stretch of the array it falls into gives all places with a verbatim match
of so many words as any carried run must hold in one piece: e changed words
part a run of L words into e + 1 pieces, so one has (L - e) / (e + 1) words or
more.  No window is left out for being frequent.  From these places an item
and a page are aligned exactly: the longest run of the item with at most one
word in ten changed, added or left out, and the longest verbatim match.

Items are sent to the shards in blocks of a bounded size; one block is one
pass over the corpus, so any number of items can be searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.words import spellings, words
from chronolith.session import written

#: Places of matches in a shard that are aligned at a time.
HITS = 1_000_000
#: Beginnings of runs that are followed at a time.
STARTS = 4096
#: Words of the windows that are counted before a page and an item are aligned, and how many words can be told in them.
TRIPLE, MAX_VOCAB = 3, 1 << 21
PLACES = ["run_words", "item_words", "run_item_at", "run_page_at", "verbatim_words", "verbatim_item_at", "verbatim_page_at"]
FOUND = "item_id long, doc_id long, " + ", ".join(f"{c} int" for c in PLACES)


class Items:
    """A block of evaluation items as word numbers; items of one wording are searched once."""

    def __init__(self, rows: Iterable[tuple[int, str | None]], share: float, slack: float):
        self.share, self.slack = share, slack
        self.vocab: dict[bytes, int] = {}
        texts = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)], t) for i, t in rows if t]
        for _, _, t in texts:
            for base, *more in spellings(t):
                for m in more:
                    self.vocab.setdefault(m, self.vocab[base])
        if len(self.vocab) >= MAX_VOCAB:
            raise ValueError("E_BUDGET: a block of items with too many different words")
        copies: dict[tuple[int, ...], list[int]] = {}
        for i, w, _ in texts:
            if w:
                copies.setdefault(tuple(w), []).append(i)
        self.ids = list(copies.values())
        self.words = [np.array(w, np.int64) for w in copies]
        self.least = np.array([max(1, int(np.ceil(share * len(w) - 1e-9))) for w in self.words], np.int64)
        self.piece = np.array([piece(int(least), len(w), slack) for least, w in zip(self.least, self.words)], np.int64)
        self.starts = np.cumsum([0, *(len(w) + 1 for w in self.words)])
        self.flat = np.zeros(int(self.starts[-1]) + 1, np.int64)
        for s, w in zip(self.starts, self.words):
            self.flat[s : s + len(w)] = w
        # every suffix that is long enough for a piece: item, place in the item, words looked up
        at = [(x, p) for x, w in enumerate(self.words) for p in range(len(w) - int(self.piece[x]) + 1)]
        self.item, self.pos = (np.array([a[i] for a in at], np.int64) for i in range(2))
        self.look = self.piece[self.item]
        self.depth = max(map(len, self.words), default=1)
        # a run of L words with e edits keeps L - TRIPLE + 1 - TRIPLE e windows of TRIPLE words
        self.windows = [packed(w) for w in self.words]
        self.intact = [
            min(L - TRIPLE + 1 - TRIPLE * int(slack * L + 1e-9) for L in range(int(n), len(w) + 1)) for n,
            w in zip(self.least, self.words)
        ]

    def numbers(self, text: str | None) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in words(text)]


def packed(flat: np.ndarray) -> np.ndarray:
    """Every window of TRIPLE word numbers (of 21 bits) as one number."""
    n = max(0, len(flat) - TRIPLE + 1)
    out = np.zeros(n, np.int64)
    for i in range(TRIPLE):
        out = (out << 21) | flat[i : i + n]
    return out


def piece(least: int, n: int, slack: float) -> int:
    """Words in one piece that every run of ``least`` to ``n`` words keeps, wherever its edits fall."""
    edits = lambda length: int(slack * length + 1e-9)
    return min(max(1, -(-(length - edits(length)) // (edits(length) + 1))) for length in range(least, n + 1))


class Shard:
    """The suffix array of one shard's texts, sorted to ``depth`` words (or to the next unknown word).

    Prefix doubling: suffixes are sorted by as many words as fit a machine word,
    then those that are still equal by the rank of what follows, twice as deep each
    round."""

    def __init__(self, texts: list[list[int]], depth: int):
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        n = int(self.starts[-1])
        flat = np.zeros(n + 1, np.int64)
        for s, t in zip(self.starts, texts):
            flat[s : s + len(t)] = t
        self.flat = flat
        stops = np.flatnonzero(flat == 0)
        known = stops[np.searchsorted(stops, np.arange(n + 1))] - np.arange(n + 1)  # words up to the next unknown one
        at = np.flatnonzero(flat)
        bits = max(1, int(flat.max(initial=0)).bit_length())
        wide = max(1, 62 // bits)
        key = np.zeros(len(at), np.int64)
        for k in range(wide):
            key = (key << bits) | np.where(known[at] > k, flat[np.minimum(at + k, n)], 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        rank = np.zeros(n + 1, np.int64)  # 1 + first place in the array of the suffixes equal so far
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(at) else np.zeros(0, bool)
        rank[at] = np.flatnonzero(first)[np.cumsum(first) - 1] + 1 if len(at) else 0
        while wide < depth and len(at):
            size = np.diff(np.concatenate((np.flatnonzero(first), [len(at)])))
            tied = np.flatnonzero((np.repeat(size, size) > 1) & (known[at] >= wide))
            if not len(tied):
                break
            some = at[tied]
            key = rank[some] * (n + 2) + rank[np.minimum(some + wide, n)]
            order = np.argsort(key, kind="stable")
            at[tied], key = some[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first[tied] = new
            rank[at[tied]] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
            wide *= 2
        self.suffixes = at

    def bounds(self, flat: np.ndarray, at: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (``look`` words of ``flat`` from ``at``): first and last place in the array that begins with it."""
        return self._bisect(flat, at, look, False), self._bisect(flat, at, look, True)

    def _bisect(self, flat: np.ndarray, at: np.ndarray, look: np.ndarray, beyond: bool) -> np.ndarray:
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._before(flat, at[open_], look[open_], self.suffixes[mid], beyond)
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def _before(self, flat: np.ndarray, at: np.ndarray, look: np.ndarray, suffix: np.ndarray, beyond: bool) -> np.ndarray:
        """Whether suffixes come before their queries (``beyond``: also those that begin with them)."""
        out = np.full(len(at), beyond)
        live, k, end = np.arange(len(at)), 0, len(self.flat) - 1
        while len(live := live[look[live] > k]):
            a, b = self.flat[np.minimum(suffix[live] + k, end)], flat[at[live] + k]
            differ = a != b
            out[live[differ]] = (a < b)[differ]
            live, k = live[~differ], k + 1
        return out


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and members of the ranges [lo, hi)."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def longest_run(item: np.ndarray, doc: np.ndarray, least: int, slack: float, diagonals: np.ndarray) -> tuple[int, int, int] | None:
    """The longest run of ``item`` in ``doc`` with at most ``slack`` of its words changed, added or left out.

    Gives its words, place in the item and place in the text; None if it is
    shorter than ``least``.  A run begins and ends with a word that stands in
    both, so it begins where a piece of verbatim match does.  All beginnings near
    the given diagonals (text place - item place) are followed word by word
    together, each with the edit distances of the diagonals in its reach; those
    beyond the edits allowed are dropped.  Of equally long runs the one with
    the fewest edits counts, then the first in the item, then in the text.
    """
    n = len(item)
    reach = int(slack * n + 1e-9) + 1
    lines = np.unique((np.unique(diagonals)[:, None] + np.arange(-reach, reach + 1)).ravel())
    pad = n + 2 * reach + 1
    text = np.concatenate((np.full(pad, -1, np.int64), doc, np.full(pad, -1, np.int64)))
    lines = lines[(lines > -n) & (lines < len(doc))]
    w = np.arange(2 * reach + 1)
    best: tuple[int, int, int, int] | None = None
    for c in range(0, len(lines), STARTS):
        some = lines[c : c + STARTS]
        same = text[some[:, None] + np.arange(n) + pad] == item
        row, a = np.nonzero(same & ~np.concatenate((np.zeros((len(some), 1), bool), same[:, :-1]), axis=1))
        d = some[row]
        ok = n - a >= least
        a, d = a[ok], d[ok]
        for k in range(0, len(a), STARTS):
            found = _followed(item, text, pad, a[k : k + STARTS], d[k : k + STARTS], w - reach, least, slack)
            best = max((x for x in (best, found) if x), default=None)
    return (best[0], -best[2], -best[3]) if best else None


def _followed(
    item: np.ndarray, text: np.ndarray, pad: int, a: np.ndarray, d: np.ndarray, off: np.ndarray, least: int,
    slack: float
) -> tuple[int, int, int, int] | None:
    """The longest run from the beginnings (place a in the item, diagonal d): words, and negated edits and places."""
    n, far, cols = len(item), 1 << 20, np.arange(len(off))
    best = None
    cost = np.broadcast_to(np.where(off >= 0, off, far), (len(a), len(off))).astype(np.int64)
    for t in range(n):
        if t:
            on = (a + t < n) & (cost.min(axis=1) <= slack * (n - a) + 1e-9)
            a, d, cost = a[on], d[on], cost[on]
            if not len(a):
                break
        same = text[(a + t + d + pad)[:, None] + off] == item[a + t][:, None]
        if t:
            left_out = np.concatenate((cost[:, 1:], np.full((len(a), 1), far)), axis=1) + 1
            cost = np.minimum(cost + ~same, left_out)
            cost = np.minimum.accumulate(cost - cols, axis=1) + cols  # words added in the text
        else:
            same = same & (off == 0)
        if t + 1 >= least:
            ends = np.where(same, cost, far).min(axis=1)
            i = np.lexsort((a + d, a, ends))[0]
            if ends[i] <= slack * (t + 1) + 1e-9:
                best = (t + 1, -int(ends[i]), -int(a[i]), -int(a[i] + d[i]))
    return best


def longest_verbatim(pos: np.ndarray, place: np.ndarray, look: int) -> tuple[int, int, int]:
    """From the places of an item's suffixes in a text: words of the longest verbatim match, and where it begins in the item
    and in the text; the first of equals.

    Matches of suffixes that follow each other on one diagonal are one match."""
    order = np.lexsort((pos, place - pos))
    p, q = pos[order], place[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(q - p) != 0) | (np.diff(p) != 1))))
    length = np.diff(np.concatenate((cut, [len(p)]))) + look - 1
    best = np.lexsort((q[cut], p[cut], -length))[0]
    return int(length[best]), int(p[cut[best]]), int(q[cut[best]])


def leaked(
    documents: DataFrame, items: DataFrame | Iterable[tuple[int, str | None]], doc_id: str = "doc_id", text: str = "text",
    share: float = 0.4, slack: float = 0.1, shard_chars: int = 16_000_000, block_chars: int = 8_000_000,
) -> DataFrame:
    """Rows (item_id, doc_id, and PLACES): documents that carry an item, how much of it and where.

    An item is carried if a run of at least ``share`` of its words stands in the
    text in order, with at most ``slack`` of the run's words changed, added or
    left out.  ``run_words`` is the length of the longest such run,
    ``verbatim_words`` that of the longest verbatim match; ``*_item_at`` and
    ``*_page_at`` are where they begin, in words() from 0.  Whole texts are read.

    Null and empty texts carry nothing; items without words are never found; a
    document given twice is found twice; one without an id can't be named and is
    left out.  Shards are cut off at ``shard_chars`` characters to bound memory,
    between documents, so nothing is lost.  ``items``: (item_id, text), a frame or
    rows; they come in blocks of ``block_chars`` characters, of which the driver and
    each task hold one at a time; where there are several, each pass is written.
    """
    rows = ((r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator()) if isinstance(items, DataFrame) else iter(items)
    found, block, size = None, [], 0

    def searched(more: bool) -> DataFrame:
        out = _searched(documents.select(doc_id, text), Items(block, share, slack), shard_chars)
        out = written(out, "leaks") if more or found is not None else out
        return out if found is None else found.unionAll(out)

    for i, t in rows:
        if i is None:
            continue
        if block and size + len(t or "") > block_chars:
            found, block, size = searched(True), [], 0
        block.append((int(i), t))
        size += len(t or "")
    return searched(False)


def _searched(documents: DataFrame, items: Items, shard_chars: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        ids: list[int] = []
        texts: list[list[int]] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and i is not None:
                    ids.append(i)
                    texts.append(it.numbers(t))
                    size += len(t)
                if size >= shard_chars:
                    yield _matches(it, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _matches(it, ids, texts)

    return documents.mapInArrow(search, FOUND)


def _pairs(shard: Shard, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Places found, (item, text, place in item, place in text), a group for each item and text."""
    row, member = _spread(lo, hi)
    place = shard.suffixes[member]
    doc = np.searchsorted(shard.starts, place, "right") - 1
    h = np.stack([item[row], doc, pos[row], place - shard.starts[doc]])
    h = h[:, np.lexsort((h[2], h[1], h[0]))]
    cut = np.flatnonzero((np.diff(h[0]) != 0) | (np.diff(h[1]) != 0)) + 1
    return np.split(h, cut, axis=1) if h.shape[1] else []


def _matches(it: Items, ids: list[int], texts: list[list[int]]) -> pa.RecordBatch:
    out: list[tuple[int, ...]] = []
    if len(it.item):
        shard = Shard(texts, it.depth)
        lo, hi = shard.bounds(it.flat, it.starts[it.item] + it.pos, it.look)
        # items go in blocks of about HITS places, so that phrases on many pages don't fill the memory
        block = np.cumsum(np.bincount(it.item, hi - lo, len(it.words))) // HITS
        windows = packed(shard.flat)
        for b in np.unique(block):
            of = block[it.item] == b
            for group in _pairs(shard, lo[of], hi[of], it.item[of], it.pos[of]):
                x, d = int(group[0, 0]), int(group[1, 0])
                w, at, end = it.words[x], shard.starts[d], shard.starts[d] + len(texts[d])
                if it.intact[x] > 1 and np.isin(it.windows[x], windows[at:end]).sum() < it.intact[x]:
                    continue
                doc = shard.flat[at:end]
                run = longest_run(w, doc, int(it.least[x]), it.slack, group[3] - group[2])
                if run:
                    places = (run[0], len(w), *run[1:], *longest_verbatim(group[2], group[3], int(it.piece[x])))
                    out.extend((i, ids[d], *places) for i in it.ids[x])
    cols = list(zip(*out)) if out else [[]] * (2 + len(PLACES))
    arrays = [pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays(arrays, names=["item_id", "doc_id", *PLACES])


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without the documents that carry an item; a null doc_id stays."""
    return documents.join(found.select(doc_id).distinct(), doc_id, "left_anti")
