"""Held-out passages inside a corpus, by q-gram counting and alignment.

Every document is reduced to words (runs of letters and digits; case, accents,
punctuation, markup and invisible characters don't count).  Its character
q-grams are looked up in an index of the held-out passages; each hit lies on a
diagonal (word position in the document less word position in the passage), and
hits are counted per passage in overlapping diagonal bands.  By the q-gram
lemma a document that carries a passage shares at least a known number of
q-grams with it inside one band:

* ``run_words`` successive words keep all q-grams of that stretch, on a single
  diagonal;
* if a third of the words may be lost and any words may come between, the inner
  q-grams of every kept word survive, so the count is at least the sum over the
  two thirds of the words with the fewest inner q-grams.

Bands that stay below their bound are dropped without losing a case; the rest
are verified exactly by aligning words within the band.  Runs are counted in
narrow bands, as they lie on one diagonal; shares in bands as wide as kept words
can move, over inner q-grams only.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.shared import spread

Q = 6
RUN_WORDS = 12
SHARE = (2, 3)
STRETCH = (3, 2)
ITEM_BLOCK = 2000  # passages of one index
BLOCKS = 5  # indexes held by a task at a time
NARROW = 16  # diagonals of a band in which runs are counted
SLICE_WORDS = 30_000  # longer documents are searched in overlapping slices
WORK_BYTES = 200_000  # normalised text searched at a time

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_BREAKING = frozenset({"br", "p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "hr"})


@functools.cache
def _unseen() -> re.Pattern:
    """Marks and format characters, which don't count."""
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")]
    ends = [i for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    spans = zip([0, *(i + 1 for i in ends[:-1])], ends)
    return re.compile("[" + "".join(f"\\U{codes[a]:08x}-\\U{codes[z]:08x}" for a, z in spans) + "]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, in the form in which they are compared."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[1].lower() in _BREAKING else "", text)
    if "&" in text:
        text = html.unescape(text.casefold())  # entities occur in either case
    if not text.isascii():
        text = _unseen().sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def _grams(data: np.ndarray) -> np.ndarray:
    """All q-grams of a byte array as integers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class PassageIndex:
    """Inverted q-gram index of a bounded block of passages."""

    bits = 20

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, w) for i, w in ((i, words_of(p)) for i, p in items) if w]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = [w for _, w in items]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.sizes = sizes
        grams, item, word, inner = [], [], [], []
        self.need = -(-sizes * SHARE[0] // SHARE[1])
        self.window = sizes * STRETCH[0] // STRETCH[1]
        self.bound_run = np.full(len(items), np.iinfo(np.int64).max)
        self.bound_share = np.zeros(len(items), np.int64)
        for k, w in enumerate(self.words):
            data = np.frombuffer((" " + " ".join(w) + " ").encode(), np.uint8)
            g = _grams(data)
            at = np.cumsum(data == 32)[: len(g)] - 1
            length = np.array([len(x.encode()) for x in w])
            ends = np.cumsum(length + 1)  # position of the blank behind each word
            inside = np.arange(len(g)) + Q - 1 <= ends[np.minimum(at, len(w) - 1)]
            grams.append(g)
            item.append(np.full(len(g), k))
            word.append(at)
            inner.append(inside)
            own = np.maximum(0, length + 3 - Q)
            self.bound_share[k] = np.sort(own)[: self.need[k]].sum()
            if len(w) >= RUN_WORDS:
                span = np.convolve(length + 1, np.ones(RUN_WORDS, int), "valid") + 1
                self.bound_run[k] = max(0, span.min() - Q + 1)
        # passages of so short words that no q-gram must survive are found by words:
        # of as many as may be lost and one more, at least one is kept
        self.by_word: dict[str, list[int]] = {}
        for k in np.flatnonzero(self.bound_share < 1).tolist():
            telling = sorted(self.words[k], key=len, reverse=True)[: int(sizes[k] - self.need[k]) + 1]
            for w in set(telling):
                self.by_word.setdefault(w, []).append(k)
        # kept matches move by at most the words lost plus the words put between
        self.band = np.maximum(8, (self.window - self.need) + (sizes - self.need) + 2)
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.gram, first, count = np.unique(grams[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        cat = lambda x: np.concatenate(x)[order] if x else np.zeros(0, np.int64)
        self.item, self.word, self.inner = cat(item).astype(np.int32), cat(word).astype(np.int32), cat(inner).astype(bool)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[_slot(self.gram, self.bits)] = True
        # inner q-grams per word of each passage, to tell fully covered words
        self.word_base = np.r_[0, np.cumsum(sizes)]
        self.inner_per_word = np.bincount(self.word_base[self.item] + self.word, weights=self.inner, minlength=int(self.word_base[-1]) + 1).astype(np.int64)
        checkable = self.inner_per_word[: self.word_base[-1]] > 0
        owner = np.repeat(np.arange(len(items)), sizes)
        self.need_covered = np.bincount(owner, weights=checkable, minlength=len(items)).astype(np.int64) - (sizes - self.need)
        self.masks = []
        for w in self.words:
            mask: dict[str, int] = {}
            for j, x in enumerate(w):
                mask[x] = mask.get(x, 0) | (1 << j)
            self.masks.append(mask)

    # -- filtering ---------------------------------------------------------
    def candidates(self, pieces: list[list[str]]) -> tuple[set, set]:
        """Regions to verify: {(piece, item, lowest diagonal)} of narrow bands that
        may hold a run, and the same of wide bands that may hold a share."""
        runs: set[tuple[int, int, int]] = set()
        shares: set[tuple[int, int, int]] = set()
        if not len(self.ids):
            return runs, shares
        if self.by_word:
            for p, w in enumerate(pieces):
                for k in {k for x in set(w) & self.by_word.keys() for k in self.by_word[x]}:
                    shares |= {(p, k, d) for d in range(-int(self.sizes[k]), len(w), int(self.band[k]))}
        sizes = np.array([len(w) for w in pieces], np.int64)
        data = np.frombuffer("\n".join(" " + " ".join(w) + " " if w else "" for w in pieces).encode(), np.uint8)
        g = _grams(data)
        if not len(g):
            return runs, shares
        hit = np.flatnonzero(self.filter[_slot(g, self.bits)])
        at = np.minimum(np.searchsorted(self.gram, g[hit]), len(self.gram) - 1)
        true = self.gram[at] == g[hit]
        hit, at = hit[true], at[true]
        if not len(hit):
            return runs, shares
        piece = np.cumsum(data == 10)[hit]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        extra = np.cumsum(sizes > 0)[piece] - 1  # every piece has one blank more than words
        local = np.cumsum(data == 32)[hit] - 1 - extra - starts[piece]
        times = self.count[at]
        post = np.repeat(self.first[at] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(int(times.sum()))
        piece, diagonal = np.repeat(piece, times), np.repeat(local, times) - self.word[post]
        found, member = self._bands(sizes, piece, diagonal, post, np.full(len(self.ids), NARROW), self.bound_run)
        if found:
            # most q-grams on one diagonal of the band
            lowest = np.array([d for _, _, d in found])
            line, on_line = np.unique(member[0] * 2 * NARROW + diagonal[member[1]] - lowest[member[0]], return_counts=True)
            most = np.zeros(len(found), np.int64)
            np.maximum.at(most, line // (2 * NARROW), on_line)
            runs |= {f for f, m in zip(found, most) if m >= self.bound_run[f[1]]}
        inner = self.inner[post]
        found, member = self._bands(sizes, piece[inner], diagonal[inner], post[inner], self.band, np.maximum(1, self.bound_share))
        if found:
            # passage words all of whose inner q-grams occur in the band
            band, place = member[0], post[inner][member[1]]
            seen = np.unique(band * len(self.item) + place)
            band, place = seen // len(self.item), seen % len(self.item)
            total = int(self.word_base[-1])
            word, got = np.unique(band * total + self.word_base[self.item[place]] + self.word[place], return_counts=True)
            full = got == self.inner_per_word[word % total]
            covered = np.bincount(word[full] // total, minlength=len(found))
            shares |= {f for f, c in zip(found, covered) if c >= max(1, self.need_covered[f[1]])}
        return runs, shares

    def _bands(self, sizes, piece, diagonal, post, width, bound):
        """Bands of two neighbouring cells of ``width`` diagonals with at least
        ``bound`` hits, as (piece, item, lowest diagonal), and the hits in them as
        (number of the band, number of the hit)."""
        item = self.item[post]
        room = int(self.sizes.max()) + 3 * int(width.max()) + 2  # so that no band reaches into another piece
        base = np.cumsum(sizes + room) - sizes
        cells_of = (int(base[-1] + sizes[-1]) + room) // width + 3
        offset = np.r_[0, np.cumsum(cells_of)]
        cell = offset[item] + (base[piece] + diagonal) // width[item]
        counts = np.bincount(cell, minlength=int(offset[-1]) + 1)
        kept = counts[:-1] + counts[1:] >= np.repeat(bound, cells_of)
        kept[offset[1:] - 1] = False
        names = np.flatnonzero(kept)
        if not len(names):
            return [], None
        k = np.searchsorted(offset, names, side="right") - 1
        lowest = (names - offset[k]) * width[k]
        p = np.clip(np.searchsorted(base - room // 2, lowest + width[k], side="right") - 1, 0, len(sizes) - 1)
        bands = list(zip(p.tolist(), k.tolist(), (lowest - base[p]).tolist()))
        number = np.cumsum(kept) - 1
        members = []
        for shift in (0, 1):
            inside = np.flatnonzero((cell >= shift) & kept[np.maximum(cell - shift, 0)])
            members.append((number[cell[inside] - shift], inside))
        return bands, (np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members]))

    # -- verification ------------------------------------------------------
    def _has_run(self, words: list[str], k: int) -> bool:
        """``RUN_WORDS`` successive words of passage k: bit j of ``state[r]``
        says that r+1 words ending at passage word j ended at the last word."""
        masks, full = self.masks[k], RUN_WORDS
        run: dict[int, int] = {}
        for w in words:
            mask = masks.get(w, 0)
            new: dict[int, int] = {}
            while mask:
                low = mask & -mask
                j = low.bit_length() - 1
                length = run.get(j - 1, 0) + 1
                if length >= full:
                    return True
                new[j] = length
                mask ^= low
            run = new
        return False

    def _aligned(self, words: list[str], at: list[int], k: int, lowest: int) -> int:
        """Most passage words found in their order on diagonals from ``lowest``
        over two widths of the band: bit-parallel, banded alignment.  ``at`` holds
        the positions of the words."""
        masks, size = self.masks[k], int(self.sizes[k])
        ones, stripe = (1 << size) - 1, (1 << 2 * int(self.band[k])) - 1
        v = ones
        for w, i in zip(words, at):
            shift = i - lowest - 2 * int(self.band[k]) + 1  # lowest passage word of the band at this position
            u = v & masks[w] & (stripe << shift if shift >= 0 else stripe >> -shift)
            if u:
                v = ((v + u) | (v - u)) & ones
        return size - v.bit_count()

    def has_share(self, words: list[str], k: int, lowest: int) -> bool:
        need, window, masks = int(self.need[k]), int(self.window[k]), self.masks[k]
        a, z = max(0, lowest), lowest + 2 * int(self.band[k]) + int(self.sizes[k])
        at = [i for i in range(a, min(z, len(words))) if words[i] in masks]
        known = [words[i] for i in at]
        if len(known) < need or self._aligned(known, at, k, lowest) < need:
            return False
        for s in range(len(known) - need + 1):
            e = bisect.bisect_left(at, at[s] + window)
            if e - s >= need and self._aligned(known[s:e], at[s:e], k, lowest) >= need:
                return True
        return False

    def has_run(self, words: list[str], k: int, lowest: int) -> bool:
        return self._has_run(words[max(0, lowest) : max(0, lowest + 2 * NARROW + int(self.sizes[k]))], k)

    def search(self, texts: list[list[str]]) -> list[list[int]]:
        """Ids of the passages each text carries, ascending."""
        found: list[set[int]] = [set() for _ in texts]
        pieces: list[list[str]] = []
        owner: list[int] = []
        size = 0
        lap = int(self.window.max() + 2 * self.band.max() + self.sizes.max()) if len(self.ids) else 0

        def flush():
            nonlocal size
            for regions, holds in zip(self.candidates(pieces), (self.has_run, self.has_share)):
                for p, k, lowest in regions:
                    if k not in found[owner[p]] and holds(pieces[p], k, lowest):
                        found[owner[p]].add(k)
            pieces.clear()
            owner.clear()
            size = 0

        for t, words in enumerate(texts):
            for a in range(0, max(1, len(words)), SLICE_WORDS):
                piece = words[a : a + SLICE_WORDS + lap]
                if not piece:
                    continue
                pieces.append(piece)
                owner.append(t)
                size += sum(map(len, piece)) + len(piece)
                if size >= WORK_BYTES:
                    flush()
        if pieces:
            flush()
        return [sorted(self.ids[k] for k in f) for f in found]


def _searcher(indexes: list[PassageIndex]):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [words_of(t) for t in batch.column(1).to_pylist()]
            docs, items = [], []
            for index in indexes:
                for i, hits in zip(ids, index.search(texts)):
                    docs += [i] * len(hits)
                    items += [int(h) for h in hits]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], schema=schema)

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id) for every document that carries a passage.

    The passages reach the tasks in indexes of ``ITEM_BLOCK``, ``BLOCKS`` of them
    at a time, so what a task holds is bounded whatever their number; documents
    are read and normalised once per ``ITEM_BLOCK * BLOCKS`` passages and never
    shuffled for the search.  Defined results: null or empty texts and passages
    carry nothing; a passage of fewer than 12 words can only be found by its
    share; rows with null ids are left out; repeated rows count once.
    """
    docs = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    docs = spread(docs, "doc_id")
    passages = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("bigint"), "passage").dropDuplicates(["item_id", "passage"])
    parts = max(1, math.ceil(passages.count() / (ITEM_BLOCK * BLOCKS)))
    found = None
    for part in range(parts):
        # about ITEM_BLOCK * BLOCKS rows, dealt evenly by hash
        own = sorted((r[0], r[1]) for r in passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts)) == part).collect())
        indexes = [PassageIndex(own[a : a + ITEM_BLOCK]) for a in range(0, max(1, len(own)), ITEM_BLOCK)]
        hits = docs.mapInArrow(_searcher(indexes), "doc_id bigint, item_id bigint")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()
