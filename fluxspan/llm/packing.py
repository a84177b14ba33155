"""Texts of varying length into containers of fixed capacity.

Lexical retrieval packing: documents are indexed in shards by an inverted BM25
index.  In every shard the longest unused document seeds a container, the index
returns its unused neighbours by BM25 score, and they fill the container's
window greedily while they fit; what room remains goes to the largest unused
texts that fit exactly or best.  A text is split only if it alone exceeds the
capacity: into full pieces and one rest, which is packed like a text.

Up to ``SHARD`` documents are one shard.  Larger corpora are cut into shards of
at most about that size along a tree of two-means splits of the documents' BM25
weights, grown from samples until its leaves are small enough, so every task's
work is bounded and similar texts stay together at any size.  Neighbours in
other shards are no candidates; only containers of small texts are spread over
the room that is left in those of other shards.  Document frequencies and the mean length are
counted over the whole corpus, the former in a fixed number of hashed buckets.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.shared import checkpointed, spread

TOKENIZER = os.environ.get("FLUXSPAN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# fixed value: the published splitting pattern of the byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TERM_BUCKETS = 1 << 16
SHARD = 50_000
PLANS = 1000  # plans handled at a time
SAMPLE = 20_000  # documents from which a round of splits is learnt
DIM = 128  # random projections of a document's term weights
ROUNDS = 8  # of splits; each makes the leaves up to SAMPLE / 40 times smaller
K1, B = 1.2, 0.75
ENCODE_CHARS = 50_000  # longest stretch handed to the tokenizer at once

_ENCODERS: dict[str, object] = {}
_SPLIT = re.compile(r"\w+")

TOKENISED = "doc_id bigint, digest bigint, n_tokens int, terms array<int>, counts array<int>"
PLACED = "plan_id bigint, container string, capacity int, doc_id bigint, text_no int, piece int, first_token int, n_tokens int"


def encoder(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("fluxspan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a whole text.  Very long texts are cut ahead of a blank that
    follows a non-blank, where the splitting pattern starts a new token anyway."""
    enc = encoder(path)
    if len(text) <= ENCODE_CHARS:
        return len(enc.encode_ordinary(text))
    total, a = 0, 0
    while a < len(text):
        z = min(len(text), a + ENCODE_CHARS)
        while a < z < len(text) and not (text[z] == " " and not text[z - 1].isspace() and z + 1 < len(text) and text[z + 1].isalpha()):
            z += 1
        total += len(enc.encode_ordinary(text[a:z]))
        a = z
    return total


def _term(word: str) -> int:
    """Bucket of a word (FNV-1a; stable across workers)."""
    h = 2166136261
    for b in word.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 16)) % TERM_BUCKETS


def _tokenise(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_tokens", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                sizes.append(count_tokens(text, path))
                bag: dict[int, int] = {}
                for w in _SPLIT.findall(text.lower()):
                    t = known.get(w)
                    if t is None:
                        t = _term(w)
                        if len(known) < 200_000:
                            known[w] = t
                    bag[t] = bag.get(t, 0) + 1
                terms.append(list(bag))
                counts.append(list(bag.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], schema=schema)

    return run


def tokenised(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, text_no, size in tokens and hashed terms of every distinct text of
    a document.  Texts are tokenised where they are read; what is shuffled to
    drop repeats are sizes and terms."""
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    bags = spread(texts, "doc_id").mapInArrow(_tokenise(tokenizer), TOKENISED)
    once = bags.repartition("doc_id").dropDuplicates(["doc_id", "digest"])
    order = W.Window.partitionBy("doc_id").orderBy("digest")
    return once.withColumn("text_no", (F.row_number().over(order) - 1).cast("int")).drop("digest")


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _weights(flat: np.ndarray, tf: np.ndarray, lengths, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 weight of each term of each document; ``lengths`` per term."""
    return idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / max(1.0, mean_length)))


_SIGNS: dict[int, np.ndarray] = {}


def projected(terms: list, counts: list, df: np.ndarray, n_docs: int, mean_length: float) -> np.ndarray:
    """Unit vectors of DIM random projections of the documents' BM25 weights."""
    if DIM not in _SIGNS:
        _SIGNS[DIM] = (np.random.default_rng(0).integers(0, 2, (TERM_BUCKETS, DIM)) * 2 - 1).astype(np.float32)
    signs, idf = _SIGNS[DIM], _idf(df, n_docs)
    out = np.zeros((len(terms), DIM), np.float32)
    for i, (t, c) in enumerate(zip(terms, counts)):
        if len(t):
            t, tf = np.sort(np.asarray(t, np.int64)), np.asarray(c, float)[np.argsort(t, kind="stable")]
            out[i] = _weights(t, tf, tf.sum(), idf, mean_length).astype(np.float32) @ signs[t]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def two_means(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Direction and threshold that part ``x``; None if all rows are alike."""
    centred = x - x.mean(axis=0)
    axis = centred[np.argmax((centred * centred).sum(axis=1))].astype(float)
    if np.linalg.norm(axis) < 1e-4:
        return None
    for _ in range(10):
        axis = centred.T @ (centred @ axis)
        axis /= max(np.linalg.norm(axis), 1e-30)
    at = float(np.median(x @ axis))
    for _ in range(10):
        right = x @ axis > at
        if not 0 < right.sum() < len(x):
            break
        a, b = x[~right].mean(axis=0), x[right].mean(axis=0)
        axis, at = b - a, float((b @ b - a @ a) / 2)
    right = x @ axis > at
    if min(right.sum(), len(x) - right.sum()) < 0.02 * len(x):  # a few odd ones: halve along the main direction
        _, _, rows = np.linalg.svd(centred, full_matrices=False)
        axis = rows[0]
        order = np.unique(x @ axis)
        at = float(order[(len(order) - 1) // 2])
        right = x @ axis > at
    return (axis, at) if 0 < right.sum() < len(x) else None


def split_tree(x: np.ndarray, share: float, shard: int):
    """Nested (direction, threshold, left, right), None for leaves.  Every row of
    ``x`` stands for ``share`` documents; leaves stand for at most ``shard`` of
    them, or for at least 20 rows of ``x``, or can't be parted."""
    if len(x) * share <= shard or len(x) < 40 or (cut := two_means(x)) is None:
        return None
    right = x @ cut[0] > cut[1]
    return (*cut, split_tree(x[~right], share, shard), split_tree(x[right], share, shard))


def leaves(x: np.ndarray, tree, path: str = "") -> np.ndarray:
    """Path of the leaf each row of ``x`` falls into."""
    if tree is None:
        return np.full(len(x), path, object)
    out, right = np.empty(len(x), object), x @ tree[0] > tree[1]
    out[~right], out[right] = leaves(x[~right], tree[2], path + "0"), leaves(x[right], tree[3], path + "1")
    return out


def with_class(docs: DataFrame, df: np.ndarray, n_docs: int, mean_length: float, shard: int) -> tuple[DataFrame, dict[str, int]]:
    """``docs`` with the class each falls into, and the classes' sizes.  Names of
    similar classes follow each other.  Leaves above ``shard`` documents are split
    again from a sample of their own, unless their documents are all alike."""
    out, sizes = docs.withColumn("class", F.lit("")), {"": n_docs}
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    fixed: set[str] = set()
    for _ in range(ROUNDS):
        large = sorted(c for c, n in sizes.items() if n > shard and c not in fixed)
        if not large:
            break
        total = sum(sizes[c] for c in large)
        # a fixed sample, the same share of each large leaf but enough of every one
        least = max(40, SAMPLE // len(large) // 4)
        share = {c: min(1.0, max(SAMPLE / total, least / sizes[c])) for c in large}
        limit = F.element_at(F.create_map(*[F.lit(x) for c in large for x in (c, share[c])]), F.col("class"))
        picked = out.where(F.col("class").isin(large)).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit * 1_000_000).select("doc_id", "class", "terms", "counts").toPandas().sort_values("doc_id")
        trees = {}
        for c, own in picked.groupby("class"):
            x = projected(own["terms"].tolist(), own["counts"].tolist(), df, n_docs, mean_length)
            trees[c] = split_tree(x, sizes[c] / len(x), shard)
        fixed |= {c for c in large if trees.get(c) is None}
        trees = {c: t for c, t in trees.items() if t is not None}
        if not trees:
            break

        def descend(batches: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                name = pdf["class"].to_numpy(object).copy()
                for c, tree in trees.items():
                    if len(at := np.flatnonzero(name == c)):
                        x = projected([pdf["terms"].iat[i] for i in at], [pdf["counts"].iat[i] for i in at], df, n_docs, mean_length)
                        name[at] = leaves(x, tree, c)
                yield pdf.assign(**{"class": name})

        out = checkpointed(out.mapInPandas(descend, ddl))
        sizes = {r[0]: r[1] for r in out.groupBy("class").count().collect()}
    return out, sizes


class ShardIndex:
    """Inverted BM25 index over the documents of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], df: np.ndarray, n_docs: int, mean_length: float | None = None):
        self.terms = terms
        lengths = np.array([c.sum() for c in counts], float)
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(float) if len(terms) else np.zeros(0)
        if mean_length is None:
            mean_length = lengths.mean() if len(lengths) else 1.0
        weight = _weights(flat, tf, lengths[owner], _idf(df, n_docs), mean_length)
        order = np.argsort(flat, kind="stable")
        owner, weight = owner[order], weight[order]
        ids, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.size = len(terms)
        # words of many documents are added as whole rows, the others posting by posting
        often = count * 8 >= self.size
        self.rows = {t: np.zeros(self.size, np.float32) for t in ids[often].tolist()}
        for t, a, c in zip(ids[often].tolist(), first[often].tolist(), count[often].tolist()):
            self.rows[t][owner[a : a + c]] = weight[a : a + c]
        seldom = np.repeat(~often, count)
        self._all = owner[seldom], weight[seldom], ids[~often], np.r_[0, np.cumsum(count[~often])]
        self.restore()

    def restore(self) -> None:
        """All documents are indexed again."""
        self.gone = np.zeros(self.size, bool)
        self.owner, self.weight, self.ids, borders = self._all
        self._spans(borders)

    def forget(self, gone: np.ndarray) -> None:
        """Drop the postings of documents that are used up."""
        self.gone = self.gone | gone
        keep = ~gone[self.owner]
        ahead = np.r_[0, np.cumsum(keep)]
        self.owner, self.weight = self.owner[keep], self.weight[keep]
        self._spans(ahead[self.borders])

    def _spans(self, borders: np.ndarray) -> None:
        self.borders = borders
        self.span = dict(zip(self.ids.tolist(), zip(borders[:-1].tolist(), borders[1:].tolist())))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document of the shard for the words of ``doc``."""
        words = self.terms[doc].tolist()
        spans = [self.span[t] for t in words if t in self.span]
        if spans:
            owner, weight = (np.concatenate([x[a:b] for a, b in spans]) for x in (self.owner, self.weight))
            out = np.bincount(owner, weights=weight, minlength=self.size)
        else:
            out = np.zeros(self.size)
        if often := [self.rows[t] for t in words if t in self.rows]:
            total = often[0].copy()
            for row in often[1:]:
                total += row
            out += total
        out[self.gone] = 0
        return out


class _Rooms:
    """Unused items by size, for best fit."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in np.argsort(-np.arange(len(sizes)), kind="stable"):
            self.by_size[sizes[i]].append(int(i))
        self.filled = 0
        for s, x in enumerate(self.by_size):
            if x:
                self.filled |= 1 << s

    def has(self, size: int, used: np.ndarray, but: int) -> bool:
        """Whether an unused item of exactly ``size`` is there, other than ``but``."""
        stack = self.by_size[size]
        while stack and used[stack[-1]]:
            stack.pop()
        return bool(stack) and (stack[-1] != but or any(not used[i] for i in stack[:-1]))

    def largest(self, room: int, used: np.ndarray) -> int | None:
        while True:
            below = self.filled & ((1 << (room + 1)) - 1)
            if not below:
                return None
            s = below.bit_length() - 1
            stack = self.by_size[s]
            while stack and used[stack[-1]]:
                stack.pop()
            if stack:
                return stack[-1]
            self.filled &= ~(1 << s)


def fill_containers(sizes: np.ndarray, capacity: int, neighbours, forget=None) -> np.ndarray:
    """Container number of each item (all sizes at most ``capacity``).

    ``neighbours(i)`` gives BM25 scores of all items for seed i, or None.  All
    unused neighbours are walked in the order of their scores while there is
    room; one is taken if it fits and the room it leaves can be filled: by
    further texts, or in the last tenth of the window by one unused text exactly.
    What then remains goes to the best-fitting unused items, and the emptiest
    containers are dissolved where their items fit elsewhere.  ``forget(used)``
    is called whenever half of the items known so far are used.
    """
    n = len(sizes)
    used = np.zeros(n, bool)
    out = np.full(n, -1)
    rooms = _Rooms(sizes, capacity)
    free: list[int] = []
    tenth = max(1, capacity // 10)
    alive, left_over = np.flatnonzero(sizes > 0), n  # as of the last time half of them were used
    while True:
        if left_over > 1000 and n - int(used.sum()) < left_over / 2:
            left_over, alive = n - int(used.sum()), alive[~used[alive]]
            if forget is not None:
                forget(used)
        seed = rooms.largest(capacity, used)
        if seed is None:
            break
        number, room = len(free), capacity

        def put(i, number=number):
            nonlocal room
            used[i] = True
            out[i] = number
            room -= int(sizes[i])

        put(seed)
        if room:
            scores = neighbours(seed)
            if scores is not None:
                open_ = alive[~used[alive]]
                open_ = open_[(sizes[open_] <= room) & (scores[open_] > 0)]
                block = 64
                while len(open_) and room:
                    far = np.argpartition(-scores[open_], block - 1)[block:] if block < len(open_) else np.zeros(0, int)
                    near = np.delete(open_, far)
                    for i in near[np.lexsort((near, -scores[near]))]:
                        left = room - int(sizes[i])
                        if left >= tenth or left == 0 or (left > 0 and rooms.has(left, used, int(i))):
                            put(i)
                    open_, block = open_[far], 4 * block
                    open_ = open_[sizes[open_] <= room]
            while room:
                i = rooms.largest(room, used)
                if i is None or sizes[i] == 0:
                    break
                put(i)
        if room == capacity:  # only empty texts are left: they join the first container
            empty = np.flatnonzero(~used)
            used[empty] = True
            home = 0 if free else number
            out[seed] = home
            out[empty] = home
            if not free:
                free.append(room)
            break
        free.append(room)
    return _dissolve(out, sizes, free, capacity)


def _dissolve(out: np.ndarray, sizes: np.ndarray, free: list[int], capacity: int) -> np.ndarray:
    """Empty sparsely filled containers into the room others have left."""
    if len(free) < 2:
        return out
    room = np.array(free)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(out.tolist()):
        members.setdefault(c, []).append(i)
    heap = [(-int(r), c) for c, r in enumerate(free) if r * 2 > capacity]
    heapq.heapify(heap)
    gone = set()
    while heap:
        _, c = heapq.heappop(heap)
        trial, moves = room.copy(), []
        trial[c] = -1
        for i in sorted(members.get(c, []), key=lambda i: -sizes[i]):
            fits = np.flatnonzero(trial >= sizes[i])
            if not len(fits):
                moves = None
                break
            t = fits[np.argmin(trial[fits])]
            trial[t] -= sizes[i]
            moves.append((i, int(t)))
        if moves:
            for i, t in moves:
                out[i] = t
                members[t].append(i)
            room = trial
            gone.add(c)
            members[c] = []
    if gone:
        names = {c: k for k, c in enumerate(sorted(set(out.tolist())))}
        out = np.array([names[c] for c in out.tolist()])
    return out


def spread_small(pdf: pd.DataFrame) -> pd.DataFrame:
    """Containers of one plan, from several shards: those that hold small texts
    only are emptied into the room others have left, where all their texts fit.
    Shards of similar texts have texts of similar length, which fill less well."""
    pdf = pdf.sort_values(["container", "doc_id", "text_no", "piece"], kind="stable").reset_index(drop=True)
    owner, names = pd.factorize(pdf["container"])
    size, capacity = pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iat[0])
    room = capacity - np.bincount(owner, weights=size).astype(np.int64)
    largest = np.zeros(len(names), np.int64)
    np.maximum.at(largest, owner, size)
    starts = np.searchsorted(owner, np.arange(len(names) + 1))
    home, took = owner.copy(), np.zeros(len(names), bool)
    for c in np.lexsort((-room, largest)):
        if took[c]:  # it has become a home of others
            continue
        own = np.arange(starts[c], starts[c + 1])
        if room.sum() - room[c] < capacity - room[c]:
            continue
        moves, old = [], int(room[c])
        room[c] = -1
        for i in own[np.argsort(-size[own], kind="stable")]:
            fits = np.flatnonzero(room >= size[i])
            if not len(fits):
                break
            t = int(fits[np.argmin(room[fits])])
            room[t] -= size[i]
            moves.append((i, t))
        if len(moves) < len(own):
            for i, t in moves:
                room[t] += size[i]
            room[c] = old
            if not moves and largest[c] > room.max():
                break  # the largest texts of all further containers are no smaller
            continue
        room[c] = 0
        for i, t in moves:
            home[i], took[t] = t, True
    return pdf.assign(container=np.asarray(names)[home])


def pack_shard(pdf: pd.DataFrame, shard: str, plans: list[tuple[int, int]], df: np.ndarray, n_docs: int, mean_length: float | None = None) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text_no"], kind="stable").reset_index(drop=True)
    terms = [np.asarray(t, np.int64) if t is not None else np.zeros(0, np.int64) for t in pdf["terms"]]
    counts = [np.asarray(t, np.int64) if t is not None else np.zeros(0, np.int64) for t in pdf["counts"]]
    index = ShardIndex(terms, counts, df, n_docs, mean_length)
    size = pdf["n_tokens"].to_numpy(dtype=np.int64)
    doc_id, text_no = pdf["doc_id"].to_numpy(), pdf["text_no"].to_numpy()
    frames = []
    for plan, capacity in plans:
        whole = np.where(size > capacity, size // capacity, 0)  # full pieces of split texts
        rest = size - whole * capacity
        item = np.flatnonzero((rest > 0) | (whole == 0))
        place = np.empty(0, int)
        if len(item):
            back = np.full(len(pdf), -1)
            back[item] = np.arange(len(item))

            def neighbours(i, item=item):
                return index.scores(int(item[i]))[item]

            def forget(used, item=item):
                gone = np.ones(len(pdf), bool)
                gone[item] = used
                index.forget(gone)

            index.restore()
            place = fill_containers(rest[item], capacity, neighbours, forget)
        piece_of = np.repeat(np.arange(len(pdf)), whole)
        piece_no = np.arange(len(piece_of)) - np.repeat(np.cumsum(whole) - whole, whole)
        number = np.r_[place, (place.max() + 1 if len(place) else 0) + np.arange(len(piece_of))]
        frames.append(
            pd.DataFrame(
                {
                    "plan_id": plan,
                    "container": [f"{shard}-{k}" for k in number],
                    "capacity": capacity,
                    "doc_id": np.r_[doc_id[item], doc_id[piece_of]],
                    "text_no": np.r_[text_no[item], text_no[piece_of]],
                    "piece": np.r_[whole[item], piece_no],
                    "first_token": np.r_[whole[item] * capacity, piece_no * capacity],
                    "n_tokens": np.r_[rest[item], np.full(len(piece_of), capacity)],
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def shard_plan(sizes: dict[int, int], shard: int) -> tuple[dict[int, int], dict[int, int]]:
    """Shard number of each class and the number of parts it is split into: small
    classes share a shard with the next ones, large ones are cut by hash."""
    group, splits, number, load = {}, {}, 0, 0
    for k, c in enumerate(sorted(sizes)):
        if sizes[c] > shard:
            group[c], splits[c] = 1_000_000 + k, -(-sizes[c] // shard)
            continue
        if load and load + sizes[c] > shard:
            number, load = number + 1, 0
        group[c], splits[c] = number, 1
        load += sizes[c]
    return group, splits


def pack_documents(documents: DataFrame, plans: DataFrame, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """One row per text, or per piece of a text longer than the capacity, and
    plan: plan_id, container, capacity, doc_id, text_no, piece (number in the
    text, from 0), first_token, n_tokens.

    Defined results: null and empty texts have no tokens and go to some
    container; rows with null doc_id are left out; rows equal in doc_id and text
    count once, further texts of a doc_id are packed too (``text_no`` tells them
    apart); plans with null or non-positive capacity are left out; no documents
    give no rows.
    """
    docs = checkpointed(tokenised(documents, tokenizer))
    # corpus-wide document frequencies in TERM_BUCKETS buckets: bounded by construction
    df = np.zeros(TERM_BUCKETS)
    for bucket, n in docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[bucket] = n
    n_docs, words = docs.agg(F.count("*"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    wanted = plans.where("plan_id is not null and capacity_tokens > 0").select("plan_id", "capacity_tokens").distinct()
    n_plans = wanted.count()
    if not n_docs or not n_plans:
        return documents.sparkSession.createDataFrame([], PLACED)
    mean_length = words / n_docs
    classed, sizes = with_class(docs, df, n_docs, mean_length, shard)
    group, splits = shard_plan(sizes, shard)
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(x) for c in sorted(d) for x in (c, d[c])]), F.col("class"))
    # only classes of like documents still have several parts
    split = F.pmod(F.xxhash64("doc_id"), lookup(splits)).cast("string")
    keyed = classed.withColumn("shard", F.concat_ws("-", lookup(group).cast("string"), split)).drop("class")
    n_shards = len({(group[c], s) for c in sizes for s in range(splits[c])})
    blocks = -(-n_plans // PLANS)
    out = None
    for block in range(blocks):
        # about PLANS rows of two numbers, dealt evenly by hash
        chosen = sorted((int(r[0]), int(r[1])) for r in wanted.where(F.pmod(F.xxhash64("plan_id", "capacity_tokens"), F.lit(blocks)) == block).collect())
        if chosen:
            placed = _packed(keyed, chosen, n_shards, len(set(group.values())) > 1, df, n_docs, mean_length, shard)
            out = placed if out is None else out.unionByName(placed)
    return out


def _packed(keyed: DataFrame, chosen: list[tuple[int, int]], n_shards: int, several: bool, df: np.ndarray, n_docs: int, mean_length: float, shard: int) -> DataFrame:
    by_plan = keyed.withColumn("plan", F.explode(F.array(*[F.lit(k) for k in range(len(chosen))])))
    # the work lies in the shards, not in their bytes: keep them spread over all cores
    tasks = len(chosen) * n_shards
    by_plan = by_plan.repartition(max(1, min(tasks, 3 * keyed.sparkSession.sparkContext.defaultParallelism), tasks // 64), "shard", "plan")
    placed = by_plan.groupBy("shard", "plan").applyInPandas(lambda key, pdf: pack_shard(pdf, key[0], [chosen[key[1]]], df, n_docs, mean_length), PLACED)
    if not several:
        return placed
    # the containers of all shards, dealt into groups of bounded size
    part = F.pmod(F.xxhash64("container"), F.lit(-(-n_docs // (2 * shard))))
    return placed.withColumn("part", part).groupBy("plan_id", "capacity", "part").applyInPandas(lambda pdf: spread_small(pdf.drop(columns="part")), PLACED)


def container_fill(placed: DataFrame) -> DataFrame:
    """Per plan: containers, texts and pieces, tokens and the share of room used."""
    per = placed.groupBy("plan_id", "capacity", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    return per.groupBy("plan_id", "capacity").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * F.first("capacity")), 6).alias("fill")
    )
