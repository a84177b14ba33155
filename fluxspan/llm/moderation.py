"""Scores for abusive, hateful and sexual content.

Gradient-boosted trees over dense features - how often words of each lexicon
group occur, how near insults, threats, peoples and sexual words stand to the
second person and to each other, capitals, punctuation and the share of
disguised words - with isotonic calibration of out-of-fold margins.  The same
features serve every category; which of them tell is left to the trees.  One
thing is settled before: insults that a sentence only reports ("he called me
...") aren't counted as insults.  A document is judged by its most telling
sentence per category, so a long text can't dilute what one sentence says.

The model is trained once on the driver from at most ``MAX_SAMPLES`` labelled
texts; its size doesn't depend on the data, and it travels to the tasks inside
the function.  Documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.llm.lexicon import GROUPS, PHRASES
from fluxspan.shared import spread

CATEGORIES = ("abusive", "hateful", "sexual")
MAX_SAMPLES = 20_000
THRESHOLD = 0.5

# fixed values: letters of other scripts and digits that pass for Latin letters
HOMOGLYPHS = str.maketrans("аеорсухіѕјԁɡһкмтвնցαεοριυνκτ", "aeopcyxisjdghkmtbngaeopiuvkt")
LEET = str.maketrans("013457@$!", "oieastasi")

_SEPARATED = re.compile(r"(?<![^\W_])[^\W\d_]([ ._\-·])[^\W\d_](?:\1[^\W\d_])+(?![^\W_]|[*])")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$!#]*[\w*@$])?|[@$*][\w*@$]*\w")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+|;\s")
# combining marks and format characters of the scripts at hand
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u0483-\u0487\u061c\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\ufeff\ufff9-\ufffb]+")
_REPEAT = re.compile(r"(.)\1+")


def fold(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    text = text.casefold()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).translate(HOMOGLYPHS)
    return text


def _squeeze(word: str) -> str:
    return _REPEAT.sub(r"\1", word)


class Lexicon:
    """Groups of a token, through its disguises: look-alikes, digits for
    letters, masked letters, stretched or dropped letters."""

    def __init__(self):
        self.names = list(GROUPS)
        self.bit = {g: 1 << i for i, g in enumerate(self.names)}
        self.exact: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        for group, words in GROUPS.items():
            for w in words.split():
                into = self.stems if w.endswith("*") else self.exact
                w = w.rstrip("*")
                into[w] = into.get(w, 0) | self.bit[group]
        self.squeezed = {_squeeze(w): b for w, b in self.exact.items()}
        self.squeezed_stems = {_squeeze(w): b for w, b in self.stems.items()}
        self.shortest = min(map(len, self.stems))
        self.deletes: dict[str, int] = {}
        for w, b in [*self.exact.items(), *self.stems.items()]:
            if len(w) >= 7:
                for k in range(1, len(w)):
                    self.deletes[w[:k] + w[k + 1 :]] = b
        self.all_words = [*self.exact, *self.stems]
        self.phrases = {g: re.compile("|".join(re.escape(p.strip()).replace(r"\ ", r"\W+").replace("'", r"\W?") for p in s.split("|") if p.strip())) for g, s in PHRASES.items()}
        self.squeezed_phrases = {g: re.compile("|".join(r"\b" + re.escape(_squeeze(re.sub(r"\W+", " ", p.strip()))) for p in s.split("|") if p.strip())) for g, s in PHRASES.items()}
        self.cache: dict[str, tuple[int, bool]] = {}

    def _plain(self, w: str) -> int:
        b = self.exact.get(w, 0)
        for k in range(self.shortest, len(w) + 1):
            b |= self.stems.get(w[:k], 0)
        return b

    def look(self, token: str) -> tuple[int, bool]:
        """(group bits, disguised?) of a folded token."""
        known = self.cache.get(token)
        if known is None:
            known = self._look(token)
            if len(self.cache) < 200_000:
                self.cache[token] = known
        return known

    def _look(self, token: str) -> tuple[int, bool]:
        if b := self._plain(token):
            return b, False
        bare = token.strip("*!#")
        if b := self._plain(bare):
            return b, False
        if len(bare) < 2:
            return 0, False
        if any(c in "013457@$!" for c in bare):
            plain = bare.translate(LEET)
            if b := self._plain(plain) or self._plain(plain.replace("i", "l")):
                return b, not plain.isdigit() and not bare.isdigit() or len(bare) > 3
        core = re.sub(r"^\*{2,}|\*{2,}$", "", token).strip("!#")
        if "*" in core and len(core) >= 3 and any(c.isalpha() for c in core):
            shape = re.compile("".join("." if c == "*" else re.escape(c.translate(LEET)) for c in core))
            b = 0
            for w in self.all_words:
                if len(w) == len(core) and shape.fullmatch(w):
                    b |= self.exact.get(w, 0) | self.stems.get(w, 0)
                elif w in self.stems and len(w) < len(core) and re.match("".join("." if c == "*" else re.escape(c) for c in core[: len(w)]) + "$", w):
                    b |= self.stems[w]
            if b:
                return b, True
        if _REPEAT.search(bare):
            s = _squeeze(bare.translate(LEET))
            b = self.squeezed.get(s, 0)
            for k in range(self.shortest, len(s) + 1):
                b |= self.squeezed_stems.get(s[:k], 0)
            if b and re.search(r"(.)\1\1", bare):
                return b, True
        if len(bare) >= 6 and bare.isalpha():
            b = self.deletes.get(bare, 0)
            for k in range(1, len(bare)):
                short = bare[:k] + bare[k + 1 :]
                b |= self.deletes.get(short, 0) | (self.exact.get(short, 0) if len(short) >= 7 else 0)
            return b, False
        return 0, False


COUNTED = ("insult", "degrading", "violence", "body", "silence", "people", "dehuman", "neutral_people", "sexual", "solicit", "innocent", "reported", "goods", "ought")
ADDRESSED = ("second", "person")
NEAR = (
    ("insult", ADDRESSED), ("violence", ADDRESSED), ("silence", ADDRESSED), ("degrading", ("insult",)), ("body", ("violence", "silence")), ("people", ("dehuman", "violence")),
    ("sexual", ("solicit", "second")), ("insult", ("innocent",)), ("insult", ("goods",)), ("sexual", ("innocent",)), ("people", ("neutral_people",)), ("insult", ("reported",)), ("violence", ("goods",)), ("violence", ("ought",)),
)
TELLING = frozenset({"insult", "degrading", "violence", "silence", "people", "dehuman", "sexual", "solicit"})
FEATURES = (*(f"n_{g}" for g in COUNTED), *(f"{a}_near_{'_'.join(b)}" for a, b in NEAR), "insult_after_article", "wish_harm", "quoted", "disguised", "capitals", "exclaims", "words", "hot_sentences")
FAINT = 0.12  # a sentence less telling than this doesn't speak for its category
MOST = 3  # counts above it say no more
ARTICLES = frozenset("a an the un une el la los las ein eine einen einem de des of such total complete".split())


def _nearness(a: list[int], b: list[int]) -> float:
    """1 / (words between) of the nearest two positions; 0 if either is absent."""
    if not a or not b:
        return 0.0
    return 1.0 / (1 + min(abs(i - j) for i in a for j in b if i != j)) if any(i != j for i in a for j in b) else 0.0


class Reader:
    """Dense features of texts."""

    def __init__(self):
        self.lexicon = Lexicon()

    def _sentence(self, raw: str) -> tuple[list[float], dict[str, float]] | None:
        """Features of one sentence and how telling it is per category; None if
        nothing in it tells anything."""
        lex = self.lexicon
        folded = fold(raw)
        tokens = _TOKEN.findall(_SEPARATED.sub(self._join, folded))
        places: dict[str, list[int]] = {}
        disguised = 0
        plain = []
        for i, t in enumerate(tokens):
            bits, hidden = lex.look(t)
            plain.append(t.translate(LEET) if hidden or not (t.isalpha() or t.isdigit()) else t)
            disguised += hidden
            if bits:
                for g in lex.names:
                    if bits & lex.bit[g]:
                        places.setdefault(g, []).append(i)
        wish = self._phrase("wish_harm", folded, plain)
        if not wish and not TELLING & places.keys():
            return None
        quoted = "insult" in places and self._phrase("quoted", folded, plain)
        if quoted:
            del places["insult"]
        at = lambda g: places.get(g, [])
        addressed = at("second") + at("person")
        insults = at("insult")
        near_insult, after_article = _nearness(insults, addressed), any(i and tokens[i - 1] in ARTICLES for i in insults)
        row = [float(min(MOST, len(at(g)))) for g in COUNTED]
        row += [_nearness(at(a), [i for b in others for i in at(b)]) if at(a) else 0.0 for a, others in NEAR]
        row += [float(after_article), float(wish), float(quoted)]
        n = max(1, len(tokens))
        row += [float(min(MOST, disguised)), sum(len(w) > 2 and w.isupper() for w in raw.split()) / n, (raw.count("!") + raw.count("?")) / max(1, len(raw)), float(min(60, n))]
        heat = {
            "abusive": 3 * near_insult + 2 * after_article + 2 * wish + _nearness(at("violence"), addressed) + _nearness(at("violence"), at("ought")) + _nearness(at("silence"), addressed),
            "hateful": 2 * len(at("people")) + len(at("dehuman")) + len(at("violence")) if at("people") else 0.0,
            "sexual": 2 * len(at("sexual")) + len(at("solicit")),
        }
        return row, heat

    def _join(self, match: re.Match) -> str:
        """Letters spelt apart, as one word; a one-letter word ahead of them stays."""
        word = match[0].replace(match[1], "")
        if not self.lexicon.look(word)[0] and self.lexicon.look(word[1:])[0]:
            return word[0] + " " + word[1:]
        return word

    def _phrase(self, group: str, folded: str, plain: list[str]) -> bool:
        """A phrase as written, or through stretched letters and digits."""
        if self.lexicon.phrases[group].search(folded):
            return True
        return bool(self.lexicon.squeezed_phrases[group].search(_squeeze(" ".join(plain))))

    def features(self, text: str | None) -> dict[str, np.ndarray]:
        """One vector per category, from its most telling sentence (zeros where no
        sentence tells anything of it)."""
        best: dict[str, tuple[float, list[float]]] = {}
        hot = dict.fromkeys(CATEGORIES, 0)
        for s in _SENTENCE.split(text or ""):
            if s and (found := self._sentence(s)) is not None:
                row, heat = found
                for c in CATEGORIES:
                    hot[c] += heat[c] >= 2
                    if heat[c] > (best[c][0] if c in best else FAINT):
                        best[c] = (heat[c], row)
        nothing = [0.0] * (len(FEATURES) - 1)
        return {c: np.array([*(best[c][1] if c in best else nothing), min(MOST, hot[c])]) for c in CATEGORIES}


class BoostedTrees:
    """Logistic gradient boosting of small regression trees on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, leaf: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.leaf, self.ridge = trees, depth, rate, leaf, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) if len(np.unique(c)) > 32 else (np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        # which split points each feature has
        self.splits = np.arange(max(1, max(map(len, self.edges)))) < np.array([len(e) for e in self.edges])[:, None]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        self.forest = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = self._grow(binned, gradient, hessian, np.arange(len(y)), self.depth)
            self.forest.append(tree)
            margin = margin + self._walk(tree, binned)
        return self

    def _grow(self, binned, gradient, hessian, rows, depth):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        value = self.rate * g / (h + self.ridge)
        best = (1e-6, -1, -1)
        if depth:
            # sums per feature and bin, of all features at once
            width = self.splits.shape[1] + 1
            at = (binned[rows] + width * np.arange(binned.shape[1])).ravel()
            sums = lambda w: np.cumsum(np.bincount(at, None if w is None else np.repeat(w[rows], binned.shape[1]), self.splits.shape[0] * width).reshape(-1, width), axis=1)[:, :-1]
            gl, hl, nl = sums(gradient), sums(hessian), sums(None)
            gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
            gain[~self.splits | (nl < self.leaf) | (len(rows) - nl < self.leaf)] = -1
            f, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[f, k] > best[0]:
                best = (float(gain[f, k]), int(f), int(k))
        if best[1] < 0:
            return float(value)
        f, k = best[1:]
        left = binned[rows, f] <= k
        return (f, k, self._grow(binned, gradient, hessian, rows[left], depth - 1), self._grow(binned, gradient, hessian, rows[~left], depth - 1))

    def _walk(self, tree, binned) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(binned), tree)
        f, k, left, right = tree
        return np.where(binned[:, f] <= k, self._walk(left, binned), self._walk(right, binned))

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        return self.base + sum(self._walk(t, binned) for t in self.forest)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing calibration curve (pool adjacent violators)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first margin, last margin
    for m, t in zip(margin[order], y[order]):
        blocks.append([float(t), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    # pull the outermost blocks off 0 and 1 by one pseudo-count
    xs, ys = [], []
    for mean, w, a, b in blocks:
        p = (mean * w + 0.5) / (w + 1)
        xs += [a, b]
        ys += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


class Moderator:
    """One calibrated model per category."""

    def __init__(self, texts: list[str], verdicts: list[str], folds: int = 5, seed: int = 7):
        self.reader = Reader()
        rows = [self.reader.features(t) for t in texts]
        labels = np.array(verdicts, object)
        fold_of = np.random.default_rng(seed).integers(0, folds, len(texts))
        self.models, self.curves, self.quality = {}, {}, {}
        for c in CATEGORIES:
            x = np.stack([r[c] for r in rows])
            y = (labels == c).astype(float)
            held = np.zeros(len(y))
            for k in range(folds):
                if (fold_of == k).any() and 0 < y[fold_of != k].sum():
                    held[fold_of == k] = BoostedTrees().fit(x[fold_of != k], y[fold_of != k]).margin(x[fold_of == k])
            self.models[c] = BoostedTrees().fit(x, y)
            self.curves[c] = isotonic(held, y)
            guess = self._calibrated(c, held) >= THRESHOLD
            self.quality[c] = {"precision": float(y[guess].mean()) if guess.any() else 0.0, "recall": float(guess[y == 1].mean()) if y.any() else 0.0}
        self.reader.lexicon.cache.clear()

    def _calibrated(self, c: str, margin: np.ndarray) -> np.ndarray:
        xs, ys = self.curves[c]
        return np.interp(margin, xs, ys)

    def scores(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        rows = [self.reader.features(t) for t in texts]
        return {c: self._calibrated(c, self.models[c].margin(np.stack([r[c] for r in rows]))) if rows else np.zeros(0) for c in CATEGORIES}


def train(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> Moderator:
    """Fit on labelled texts.  Unlabelled rows are left out; beyond
    ``max_samples`` rows a fixed sample by hash of the id is taken."""
    labelled = samples.where("verdict is not null and text is not null").select("sample_id", "text", "verdict")
    rows = labelled.orderBy(F.xxhash64("sample_id"), "sample_id").limit(max_samples).collect()
    return Moderator([r["text"] for r in rows], [r["verdict"] for r in rows])


def score_documents(documents: DataFrame, model: Moderator, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and one calibrated score per category for every document.

    Defined results: null and empty texts get the scores of a text without any
    telling word; repeated rows are scored each; other columns are dropped.
    """
    fields = [documents.schema[c] for c in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(f"{c} double" for c in CATEGORIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(scores[c], pa.float64()) for c in CATEGORIES)], names=[*keep, *CATEGORIES])

    return spread(documents.select(*keep, "text"), keep[0]).mapInArrow(run, schema)


def flagged(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, category) for every score that reaches the threshold."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    return scored.select("doc_id", F.explode(pairs).alias("p")).where(F.col("p.score") >= threshold).select("doc_id", "p.category").distinct()


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, flagged documents and mean score per source and category."""
    aggs = [F.count("*").alias("documents")]
    for c in CATEGORIES:
        aggs += [F.count_if(F.col(c) >= threshold).alias(f"n_{c}"), F.round(F.avg(F.col(c)), 6).alias(f"mean_{c}")]
    rates = scored.groupBy("source").agg(*aggs)
    return rates.select("source", "documents", *[x for c in CATEGORIES for x in (f"n_{c}", F.round(F.col(f"n_{c}") / F.col("documents"), 6).alias(f"rate_{c}"), f"mean_{c}")])
