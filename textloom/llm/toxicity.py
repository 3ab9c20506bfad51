"""Toxicity classifier with a counterfactual penalty.

A text is the set of its words and of their beginnings.  Features that go with
the label more than chance allows enter a logistic model.  For each labelled
text that names a group, the text with its group terms swapped for others of
their kind is scored too, and the squared change of the score is added to the
loss: a neutral mention of a group moves the score as little as any other does.

Which terms name groups is a fixed list, the start, and what the labelled texts
themselves show: words that are frequent, that stand between the same words as
others do, and that go with neither label.  The fixed terms alone would leave the
penalty idle on a corpus that names no such group.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.labelled import BYTES, ROWS, fold, sample
from textloom.llm.quality import THRESHOLD, score_only
from textloom.llm.util import PIECE, mix, pieces, powers, word_hashes

FOLDS, HELD_OUT = 4, 2
#: Bytes of a word's beginnings that are features, beside the word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Labelled texts a feature must be in, and its least log-odds over its error.
LEAST_TEXTS, LEAST_SIGNAL, MOST_FEATURES = 4, 2.6, 4000
PENALTY, DECAY, STEPS, RATE = 2.0, 0.002, 400, 0.05

#: Identity terms, by kind of group; terms of a kind are swapped for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "transgender", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
)
SWAPS = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
WORD = re.compile(r"[^\W\d_]+")
#: Learned terms: share of texts and number of texts with either label they are in at least, log-odds over its error at
#: most, likeness of the words around them at least; words looked at, words around that count, and terms of a kind.
TERM_SHARE, TERM_TEXTS, TERM_SIGNAL, TERM_LIKENESS = 0.02, 5, 1.0, 0.9
TERM_WORDS, AROUND_WORDS, KIND_TERMS = 200, 100, 8

# Letters, digits and the bytes of letters beyond ASCII make words here.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def counterfactual(text: str, swaps: dict[str, str] = SWAPS) -> str:
    """The text with each group term swapped for the next of its kind; a capital first letter stays one."""

    def other(m: re.Match) -> str:
        found = swaps.get(m[0].lower())
        return m[0] if found is None else found.capitalize() if m[0][0].isupper() else found

    return WORD.sub(other, text)


def learned_terms(texts: list[str], y: np.ndarray) -> list[list[str]]:
    """Kinds of terms, two to KIND_TERMS each, that the labelled texts use alike and with either label."""
    split = [[w.lower() for w in WORD.findall(t)] for t in texts]
    toxic, clean, often = Counter(), Counter(), Counter()
    for words, label in zip(split, y):
        (toxic if label > 0.5 else clean).update(set(words))
        often.update(words)
    p, q = float((y > 0.5).sum()), float((y <= 0.5).sum())
    terms = []
    for w, n in sorted((toxic + clean).items(), key=lambda x: (-x[1], x[0])):
        a, b = toxic[w], clean[w]
        if n < TERM_SHARE * len(texts) or len(terms) == TERM_WORDS:
            break
        error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (p - a + 0.5) + 1 / (q - b + 0.5))
        odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (q - b + 0.5))
        if len(w) > 2 and min(a, b) >= TERM_TEXTS and abs(odds) <= TERM_SIGNAL * error:
            terms.append(w)
    if len(terms) < 2:
        return []
    at = {w: i for i, w in enumerate(terms)}
    around = {w: i for i, (w, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:AROUND_WORDS])}
    seen = np.zeros((len(terms), 2 * AROUND_WORDS))
    for words in split:
        for left, word, right in zip(["", *words], words, [*words[1:], ""]):
            if word in at:
                if left in around:
                    seen[at[word], around[left]] += 1
                if right in around:
                    seen[at[word], AROUND_WORDS + around[right]] += 1
    unit = np.sqrt(seen / np.maximum(seen.sum(1, keepdims=True), 1))
    like = unit @ unit.T
    kinds: list[list[int]] = []
    for i in range(len(terms)):
        best = max((k for k in kinds if len(k) < KIND_TERMS and like[i, k].min() >= TERM_LIKENESS), key=lambda k: like[i, k].min(), default=None)
        kinds.append([i]) if best is None else best.append(i)
    return [[terms[i] for i in k] for k in kinds if len(k) > 1]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word and beginning of a word."""
    h, doc, starts, ends = word_hashes(data, offsets, APART)
    if not len(h):
        return h, doc
    found, where = [h], [doc]
    table = powers(max(BEGINNINGS) + 1)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    sums, size, upto = np.zeros(len(h), np.uint64), ends - starts, 0
    for n in BEGINNINGS:
        for k in range(upto, n):
            at = np.minimum(starts + k, len(data) - 1)
            sums = sums + (low[at].astype(np.uint64) + np.uint64(1)) * table[k]
        upto = n
        long = size > n
        found.append(mix(sums[long] ^ np.uint64(n << 56)))
        where.append(doc[long])
    return np.concatenate(found), np.concatenate(where)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])


class Model:
    """Weights of the chosen features (sorted hashes) and an intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float):
        self.keys, self.weights, self.intercept = keys, weights, intercept
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys >> np.uint64(48)).astype(np.int64)] = True
        self.swaps, self.named, self.counterfactuals = dict(SWAPS), 0, 0

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, text) pairs, once each."""
        h, doc = features(data, offsets)
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        h, doc = h[some], doc[some]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        both = np.unique(doc[hit].astype(np.int64) * len(self.keys) + at[hit])
        return both % len(self.keys), both // len(self.keys)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > PIECE:
            # a long text is read in pieces, cut between words
            parts = [self.present(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data, APART, PIECE)]
            f = np.unique(np.concatenate(parts))
            doc = np.zeros(len(f), np.int64)
        else:
            f, doc = self.present(data, offsets)
        logit = self.intercept + np.bincount(doc, weights=self.weights[f], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-logit))


def choose(texts: list[str], y: np.ndarray, swaps: dict[str, str]) -> np.ndarray:
    """Hashes of the features whose log-odds stand out, and of all group terms in the texts."""
    with_label, in_all = Counter(), Counter()
    for a in range(0, len(texts), 200):
        h, doc = features(*coded(texts[a : a + 200]))
        pairs = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)
        keys, n = np.unique(pairs[1], return_counts=True)
        in_all.update(dict(zip(keys.tolist(), n.tolist())))
        toxic = pairs[1][y[a : a + 200][pairs[0].astype(np.int64)] > 0.5]
        keys, n = np.unique(toxic, return_counts=True)
        with_label.update(dict(zip(keys.tolist(), n.tolist())))
    p, q = float((y > 0.5).sum()), float((y <= 0.5).sum())
    scored = []
    for k, n in in_all.items():
        if n >= LEAST_TEXTS:
            a = with_label[k]
            b = n - a
            odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (q - b + 0.5))
            z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (p - a + 0.5) + 1 / (q - b + 0.5))
            if z > LEAST_SIGNAL and odds > 1.5:
                scored.append((-z, k))
    terms = word_hashes(*coded(sorted(swaps)), APART)[0].tolist()
    kept = {k for _, k in sorted(scored)[:MOST_FEATURES]} | {k for k in terms if in_all[k]}
    return np.array(sorted(kept), np.uint64)


def train(texts: list[str], labels: list[float], penalty: float = PENALTY) -> Model:
    """Full-batch Adam; both classes weigh the same.  Without both classes the score is the class's share.

    The model tells what its penalty rests on: ``swaps``, and how many texts name a term of the fixed list and any.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not len(y) else (4.0 if y[0] > 0.5 else -4.0))
    swaps = {t: k[(i + 1) % len(k)] for k in learned_terms(texts, y) for i, t in enumerate(k)} | SWAPS
    swapped = [counterfactual(t, swaps) for t in texts]
    other = [i for i, t in enumerate(swapped) if t != texts[i]]
    named = sum(any(w.lower() in SWAPS for w in WORD.findall(texts[i])) for i in other)
    swapped = [swapped[i] for i in other]
    keys = choose(texts, y, swaps)
    model = Model(keys, np.zeros(len(keys)), 0.0)
    f, d = model.present(*coded(texts))
    g, e = model.present(*coded(swapped))
    other = np.array(other, np.int64)
    share = (y > 0.5).mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, c = np.zeros(len(keys)), -1.0
    m, s = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(c + np.bincount(d, weights=w[f], minlength=len(y)))))
        r = (p - y) * weight
        if len(other):
            q = 1 / (1 + np.exp(-(c + np.bincount(e, weights=w[g], minlength=len(other)))))
            gap = 2 * penalty * (p[other] - q) / len(other)
            np.add.at(r, other, gap * p[other] * (1 - p[other]))
            back = -gap * q * (1 - q)
        grad = np.bincount(f, weights=r[d], minlength=len(keys)) + DECAY * w
        total = r.sum()
        if len(other):
            grad += np.bincount(g, weights=back[e], minlength=len(keys))
            total += back.sum()
        step = np.append(grad, total)
        m += 0.1 * (step - m)
        s += 0.001 * (step * step - s)
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, c = w - move[:-1], c - move[-1]
    model = Model(keys, w, float(c))
    model.swaps, model.named, model.counterfactuals = swaps, named, len(other)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = BYTES) -> Model:
    """The model of a bounded sample of the documents that ``labels.toxic`` marks outside the held-out fold."""
    return train(*sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows, most))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    A null text is scored as an empty one, texts of any length in pieces; equal
    rows each give a row with the same score, a null id falls in the fold of an
    empty text, further columns are ignored.  Without labels, or with labels of
    one kind, all scores are equal.
    """
    scored = score_only(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
