"""Abusive, hateful or sexual content: weak supervision.

1. Every document is cut into overlapping windows of cleaned words; some fifty voters fire or abstain on each.
2. A generative label model estimates, from the counts of vote patterns over all windows, how often each voter fires
   on clean windows and on four kinds of abusive ones, and, in the same rounds, which voters hang together given the
   class: a tree of the strongest dependences, every voter's rate being conditional on its neighbour's vote.
3. A linear classifier over words, word pairs and the votes themselves is trained on the posterior labels of a
   bounded sample. Words teach it what voters miss; votes carry over to wordings it has not seen.
4. A document's score is that of its worst window.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.abuse_voters import CLASSES, VOTERS, classes, ranges, segments, votes, votes_on, words_of
from ledgerloom.runtime import bounded, durable

#: Windows the classifier is trained on: at most about this many on which an abuse voter fires, and as many others.
TRAIN = 15_000
#: Distinct vote patterns; a window of twelve words fires few voters, so there are some thousands.
PATTERNS = 1 << 20
FEATURES = 1 << 17
#: Weight of the starting rates beside what is counted.
HELD = 0.5
ACCEPT = 0.5
#: Share of the training windows that are shown to the classifier by their votes alone.
VOTES_ALONE = 0.4
#: How often single votes and pairs of votes stand beside the sample.
COPIES = 8
#: Voters for a calm reading that see words only; the others see how they meet and are the surer.
WORDS_OF_CALM = ("calm_medical", "calm_technical", "calm_report", "calm_polite")
_ABUSE_BITS = sum(1 << k for k, (_, side, _, _) in enumerate(VOTERS) if side)
_MEMO = 150_000
#: Hash buckets of the sample.
_BUCKETS = 4096


class LabelModel:
    """Latent classes (clean and four kinds of abuse) over voters, fitted by EM on pattern counts. Given the class the
    votes form a tree: a voter's rate depends on the vote of its parent, the voter it hangs together with most."""

    def __init__(self, patterns: list[int], counts: list[int], rounds: int = 40):
        V, C = len(VOTERS), len(CLASSES)
        # windows on which no abuse voter fires are clean by definition; the model tells the others apart
        loud = [(p, n) for p, n in zip(patterns, counts) if p & _ABUSE_BITS] or [(0, 1)]
        self.fired = np.array([[p >> k & 1 for k in range(V)] for p, _ in loud], float)
        n = np.array([n for _, n in loud], float)
        side = np.array([s for _, s, _, _ in VOTERS])
        own = np.array([CLASSES.index(c) for _, _, c, _ in VOTERS])
        bare = np.array([name in ("insult_word", "slur") for name, *_ in VOTERS])  # one strong word, whatever stands around it
        plain = np.array([name in WORDS_OF_CALM for name, *_ in VOTERS])
        rate = (self.fired.T @ n + 0.5) / (n.sum() + 1)
        # Start: words may well be met on clean windows, voters on how words meet seldom, and what speaks against abuse
        # is common on clean windows and rare on others. EM moves rates within the side each voter is for.
        start = np.empty((C, V))
        start[0] = np.choose(side, [np.maximum(rate, 0.4), rate, rate * np.where(bare, 0.2, 0.02)])
        for c in range(1, C):
            start[c] = np.where(side == 0, np.where(plain, 0.03, 0.002), np.where(own == c, np.choose(side, [rate, 0.2, 0.15]), np.minimum(rate, 0.1)))
        start = np.clip(start, 1e-4, 0.95)
        least, most = start * 0.2, np.clip(start * 2.5, 0, 0.97)
        least[1:] = np.where((side > 0) & (own == np.arange(1, C)[:, None]), 0.05, least[1:])
        self.parent = np.full(V, -1)
        self.rate1 = self.rate0 = start  # rates where the parent fired and where it did not
        self.prior = np.array([0.5] + [0.5 / (C - 1)] * (C - 1))
        for r in range(rounds):
            w = self.classes(self.fired) * n[:, None]
            size = w.sum(0)
            joint = np.stack([(self.fired * w[:, c : c + 1]).T @ self.fired for c in range(C)])
            single = np.stack([np.diag(j) for j in joint])
            held = HELD * size[:, None] + 5
            rates = np.clip((single + held * start) / (size[:, None] + held), least, most)
            if r >= 5:
                self.parent = self._tree(joint, single, size)
            self.rate1, self.rate0 = self._conditional(joint, single, size, rates)
            for rate in (self.rate1, self.rate0):  # what speaks against abuse stays rare on abusive windows, whatever its neighbour
                rate[1:] = np.where(side == 0, np.minimum(rate[1:], most[1:]), rate[1:])
            self.prior = np.clip((size + np.array([4.0] + [1.0] * (C - 1))) / (n.sum() + 8), 0.02, None)
            self.prior /= self.prior.sum()

    @staticmethod
    def _tree(joint, single, size) -> np.ndarray:
        """Parent of each voter in the tree of greatest mutual information given the class (-1 for a root)."""
        V = single.shape[1]
        info = np.zeros((V, V))
        for c in range(len(size)):
            N = size[c] + 4.0
            p11 = (joint[c] + 1.0) / N
            pi, pj = (single[c][:, None] + 2.0) / N, (single[c][None] + 2.0) / N
            for p, a, b in ((p11, pi, pj), (pi - p11, pi, 1 - pj), (pj - p11, 1 - pi, pj), (1 - pi - pj + p11, 1 - pi, 1 - pj)):
                p = np.clip(p, 1e-12, 1)
                info += size[c] * p * np.log(p / np.clip(a * b, 1e-12, None))
        np.fill_diagonal(info, -1)
        parent, inside, best = np.full(V, -1), np.zeros(V, bool), info[0].copy()
        link, inside[0] = np.zeros(V, int), True
        floor = 3.0 * np.log(size.sum() + 2)  # weaker links are chance
        for _ in range(V - 1):
            k = int(np.argmax(np.where(inside, -np.inf, best)))
            parent[k] = link[k] if best[k] > floor else -1
            inside[k] = True
            closer = info[k] > best
            link, best = np.where(closer, k, link), np.where(closer, info[k], best)
        return parent

    def _conditional(self, joint, single, size, rates):
        """Rates given that the parent fired, or did not, held near the voter's overall rate where that is rare."""
        up, has = np.maximum(self.parent, 0), self.parent >= 0
        both = joint[:, np.arange(len(up)), up]
        on = single[:, up]
        m = 5.0
        one = (both + m * rates) / (on + m)
        zero = (single - both + m * rates) / (size[:, None] - on + m)
        clip = lambda x: np.clip(np.where(has, x, rates), 1e-6, 0.99)
        return clip(one), clip(zero)

    def classes(self, fired: np.ndarray) -> np.ndarray:
        """Posterior of each class for each pattern."""
        up = np.where(self.parent >= 0, fired[:, np.maximum(self.parent, 0)], 0.0)
        lo = np.tile(np.log(self.prior), (len(fired), 1))
        for c in range(len(CLASSES)):
            p = up * self.rate1[c] + (1 - up) * self.rate0[c]
            lo[:, c] += (fired * np.log(p) + (1 - fired) * np.log(1 - p)).sum(1)
        q = np.exp(lo - lo.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)

    def of(self, pattern: int) -> float:
        """Probability that a window with this pattern is abusive in any way; a window on which no abuse voter fires is
        clean, whatever the prior."""
        if not pattern & _ABUSE_BITS:
            return 0.0
        return float(1 - self.classes(np.array([[pattern >> k & 1 for k in range(len(VOTERS))]], float))[0, 0])


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (FEATURES - 1)


_VOTE_SLOTS = [_slot(f"#vote {name}") for name, *_ in VOTERS]


def features(window: str, pattern: int) -> np.ndarray:
    """Hashed words, pairs of neighbours and votes."""
    words = window.split()
    grams = [_slot(w) for w in words] + [_slot(f"{a} {b}") for a, b in zip(words, words[1:])]
    return np.array(grams + [s for k, s in enumerate(_VOTE_SLOTS) if pattern >> k & 1], np.int64)


def train_classifier(texts: list[str], patterns: list[int], target: np.ndarray, weight: np.ndarray, epochs: int = 10, rate: float = 0.15, decay: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad. In each epoch a part of the windows, drawn anew, is shown by its votes
    alone, so that votes and bias also stand by themselves on wordings that were never seen."""
    g = np.random.default_rng(seed)
    feats = [features(t, p) for t, p in zip(texts, patterns)]
    bare = [features("", p) for p in patterns]
    w, h, bias, hb = np.zeros(FEATURES, np.float64), np.full(FEATURES, 1e-3), -3.0, 1e-3
    order = np.arange(len(texts))
    for _ in range(epochs):
        g.shuffle(order)
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            shown = [bare[i] if blind else feats[i] for i, blind in zip(part, g.random(len(part)) < VOTES_ALONE)]
            sizes = np.array([len(x) for x in shown])
            idx, row = np.concatenate(shown), np.repeat(np.arange(len(part)), sizes)
            z = np.bincount(row, w[idx], len(part)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part]
            live, where = np.unique(idx, return_inverse=True)
            step = np.bincount(where, err[row], len(live)) + decay * w[live]
            h[live] += step * step
            w[live] -= rate * step / np.sqrt(h[live])
            b = err.sum()
            hb += b * b
            bias -= rate * b / np.sqrt(hb)
    return w.astype(np.float32), float(bias)


def _mixed(own: int, n: int) -> int:
    """A 32-bit hash of a document's hash and the number of a window in it."""
    x = (own ^ (n * 0x9E3779B1)) & 0xFFFFFFFF
    x = ((x ^ x >> 16) * 0x85EBCA6B) & 0xFFFFFFFF
    x = ((x ^ x >> 13) * 0xC2B2AE35) & 0xFFFFFFFF
    return x ^ x >> 16


def _segment_votes(seg: str, memo: dict[str, tuple]) -> tuple:
    """Votes of each window of a segment."""
    known = memo.get(seg)
    if known is None:
        words = words_of(seg)
        masks = [classes(w) for w in words]
        known = tuple(votes_on(words[a:b], masks[a:b]) for a, b in ranges(len(words)))
        if len(memo) < _MEMO and len(seg) < 600:
            memo[seg] = known
    return known


def fit(docs: DataFrame, train: int = TRAIN) -> tuple[LabelModel, np.ndarray, float]:
    """Votes on all windows of all documents are counted. The windows to train on are those with the smallest hashes,
    so the sample is the same whatever the partitions; their bound comes from a histogram of hashes."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        memo: dict[str, tuple] = {}
        kept: dict[int, dict[tuple[int, str], int]] = {0: {}, 1: {}}  # (hash, window) -> votes, without and with an abuse vote
        limit = {0: 1 << 32, 1: 1 << 32}
        for pdf in batches:
            for text in pdf.text:
                own, n = zlib.crc32(text.encode()), 0
                for seg in segments(text):
                    words = None
                    for i, v in enumerate(_segment_votes(seg, memo)):
                        counts[v] += 1
                        n += 1
                        side = 1 if v & _ABUSE_BITS else 0
                        h = _mixed(own, n)  # occurrences are drawn, so frequent windows are learnt well
                        if h < limit[side]:
                            words = words or words_of(seg)
                            a, b = ranges(len(words))[i]
                            kept[side][h, " ".join(words[a:b])] = v
                            if len(kept[side]) > 2 * train:
                                best = sorted(kept[side].items())[:train]
                                kept[side], limit[side] = dict(best), best[-1][0][0]
        yield pd.DataFrame({"window": None, "side": -1, "h": 0, "votes": list(counts), "n": list(counts.values())}).astype({"window": object})
        for side, ws in kept.items():
            best = sorted(ws.items())[:train]
            yield pd.DataFrame({"window": [w for (_, w), _ in best], "side": side, "h": [h for (h, _), _ in best], "votes": [v for _, v in best], "n": 1}).astype({"window": object})

    seen = durable(docs.where("text <> ''").select("text").mapInPandas(vote, "window string, side int, h bigint, votes bigint, n bigint"))
    patterns = bounded(seen.where("side < 0").groupBy("votes").agg(F.sum("n").alias("n")), PATTERNS, "vote patterns")
    if not patterns:
        return LabelModel([0], [1], 1), np.zeros(FEATURES, np.float32), -10.0
    model = LabelModel([r["votes"] for r in patterns], [r["n"] for r in patterns])
    sample = seen.where("side >= 0").select("side", "window", "h", "votes").distinct()
    bucket = F.shiftright("h", 32 - _BUCKETS.bit_length() + 1)
    histogram = {(r["side"], r["b"]): r["n"] for r in sample.groupBy("side", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 x 4,096 rows at most
    rows = []
    for side in (0, 1):
        sums = list(accumulate(histogram.get((side, b), 0) for b in range(_BUCKETS)))
        last = next((b for b, total in enumerate(sums) if total >= train), _BUCKETS - 1)
        rows += sample.where((F.col("side") == side) & (bucket <= last)).orderBy("h", "window").limit(train).collect()
    w, bias = learn(model, [(r["window"], r["votes"]) for r in rows])
    return model, w, bias


def learn(model: LabelModel, sample: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """The classifier of a sample of (window, votes). Beside the sample stand all single votes and pairs of votes, without
    words, with what the label model makes of them, so that a voter counts that hardly ever fires in the sample."""
    alone = [1 << k for k in range(len(VOTERS))]
    alone += [a | b for i, a in enumerate(alone) for b in alone[:i]]
    sample = sample + [("", v) for v in alone if v & _ABUSE_BITS] * COPIES
    target = np.array([model.of(v) for _, v in sample])
    sure = np.abs(2 * target - 1)  # undecided labels teach little
    return train_classifier([x for x, _ in sample], [v for _, v in sample], target, 0.1 + 0.9 * sure)


class Scorer:
    """The classifier over segments; what words and segments weigh is kept from text to text."""

    def __init__(self, w: np.ndarray, bias: float):
        self.bias, self.memo = bias, {}
        self.votes = [float(w[s]) for s in _VOTE_SLOTS]
        self.w, self.known = w, {}

    def _weight(self, gram: str) -> float:
        x = self.known.get(gram)
        if x is None:
            x = float(self.w[_slot(gram)])
            if len(self.known) < 4 * _MEMO:
                self.known[gram] = x
        return x

    def segment(self, seg: str) -> float:
        """Log-odds of the segment's worst window; -40 if it holds no word."""
        top = self.memo.get(seg)
        if top is not None:
            return top
        words, top = words_of(seg), -40.0
        masks = [classes(w) for w in words]
        ones = [0.0, *accumulate(map(self._weight, words))]
        twos = [0.0, *accumulate(map(self._weight, map(" ".join, zip(words, words[1:]))))]
        for a, b in ranges(len(words)):
            z = self.bias + ones[b] - ones[a] + twos[max(a, b - 1)] - twos[a]
            pattern = votes_on(words[a:b], masks[a:b])
            while pattern:
                low = pattern & -pattern
                z += self.votes[low.bit_length() - 1]
                pattern ^= low
            top = max(top, z)
        if len(self.memo) < _MEMO and len(seg) < 600:
            self.memo[seg] = top
        return top

    def text(self, text: str | None) -> float:
        top = max(map(self.segment, segments(text)), default=-40.0)
        return float(1 / (1 + np.exp(-top))) if top > -40 else 0.0


def score(docs: DataFrame, w: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, source, score): the worst window's probability. Null, empty or wordless texts have score 0."""
    shared = docs.sparkSession.sparkContext.broadcast((w, bias))  # half a megabyte

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for series in texts:
            yield pd.Series([scorer.text(t) for t in series], dtype=float)

    return docs.select("doc_id", "source", F.pandas_udf(run, "double")("text").alias("score"))


def score_documents(docs: DataFrame, train: int = TRAIN) -> DataFrame:
    """(doc_id, source, score) of every row of docs; repeated rows each keep their score."""
    docs = docs.select("doc_id", "source", "text")
    _, w, bias = fit(docs, train)
    return score(docs, w, bias)


def rates(scored: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per source: documents, those at or above accept, and their share."""
    hit = (F.col("score") >= accept).cast("bigint")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("flagged"), F.avg(hit).alias("rate"))
