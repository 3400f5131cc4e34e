"""A character-level bidirectional LSTM with a CRF on top, in numpy: training by hand-written gradients,
decoding over overlapping windows that are reconciled by one global best path."""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 192, 128
CHARS = "\n !\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]_abcdefghijklmnopqrstuvwxyzáéíóúñüÁÉÍÓÚÑÜ"
_ID = {c: i + 2 for i, c in enumerate(CHARS)}


def encode(text: str) -> np.ndarray:
    """Character numbers; 0 is padding, 1 any other character."""
    return np.fromiter((_ID.get(c, 1) for c in text), np.int64, len(text))


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)  # tanh does not overflow and is vectorised


class Tagger:
    """params: E (chars x D), Wx/Wh/b per direction, Wo, bo (to tags), A (tag to tag), s, e (start, end)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.H = params["f_Wh"].shape[0]

    @classmethod
    def new(cls, tags: int, dim: int = 24, hidden: int = 48, seed: int = 0) -> "Tagger":
        g = np.random.default_rng(seed)
        mat = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": (0.3 * g.standard_normal((len(CHARS) + 2, dim))).astype(np.float32), "Wo": mat(2 * hidden, tags), "bo": np.zeros(tags, np.float32),
             "A": np.zeros((tags, tags), np.float32), "s": np.zeros(tags, np.float32), "e": np.zeros(tags, np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0  # remember at first
            p |= {f"{d}_Wx": mat(dim, 4 * hidden), f"{d}_Wh": mat(hidden, 4 * hidden), f"{d}_b": b}
        return cls(p)

    # forward ------------------------------------------------------------------------------------------
    def _run(self, gates: np.ndarray, Wh: np.ndarray, keep: bool):
        T, B, _ = gates.shape
        H = self.H
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        hs, cache = np.empty((T, B, H), np.float32), []
        for t in range(T):
            z = gates[t] + h @ Wh
            ifo = _sigmoid(z[:, : 3 * H])
            g = np.tanh(z[:, 3 * H :])
            i, f, o = ifo[:, :H], ifo[:, H : 2 * H], ifo[:, 2 * H :]
            before = c
            c = f * before + i * g
            tc = np.tanh(c)
            if keep:
                cache.append((h, before, i, f, o, g, tc))
            h = o * tc
            hs[t] = h
        return hs, cache

    def emissions(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """ids (T, B) -> scores (T, B, tags)."""
        p, (T, B) = self.p, ids.shape
        rev = np.where(np.arange(T)[:, None] < lengths[None], lengths[None] - 1 - np.arange(T)[:, None], np.arange(T)[:, None])
        cols = np.arange(B)[None]
        ids_b = ids[rev, cols]
        out = {}
        for d, x in (("f", ids), ("b", ids_b)):
            table = p["E"] @ p[f"{d}_Wx"] + p[f"{d}_b"]  # one row of gate inputs per character
            out[d] = self._run(table[x], p[f"{d}_Wh"], keep)
        hb = out["b"][0][rev, cols]
        hcat = np.concatenate([out["f"][0], hb], axis=2)
        em = hcat @ p["Wo"] + p["bo"]
        return (em, (ids, ids_b, rev, cols, out, hcat)) if keep else em

    # training -----------------------------------------------------------------------------------------
    def loss_and_grads(self, ids, lengths, tags):
        p, H = self.p, self.H
        em, (ids, ids_b, rev, cols, out, hcat) = self.emissions(ids, lengths, keep=True)
        T, B, K = em.shape
        mask = np.arange(T)[:, None] < lengths[None]
        A = p["A"]
        alpha, beta = np.empty((T, B, K)), np.empty((T, B, K))
        alpha[0] = em[0] + p["s"]
        for t in range(1, T):
            m = alpha[t - 1].max(1, keepdims=True)
            nxt = np.log(np.exp(alpha[t - 1] - m) @ np.exp(A) + 1e-30) + m + em[t]
            alpha[t] = np.where(mask[t][:, None], nxt, alpha[t - 1])
        last = alpha[T - 1] + p["e"]
        m = last.max(1, keepdims=True)
        logz = np.log(np.exp(last - m).sum(1)) + m[:, 0]
        beta[T - 1] = p["e"]
        expA = np.exp(A)
        for t in range(T - 2, -1, -1):
            v = beta[t + 1] + em[t + 1]
            m = v.max(1, keepdims=True)
            prev = np.log(np.exp(v - m) @ expA.T + 1e-30) + m
            beta[t] = np.where(mask[t + 1][:, None], prev, p["e"])
        marg = np.exp(alpha + beta - logz[None, :, None]) * mask[..., None]
        gold = np.zeros((T, B, K))
        gold[np.arange(T)[:, None], cols, tags] = 1
        gold *= mask[..., None]
        score = (em * gold).sum() + p["s"][tags[0]].sum() + p["e"][tags[lengths - 1, np.arange(B)]].sum()
        both = mask[1:]
        score += (A[tags[:-1], tags[1:]] * both).sum()
        dem = ((marg - gold) / B).astype(np.float32)
        g = {"s": (marg[0] - gold[0]).sum(0) / B, "e": None}
        endm = np.exp(last - logz[:, None])
        np.add.at(endm, (np.arange(B), tags[lengths - 1, np.arange(B)]), -1)
        g["e"] = endm.sum(0) / B
        dA = np.zeros((K, K))
        for t in range(1, T):
            w = both[t - 1]
            if not w.any():
                break
            left, right = alpha[t - 1][w], (em[t] + beta[t])[w] - logz[w][:, None]
            ml, mr = left.max(1, keepdims=True), right.max(1, keepdims=True)
            dA += expA * ((np.exp(left - ml) * np.exp(ml + mr)).T @ np.exp(right - mr))
            np.add.at(dA, (tags[t - 1][w], tags[t][w]), -1)
        g["A"] = dA / B
        g["Wo"] = np.tensordot(hcat, dem, ((0, 1), (0, 1)))
        g["bo"] = dem.sum((0, 1))
        dh = dem @ p["Wo"].T
        g["E"] = np.zeros_like(p["E"])
        for d, x, dout in (("f", ids, dh[..., :H]), ("b", ids_b, dh[..., H:][rev, cols])):
            Wh, Wx = p[f"{d}_Wh"], p[f"{d}_Wx"]
            dz = np.empty((T, B, 4 * H), np.float32)
            dhn, dcn = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
            dWh = np.zeros_like(Wh)
            for t in range(T - 1, -1, -1):
                h0, c0, i, f, o, gg, tc = out[d][1][t]
                dht = dout[t] + dhn
                dc = dcn + dht * o * (1 - tc * tc)
                dz[t, :, :H] = dc * gg * i * (1 - i)
                dz[t, :, H : 2 * H] = dc * c0 * f * (1 - f)
                dz[t, :, 2 * H : 3 * H] = dht * tc * o * (1 - o)
                dz[t, :, 3 * H :] = dc * i * (1 - gg * gg)
                dhn = dz[t] @ Wh.T
                dcn = dc * f
                dWh += h0.T @ dz[t]
            g[f"{d}_Wh"] = dWh
            per_char = np.zeros((len(p["E"]), 4 * H), np.float32)
            np.add.at(per_char, x.ravel(), dz.reshape(-1, 4 * H))
            g[f"{d}_Wx"] = p["E"].T @ per_char
            g[f"{d}_b"] = per_char.sum(0)
            g["E"] += per_char @ Wx.T
        return float((logz.sum() - score) / B), g

    def train(self, batches, rate: float = 0.004, clip: float = 5.0, say=None):
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step, (ids, lengths, tags, scale) in enumerate(batches, 1):
            loss, g = self.loss_and_grads(ids, lengths, tags)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, clip / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.p[k] = (self.p[k] - rate * scale * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if say:
                say(step, loss)

    # decoding -----------------------------------------------------------------------------------------
    def best_paths(self, texts: list[str], batch: int = 512) -> list[np.ndarray]:
        """The best tag of every character of each text. Windows overlap; a character's scores come from the
        window in which it stands farthest from an edge, and one path is sought over the whole text."""
        K = len(self.p["bo"])
        scores = [np.empty((len(t), K), np.float32) for t in texts]
        jobs = []
        for n, t in enumerate(texts):
            starts = [0] if len(t) <= WINDOW else [*range(0, len(t) - WINDOW, STRIDE), len(t) - WINDOW]
            for j, a in enumerate(starts):
                b = min(len(t), a + WINDOW)
                lo = a if j == 0 else (a + starts[j - 1] + WINDOW) // 2
                hi = b if j + 1 == len(starts) else (starts[j + 1] + b) // 2
                if t:
                    jobs.append((b - a, n, a, b, lo, hi))
        jobs.sort()
        for k in range(0, len(jobs), batch):
            part = jobs[k : k + batch]
            lengths = np.array([x[0] for x in part])
            ids = np.zeros((lengths.max(), len(part)), np.int64)
            for c, (size, n, a, b, _, _) in enumerate(part):
                ids[:size, c] = encode(texts[n][a:b])
            em = self.emissions(ids, lengths)
            for c, (_, n, a, _, lo, hi) in enumerate(part):
                scores[n][lo:hi] = em[lo - a : hi - a, c]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
        for k in range(0, len(order), batch):
            part = [i for i in order[k : k + batch] if len(texts[i])]
            if part:
                for i, path in zip(part, self._viterbi([scores[i] for i in part])):
                    paths[i] = path
        return paths

    def _viterbi(self, em: list[np.ndarray]) -> list[np.ndarray]:
        A, (B, T, K) = self.p["A"], (len(em), max(map(len, em)), len(self.p["bo"]))
        lengths = np.array([len(x) for x in em])
        pad = np.zeros((T, B, K), np.float32)
        for b, x in enumerate(em):
            pad[: len(x), b] = x
        back = np.zeros((T, B, K), np.int8)
        At = np.ascontiguousarray(A.T)[None]  # to, from
        v = pad[0] + self.p["s"]
        for t in range(1, T):
            cand = v[:, None, :] + At
            best = cand.argmax(2)
            back[t] = best
            v = np.where((t < lengths)[:, None], np.take_along_axis(cand, best[:, :, None], 2)[:, :, 0] + pad[t], v)
        tag = (v + self.p["e"]).argmax(1)
        out = np.zeros((T, B), np.int64)
        for t in range(T - 1, -1, -1):
            live = t < lengths
            out[t] = np.where(live, tag, 0)
            if t:
                tag = np.where(live, back[t, np.arange(B), tag], tag)
        return [out[: lengths[b], b] for b in range(B)]
