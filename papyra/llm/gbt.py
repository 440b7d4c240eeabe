"""Gradient-boosted trees with logistic loss, grown and applied column by column.

Trees are symmetric: all nodes of a level share one test, so a tree of depth d is d column comparisons and one
table lookup, which numpy does over millions of rows without a Python loop over rows.
"""

from __future__ import annotations

import json
import os

import numpy as np

MODELS = os.path.join(os.path.dirname(__file__), "models")


class Boosted:
    """Binned columns, symmetric trees, and a calibrated probability."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple[list[int], list[int], np.ndarray]], base: float, scale: tuple[float, float] = (1.0, 0.0)):
        self.edges, self.trees, self.base, self.scale = edges, trees, base, scale

    # ------------------------------------------------------------ fitting

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 32, l2: float = 3.0, weight: np.ndarray | None = None) -> Boosted:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        edges = [np.unique(np.concatenate([e, [0.0]])) if (x[:, j] == 0).mean() > 0.3 else e for j, e in enumerate(edges)]
        b = cls._bin(x, edges)
        w = np.ones(n) if weight is None else weight
        p0 = min(max((y * w).sum() / w.sum(), 1e-4), 1 - 1e-4)
        base = float(np.log(p0 / (1 - p0)))
        score, out = np.full(n, base), []
        wide = [len(e) + 1 for e in edges]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * w, p * (1 - p) * w
            leaf, feats, cuts = np.zeros(n, dtype=np.int64), [], []
            for level in range(depth):
                best = (1e-9, -1, -1)
                for j in range(width):
                    k = wide[j]
                    if k < 2:
                        continue
                    at = leaf * k + b[j]
                    hg = np.bincount(at, g, minlength=k << level).reshape(-1, k)
                    hh = np.bincount(at, h, minlength=k << level).reshape(-1, k)
                    lg, lh = np.cumsum(hg, 1)[:, :-1], np.cumsum(hh, 1)[:, :-1]
                    tg, th = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                    gain = (lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)).sum(0)
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), j, c)
                if best[1] < 0:
                    break
                feats.append(best[1])
                cuts.append(best[2])
                leaf |= (b[best[1]] > best[2]).astype(np.int64) << level
            if not feats:
                break
            size = 1 << len(feats)
            value = rate * np.bincount(leaf, g, minlength=size) / (np.bincount(leaf, h, minlength=size) + l2)
            score += value[leaf]
            out.append((feats, cuts, value.astype(np.float32)))
        return cls(edges, out, base)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit the two numbers of a logistic calibration on rows that weren't fitted on."""
        s, (a, b) = self.raw(x), (1.0, 0.0)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            r, v = t - p, p * (1 - p) + 1e-6
            m = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(m, [(r * s).sum(), r.sum()])
            a, b = a + step[0], b + step[1]
        self.scale = (float(max(a, 0.05)), float(b))
        return self

    # ------------------------------------------------------------ applying

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        used = sorted({f for t in self.trees for f in t[0]})
        b = {j: np.searchsorted(self.edges[j], x[:, j], side="left").astype(np.uint8) for j in used}
        score = np.full(len(x), self.base, dtype=np.float32)
        for feats, cuts, value in self.trees:
            at = (b[feats[0]] > cuts[0]).astype(np.uint8)
            for level in range(1, len(feats)):
                at |= (b[feats[level]] > cuts[level]).view(np.uint8) << np.uint8(level)
            score += value[at]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))

    # ------------------------------------------------------------ files

    def as_json(self) -> dict:
        return {
            "edges": [[float(f"{v:.6g}") for v in e] for e in self.edges],
            "trees": [[f, c, [float(f"{v:.5g}") for v in leaf]] for f, c, leaf in self.trees],
            "base": self.base,
            "scale": list(self.scale),
        }

    @classmethod
    def of_json(cls, d: dict) -> Boosted:
        trees = [(f, c, np.array(v, dtype=np.float32)) for f, c, v in d["trees"]]
        return cls([np.array(e) for e in d["edges"]], trees, d["base"], tuple(d["scale"]))


def save(name: str, models: dict[str, Boosted], **more) -> None:
    os.makedirs(MODELS, exist_ok=True)
    with open(f"{MODELS}/{name}.json", "w") as f:
        json.dump({"models": {k: m.as_json() for k, m in models.items()}, **more}, f, separators=(",", ":"))


_loaded: dict[str, tuple[dict[str, Boosted], dict]] = {}


def load(name: str) -> tuple[dict[str, Boosted], dict]:
    if name not in _loaded:
        with open(f"{MODELS}/{name}.json") as f:
            d = json.load(f)
        _loaded[name] = ({k: Boosted.of_json(m) for k, m in d.pop("models").items()}, d)
    return _loaded[name]
