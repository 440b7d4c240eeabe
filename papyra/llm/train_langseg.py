"""Training of the language field: python -m papyra.llm.train_langseg DATA_DIR.

Texts whose label agrees with their function words give single-language sentences; chains of sentences of one or
several languages, in the proportions of code-switched text, teach scores and transitions together by gradient
steps on the log-likelihood (forward-backward). At most SAMPLE documents are taken (a documented bound).
"""

from __future__ import annotations

import os
import re
import sys

import numpy as np

from papyra.llm import gbt
from papyra.llm.langseg import BUCKETS, LANGS, label_of, word_features, words_of

SAMPLE, CHAINS, STEPS = 6_000, 9_000, 60
#: Words of a made-up chain.
CHAIN = 64

#: Function words that vote on a text's language in training.
_VOTES = {
    "deu": "der die das und ist nicht mit von dem wir eine zu", "eng": "the of and to in is was for on with that", "fra": "le la les des une est dans pour qui du",
    "ita": "il della una che per di nel sono è un", "nld": "de het een van en is niet voor dat zijn", "pol": "nie na do jest się że w z oraz który", "por": "o os da do uma não para com que em",
    "rus": "и в на не что с по из для", "spa": "el los las una del que no para con en",
}


def vote(words: list[str]) -> str | None:
    if sum(w[0] >= "぀" for w in words) > 0.4 * len(words):
        return "jpn"
    seen = {k: sum(w in set(v.split()) for w in words) for k, v in _VOTES.items()}
    top = sorted(seen.values())
    return max(seen, key=seen.get) if top[-1] >= 3 and top[-1] > 1.25 * top[-2] else None


def main(data: str) -> None:
    import duckdb

    rows = duckdb.sql(f"select any_value(content), any_value(detected_languages) from '{data}/extraction_results.parquet' where length(content) > 80 group by result_id order by hash(result_id) limit {SAMPLE}").fetchall()
    rows += duckdb.sql(f"select text, [lang] from '{data}/documents.parquet' where length(text) > 80 order by hash(doc_id) limit {SAMPLE}").fetchall()
    units: dict[str, list[list[str]]] = {k: [] for k in LANGS}
    for text, labels in rows:
        for block in re.split(r"\n\s*\n", text):
            ws = words_of(block)
            own = vote(ws)
            if own and own in {label_of(c) for c in labels or []}:
                for s in re.split(r"(?<=[.!?。])\s*", block):
                    sw = words_of(s)
                    if 3 <= len(sw) <= 40:
                        units[own].append(sw)
            elif own is None and len({label_of(c) for c in labels or []}) == 1 and 2 <= len(ws) <= 400 and "\n" in block:
                k = label_of(labels[0])  # lists and tables: item by item, in the label's language
                if k:
                    for line in block.split("\n"):
                        lw = words_of(line)
                        if 2 <= len(lw) <= 8 and sum(map(len, lw)) > 0.5 * len(line.strip()):
                            units[k].append(lw)
    rng = np.random.default_rng(11)
    print({k: len(v) for k, v in units.items()})
    names = [k for k in LANGS if units[k]]
    chains: list[tuple[list[str], list[int]]] = []
    for _ in range(CHAINS):
        words, langs, k = [], [], names[rng.integers(len(names))]
        mixed = rng.random() < 0.3
        while len(words) < CHAIN:
            u = units[k][rng.integers(len(units[k]))]
            words += u
            langs += [LANGS.index(k)] * len(u)
            if mixed and rng.random() < 0.5:
                k = names[rng.integers(len(names))]
            elif not mixed and rng.random() < 0.15:
                break
        chains.append((words[:CHAIN], langs[:CHAIN]))
    kinds: dict[str, int] = {}
    x = np.zeros((len(chains), CHAIN), dtype=np.int64)
    y = np.full((len(chains), CHAIN), -1, dtype=np.int64)
    for r, (ws, ls) in enumerate(chains):
        for t, (w, k) in enumerate(zip(ws, ls)):
            x[r, t] = kinds.setdefault(w, len(kinds))
            y[r, t] = k
    mask = y >= 0
    feats = [word_features(w) for w in kinds]
    of = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    n = len(LANGS)
    weights, trans, begin = np.zeros((BUCKETS, n)), np.eye(n) * 2.0, np.zeros(n)
    g2w, g2t = np.full((BUCKETS, n), 1e-2), np.full((n, n), 1e-2)
    for step in range(STEPS):
        # words drop their own feature now and then, so that affixes learn to do without it
        use = rng.random(len(flat)) > 0.25
        rows_ = np.stack([np.bincount(of[use], weights[flat[use], k], minlength=len(feats)) for k in range(n)], 1)
        pick = rng.permutation(len(chains))[:3000]
        xs, ys, ms = x[pick], y[pick], mask[pick]
        e = rows_[xs]
        top = e.max(2, keepdims=True)
        ee, tt = np.exp(e - top), np.exp(trans)
        alpha = np.empty_like(ee)
        a = ee[:, 0] * np.exp(begin)
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, CHAIN):
            a = (alpha[:, t - 1] @ tt) * ee[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[:, t] = np.where(ms[:, t, None], a, alpha[:, t - 1])
        post, b = np.empty_like(alpha), np.ones((len(pick), n))
        gt = np.zeros((n, n))
        for t in range(CHAIN - 1, -1, -1):
            q = alpha[:, t] * b
            post[:, t] = q / q.sum(1, keepdims=True)
            if t:
                pair = alpha[:, t - 1][:, :, None] * tt[None] * (ee[:, t] * b)[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                on = ms[:, t]
                gt -= pair[on].sum(0)
                np.add.at(gt, (ys[on, t - 1], ys[on, t]), 1)
            nb = (ee[:, t] * b) @ tt.T
            nb /= nb.sum(1, keepdims=True)
            b = np.where(ms[:, t, None], nb, b)
        one = np.zeros_like(post)
        one[ms, ys[ms]] = 1
        d = (one - post)[ms]
        gw_word = np.stack([np.bincount(xs[ms], d[:, k], minlength=len(feats)) for k in range(n)], 1)
        gw = np.stack([np.bincount(flat[use], gw_word[of[use], k], minlength=BUCKETS) for k in range(n)], 1) - 0.02 * weights
        g2w += gw**2
        g2t += gt**2
        weights += 0.3 * gw / np.sqrt(g2w)
        trans += 0.2 * gt / np.sqrt(g2t)
        if step % 10 == 9:
            print(step + 1, "word accuracy", round(float((post.argmax(2)[ms] == ys[ms]).mean()), 4))
    os.makedirs(gbt.MODELS, exist_ok=True)
    np.savez_compressed(f"{gbt.MODELS}/langseg.npz", weights=weights.astype(np.float16), transition=trans.astype(np.float32), begin=begin.astype(np.float32))


if __name__ == "__main__":
    main(*sys.argv[1:])
