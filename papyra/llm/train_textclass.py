"""Training of the text-class model: python -m papyra.llm.train_textclass DATA_DIR papyra/llm/textclass_holdout.json.

Lines get weak labels by the rules here; trees are fitted on the lines of at most SAMPLE documents (a documented
bound) and calibrated on one half of the documents whose class was checked by eye; the other half measures.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import Counter

import numpy as np

from papyra.llm import gbt, textclass, textstats
from papyra.llm.textclass import CLASSES, batches_of

#: Most documents that a fit takes, and lines of each.
SAMPLE, LINES = 6_000, 6

_COMMON = set(textstats.COMMON)
_ITEM = re.compile(r"^\s*(?:[-+*•–—·▪●o]\s|\[[ xX]?\]\s|\(?\w{1,2}[.)]\s|\(\w\)\s|\d+(?:\.\d+)*[.)]?\s|[A-Z]\t)")
_PATHLIKE = re.compile(r"^\s*(?:[-+*•–o]\s+)?[\w.-]+/[\w./-]+$")
_KEY = re.compile(r"^[^:.!?]{1,40}:\s\S")
_HEX = re.compile(r"^[0-9a-f]{8}\s+(?:[0-9a-f]{2}\s?)+")
_BASE = re.compile(r"^[A-Za-z0-9+/=]{40,}$")
_CID = re.compile(r"\(cid:\d+\)")
_MOJI = re.compile("[À-ÿ][\u0080-¿�]|�")


def junk_line(s: str) -> bool:
    t = s.strip()
    if not t:
        return False
    ink = re.sub(r"\s", "", t)
    n = len(ink)
    if _HEX.match(t) or _BASE.match(t) and re.search(r"\d|[a-z][A-Z]", t):
        return True
    if sum(map(len, _CID.findall(t))) > 0.5 * n:
        return True
    if 2 * len(_MOJI.findall(t)) > 0.3 * n or sum(c in "�□¤" for c in ink) > 0.12 * n:
        return True
    if "endobj" in t or "FlateDecode" in t or re.search(r"\bstream\b.*endstream", t):
        return True
    if n >= 20 and max(Counter(ink).values()) > 0.85 * n:
        return True
    letters = sum(c.isalpha() for c in ink)
    symbols = sum(not c.isalnum() and c not in "|│.,;:-()/'\"" for c in ink)
    if n >= 20 and symbols > 0.3 * n and letters < 0.5 * n:
        return True
    words = re.findall(r"[^\W\d_]{2,}", t.lower())
    if n >= 30 and words and not any("぀" <= c for c in t):
        vowels = sum(c in "aeiouyаеёиоуыэюяäöüáéíóúàèìòùâêîôûãõąęåøæœ" for w in words for c in w)
        if vowels < 0.15 * sum(map(len, words)) and letters > 0.5 * n:
            return True
    return n >= 60 and letters > 0.6 * n and " " not in t and not any("぀" <= c for c in t) and bool(re.search(r"\d", t))


def prose_block(lines: list[str]) -> bool:
    t = " ".join(x.strip(" >\t") for x in lines)
    words = re.findall(r"[^\W\d_]+", t.lower())
    cjk = sum("぀" <= c for c in t)
    if cjk > 0.4 * len(t):
        return "。" in t or "ました" in t or "です" in t
    if len(words) < 3:
        return False
    share = sum(w in _COMMON for w in words) / len(words)
    per_line = len(words) / len(lines)
    ended = sum(bool(re.search(r"[.!?…][\"'”»)]*\s*$", x)) for x in lines) / len(lines)
    digits = sum(c.isdigit() for c in t) / max(1, len(t))
    # a bar here and there may be a misread letter
    delimiters = sum(t.count(c) for c in "|│\t") + len(re.findall(r";(?=\S)", t))
    if digits > 0.2 or delimiters > 0.12 * len(words):
        return False
    return share > 0.12 and per_line >= 5 and (ended > 0.25 or re.search(r"[.!?][\"'”)]*\s+[A-ZÀ-ÞА-Я]", t) is not None or len(words) > 60)


def table_lines(lines: list[str]) -> set[int]:
    """Lines that share a delimiter or column gaps with most of their neighbours."""
    out: set[int] = set()
    for pattern, least in ((r"\|", 2), (r"│", 1), (r"\t", 1), (r";", 1), (r",(?!\s)", 1), (r"\S\s{2,}(?=\S)", 1)):
        # a delimiter at the very end closes an item of a list
        counts = [len(re.findall(pattern, x.strip(" ") if pattern != ";" and pattern[0] != "," else x.rstrip(" ,;") if sum(y.count(pattern[0]) for y in lines) <= len(lines) else x.strip(" "))) for x in lines]
        having = [c for c in counts if c >= least]
        if len(having) < 2 or len(having) < 0.5 * len(lines):
            continue
        common, n = Counter(having).most_common(1)[0]
        if pattern == r"\t" and sum(bool(re.match(r"^\s*(?:[A-Z]|\(?\w\)|\d+[.)])\t", x)) for x in lines) > 0.3 * len(lines):
            continue
        if pattern.startswith(r"\S") and sum(bool(_ITEM.match(x)) for x in lines) > 0.4 * len(lines):
            continue
        if n >= 0.5 * len(having) or pattern.startswith(r"\S") or pattern in (r"\|", "│"):
            out |= {i for i, c in enumerate(counts) if c >= least}
    return out


def weak_labels(text: str) -> list[str | None]:
    """A class for each line with ink, or None where the rules say nothing."""
    rows = [x.rstrip("\r") for x in text.split("\n")]
    blocks, own = [], []
    for i, x in enumerate(rows):
        if x.strip():
            own.append(i)
        elif own:
            blocks.append(own)
            own = []
    if own:
        blocks.append(own)
    label: dict[int, str | None] = {}
    for b in blocks:
        lines = [rows[i] for i in b]
        bad = sum(len(x) for x in lines if junk_line(x) and not re.search(r"\.{4,}\s*\d+$", x))
        if bad > 0.6 * sum(map(len, lines)):
            label |= {i: "junk" for i in b}
            continue
        if prose_block(lines):
            label |= {i: "prose" for i in b}
            continue
        tab = table_lines(lines)
        for k, i in enumerate(b):
            s = rows[i]
            label[i] = "list" if re.search(r"\.{4,}\s*\d+$", s) else "junk" if junk_line(s) else "table" if k in tab else "list" if _ITEM.match(s) or _PATHLIKE.match(s) or _KEY.match(s) or re.search(r"\.{4,}\s*\d+$", s) else None
            if label[i] is None and prose_block([s]) and re.search(r"[.!?。][\"'”]?\s*$", s):
                label[i] = "prose"
    # short lines without a say take the class of the document's other lines
    by = Counter()
    for i, c in label.items():
        if c:
            by[c] += len(rows[i])
    loose = [i for i, c in label.items() if c is None]
    # "[x] short" fragments and unmarked one-line items are lists
    main = by.most_common(1)[0][0] if by else "list"
    short = sum(len(re.findall(r"\w+", rows[i])) <= 8 for i in loose)
    for i in loose:
        words = len(re.findall(r"\w+", rows[i]))
        if short > 3 and short > 0.5 * len(label) and words <= 8:
            label[i] = "list"
        elif words <= 8 and len(loose) <= 3:
            label[i] = "list" if main == "prose" and len(label) < 4 else main if main != "junk" else None
    return [label[i] for i in sorted(label)]


def doc_label(text: str) -> str | None:
    rows = [x for x in text.split("\n") if x.strip("\r \t")]
    by = Counter()
    for x, c in zip(rows, weak_labels(text)):
        by[c] += len(x.strip())
    if by["prose"] >= 0.5 * sum(by.values()):
        return "prose"
    by.pop("prose", None)
    return by.most_common(1)[0][0] if by else None


def training(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, classes (-1: none) and the document of each line."""
    xs, ys, docs, base = [], [], [], 0
    for _, run in batches_of(texts):
        run = [t.replace("\x00", " ") for t in run]
        x, doc, _ = textstats.features(run)
        y = []
        for t in run:
            # the same notion of blank lines as the features have
            y += weak_labels(t)
        if len(y) != len(x):  # unusual line ends: fall back to document by document
            ok, y = [], []
            for d, t in enumerate(run):
                w = weak_labels(t)
                m = int((doc == d).sum())
                y += w if len(w) == m else [None] * m
        xs.append(x)
        ys += y
        docs.append(doc + base)
        base += len(run)
    return np.concatenate(xs), np.array([CLASSES.index(c) if c else -1 for c in ys]), np.concatenate(docs)


def made_up(n: int = 700, seed: int = 9) -> list[tuple[str, str]]:
    """Small tables and lists of other words than the data's, so that neither length nor vocabulary decides."""
    import random

    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.choice((1, 1, 3, 5, 8))))
    cell = lambda: rng.choice((word(), word(), str(rng.randrange(10 ** rng.randrange(1, 6))), f"{rng.random() * 99:.2f}", "", f"{word()} {word()}"))
    for _ in range(n):
        rows, cols, d = rng.randrange(3, 14), rng.randrange(2, 7), rng.choice("||;\t,│ ")
        grid = [[cell() or ("-" if d == " " else "") for _ in range(cols)] for _ in range(rows)]
        if d == "|":
            lines = ["| " + " | ".join(r) + " |" for r in grid]
            if rng.random() < 0.7:
                lines.insert(1, "|" + "---|" * cols)
        elif d == " ":
            lines = ["".join(c.ljust(14) for c in r) for r in grid]
        else:
            lines = [(f" {d} " if d == "│" else d).join(r) for r in grid]
        out.append(("\n".join(lines), "table"))
        sign = rng.choice(("- ", "* ", "+ ", "• ", "{}. ", "{}) ", "[ ] ", "", "({}) "))
        items = [sign.replace("{}", str(i + 1)) + " ".join(word() for _ in range(rng.randrange(1, 5))) + rng.choice(("", "", ";", ",")) for i in range(rng.randrange(3, 14))]
        out.append(("\n".join(items), "list"))
    return out


def calibrates(result_id: int) -> bool:
    """Whether a checked document belongs to the half that calibrates."""
    return zlib.crc32(str(result_id).encode()) % 2 == 0


def main(data: str, holdout: str | None = None) -> None:
    import duckdb

    rows = duckdb.sql(f"select result_id, any_value(content) from '{data}/extraction_results.parquet' where trim(content) <> '' group by 1 order by hash(result_id) limit {SAMPLE}").fetchall()
    checked = {int(k): v for k, v in json.load(open(holdout)).items()} if holdout else {}
    fit_rows = [t for r, t in rows if r not in checked]
    x, y, doc = training(fit_rows)
    more = made_up()
    mx, md, _ = textstats.features([t for t, _ in more])
    my = np.array([CLASSES.index(c) for _, c in more])[md]
    x, y, doc = np.concatenate([x, mx]), np.concatenate([y, my]), np.concatenate([doc, md + doc.max() + 1])
    # at most LINES lines of a document, and every document weighs the same, so that long ones don't decide
    rng = np.random.default_rng(5)
    order = rng.permutation(np.flatnonzero(y >= 0))
    order = order[np.argsort(doc[order], kind="stable")]
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    pick = order[rank < LINES]
    weight = 1.0 / np.bincount(doc[pick])[doc[pick]]
    models = {c: gbt.Boosted.fit(x[pick], (y[pick] == k).astype(float), trees=60, depth=5, rate=0.25, l2=0.5, weight=weight) for k, c in enumerate(CLASSES)}
    held = [(r, t, checked[r]) for r, t in rows if r in checked]
    if held:
        # one half of the checked documents calibrates, the other is measured on
        half = [h for h in held if calibrates(h[0])]
        xs, ks = [], []
        for _, t, c in half:
            hx, _, _ = textstats.features([t.replace("\x00", " ")])
            w = weak_labels(t)
            # in a checked document, all lines have its class but those of which the rules say another
            for row, k in zip(hx, w if len(w) == len(hx) else [None] * len(hx)):
                if k == c or k is None:
                    xs.append(row)
                    ks.append(CLASSES.index(c))
        hx, hk = np.array(xs), np.array(ks)
        for k, c in enumerate(CLASSES):
            models[c].calibrate(hx, (hk == k).astype(float))
    gbt.save("textclass", models, features=textstats.ALL_NAMES)
    rest = [h for h in held if not calibrates(h[0])]
    if rest:
        gbt._loaded.clear()
        got = [CLASSES[i] for i in textclass.decide(textclass.class_shares([t for _, t, _ in rest]))]
        print("checked documents that calibrate:", len(half), "- measured on the others:", sum(g == c for g, (_, _, c) in zip(got, rest)), "of", len(rest))


if __name__ == "__main__":
    main(*sys.argv[1:])
