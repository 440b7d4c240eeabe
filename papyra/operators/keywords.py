"""Keywords: RAKE and YAKE by document, and the choice between them by configuration.

RAKE: candidate phrases are runs of words between stop words and delimiters, found by an array expression; a word's
score is its degree by its frequency within the document; a phrase's score is the sum of its words'. Scores are scaled
to 0..1 by document (all equal: 1). All of it lies within one document, so nothing is shuffled. Results: null and empty
texts have no keywords; ties go to the phrase that sorts first.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.config import Keywords


def phrases(text: Column, stop: Column) -> Column:
    """Candidate phrases of a text, in order, in lower case: an array expression, no shuffle."""
    marked = F.regexp_replace(F.lower(text), r"[^\pL\pN' \-]+", " \x01 ")
    tokens = F.filter(F.split(marked, r"[ \-]+"), lambda w: w != "")
    flagged = F.transform(tokens, lambda w: F.when((w == "\x01") | F.array_contains(stop, w), "\x01").otherwise(w))
    runs = F.transform(F.split(F.array_join(flagged, " "), "\x01"), lambda x: F.trim(x))
    return F.filter(runs, lambda p: p != "")


def rake_one(found: list[str], k: int = 10, min_score: float = 0.0, ngrams: tuple[int, int] = (1, 3), max_words: int = 3, min_length: int = 1) -> list[tuple[str, float]]:
    """The k best of a document's candidate phrases; a phrase has min_length bytes, and words within both bounds."""
    count = Counter(found)
    freq, degree = Counter(), Counter()
    split = {p: p.split(" ") for p in count}
    for p, n in count.items():
        for w in split[p]:
            freq[w] += n
            degree[w] += n * len(split[p])
    raw = {p: sum(degree[w] / freq[w] for w in ws) for p, ws in split.items() if ngrams[0] <= len(ws) <= min(ngrams[1], max_words) and len(p.encode()) >= min_length}
    if not raw:
        return []
    low, high = min(raw.values()), max(raw.values())
    scored = [(p, (v - low) / (high - low) if high > low else 1.0) for p, v in raw.items()]
    kept = [x for x in scored if min_score <= 0 or x[1] >= min_score]
    return sorted(kept, key=lambda x: (-round(x[1], 9), x[0]))[:k]


def rake(df: DataFrame, key: str, text: str, stop: str, k: int = 10, min_score: float = 0.0, max_words: int = 3, ngrams: tuple[int, int] = (1, 3), min_length: int = 1, fallback: list[str] | None = None) -> DataFrame:
    """(key, keyword, score): the k best phrases of each row; `stop` is a column with the row's stop words.

    `fallback` is another list of stop words, English ones as a rule, tried for rows that have no keyword with their own.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, scores = [], [], []
            for i, found in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, batch.num_columns)))):
                got = next((g for f in found if (g := rake_one(f or [], k, min_score, ngrams, max_words, min_length))), [])
                at += [i] * len(got)
                words += [p for p, _ in got]
                scores += [v for _, v in got]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(scores, pa.float64())], [key, "keyword", "score"])

    lists = [phrases(F.col(text), F.col(stop)).alias("p")]
    if fallback is not None:
        lists.append(phrases(F.col(text), F.array(*[F.lit(w) for w in fallback])).alias("q"))
    return df.select(key, *lists).mapInArrow(run, f"`{key}` {kind}, keyword string, score double")


_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_TERM = re.compile(r"[^\W_][\w'-]*")


def yake_one(text: str, stop: set[str], k: int = 10, longest: int = 3, window: int = 2) -> list[tuple[str, float]]:
    """The k best terms of a text by casing, position, frequency, relatedness and spread; higher is better, below 1."""
    sentences = [_TERM.findall(s) for s in _SENTENCE.split(text)]
    sentences = [s for s in sentences if s]
    if not sentences:
        return []
    tf, upper, acro, where = Counter(), Counter(), Counter(), defaultdict(list)
    left, right = defaultdict(Counter), defaultdict(Counter)
    for i, s in enumerate(sentences):
        for j, w in enumerate(s):
            t = w.lower()
            tf[t] += 1
            where[t].append(i)
            if w.isupper() and len(w) > 1:
                acro[t] += 1
            elif w[0].isupper() and j:
                upper[t] += 1
            for d in range(1, window + 1):
                if j >= d:
                    left[t][s[j - d].lower()] += 1
                    right[s[j - d].lower()][t] += 1
    real = [n for t, n in tf.items() if t not in stop] or [1]
    mean = sum(real) / len(real)
    std = math.sqrt(sum((n - mean) ** 2 for n in real) / len(real))
    most, score = max(tf.values()), {}
    for t, n in tf.items():
        case = max(upper[t], acro[t]) / (1 + math.log(n))
        spots = sorted(where[t])
        pos = math.log(math.log(3 + spots[len(spots) // 2]))
        freq = n / (mean + std)
        dl = len(left[t]) / sum(left[t].values()) if left[t] else 0
        dr = len(right[t]) / sum(right[t].values()) if right[t] else 0
        rel = 1 + (dl + dr) * n / most
        spread = len(set(spots)) / len(sentences)
        score[t] = rel * pos / (case + freq / rel + spread / rel)
    terms: Counter = Counter()
    for s in sentences:
        low = [w.lower() for w in s]
        for size in range(1, longest + 1):
            for j in range(len(low) - size + 1):
                g = low[j : j + size]
                if g[0] not in stop and g[-1] not in stop and all(len(w) > 2 or w in stop for w in g):
                    terms[" ".join(g)] += 1
    out = []
    for g, n in terms.items():
        own = [score[w] for w in g.split() if w not in stop]
        prod = math.prod(own)
        out.append((g, prod / (n * (1 + sum(own)))))
    out.sort(key=lambda x: (x[1], x[0]))
    return [(g, 1 / (1 + max(v, 0.0))) for g, v in out[:k]]


def yake_kept(text: str, stop: set[str], k: int, ngrams: tuple[int, int], window: int, min_score: float) -> list[tuple[str, float]]:
    """The k best first, then those with enough words and a high enough score: fewer than k may stay."""
    best = yake_one(text, stop, k, ngrams[1], window)
    return [(g, v) for g, v in best if len(g.split()) >= ngrams[0] and (min_score <= 0 or v >= min_score)]


def yake(df: DataFrame, key: str, text: str, stop: str, k: int = 10, ngrams: tuple[int, int] = (1, 3), window: int = 2, min_score: float = 0.0) -> DataFrame:
    """(key, keyword, score) by yake_one and the filters after it."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, scores = [], [], []
            for i, (t, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for g, v in yake_kept(t or "", set(s or []), k, ngrams, window, min_score):
                    at.append(i)
                    words.append(g)
                    scores.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(scores, pa.float32())], [key, "keyword", "score"])

    return df.select(key, text, stop).mapInArrow(run, f"`{key}` {kind}, keyword string, score float")


def extract(df: DataFrame, key: str, text: str, stop: str, settings: Keywords = Keywords(), english: list[str] | None = None) -> DataFrame:
    """(key, keyword, score) by the algorithm of the settings."""
    if settings.algorithm == "rake":
        return rake(df, key, text, stop, settings.max_keywords, settings.min_score, settings.max_words, settings.ngram_range, settings.min_length, english)
    return yake(df, key, text, stop, settings.max_keywords, settings.ngram_range, settings.window, settings.min_score)


def column(text: Column, stop: list[str], settings: Keywords = Keywords()) -> Column:
    """The keywords of a text with their scores, best first: an array of structs, by Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    kind = "array<struct<keyword:string,score:double>>"
    own = set(stop)

    @pandas_udf(kind)
    def of_phrases(found):
        return found.map(lambda ps: [{"keyword": p, "score": v} for p, v in rake_one(list(ps) if ps is not None else [], settings.max_keywords, settings.min_score, settings.ngram_range, settings.max_words, settings.min_length)])

    @pandas_udf(kind)
    def of_text(texts):
        return texts.map(lambda t: [{"keyword": p, "score": float(v)} for p, v in yake_kept(t or "", own, settings.max_keywords, settings.ngram_range, settings.window, settings.min_score)])

    return of_phrases(phrases(text, F.array(*[F.lit(w) for w in stop]))) if settings.algorithm == "rake" else of_text(text)
