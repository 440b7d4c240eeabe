"""Text statistics of each document, and the class of its content: prose, list, table or junk.

Boosted trees judge each line by the statistics of the line, its block and its document; a document's class is
the one that most of its characters have. The trees were trained on lines labelled by rules (weak labels) and
their probabilities calibrated on documents checked by eye; see train_textclass.py.

Results: null and blank contents have statistics of zero and no class; a repeated or redelivered row counts
once; ties go to prose, then table, list, junk. Texts are read whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm import gbt, textstats
from papyra.session import spread

CLASSES = ("prose", "table", "list", "junk")
#: Characters that are judged at once.
BATCH = 3_000_000


def batches_of(texts: list[str | None], size: int = BATCH) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of texts that aren't blank, with their places, of bounded total length."""
    at, run, total = [], [], 0
    for i, t in enumerate(texts):
        if t and not t.isspace():
            at.append(i)
            run.append(t)
            total += len(t)
            if total >= size:
                yield at, run
                at, run, total = [], [], 0
    if run:
        yield at, run


def line_classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities by CLASSES, document, characters) of each line with ink."""
    models, _ = gbt.load("textclass")
    x, doc, chars = textstats.features([t.replace("\x00", " ") for t in texts])
    p = np.column_stack([models[c].predict(x) for c in CLASSES]) if len(x) else np.zeros((0, 4))
    return p / np.maximum(p.sum(1, keepdims=True), 1e-9), doc, chars


def class_shares(texts: list[str]) -> np.ndarray:
    """For each text the characters of its lines by class, as shares."""
    p, doc, chars = line_classes(texts)
    best = p.argmax(1)
    out = np.zeros((len(texts), len(CLASSES)))
    np.add.at(out, (doc, best), chars)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def decide(shares: np.ndarray) -> np.ndarray:
    """Index of the class of each row of shares: prose unless less than half is prose, then the largest other."""
    other = shares.copy()
    other[:, 0] = -1
    return np.where(shares[:, 0] >= 0.5, 0, other.argmax(1))


def classify(df: DataFrame, key: str = "result_id", text: str = "content") -> DataFrame:
    """(key, text_class, share_prose, share_table, share_list, share_junk) of each text that isn't blank."""
    kind = dict(df.dtypes)[key]
    rows = spread(df.select(key, text), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch.column(1).to_pylist()):
                s = class_shares(texts)
                names = [CLASSES[i] for i in decide(s)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(names), *[pa.array(s[:, i]) for i in range(4)]],
                    [key, "text_class", *[f"share_{c}" for c in CLASSES]],
                )

    schema = f"`{key}` {kind}, text_class string, " + ", ".join(f"share_{c} double" for c in CLASSES)
    return rows.mapInArrow(run, schema).dropDuplicates([key])


STATS = ("n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "damaged_ratio", "end_punctuation_share", "item_share", "common_word_share")


def statistics(df: DataFrame, key: str = "result_id", text: str = "content") -> DataFrame:
    """One row of statistics for each row, zero for null and blank texts."""
    kind = dict(df.dtypes)[key]
    rows = spread(df.select(key, text), key)
    name = {n: i for i, n in enumerate(textstats.ALL_NAMES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            out = np.zeros((len(all_texts), len(STATS)))
            out[:, 0] = [len(t or "") for t in all_texts]
            for at, texts in batches_of(all_texts):
                x, doc, _ = textstats.features([t.replace("\x00", " ") for t in texts])
                firsts = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
                d = np.array(at)[doc[firsts]]
                g = lambda n: x[firsts, name[n]].astype(float)
                lines = np.bincount(doc, minlength=len(texts))[doc[firsts]]
                out[d, 1] = lines
                out[d, 2] = np.rint(g("doc_words_a_line") * lines)
                out[d, 3] = np.where(out[d, 2] > 0, g("doc_word_length"), 0)
                out[d, 4] = g("doc_share_symbol") + g("doc_share_pipe") + g("doc_share_mark")
                for k, n in ((5, "digit"), (6, "upper"), (7, "damaged")):
                    out[d, k] = g(f"doc_share_{n}")
                out[d, 8], out[d, 9], out[d, 10] = g("doc_ends"), g("doc_item"), g("doc_share_common")
            cols = [pa.array(out[:, i].astype(np.int64) if i < 3 else out[:, i]) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, *STATS])

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} {'bigint' if i < 3 else 'double'}" for i, c in enumerate(STATS))
    return rows.mapInArrow(run, schema).dropDuplicates([key])
