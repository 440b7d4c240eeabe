"""Encoding of a corpus with a public byte-level BPE vocabulary through a minimal acyclic transducer.

The frequent words of the corpus (counts over all documents) are compiled once into a minimal acyclic
automaton with shared suffixes. Every arc carries the number of words that sort before it, so that the sum
along a path is the word's rank (the transducer's output), and the rank addresses the word's ids. The
automaton is a few flat arrays in the shared folder; every Python worker memory-maps those files, so the lexicon is in
memory once per machine. Words that the automaton lacks are merged exactly by the vocabulary's ranks. In front of both,
each worker keeps the ids of the pieces it met last (at most MEMO entries, then it starts anew), since a repeated piece
needs no second walk through the automaton; the ids are the same with and without it.

Results: null and empty texts give the empty list; strings that look like special tokens are ordinary text;
white-space runs, unusual Unicode and very long words are encoded in full. Rows are never dropped or doubled;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import atexit
import base64
import itertools
import os
import re
import shutil
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import cut, new_shared_path, spread

#: Where the ranks of byte_bpe_50k are.
TOKENIZER_PATH = os.environ.get("PAPYRA_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: The automaton holds at most so many words, the most frequent ones; all others are merged, with the same ids.
LEXICON_WORDS = 50_000

#: Fixed value: the published split pattern of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split for texts without the characters of ODD, in the syntax of the faster standard module.
_PLAIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def _odd_class() -> str:
    """Characters that the two pattern modules class differently: numbers that aren't decimal, and old separators."""
    odd = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("No", "Nl")] + list("\x1c\x1d\x1e\x1f")
    # marks count as neither letter nor number in the vocabulary's pattern; the standard module agrees on those
    points, runs = sorted(map(ord, odd)), []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_UNSAFE_SPACE = re.compile(r"[^\S ] | \s")
_state: dict = {}


def _odd() -> re.Pattern:
    if "odd" not in _state:
        _state["odd"] = re.compile(_odd_class())
    return _state["odd"]


def words_of(text: str) -> list[str]:
    """The pre-token words of a text, in order; their concatenation is the text."""
    if not text.isascii() and _odd().search(text) or text.isascii() and re.search("[\x1c-\x1f]", text):
        import regex

        if "full" not in _state:
            _state["full"] = regex.compile(SPLIT)
        return _state["full"].findall(text)
    return _PLAIN.findall(text)


def pieces_of(text: str) -> list[str]:
    """Cuts of a text at places that always are word boundaries: before a single space between two non-spaces.

    Coarser than words and far cheaper to find; where spaces meet other white space, the words themselves.
    """
    if _UNSAFE_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return words_of(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


# ---------------------------------------------------------------- the automaton


class Automaton:
    """A minimal acyclic automaton over bytes whose path outputs add up to the rank of the word."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = keys, targets, skips, final, starts, ids

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Automaton:
        """Incremental construction from sorted words: the last branch is frozen and its suffixes are shared."""
        words = sorted(entries)
        arcs: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        register: dict[tuple, int] = {}

        def freeze(path: list[int], word: bytes, down_to: int) -> None:
            for depth in range(len(path) - 1, down_to, -1):
                state = path[depth]
                shape = (final[state], tuple(arcs[state].items()))
                same = register.setdefault(shape, state)
                if same != state:
                    arcs[path[depth - 1]][word[depth - 1]] = same

        path, last = [0], b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            freeze(path, last, common)
            del path[common + 1 :]
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        freeze(path, last, 0)

        order, counts = [], {}
        stack: list[tuple[int, bool]] = [(0, False)]
        while stack:  # post-order, without recursion
            state, done = stack.pop()
            if state in counts:
                continue
            if done:
                counts[state] = final[state] + sum(counts[t] for t in arcs[state].values())
                order.append(state)
                continue
            stack.append((state, True))
            for t in arcs[state].values():
                if t not in counts:
                    stack.append((t, False))
        number = {s: i for i, s in enumerate(reversed(order))}
        rows = []
        for s in order:
            before = int(final[s])
            for byte, t in sorted(arcs[s].items()):
                rows.append((number[s] << 8 | byte, number[t], before))
                before += counts[t]
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        ends = np.zeros(max(1, len(order)), dtype=bool)
        for s, i in number.items():
            ends[i] = final[s]
        lengths = [len(entries[w]) for w in words]
        return cls(
            table[:, 0].astype(np.int64),
            table[:, 1].astype(np.int32),
            table[:, 2].astype(np.int32),
            ends,
            np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            np.fromiter(itertools.chain.from_iterable(entries[w] for w in words), dtype=np.int32, count=sum(lengths)),
        )

    PARTS = ("keys", "targets", "skips", "final", "starts", "ids")

    def save(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)
        for part in self.PARTS:
            np.save(f"{path}/{part}.npy", getattr(self, part))

    @classmethod
    def mapped(cls, path: str) -> Automaton:
        return cls(*(np.load(f"{path}/{part}.npy", mmap_mode="r") for part in cls.PARTS))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, or -1, all words stepping through the automaton together."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        live = np.flatnonzero(lengths > 0)
        state, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        step, keys = 0, self.keys
        while len(live):
            want = state[live] << 8 | flat[begin[live] + step]
            at = np.searchsorted(keys, want)
            at[at == len(keys)] = 0
            ok = keys[at] == want
            live, at = live[ok], at[ok]
            total[live] += self.skips[at]
            state[live] = self.targets[at]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            done = done[self.final[state[done]]]
            out[done] = total[done]
            live = live[~ended]
        return out


# ---------------------------------------------------------------- exact merges


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merger(data: bytes):
    """Exact byte-pair merging by rank of one pre-token word, by the tokenizer library."""
    import tiktoken

    own = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=read_ranks(data), special_tokens={})
    return own.encode_single_piece if hasattr(own, "encode_single_piece") else own._encode_single_piece


class Encoder:
    """Words and pieces to ids: first the memo of this worker, then the mapped automaton, then exact merging."""

    MEMO = 400_000

    def __init__(self, ranks: bytes, automaton: Automaton | None):
        self.merge, self.automaton = merger(ranks), automaton
        self.memo: dict[str, list[int]] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        memo = self.memo
        new = [p for p in set(pieces) if p not in memo]
        if not new:
            return
        split = [words_of(p) for p in new]
        words = list({w for ws in split for w in ws})
        ids: dict[str, list[int]] = {}
        if self.automaton is not None:
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            ranks = self.automaton.ranks(raw)
            starts, values = self.automaton.starts, self.automaton.ids
            for w, r in zip(words, ranks.tolist()):
                if r >= 0:
                    ids[w] = values[starts[r] : starts[r + 1]].tolist()
        for w in words:
            if w not in ids:
                ids[w] = self.merge(w.encode("utf-8", "replace"))
        for p, ws in zip(new, split):
            memo[p] = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        offsets, parts = [0], []
        for some in _groups(texts):
            cuts = [pieces_of(t) if t else [] for t in some]
            if len(self.memo) > self.MEMO:
                self.memo.clear()
            self.learn(itertools.chain.from_iterable(cuts))
            get = self.memo.__getitem__
            for c in cuts:
                ids = list(itertools.chain.from_iterable(map(get, c)))
                parts.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
        return np.array(offsets, dtype=np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def count_all(self, texts: list[str | None]) -> list[int]:
        out = []
        for some in _groups(texts):
            cuts = [pieces_of(t) if t else [] for t in some]
            if len(self.memo) > self.MEMO:
                self.memo.clear()
            self.learn(itertools.chain.from_iterable(cuts))
            get = self.memo.__getitem__
            out += [sum(map(len, map(get, c))) for c in cuts]
        return out


def _groups(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of bounded size, so that a batch of very long texts isn't cut up all at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


# ---------------------------------------------------------------- operators


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents, counted within each batch before the shuffle. Null and empty texts have no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for batch in batches:
            of: Counter = Counter()
            for t in batch.column(0):
                if s := t.as_py():
                    of.update(pieces_of(s))
            words: Counter = Counter()
            for p, n in of.items():
                if len(memo) > 200_000:
                    memo.clear()
                if (ws := memo.get(p)) is None:
                    ws = memo[p] = words_of(p)
                for w in ws:
                    words[w] += n
            kept = [(w, n) for w, n in words.items() if len(w) <= 64]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    return docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> DataFrame:
    """The rows of the highest counts, at most `words`: all above an edge that a small histogram of the counts gives.

    A sort with a limit would send the driver that many rows of every partition.
    """
    counts = cut(counts)
    step = F.floor(F.log2("n") * 16).cast("int")
    total, edge = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # at most 16 x 63 rows
        total += r.k
        if total > words:
            break
        edge = r.least
    return counts.filter(F.col("n") >= edge) if edge is not None else counts.filter(F.lit(False))


def build_lexicon(docs: DataFrame, text: str = "text", ranks_path: str = TOKENIZER_PATH, words: int = LEXICON_WORDS) -> tuple[str, bytes]:
    """Compile the most frequent words of all documents; returns the automaton's folder and the vocabulary's bytes.

    At most `words` rows reach the driver (a documented bound), however many partitions there are; which words those are
    changes speed only.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    top = most_frequent(word_counts(docs, text).filter("n > 1"), words).collect()
    merge = merger(ranks)
    entries = {(w := r.word.encode("utf-8", "surrogatepass")): merge(w) for r in top}
    path = new_shared_path(spark, "lexicon")
    automaton = Automaton.compile(entries)
    if path.startswith("file:") or "://" not in path:
        local = re.sub("^file:/*", "/", path)
        automaton.save(local)
        _dropped_at_exit(local)
        return local, ranks
    # a shared folder that isn't a file system: the files travel with the job from a temporary folder of the driver
    here = f"{tempfile.mkdtemp(prefix='papyra-')}/{path.rsplit('/', 1)[1]}"
    automaton.save(here)
    spark.sparkContext.addFile(here, recursive=True)
    _dropped_at_exit(os.path.dirname(here))
    return f"sparkfile:{os.path.basename(here)}", ranks


def _dropped_at_exit(path: str) -> None:
    """Lexicons are needed as long as frames made with them may run, so they go with the driver."""
    atexit.register(shutil.rmtree, path, ignore_errors=True)


_workers: dict[str, Encoder] = {}


def _encoder(path: str, ranks: bytes) -> Encoder:
    """One encoder for each worker process and lexicon."""
    if path not in _workers:
        _workers.clear()
        place = path
        if path.startswith("sparkfile:"):
            from pyspark import SparkFiles

            place = SparkFiles.get(path[10:])
        _workers[path] = Encoder(ranks, Automaton.mapped(place))
    return _workers[path]


def _id_type(df: DataFrame, key: str) -> str:
    return dict(df.dtypes)[key]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = TOKENIZER_PATH, words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): the ids of each row's text. Null and empty texts give the empty list."""
    docs = spread(docs.select(key, text), key)
    path, ranks = build_lexicon(docs, text, ranks_path, words)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # under 1 MB, the public vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                offsets, ids = own.encode_all(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return docs.mapInArrow(run, f"`{key}` {_id_type(docs, key)}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), ranks_path: str = TOKENIZER_PATH) -> DataFrame:
    """(key, *keep, n_tokens): number of tokens of each row's text; 0 for null and empty texts.

    Counting needs no lexicon, so the texts are read once.
    """
    docs = spread(docs.select(key, *keep, text), key)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB, the public vocabulary
    schema = ", ".join(f"`{c}` {_id_type(docs, c)}" for c in (key, *keep)) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "count" not in _workers:
            _workers["count"] = Encoder(shared.value, None)
        for batch in batches:
            n = _workers["count"].count_all(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [key, *keep, "n_tokens"])

    return docs.mapInArrow(run, schema)
