"""Splitting of oversized texts at natural boundaries by lexical cohesion.

For each text above the limit: find all boundaries (paragraph, line, sentence, word), give each inner boundary
the similarity of the word blocks before and after it, and cut at the deepest valley of the coarsest kind that
has a boundary in the window below the limit. The next piece begins at a boundary 100 to 200 characters back
where there is one, else at the cut.

Results: null, empty and short texts give no rows; repeated rows count once; a text without any white space is
cut after `limit` characters, never before a combining mark. Pieces that are white space only don't come out.
Other columns are not read, so clashing names do no harm. All offsets are within the text given.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.tokenise import TOKENIZER_PATH, Encoder

LIMIT, OVERLAP = 1000, (100, 200)
#: Words on each side of a boundary whose counts are compared.
BLOCK = 40
KINDS = ("paragraph", "line", "sentence", "word")

#: Fixed value: the characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORD = re.compile(r"[^\W_]+")
_IS_WHITE = np.zeros(max(map(ord, WHITE)) + 2, dtype=bool)
_IS_WHITE[[ord(w) for w in WHITE]] = True
#: Of each character met so far: whether it is known, whether words hold it, its lower case.
_known, _in_word, _lower = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
#: Characters whose lower case takes two characters or depends on their neighbours; words with them are lowered one by one.
UNEVEN = "\u0130\u03a3"
#: Characters of the texts that are looked at together.
GROUP = 500_000


def _inside(c: np.ndarray) -> np.ndarray:
    """Which characters belong to words; those that weren't met before are looked up once."""
    out = np.empty(len(c), dtype=bool)
    for at in range(0, len(c), GROUP):
        part = c[at : at + GROUP]
        new = part[~_known[part]]
        for i in np.unique(new).tolist() if len(new) else ():
            low = chr(i).lower()
            _known[i], _in_word[i], _lower[i] = True, chr(i).isalnum(), ord(low) if len(low) == 1 else i
        out[at : at + GROUP] = _in_word[part]
    return out


def _words(text: str) -> tuple[list[str], list[int]]:
    """The words of one text in lower case, and where they start; _ids gives the same for many texts at once."""
    words, starts = [], []
    for m in _WORD.finditer(text):
        w = m.group().lower()
        # scripts without spaces: pairs of characters stand for words
        if len(w) > 3 and ord(w[0]) >= 0x3040:
            for i in range(0, len(w) - 1, 2):
                words.append(w[i : i + 2])
                starts.append(m.start() + i)
        else:
            words.append(w)
            starts.append(m.start())
    return words, starts


def _ids(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the characters, the same for the same word in lower case, and where they start."""
    inside = _inside(c)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first and the last character are no part of a word
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    paired = (sizes > 3) & (_lower[c[starts]] >= 0x3040)
    if paired.any():
        inside[(starts + sizes - 1)[paired & (sizes % 2 == 1)]] = False
        times = np.where(paired, sizes // 2, 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, sizes = np.repeat(starts, times) + 2 * nth, np.repeat(np.where(paired, 2, sizes), times)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends * 4), pa.py_buffer(_lower[c[inside]])])
    return words.dictionary_encode().indices.to_numpy(), starts


class Texts:
    """Boundaries, word similarities and places in UTF-8 of several texts, found in one go."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        # a sign that is neither white space nor part of a word stands before each text and at the end
        self.c = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = np.array([len(t) for t in texts], dtype=np.int64)
        self.base = np.cumsum(self.n + 1) - self.n
        self.own_places = list(zip(*map(self._by_text, self._boundaries())))
        self._similarities()
        small = np.int32 if len(self.c) < 1 << 29 else np.int64  # half the memory, which counts with very long texts
        self.bytes = None if int(self.c.max()) < 0x80 else np.cumsum(np.uint8(1) + (self.c >= 0x80) + (self.c >= 0x800) + (self.c >= 0x10000), dtype=small)
        del self.c

    def _by_text(self, at: np.ndarray) -> list[list[int]]:
        """Places among all characters, each right after a character of a text, as places within the texts, their ends left out."""
        text = np.searchsorted(self.base, at, "right") - 1
        place = at - self.base[text]
        inner = place < self.n[text]
        text, place = text[inner], place[inner].tolist()
        to = np.searchsorted(text, np.arange(len(self.n) + 1)).tolist()
        return [place[a:b] for a, b in zip(to, to[1:])]

    def _boundaries(self) -> list[np.ndarray]:
        c = self.c
        white, lines = _IS_WHITE[np.minimum(c, len(_IS_WHITE) - 1)], np.flatnonzero(c == 10)
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        runs = edges[::2]
        # a paragraph ends after the last line end of a run of white space that holds an empty line or begins the text
        run = np.searchsorted(runs, lines, "right") - 1
        same = run[1:] == run[:-1]
        last, more = np.append(~same, True)[: len(lines)], np.append(False, same)[: len(lines)]
        paragraphs = lines[last & (more | np.isin(runs[run], self.base))] + 1
        stops = ((c[:-1] == 0x2E) | (c[:-1] == 0x21) | (c[:-1] == 0x3F)) & white[1:]
        return [paragraphs, lines + 1, np.flatnonzero(stops | (c[:-1] == 0x3002)) + 1, edges[1::2]]

    def _similarities(self) -> None:
        """Pairs of equal words across each place between two words, and the product of the pairs within both sides.

        The dot product of two blocks' counts is the number of equal pairs across them, a block's own product that of its
        pairs within, so numbers of pairs in windows of one and of two blocks, moved along by a word at a time, give all.
        """
        ids, starts = _ids(self.c)
        first = np.searchsorted(starts, self.base)
        count = np.append(first[1:], len(starts)) - first
        starts = starts - np.repeat(self.base, count)
        if any(x in t for t in self.texts for x in UNEVEN):
            parts = []
            for k, t in enumerate(self.texts):
                own, at = ids[first[k] : first[k] + count[k]], starts[first[k] : first[k] + count[k]]
                if any(x in t for x in UNEVEN):
                    words, at = _words(t)
                    numbers: dict[str, int] = {}
                    own = [numbers.setdefault(w, len(numbers)) for w in words]
                parts.append((np.array(own, dtype=np.int64), np.array(at, dtype=np.int64)))
            ids, starts = (np.concatenate(x) for x in zip(*parts))
            count = np.array([len(x[0]) for x in parts])
            first = np.cumsum(count) - count
        # between texts stand BLOCK words that equal no other
        text = np.repeat(np.arange(len(count)), count)
        x = -1 - np.arange(len(ids) + BLOCK * (len(count) + 1), dtype=np.int32)
        x[np.arange(len(ids)) + BLOCK * (text + 1)] = ids
        before, after, pairs = np.zeros(len(x), dtype=np.int16), np.zeros(len(x), dtype=np.int16), []
        for d in range(1, 2 * BLOCK):
            equal = (x[d:] == x[:-d]).view(np.uint8)
            before[d:] += equal
            after[:-d] += equal
            if d + 1 in (BLOCK, 2 * BLOCK):  # pairs in the d + 1 words before each place
                change = before.astype(np.int32)
                change[d + 1 :] -= after[: -d - 1]
                pairs.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(change, dtype=np.int32)]))
        # each text has one place more than words
        nth = np.arange(len(ids) + len(count)) - np.repeat(first + np.arange(len(count)), count + 1)
        at = nth + np.repeat(first + BLOCK * np.arange(1, len(count) + 1), count + 1)
        left, right = pairs[0][at], pairs[0][at + BLOCK]
        self.across = pairs[1][at + BLOCK] - left - right
        del at, x, before, after, pairs
        self.within = (np.minimum(nth, BLOCK) + 2 * left) * (np.minimum(np.repeat(count, count + 1) - nth, BLOCK) + 2 * right)
        self.starts, self.first, self.count = starts, first, count

    def cohesion(self, k: int) -> Cohesion:
        a, n = int(self.first[k]), int(self.count[k])
        return Cohesion(self.starts[a : a + n].tolist(), self.across[a + k : a + k + n + 1].tolist(), self.within[a + k : a + k + n + 1].tolist())

    def byte_places(self, k: int, places: list[int]) -> list[int]:
        """The places in UTF-8 of places in a text."""
        if self.bytes is None:
            return places
        a = int(self.base[k]) - 1
        return (self.bytes[np.array(places, dtype=np.int64) + a] - self.bytes[a]).tolist()


def boundaries(text: str) -> list[list[int]]:
    """For each kind, the places at which the text may be cut; a cut lies right after the sign that ends the piece."""
    return list(Texts([text]).own_places[0])


def cut_level(text: str, limit: int = LIMIT, found: list[list[int]] | None = None) -> str:
    """The first kind with which, together with the kinds before it, no piece is above the limit, else character."""
    places: set[int] = set()
    for kind, own in zip(KINDS, found or boundaries(text)):
        places |= set(own)
        at = [0, *sorted(places), len(text)]
        if all(b - a <= limit or len(text[a:b].strip(WHITE)) <= limit for a, b in zip(at, at[1:])):
            return kind
    return "character"


class Cohesion:
    """Similarity of the word blocks on both sides of a place in a text."""

    def __init__(self, starts: list[int], across: list[int], within: list[int]):
        self.starts, self.across, self.within = starts, across, within

    def similarity(self, place: int) -> float:
        i = bisect.bisect_left(self.starts, place)
        return self.across[i] / self.within[i] ** 0.5 if self.within[i] else 0.0

    def deepest(self, places: list[int]) -> int:
        """The place with the deepest valley: how far similarity climbs on both sides; the later one of equals."""
        if len(places) == 1:
            return places[0]
        sims = np.array([self.similarity(p) for p in places])
        left = np.maximum.accumulate(sims)
        right = np.maximum.accumulate(sims[::-1])[::-1]
        depth = left + right - 2 * sims
        return places[len(places) - 1 - int(np.argmax(depth[::-1] - 1e-9 * sims[::-1]))]


def pieces(text: str, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, texts: Texts | None = None, nth: int = 0) -> list[tuple[int, int]]:
    """(start, end) of each piece, in order, white space at both ends left out; texts: holds the text in nth place."""
    texts = texts or Texts([text])
    found, cohesion, out, start, n = texts.own_places[nth], texts.cohesion(nth), [], 0, len(text)
    last = len(text.rstrip(WHITE))

    def within(own: list[int], low: int, high: int) -> list[int]:
        return own[bisect.bisect_left(own, low) : bisect.bisect_right(own, high)]

    while True:
        while start < n and text[start] in WHITE:
            start += 1
        if start >= n:
            break
        if last - start <= limit:
            out.append((start, last))
            break
        top = start + limit
        while top < n and text[top] in WHITE:  # white space after the last sign doesn't count
            top += 1
        end = None
        for low in (start + limit // 2, start + overlap[1] + 1):
            for own in found:
                if places := within(own, low, top):
                    end = cohesion.deepest(places)
                    break
            if end:
                break
        if end is None:
            end = start + limit
            while end > start + overlap[1] + 1 and unicodedata.combining(text[end]):
                end -= 1
        stop = start + len(text[start:end].rstrip(WHITE))
        out.append((start, stop))
        begin = end
        for own in found:
            # the shared part counts from the next piece's first sign to this piece's last; a short piece before much white
            # space can be all shared, and the next one must begin after it did
            places = [p for p in within(own, max(stop - overlap[1], start + 1), stop - overlap[0]) if overlap[0] <= stop - _first(text, p) <= overlap[1]]
            if places:
                begin = places[-1]
                break
        start = begin
    return out


def _first(text: str, at: int) -> int:
    while at < len(text) and text[at] in WHITE:
        at += 1
    return at


def grouped(texts: list[str]) -> Iterator[tuple[int, Texts]]:
    """Texts in groups of about GROUP characters, each with the number of its first text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield start, Texts(texts[start:i])
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, Texts(texts[start:])


_own: dict[str, Encoder] = {}


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "content", limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, ranks_path: str = TOKENIZER_PATH, with_pieces: bool = True) -> DataFrame:
    """One row for each piece: key, cut_at, piece_no, char_start, char_end, byte_start, byte_end, token_count, content.

    Only oversized rows leave the scan; repeated rows are dropped by key and text, and that shuffle also spreads the
    work. With `with_pieces` off, the pieces' text and token counts are left out, which callers that only want places
    or cut_at save. cut_at is a property of all boundaries, the same in each row of a text.
    """
    kind = dict(df.dtypes)[key]
    big = df.select(F.col(key), F.col(text)).filter(F.length(text) > limit).dropDuplicates([key, text])
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB, the public vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cols = [], {c: [] for c in ("cut_at", "piece_no", "char_start", "char_end", "byte_start", "byte_end", "token_count", "content")}
            for start, texts in grouped(batch.column(1).to_pylist()):
                for k, t in enumerate(texts.texts):
                    level = cut_level(t, limit, texts.own_places[k])
                    spans = pieces(t, limit, overlap, texts, k)
                    octets = texts.byte_places(k, [p for span in spans for p in span])
                    for no, (a, b) in enumerate(spans):
                        keys.append(start + k)
                        values = (level, no, a, b, octets[2 * no], octets[2 * no + 1], 0, t[a:b] if with_pieces else None)
                        for c, v in zip(cols, values):
                            cols[c].append(v)
            if with_pieces:
                if "e" not in _own:
                    _own["e"] = Encoder(ranks.value, None)
                cols["token_count"] = _own["e"].count_all(cols["content"])
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(v, t) for v, t in zip(cols.values(), types)]], [key, *cols])

    return big.mapInArrow(run, f"`{key}` {kind}, cut_at string, piece_no int, char_start bigint, char_end bigint, byte_start bigint, byte_end bigint, token_count bigint, content string")
