"""Detection of template residue, filler, error pages and script notices in a corpus, and the documents without them.

Rules label the sure cases (see residue_rules). Near-duplicates of those are found over all documents: texts are
folded and masked, equal ones count once, each gets a SimHash of its five-word shingles, tables partitioned by
parts of the SimHash give candidate pairs, which are verified by Hamming distance and then by the Jaccard
similarity of their shingles (0.8 or more). Trusted labels spread through the connected components of the
verified pairs to documents whose own signs the rules miss (another delimiter, misread letters). An exact check
confirms each: most of its shingles lie in the residue passages of trusted documents of its component, or between
the words around an unfilled field of one it has the field's own words, and not in code.

A bucket with more than HOT texts is linked to its pivots first: texts verified to be near a bucket's pivot are one
component already, so only pairs with a text outside of the pivot's group are looked at, in blocks spread over
tasks. No pair that could join two components is left out, and a group of near copies costs its size, not its square.

Results: null and blank texts belong to no class of near-duplicates and are no case; texts of fewer than five
words have one shingle, the whole text; repeated ids count once; ties of components go to the smallest id. Texts
are read whole. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import residue_rules as rules
from papyra.session import cut, spread

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a SimHash, bits of a table's key (each table has its own bits), and the Hamming distance verified.
LONGS, TABLE_BITS, HAMMING = 4, 16, 64
#: Sets of tables that use each bit once: three give 48 tables, of which a pair at similarity 0.8 shares one with 0.97.
#: Buckets grow with the number of texts: 16 bits serve up to some 10^8 texts; 24 bits and 14 rounds find as many pairs.
ROUNDS = 3
#: Hamming distance allowed in the first word of the SimHash, which travels with the keys; at 0.8 one pair in 1,000 has more.
FIRST = 19
#: A bucket with more texts is linked to pivots first and compared in blocks of about so many.
HOT = 2_000
#: Pivots of a hot bucket.
PIVOTS = 4
#: So many ids of candidates, at most, are broadcast to fetch their texts (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of one node are spread over so many parts in the joins of the components.
SALT = 8
#: The share of residue that makes a document a case.
SURE = 0.5
#: Words on each side by which a field's place is known, most words in it, and how far a misread field may be from it.
AROUND, WITHIN, MISREAD = 3, 6, 0.34


@cache
def _classes() -> np.ndarray:
    """Of each character: 0 no part of a word, 1 letter, 2 digit, 3 a sign of a script without spaces (a word of its own)."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isdecimal():
            out[c] = 2
        elif ch.isalnum():
            out[c] = 3 if 0x0E00 <= c < 0x0F00 or 0x1000 <= c < 0x10A0 or 0x1780 <= c < 0x1800 or 0x3040 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0xFF66 <= c < 0xFFA0 else 1
    out[0x20000:0x32000] = 3
    return out


_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, text) of all words of some texts, by text and place; case, digits and punctuation folded away.

    A text without any word has one, itself. Places are in the lower-cased texts, each followed by one sign.
    """
    lowered = [t.lower() for t in texts]
    lowered = [t if any(map(str.isalnum, t)) else t.strip() or "-" for t in lowered]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.cumsum([len(t) + 1 for t in lowered])
    kind = _classes()[codes]
    bare = np.array([not any(map(str.isalnum, t)) for t in lowered], dtype=bool)
    if bare.any():  # each is one word
        for k in np.flatnonzero(bare):
            kind[bounds[k] - len(lowered[k]) - 1 : bounds[k] - 1] = 1
    before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
    begin = np.flatnonzero((kind > 0) & ((kind != before) | (kind == 3)))
    after = np.concatenate([kind[1:], [0]]).astype(np.uint8)
    end = np.flatnonzero((kind > 0) & ((kind != after) | (kind == 3))) + 1
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(codes)]])))
    signs = _mix((codes.astype(np.uint64) + np.uint64(1)) * _ODD + place.astype(np.uint64))
    signs[kind == 0] = 0
    sums = np.add.reduceat(signs, begin) if len(begin) else signs[:0]
    hashes = _mix(sums)
    hashes[kind[begin] == 2] = np.uint64(7)
    return hashes, begin, end, np.searchsorted(bounds, begin, side="right")


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the distinct five-word shingles of a run of words; of the whole run if it is shorter."""
    n = max(1, len(h) - SHINGLE + 1)
    out = h[:n].copy()
    for k in range(1, min(SHINGLE, len(h))):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    hashes, _, _, of = words_of(texts)
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    return [shingles(hashes[a:b]) for a, b in zip(at, at[1:])]


_SALT = np.array([(0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF for k in range(LONGS)], dtype=np.uint64)


def simhash(s: np.ndarray) -> np.ndarray:
    """Sign of the sum of the shingles' bits, in LONGS words."""
    ones = np.zeros(64 * LONGS, dtype=np.int64)
    for lo in range(0, len(s), 255):  # sums of up to 255 bits fit a byte
        m = _mix(s[lo : lo + 255, None] + _SALT)
        ones += np.unpackbits(m.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s)).view(np.int64)


def _facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field_n, residue, copy_of, size, h0..): the rules' findings, hash of the masked text, and SimHash of each text that isn't blank."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = batch.column(1).to_pylist()
                at = [i for i, t in enumerate(texts) if t and not t.isspace()]
                texts = [texts[i] for i in at]
                found = [rules.examine(t) for t in texts]
                hashes, _, _, of = words_of(texts)
                ends = np.searchsorted(of, np.arange(len(texts) + 1))
                copy, size, sim = [], [], []
                for a, b in zip(ends, ends[1:]):
                    s = shingles(hashes[a:b])
                    copy.append(int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True))
                    size.append(len(s))
                    sim.append(simhash(s))
                h = np.array(sim, dtype=np.int64).reshape(-1, LONGS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([len(f) for f, _, _ in found], pa.int32()), pa.array([rules.residue_share(n) for _, n, _ in found], pa.float64()), pa.array(copy, pa.int64()), pa.array(size, pa.int32()), *[pa.array(h[:, k]) for k in range(LONGS)]],
                    [key, "field_n", "residue", "copy_of", "size", *[f"h{k}" for k in range(LONGS)]],
                )

    schema = f"`{key}` {kind}, field_n int, residue double, copy_of bigint, size int, " + ", ".join(f"h{k} bigint" for k in range(LONGS))
    return spread(docs.select(key, text), key).mapInArrow(run, schema)


def _keyed(reps: DataFrame) -> DataFrame:
    """(key, rep, size, h0): the texts in each bucket of each table."""
    half, mask = TABLE_BITS // 2, (1 << TABLE_BITS) - 1
    parts = [F.shiftrightunsigned(F.col(f"h{k}"), half * j).bitwiseAND((1 << half) - 1) for k in range(LONGS) for j in range(64 // half)]
    # a key joins two parts; in each round every part is in one key, and no two keys have both parts in common
    keys = [F.shiftleft(parts[i + 2 * r + 1 - len(parts)], half).bitwiseOR(parts[i]) for r in range(ROUNDS) for i in range(0, len(parts), 2)]
    rows = reps.select("rep", "size", "h0", F.posexplode(F.array(*keys)).alias("t", "bucket"))
    return rows.select("rep", "size", "h0", (F.col("t") * (mask + 1) + F.col("bucket")).cast("int").alias("key"))


def _near(distance: F.Column, sizes: tuple[str, str], most: int) -> F.Column:
    a, b = F.col(sizes[0]), F.col(sizes[1])
    return (a >= b * F.lit(SIMILARITY)) & (b >= a * F.lit(SIMILARITY)) & (distance <= most)


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("key", *more, F.col("rep").alias(x), F.col("size").alias(f"size_{x}"), F.col("h0").alias(f"h0{x}"))


def _paired(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """(a, b), a < b: pairs of two sides of some buckets that are near by size and the first word of the SimHash."""
    both = left.join(right, [*on]).filter(_near(F.bit_count(F.col("h0a").bitwiseXOR(F.col("h0b"))), ("size_a", "size_b"), FIRST) & (F.col("a") != F.col("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified_pairs(reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: verified pairs that share a bucket of a table; of hot buckets, those that can join two components."""
    rows = _keyed(reps)
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT))
    if hot.isEmpty():
        # one shuffle by bucket serves both sides
        rows = rows.repartition("key")
        return cut(verified(cut(_paired(_side(rows, "a"), _side(rows, "b"), "key").distinct()), reps, docs, key, text))
    n_hot = hot.count()
    keys = hot.select("key")
    keys = F.broadcast(keys) if n_hot <= BROADCAST_IDS else keys
    cold = rows.join(keys, "key", "left_anti").repartition("key")
    pairs = _paired(_side(cold, "a"), _side(cold, "b"), "key")
    warm = cut(rows.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, "key").withColumn("blocks", F.ceil(F.col("n") / HOT).cast("int")).drop("n"))
    # a bucket's pivots: of each of PIVOTS parts of its texts, the one with the smallest hash
    part = F.pmod(F.xxhash64("rep", F.lit("part")), F.lit(PIVOTS)).alias("part")
    pivots = warm.groupBy("key", part).agg(F.min(F.struct(F.xxhash64("rep").alias("x"), "rep", "size", "h0")).alias("p")).select("key", "p.rep", "p.size", "p.h0")
    stars = _paired(_side(warm, "a"), F.broadcast(_side(pivots, "b")) if n_hot * PIVOTS <= BROADCAST_IDS // 4 else _side(pivots, "b"), "key").distinct()
    linked = cut(verified(cut(stars), reps, docs, key, text))
    # each text near a pivot belongs to the smallest pivot that it is near
    ends = linked.select(F.col("a").alias("rep"), F.col("b").alias("pivot")).unionByName(linked.select(F.col("b").alias("rep"), F.col("a").alias("pivot")))
    chosen = pivots.select(F.col("rep").alias("pivot")).distinct()
    groups = ends.join(chosen, "pivot", "left_semi").unionByName(chosen.select(F.col("pivot").alias("rep"), "pivot")).groupBy("rep").agg(F.min("pivot").alias("group"))
    warm = cut(warm.join(groups, "rep", "left"))
    # of each bucket, the group with most of its texts needs no comparison within itself
    most = warm.filter("group is not null").groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "group")).alias("m")).select("key", F.col("m.group").alias("main"))
    warm = warm.join(most, "key", "left")
    rest = warm.filter(~F.col("group").eqNullSafe(F.col("main")) | F.col("main").isNull())
    own = rest.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    every = warm.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.unionByName(_paired(_side(own, "a", "block"), _side(every, "b", "block"), "key", "block"))
    return cut(verified(cut(pairs.distinct()), reps, docs, key, text).unionByName(linked).distinct())


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs whose SimHashes are near and whose shingles' Jaccard similarity is at least SIMILARITY."""
    sims = [f"h{k}" for k in range(LONGS)]
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(x), *[F.col(h).alias(h + x) for h in sims[1:]], F.col("h0").alias(f"h0{x}")), x)
    distance = sum((F.bit_count(F.col(f"{h}a").bitwiseXOR(F.col(f"{h}b"))) for h in sims), F.lit(0))
    pairs = cut(pairs.filter(distance <= HAMMING).select("a", "b"))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
    texts = docs.select(key, text).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "s"])

    sets = texts.mapInArrow(run, f"`{key}` {kind}, s array<bigint>").dropDuplicates([key])
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col(key).alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= F.lit(SIMILARITY) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each, by repeated stars to the smallest neighbour.

    The rows of a node with many neighbours are spread over SALT parts, to each of which its smallest is sent.
    """
    edges = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        small = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        salted = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        # each node hangs its neighbours and itself on the smallest of them
        hung = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(salted, ["u", "part"])
        hung = hung.select(F.col("v").alias("x"), "m").union(small.select(F.col("u").alias("x"), "m"))
        new = cut(hung.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        if new.isEmpty():
            return new.toDF("node", "root")
        # stable once every node hangs on one root and no root hangs on another
        roots = new.select(F.col("v").alias("u")).distinct()
        if new.groupBy("u").count().filter("count > 1").isEmpty() and new.join(roots, "u", "left_semi").isEmpty():
            return new.toDF("node", "root")
        edges = new


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, field_n, residue, class_id) of each text that isn't blank, and the verified pairs of representatives."""
    facts = cut(_facts(docs, key, text).dropDuplicates([key]))
    sims = [f"h{k}" for k in range(LONGS)]
    reps = facts.groupBy("copy_of").agg(F.min(F.struct(F.col(key).alias("rep"), "size", *sims)).alias("r")).select("copy_of", "r.*")
    reps = cut(reps)
    pairs = verified_pairs(reps.drop("copy_of"), docs, key, text)
    roots = components(pairs)
    # copies of one text may be many: adaptive execution splits that key, since both sides come straight from a shuffle
    classes = reps.select("copy_of", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("copy_of", F.coalesce("root", "rep").alias("class_id"))
    return facts.join(classes, "copy_of").select(key, "field_n", "residue", "class_id"), pairs


def _field_places(text: str, spans: list[tuple[int, int]] | None) -> Iterator[tuple[int, str]]:
    """(hash of the words around, the words within) of the fields at `spans`, or of every place where a field may be."""
    hashes, begin, end, _ = words_of([text])
    lowered = text.lower()
    if len(lowered) != len(text) or not len(hashes):
        return
    n = len(hashes)

    def around(i: int, j: int) -> int:
        h = np.concatenate([hashes[max(0, i - AROUND) : i], [np.uint64(i < AROUND)], hashes[j : j + AROUND], [np.uint64(j + AROUND > n)]])
        return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)

    if spans is None:
        places = ((i, j) for i in range(n) for j in range(i + 1, min(n, i + WITHIN) + 1))
    else:
        places = ((int(np.searchsorted(begin, a)), int(np.searchsorted(begin, b))) for a, b in spans)
    for i, j in places:
        if 0 <= i < j <= n:
            yield around(i, j), " ".join(lowered[begin[k] : end[k]] for k in range(i, j))


def _evidence(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, trusted, key, sign, words, total) of documents with class_id and trusted.

    Of a trusted one, the shingles of its residue passages (words is null) and the places of its fields; of another,
    all its shingles, with their number as total, and all places where a field may be.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, c, trusted, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                plain = rules.without_code(t)
                if trusted:
                    fields, _, found = rules.examine(t)
                    signs = set(np.concatenate(shingle_sets(found)).view(np.int64).tolist()) if found else set()
                    places = _field_places(plain, [(a, b) for a, b, _ in fields])
                else:
                    signs, places = set(shingle_sets([t])[0].view(np.int64).tolist()), _field_places(plain, None)
                out += [(c, trusted, k, s, None, len(signs)) for s in signs]
                out += [(c, trusted, k, s, w, 0) for s, w in set(places)]
            columns = list(zip(*out)) or [()] * 6
            types = [batch.schema.field(1).type, pa.bool_(), batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], ["class_id", "trusted", key, "sign", "words", "total"])

    return docs.select(key, "class_id", "trusted", text).mapInArrow(run, f"class_id {kind}, trusted boolean, `{key}` {kind}, sign bigint, words string, total int")


def label(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, field_n, residue, is_residue, propagated) of each text that isn't blank.

    propagated: the label came from trusted near-duplicates, not from the rules.
    """
    classes, _ = near_duplicate_classes(docs, key, text)
    classes = cut(classes.withColumn("sure", (F.col("field_n") > 0) | (F.col("residue") > SURE)))
    # components with both: their other documents are held against the trusted ones
    mixed = cut(classes.groupBy("class_id").agg(F.max("sure").alias("some"), F.min("sure").alias("all")).filter("some and not all").select("class_id"))
    few = mixed.count() <= BROADCAST_IDS
    looked = cut(classes.join(F.broadcast(mixed) if few else mixed, "class_id", "left_semi").select(key, "class_id", F.col("sure").alias("trusted")))
    texts = docs.select(key, text).join(F.broadcast(looked) if looked.count() <= BROADCAST_IDS // 4 else looked, key).dropDuplicates([key])
    signs = cut(_evidence(texts, key, text))
    known = signs.filter("trusted").select("class_id", "sign", F.col("words").alias("known")).distinct()
    own = signs.filter("not trusted")
    met = own.join(known, ["class_id", "sign"])
    passage = met.filter("words is null and known is null").groupBy(key).agg((F.count("*") > SURE * F.max("total")).alias("yes"))
    same = F.levenshtein("words", "known") <= F.length("known") * F.lit(MISREAD)
    field = met.filter("words is not null and known is not null").groupBy(key).agg(F.max(same).alias("yes"))
    won = passage.unionByName(field).filter("yes").select(key).distinct().withColumn("propagated", F.lit(True))
    out = classes.join(won, key, "left").withColumn("propagated", F.coalesce("propagated", F.lit(False)))
    return out.select(key, "class_id", "field_n", "residue", (F.col("sure") | F.col("propagated")).alias("is_residue"), "propagated")


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't residue, null and blank ones among them."""
    bad = label(docs, key, text).filter("is_residue").select(key)
    return docs.join(bad, key, "left_anti")
