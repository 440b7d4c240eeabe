"""Mixing of sources to target shares by Poisson replication.

Each document has a uniform number from a seeded hash of its id. Inverting the Poisson distribution with mean
m at that number gives the document's count of uses, never above its source's cap. m is the repetition rate
of the source; it is found by narrowing a grid on the tokens really selected (one pass over the small table of
token counts for each narrowing) to the largest rate that doesn't exceed the tokens wanted. What is missing then, less
than one document's step, is filled with single further uses of documents that fit, the largest first, so the share
that comes out is as near as the documents' sizes allow. The selected copies come out in a global random order by a
second seeded hash.

Policies: "shares" takes the largest total at which every source can have its share under its cap; "total" keeps the
total asked for (without one, all tokens of the listed sources) and lets sources at their cap fall short, which the
report tells.

Results: sources are compared in lower case with "-" and blanks as "_". Documents of no listed source, with a
null source or without tokens are not used. A target without documents reaches share 0, and the others keep
their proportions. A repeated doc_id counts once. A null or negative share or cap counts as 0. Without any
usable source the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.tokenise import TOKENIZER_PATH, count_tokens
from papyra.session import cut

#: Points of the grid of rates in each narrowing, and the number of narrowings.
GRID, PASSES = 64, 4
#: Further uses of single documents that fill what the rate leaves open, for each source.
FILLS = 6


def source_key(c: Column) -> Column:
    """Spelling-independent name of a source."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from a seeded hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _cdf(rate: float, cap: int) -> list[float]:
    """P(N <= k) for k below the cap; an infinite rate puts every document at the cap."""
    if rate <= 0 or math.isinf(rate):
        return [float(rate <= 0)] * cap
    k = np.arange(cap, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, cap)))]) if cap > 1 else np.zeros(cap)
    return np.minimum(np.cumsum(np.exp(k * math.log(rate) - rate - logs)), 1.0).tolist()


def top_rate(cap: int) -> float:
    """A finite rate above which hardly a document is below its cap."""
    return cap + 10 * math.sqrt(cap) + 40


def _realised(docs: DataFrame, rates: dict[str, list[float]], caps: dict[str, int]) -> dict[str, np.ndarray]:
    """Tokens that each source would have at each of its rates: partial sums within batches, one row for each source out."""
    names = sorted(rates)
    most = max(caps.values())
    bounds = np.full((len(names), GRID, most), 2.0)  # 2: a number never reaches it
    for i, s in enumerate(names):
        for j, r in enumerate(rates[s]):
            bounds[i, j, : caps[s]] = _cdf(r, caps[s])
    at = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), GRID), dtype=np.float64)
        for b in batches:
            idx = np.array([at.get(x, -1) for x in b.column(0).to_pylist()], dtype=np.int64)
            tok, u = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for i in np.unique(idx[idx >= 0]):
                of = idx == i
                for k in range(caps[names[i]]):
                    # tokens of documents with u above the bound, for every rate at once
                    order = np.argsort(u[of])
                    above = np.concatenate([np.cumsum(tok[of][order][::-1])[::-1], [0]])
                    total[i] += above[np.searchsorted(u[of][order], bounds[i, :, k], side="right")]
        yield pa.RecordBatch.from_pydict({"source": pa.array(names, pa.string()), "sums": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = docs.select("source", "n_tokens", "u").mapInArrow(run, "source string, sums array<double>")
    sums = parts.select("source", F.posexplode("sums").alias("j", "v")).groupBy("source", "j").agg(F.sum("v").alias("v"))
    out = {s: np.zeros(GRID) for s in names}
    for r in sums.collect():  # sources x GRID rows, bounded by the table of targets
        out[r.source][r.j] = r.v
    return out


def plan(counted: DataFrame, targets: DataFrame, total: float | None = None, policy: str = "shares") -> list[dict]:
    """One entry for each target: share, cap, tokens there are, tokens wanted, rate, fills. `counted`: doc_id, source, n_tokens, u.

    The table of targets is small by nature (one row a source) and is read whole.
    """
    wanted: dict[str, dict] = {}
    for r in targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        if r.source is not None and r.source not in wanted:
            share = r.target_share if r.target_share and r.target_share > 0 and math.isfinite(r.target_share) else 0.0
            wanted[r.source] = {"source": r.source, "target_share": share, "max_repeats": max(0, r.max_repeats or 0)}
    there = {r.source: r.n for r in counted.filter(F.col("source").isin(sorted(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    usable = [w for w in wanted.values() if there.get(w["source"]) and w["target_share"] and w["max_repeats"]]
    for w in wanted.values():
        w |= {"source_tokens": int(there.get(w["source"]) or 0), "wanted": 0.0, "rate": 0.0, "fills": []}
    if not usable:
        return list(wanted.values())
    whole = sum(w["target_share"] for w in usable)
    if policy == "total":
        most = total or float(sum(w["source_tokens"] for w in usable))
    else:
        most = min(w["source_tokens"] * w["max_repeats"] / (w["target_share"] / whole) for w in usable)
        most = min(most, total) if total else most
    caps = {w["source"]: w["max_repeats"] for w in usable}
    low, high = {s: 0.0 for s in caps}, {s: top_rate(c) for s, c in caps.items()}
    for w in usable:
        w["wanted"] = most * w["target_share"] / whole
        if w["wanted"] >= w["source_tokens"] * w["max_repeats"]:
            w["rate"] = math.inf
    left = {w["source"]: w["wanted"] for w in usable}
    for _ in range(PASSES):
        rates = {s: np.linspace(low[s], high[s], GRID).tolist() for s in caps}
        got = _realised(counted, rates, caps)
        for w in usable:
            s = w["source"]
            up = int(np.searchsorted(got[s], w["wanted"], side="right"))  # sums never fall with the rate
            low[s], high[s] = rates[s][max(0, up - 1)], rates[s][min(GRID - 1, up)]
            if not math.isinf(w["rate"]):
                w["rate"], left[s] = low[s], w["wanted"] - got[s][max(0, up - 1)]
    _fill(counted, usable, left)
    return list(wanted.values())


def _fill(counted: DataFrame, usable: list[dict], left: dict[str, float]) -> None:
    """Add to each plan single further uses that fit into what its rate leaves open; one pass for each, one row a source out."""
    open_ = [w for w in usable if not math.isinf(w["rate"])]
    base = with_uses(counted, open_)
    for _ in range(FILLS):
        open_ = [w for w in open_ if left[w["source"]] >= 1]
        if not open_:
            return
        rest = counted.sparkSession.createDataFrame([(w["source"], float(left[w["source"]]), w["max_repeats"], sorted(d for d, _ in w["fills"])) for w in open_], f"source string, room double, cap int, taken array<{dict(counted.dtypes)['doc_id']}>")
        fits = base.join(F.broadcast(rest), "source").filter((F.col("n_tokens") <= F.col("room")) & (F.col("uses") < F.col("cap")) & ~F.array_contains("taken", F.col("doc_id")))
        found = {r.source: r.best for r in fits.groupBy("source").agg(F.max(F.struct("n_tokens", "u", "doc_id")).alias("best")).collect()}
        for w in open_:
            if w["source"] in found:
                w["fills"].append((found[w["source"]].doc_id, 1))
                left[w["source"]] -= found[w["source"]].n_tokens
            else:
                left[w["source"]] = 0.0


def with_uses(counted: DataFrame, plans: list[dict]) -> DataFrame:
    """`counted` with uses: the Poisson inverse at u under the source's rate, at most the cap, and the fills.

    The plan is a table of one row for each target and is broadcast; fills are at most FILLS for each.
    """
    spark = counted.sparkSession
    rows = [(p["source"], _cdf(p["rate"], p["max_repeats"])) for p in plans if p["rate"] > 0]
    bounds = spark.createDataFrame(rows, "source string, bounds array<double>")
    out = counted.join(F.broadcast(bounds), "source", "left").withColumn("uses", F.coalesce(F.size(F.filter("bounds", lambda x: x < F.col("u"))), F.lit(0))).drop("bounds")
    extra = [(p["source"], d, n) for p in plans for d, n in p["fills"]]
    if extra:
        more = spark.createDataFrame(extra, f"source string, doc_id {dict(counted.dtypes)['doc_id']}, more int")
        out = out.join(F.broadcast(more), ["source", "doc_id"], "left").withColumn("uses", F.col("uses") + F.coalesce("more", F.lit(0))).drop("more")
    return out


def _counted(docs: DataFrame, seed: int, ranks_path: str) -> DataFrame:
    own = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    counted = count_tokens(own, "doc_id", "text", ("source",), ranks_path).filter("source is not null and n_tokens > 0")
    return cut(counted.dropDuplicates(["doc_id"]).withColumn("u", uniform(seed, "doc_id")))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None, ranks_path: str = TOKENIZER_PATH, policy: str = "shares") -> DataFrame:
    """(doc_id, source, n_tokens, copy_no, shuffle_key): one row for each use of a document, in global random order."""
    counted = _counted(docs, seed, ranks_path)
    uses = with_uses(counted, plan(counted, targets, total, policy)).filter("uses > 0")
    copies = uses.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"))
    return copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no")).orderBy("shuffle_key")


def shares(docs: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None, ranks_path: str = TOKENIZER_PATH, policy: str = "shares") -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, wanted_tokens, selected_tokens, shortfall, at_cap, rate, actual_share): the report of a mix.

    shortfall: the tokens wanted that the cap or the documents' sizes don't allow; at_cap: every document is used max_repeats times.
    """
    counted = _counted(docs, seed, ranks_path)
    plans = plan(counted, targets, total, policy)
    spark = docs.sparkSession
    rows = [(p["source"], p["target_share"], p["max_repeats"], p["source_tokens"], int(round(p["wanted"])), p["rate"]) for p in plans]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens bigint, wanted_tokens bigint, rate double")
    got = with_uses(counted, plans).groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("selected_tokens"))
    joined = base.join(got, "source", "left").fillna({"selected_tokens": 0})
    whole = F.sum("selected_tokens").over(Window.partitionBy())  # one row a target
    share = F.when(whole > 0, F.try_divide(F.col("selected_tokens"), whole)).otherwise(F.lit(0.0))
    short = F.greatest(F.lit(0), F.col("wanted_tokens") - F.col("selected_tokens"))
    at_cap = (F.col("source_tokens") > 0) & (F.col("selected_tokens") == F.col("source_tokens") * F.col("max_repeats"))
    return joined.select("source", "target_share", "max_repeats", "source_tokens", "wanted_tokens", "selected_tokens", short.alias("shortfall"), at_cap.alias("at_cap"), "rate", share.alias("actual_share"))
