"""Near-duplicate components by SetSketch registers, likelihood and full verification.

A document's set holds the hashes of its word shingles. Its SetSketch has
registers floor(1 - log_b(x)), where x is the smallest of exponentially
distributed values of the set's members: mergeable by the maximum, and equal in
two sketches with a probability that follows the Jaccard similarity. Bands of
registers bring candidates together, the joint likelihood of two register
vectors estimates their similarity, and the full sets decide.

Equal sets become one node. In a band's bucket each node meets only the
bucket's pivot. What that may miss is settled exactly: in groups of nodes that
buckets connect, but links do not, a node is told by its differences from the
group's majority of shingles (see settled()). One star around the group's centre
holds every link that rests on the majority alone; other links share a rare
difference. Nodes of one such difference meet its pivot, and only those that
then still are in different components, and whose counts allow a link, meet
each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import graph, shared

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
CACHED_WORDS = 300_000


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80  # a link: 100 * intersection >= percent * union
    bands: int = 28
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    margin: float = 0.2  # a pair whose estimate is further below the threshold is no link


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[0]
    return (x ^ (x >> np.uint64(29))) * _K[1]


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; of all its words if there are fewer."""
    found = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out ^ h[i : len(h) - k + 1 + i])
    return np.unique(out)


def registers(members: np.ndarray, p: Params) -> np.ndarray:
    """The SetSketch of a nonempty set, as unsigned 16-bit registers."""
    rng = np.random.default_rng(20)
    m = p.bands * p.rows
    times = rng.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, m, np.uint64)
    least = np.full(m, np.uint64(2**64 - 1))
    for s in range(0, len(members), 512):
        np.minimum(least, (members[s : s + 512, None] * times + plus).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / p.rate
    return np.clip(np.floor(1 - np.log(x) / math.log(p.base)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray, p: Params) -> np.ndarray:
    """rows of registers -> rows of 64-bit band keys."""
    parts = regs.reshape(len(regs), p.bands, p.rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(p.rows):
        out = mix(out ^ parts[:, :, i])
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from register rows and set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)
    over, under = np.maximum(share(u - v * j), 1e-12), np.maximum(share(v - u * j), 1e-12)
    at = (more * np.log(over) + less * np.log(under) + same * np.log(np.maximum(1 - over - under, 1e-12))).argmax(axis=1)
    return j[np.arange(len(j)), at]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set), bands, registers; null text: no shingles."""
    schema = pa.schema({"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "bands": pa.list_(pa.int64()), "registers": pa.binary()})

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, regs = [], [], []
            for text in batch.column(1):
                members = shingles(text.as_py() or b"", p.words, hashes)
                sizes.append(len(members))
                keys.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
                regs.append(registers(members, p) if len(members) else None)
            full = [r for r in regs if r is not None]
            bands = iter(band_keys(np.array(full), p).tolist() if full else [])
            yield _batch([batch.column(0).to_pylist(), sizes, keys, [None if r is None else next(bands) for r in regs], [None if r is None else r.tobytes() for r in regs]], schema)

    return shared.in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, registers binary")


def member_sets(docs: DataFrame, ids: DataFrame, p: Params) -> DataFrame:
    """(id, members) of the documents in ids: sorted 64-bit hashes as bytes."""
    schema = pa.schema({"id": pa.int64(), "members": pa.binary()})

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield _batch([batch.column(0).to_pylist(), [shingles(t.as_py() or b"", p.words, hashes).tobytes() for t in batch.column(1)]], schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(ids.select("id").distinct(), "id", "left_semi")
    return shared.in_small_batches(wanted).mapInArrow(run, "id long, members binary")


def likely(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) with their estimated similarity, without those too far below the threshold."""
    schema = pa.schema({"a": pa.int64(), "b": pa.int64(), "similarity": pa.float64()})

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            r_a, r_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(a), -1) for i in (4, 5))
            found = np.concatenate([estimate(r_a[s : s + 512], r_b[s : s + 512], n_a[s : s + 512], n_b[s : s + 512], p.base) for s in range(0, len(a), 512)])
            keep = found >= p.percent / 100 - p.margin
            yield _batch([a[keep], b[keep], found[keep]], schema)

    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long, similarity double")


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs whose full sets are as similar as a link asks for."""
    schema = pa.schema({"a": pa.int64(), "b": pa.int64()})

    def run(batches):
        for batch in batches:
            links: list[list[int]] = [[], []]
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= p.percent * (len(x) + len(y) - both):
                    links[0].append(a)
                    links[1].append(b)
            yield _batch(links, schema)

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("s_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def _size_fits(a: str, b: str, p: Params):
    return (100 * F.least(a, b)) >= (p.percent * F.greatest(a, b))


def profiles(inside: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """inside (g, size, id, n) with how each node differs from its group.

    differs: the majority shingles that a node lacks and the minority shingles
    that it has; h: the majority shingles that it has; e: see settled(). A group
    has at most twice as many majority shingles as its mean node has shingles.
    """
    pair, told = pa.schema({"g": pa.int64(), "s": pa.int64()}), pa.schema({"g": pa.int64(), "id": pa.int64(), "n": pa.int64(), "h": pa.int64(), "differs": pa.list_(pa.int64())})

    def explode(batches):
        for batch in batches:
            for g, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(m.as_py(), np.int64)
                yield _batch([np.full(len(s), g), s], pair)

    def compare(batches):
        for batch in batches:
            has, differs = [], []
            for m, majority in zip(batch.column(3), batch.column(4), strict=True):
                s = np.frombuffer(m.as_py(), np.int64)
                most = np.array(majority.as_py() or [], np.int64)
                d = np.setxor1d(s, most, assume_unique=True)
                differs.append(d)
                has.append((len(s) + len(most) - len(d)) // 2)
            yield _batch([*(batch.column(i) for i in range(3)), has, differs], told)

    members = inside.join(sets, "id")
    often = members.select("g", "members").mapInArrow(explode, "g long, s long").groupBy("g", "s").agg(F.count("*").alias("f"))
    majority = often.join(inside.select("g", "size").distinct(), "g").filter(F.col("f") * 2 > F.col("size")).groupBy("g").agg(F.collect_list("s").alias("majority"))
    out = members.join(majority, "g", "left").select("g", "id", "n", "members", "majority").mapInArrow(compare, "g long, id long, n long, h long, differs array<long>")
    d = F.size("differs").cast("long")
    return out.withColumns({"d": d, "e": (100 + p.percent) * d - (100 - p.percent) * F.col("n")})


def _may_meet(p: Params):
    """Whether x and y, whose first common difference is s, have enough left in common, in different components."""
    left = 1 + F.least(F.col("d") - F.col("at"), F.col("d2") - F.col("at2"))
    return (F.col("c") != F.col("c2")) & _size_fits("n", "n2", p) & (2 * (100 + p.percent) * left >= F.col("e") + F.col("e2"))


def settled(nodes: DataFrame, sets: DataFrame, groups: DataFrame, labels: DataFrame, tried: DataFrame, p: Params) -> DataFrame:
    """labels (node, component) after the links inside groups (node, component) that were not found before.

    Two nodes with n and n2 shingles, d and d2 differences from their group's
    majority and x differences in common are linked if, and only if,
    e + e2 <= 2 (100 + percent) x, where e = (100 + percent) d - (100 - percent) n.
    So the group's centre, the node of least e, is linked with every node that
    any link without a common difference could join. All other links have a
    common difference among the rarest of both nodes. The nodes of each such
    difference meet one of them first; those that are then still in different
    components meet each other. tried: pairs (a, b) that were settled before.
    """
    of = groups.select(F.col("node").alias("id"), F.col("component").alias("g")).join(labels.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    open_ = of.groupBy("g").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("size")).filter("_lo <> _hi and size > 2").select("g", "size")
    inside = shared.staged(of.join(open_, "g").join(nodes.select("id", "n"), "id").select("g", "size", "id", "n"), "open")
    each = shared.staged(profiles(inside, sets, p), "profiles")
    centre = each.groupBy("g").agg(F.min(F.struct("e", "id")).alias("_least")).select("g", F.col("_least.e").alias("e0"), F.col("_least.id").alias("centre"))
    each = each.join(centre, "g")
    labels = graph.merged(labels, each.filter("e + e0 <= 0 and id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")))

    # at least `need` common differences with any node that is not linked by the centre
    partner = F.when(F.col("e") + F.col("e0") <= 0, F.greatest(F.col("e0"), 1 - F.col("e0"))).otherwise(F.col("e0"))
    need = F.greatest(F.ceil((F.col("e") + partner) / (2 * (100 + p.percent))), F.ceil(F.col("n") * p.percent / 100) - F.col("h"), F.lit(1))
    each = each.select("g", "id", "n", "d", "e", (F.col("d") - need + 1).alias("prefix"), F.explode("differs").alias("s"))
    often = each.groupBy("g", "s").agg(F.count("*").alias("f")).filter("f > 1")
    mine = Window.partitionBy("id")  # a node's differences, as many as its text and its group's majority have shingles
    rated = each.join(often, ["g", "s"]).withColumn("at", F.row_number().over(mine.orderBy("f", "s")) + F.col("d") - F.count("*").over(mine))
    rare = shared.staged(rated.filter("at <= prefix").select("g", "s", "id", "n", "d", "e", "at"), "prefixes")

    def current() -> DataFrame:
        """The prefixes with components, without differences that only one component has."""
        now = rare.join(labels.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
        mixed = now.groupBy("g", "s").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo <> _hi").select("g", "s")
        return now.join(mixed, ["g", "s"])

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs not tried before, and the links among them."""
        fresh = shared.staged(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        return fresh, shared.staged(verified(likely(fresh, nodes, p), sets, p), "links")

    ends = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]
    now = shared.staged(current(), "mixed")
    pivot = now.groupBy("g", "s").agg(F.min(F.struct("e", "id", "c", "n", "d", "at")).alias("_p")).select("g", "s", *(F.col(f"_p.{k}").alias(f"{k}2") for k in ("id", "c", "n", "d", "e", "at")))
    fresh, links = linked(now.join(pivot, ["g", "s"]).filter(_may_meet(p)).select(*ends))
    labels, tried = graph.merged(labels, links), tried.union(fresh)
    now = shared.staged(current(), "mixed")
    other = now.select("g", "s", *(F.col(k).alias(f"{k}2") for k in ("id", "c", "n", "d", "e", "at")))
    _, links = linked(now.join(other, ["g", "s"]).filter((F.col("id") < F.col("id2")) & _may_meet(p)).select(*ends))
    return graph.merged(labels, links)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Texts that are null or have no word have no shingles and are linked with
    nothing. Rows that repeat a doc_id share its component; rows without a
    doc_id take no part (component null, kept). An empty table gives an empty
    result. Columns other than doc_id and text are ignored.
    """
    sketch = shared.staged(sketches(docs, p), "sketches")
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    # equal sets have equal sketches, so any row of the class stands for it; copies meet in partial sums
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("registers").alias("registers"))
    nodes = shared.staged(classes, "nodes")
    sets_of = nodes.filter("copies > 1").select("set_key", F.col("id").alias("_first"))
    nodes = nodes.select("id", "n", "bands", "registers")

    bucket = nodes.select("id", "n", F.explode("bands").alias("key"))
    pivots = bucket.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("pivot"), F.min_by("n", F.xxhash64("id", "key")).alias("n_pivot"), F.count("*").alias("size")).filter("size > 1").drop("size")
    star = shared.staged(bucket.join(pivots, "key").filter("id <> pivot").groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).agg(F.bool_or(_size_fits("n", "n_pivot", p)).alias("fits")), "stars")
    met = graph.components(star)

    guess = shared.staged(likely(star.filter("fits"), nodes, p), "guesses")
    sets = shared.staged(member_sets(docs, met.select(F.col("node").alias("id")), p), "sets")
    # each node's most likely partner first; most others then are connected already
    best = guess.groupBy("a").agg(F.max_by("b", "similarity").alias("b")).union(guess.groupBy("b").agg(F.max_by("a", "similarity").alias("a")).select("a", "b")).distinct()
    links = shared.staged(verified(best, sets, p), "links")
    labels = graph.components(links)
    more = shared.staged(verified(_labelled(guess.join(best, ["a", "b"], "left_anti"), labels), sets, p), "links")
    labels = graph.merged(labels, more)
    labels = settled(nodes, sets, met, labels, star.filter("fits").select("a", "b"), p)

    first = sketch.join(sets_of, "set_key", "left").withColumn("_node", F.coalesce("_first", "doc_id"))
    out = first.join(labels.select(F.col("node").alias("_node"), "component"), "_node", "left")
    component = F.coalesce("component", "_node")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
