"""SimHash near-dedup by anchor points of a covering code.

Fingerprints of 64 bits come from word shingles; two link at ``THRESHOLD`` or fewer differing bits. Each half
of a fingerprint contributes 31 bits, and of a linked pair one half differs in one bit at most (three bits over
two halves). Anchors of a half are the words of the perfect [31, 26] Hamming code: its covering radius is 1, so
every half has one anchor within 1, its home. A fingerprint is replicated to every anchor within covering
radius plus threshold, 1 + 1 = 2: at most 16 a half. Whichever side of a linked pair is at home, the other is
among the replicas there; each anchor compares those at home with its replicas over all 64 bits.

A dense family doesn't emit its pairs: at each anchor, fingerprints that link to the least one at home are linked to it
alone, and only the others meet all.

Equal fingerprints are one node from the start, so copies never meet as pairs. Links of different
fingerprints pass to connected components by alternating star contraction over distinct edges, each round
written to the shared folder.

Similar shingles (:func:`drop_near_duplicates`). Documents whose sets of five-word shingles have a similarity of 0.8
or more differ in some 39 of 256 bits, which no covering code finds in one piece. Anchors of ``FIRST`` samples of the bits
(codes of all their words, covering radius 0) connect most similar texts at once: members of an anchor compare with its head.
What the samples don't bring together, an exact way does. All sets have their shingles in one order, frequent ones last; two
sets of similarity 0.8 share one of the first fifth of both, whatever the order. So every node goes to the shingles of its
first fifth, and nodes that meet there and aren't connected yet are candidates unless their sizes or the parities of their
shingles in classes rule the similarity out, which never loses a link. Candidates are checked by their texts' exact
similarity. Components are those of all links: no sample, number of members or frequency bounds what is compared.

Defined results: null texts are empty; texts without words have fingerprint zero and link like others; texts
of fewer words than a shingle use the whole sequence; a null id is never a component's smallest id unless all ids
there are null; repeated rows get a row each; an empty table gives an empty result. Dropping goes by row, not by id: rows
that repeat an id with other texts have verdicts of their own, and of rows that repeat the id that stays with texts of one
fingerprint all stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import cascade, sieve, sifted, told
from .runtime import batches_of, bound_batches, fits, if_small, materialize

WIDTH = 3
THRESHOLD = 3
SEED = 20240607
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
BLOCK = 65_536  # shingles whose hashes are held at a time

SIMILAR = 0.8
WIDE = 5  # words of a shingle where similarity is asked for
BITS = 256  # of a wide fingerprint
MET = 0.95  # of pairs whose similarity is just ``SIMILAR``: share that meets at an anchor of all samples
FIRST = 24  # samples of them whose anchors are looked at: the exact way finds what they miss
#: Share of bits in which fingerprints of sets of similarity 0.8 differ: the angle of their indicator vectors.
DIFFER = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
#: Differing bits up to which texts are compared: 3 deviations above the mean at similarity 0.8.
REACH = round(BITS * DIFFER + 3 * math.sqrt(BITS * DIFFER * (1 - DIFFER)))

#: Shingles that ``OFTEN`` of one in ``DEALT`` texts hold come last in the order, the ``FREQUENT`` most frequent ones at most.
#: This sets how many nodes meet, not which links are found.
DEALT, OFTEN, FREQUENT = 16, 8, 1 << 17
PARITIES = 512  # classes of shingles whose numbers are known to be even or odd
ROUNDS = (8, 1)  # one in so many shingles is met at: a few connect most nodes before all are looked at

#: Parity masks of the [31, 26] Hamming code: bit i - 1 counts for check k where i has bit k.
PARITY = tuple(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5))


def shingle_hashes(text: str, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's word shingles, in blocks."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # bytes.split cuts at the same six characters
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    for k in range(0, n, BLOCK):
        a, b = starts[k : min(n, k + BLOCK)].tolist(), ends[k + width - 1 : min(n, k + BLOCK) + width - 1].tolist()
        yield np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], dtype=np.uint64)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Unsigned; bit i is set where more than half of the hashes have it."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> Column:
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(F.coalesce(F.col(text_col), F.lit("")))


def anchors_of(half: Column, reach: int) -> Column:
    """Anchors of a 31-bit half as an array: its home (reach 1), or all within radius plus threshold (reach 2)."""
    syndrome = F.lit(0)
    for k, mask in enumerate(PARITY):
        syndrome = syndrome + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, k)
    syndrome = syndrome.cast("int")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)
    home = F.when(syndrome == 0, half).otherwise(half.bitwiseXOR(bit(F.greatest(syndrome, F.lit(1)))))
    if reach == 1:
        return F.array(home)
    others = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i.bitwiseXOR(syndrome) > i)
    two = F.transform(others, lambda i: half.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(syndrome))))
    # A half that is an anchor has no other within 2: anchors differ in three bits at least.
    return F.when(syndrome == 0, F.array(home)).otherwise(F.concat(F.array(home), two))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many parts as shuffles have: those that come from a few small files are about to be replicated."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def linked(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a < b`` of the distinct fingerprints ``fp`` that differ in ``threshold`` (3 or fewer) bits at most.

    Not all pairs: of those that link to an anchor's least fingerprint, only these links. Components are the same.
    """
    if threshold > 3:
        raise ValueError("two halves of radius 1 find up to three differing bits")
    low, at = F.lit((1 << 31) - 1), ["side", "anchor"]
    halves = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseAND(low))
    split = nodes.select("fp", F.posexplode(halves).alias("side", "half"))
    home = split.select("side", F.explode(anchors_of(F.col("half"), 1)).alias("anchor"), F.col("fp").alias("a"))
    near = split.select("side", F.explode(anchors_of(F.col("half"), 2)).alias("anchor"), F.col("fp").alias("b"))
    close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= threshold
    # Spark sizes what comes from an explode as the rows before it, and would send a table of replicas through the driver.
    home, near = home.hint("merge"), near.hint("merge")
    heads = home.groupBy(*at).agg(F.min("a").alias("head"))
    starred = near.join(heads, at).select(*at, "b", "head", close("head", "b").alias("held"))
    stars = starred.where("held and head <> b").select(F.least("head", "b").alias("a"), F.greatest("head", "b").alias("b"))
    # Those that the head doesn't hold, at home or near, meet everybody on the other side.
    loose = starred.where("not held").select(*at, "b").hint("merge")
    held = home.join(heads, at).select(*at, "a", close("a", "head").alias("held"))
    met = held.join(loose, at).where(close("a", "b"))
    met = met.select("a", "b").unionByName(held.where("not held").join(near, at).where(close("a", "b")).select("a", "b")).where("a <> b")
    return stars.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def contract(edges: DataFrame, label: str = "simhash") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node; isolated nodes don't occur.

    Alternates large stars and small stars until the edges stay the same: O(log n) rounds in practice. Hubs are
    aggregated before the shuffle and joined in a way that adaptive execution can split.
    """
    state = None
    edges = materialize(edges, f"{label}-edges")
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), f"{label}-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprints(docs, text_col, width).alias("fp")), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    roots = contract(linked(spread(nodes.select("fp"), "fp"), threshold))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def mixed(h: np.ndarray) -> np.ndarray:
    """Rows of four 64-bit words, independent of each other, from one hash each (the finaliser of SplitMix64)."""
    z = h[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str, width: int = WIDE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits over a set of shingles, as signed 64-bit words."""
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(mixed(hashes[k : k + 4096]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)


def parities(hashes: np.ndarray, classes: int = PARITIES) -> np.ndarray:
    """Bits of the classes that hold an odd number of a set's shingles, as signed 64-bit words.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    odd = np.bincount((hashes % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def fine_parities(hashes: np.ndarray) -> np.ndarray:
    """Parities in so many classes, a power of 2, that few of the set's shingles share one."""
    return parities(hashes, 1 << max(6, (2 * len(hashes) - 1).bit_length()))


def leading(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a (sorted) set in the order of all: those that aren't in ``frequent`` (sorted), and those that are.

    A set that is similar to this one holds all but a fifth of it, and so one of one more than that fifth.
    """
    count = len(hashes) - math.ceil(SIMILAR * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    last = np.zeros(len(hashes), dtype=bool)
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    light = hashes[~last][:count]
    return light.view(np.int64), hashes[last][: count - len(light)].view(np.int64)


def frequent_shingles(docs: DataFrame, text: Column, width: int = WIDE) -> np.ndarray:
    """Hashes of the most frequent shingles, sorted."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in texts], dtype=object)

    some = docs.select(text.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(DEALT)) == 0)
    counts = some.select(F.explode(shingles("t")).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    found = counts.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(FREQUENT).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], dtype=np.int64).view(np.uint64))


def met_by(size: int, samples: int) -> float:
    """Share of pairs at the least similarity that agree in all bits of one of the samples.

    Their differing bits are one draw that all samples share, so this is the mean over how many bits differ.
    """
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    out = 0.0
    for d in range(BITS - size + 1):
        share = math.exp(log_choose(BITS, d) + d * math.log(DIFFER) + (BITS - d) * math.log(1 - DIFFER))
        out += share * -math.expm1(samples * math.log1p(-min(math.exp(log_choose(BITS - d, size) - log_choose(BITS, size)), 1 - 1e-12)))
    return out


@lru_cache
def number_of(size: int) -> int:
    """Samples of ``size`` bits that give ``MET`` at the least similarity."""
    low, high = 1, 1
    while met_by(size, high) < MET:
        low, high = high, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if met_by(size, middle) >= MET else (middle + 1, high)
    return low


def samples_of(size: int, seed: int = SEED) -> np.ndarray:
    """Bits of each sample."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(BITS, size, replace=False) for _ in range(number_of(size))])


def anchors_at(fps: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Fingerprints' anchors, a column a sample: hashes of the sample's number and the sampled bits."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
    weight = np.uint64(1) << np.arange(samples.shape[1], dtype=np.uint64)
    number = mixed(np.arange(len(samples), dtype=np.uint64))[:, 0]
    words = np.stack([bits[:, s] @ weight for s in samples], axis=1) ^ number
    return mixed(words.ravel())[:, 0].reshape(words.shape).view(np.int64)


def anchored(nodes: DataFrame, count: int) -> DataFrame:
    """Rows (anchor, node) of nodes (node, fp): samples so long that few of ``count`` random fingerprints share an anchor."""
    samples = samples_of(max(12, count.bit_length() + 2))[:FIRST]

    @F.pandas_udf("array<long>")
    def anchors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for fps in batches:
            yield pd.Series(list(anchors_at(np.stack(fps.to_list()), samples))) if len(fps) else pd.Series([], dtype=object)

    return nodes.select(F.explode(anchors("fp")).alias("anchor"), "node")


def apart(x: str, y: str, bits: int = BITS) -> Column:
    """Differing bits of two arrays of longs."""
    return reduce(add, [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(bits // 64)])


def fine_apart(x: str, y: str) -> Column:
    """Differing bits of two fine parities; of one of twice the size the halves are added up, which gives its coarser parities."""
    xor = lambda p, q: p.bitwiseXOR(q)

    def folded(u: Column, v: Column) -> Column:
        half = F.size(v)
        return F.when(F.size(u) > half, F.zip_with(F.slice(u, F.lit(1), half), F.slice(u, half + 1, half), xor)).otherwise(u)

    differ = F.zip_with(folded(F.col(x), F.col(y)), folded(F.col(y), F.col(x)), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda total, v: total + v)


def similar(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = SIMILAR, width: int = WIDE) -> DataFrame:
    """Pairs (a, b) of nodes whose texts have sets of shingles of similarity ``least`` or more.

    ``texts_of`` gives (node, text) for a table of nodes; only those of pairs are asked for.
    """

    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = shingle_set(x, width), shingle_set(y, width)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(len(x) + len(y) - both, 1))
        return pd.Series(out)

    texts = materialize(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "near-texts")
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    with batches_of(pairs.sparkSession, 64):
        return materialize(pairs.join(a, "a").join(b, "b").where(jaccard("text_a", "text_b") >= least).select("a", "b"), "near-links")


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes."""
    roots = contract(edges, "near").withColumnRenamed("node", "n")
    return materialize(nodes.select("node").join(roots, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("root")), "near-roots")


def parted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) whose nodes aren't connected yet."""
    for x in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x)
    return pairs.where("root_a <> root_b").select("a", "b")


def starred(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, d) of anchors' heads and members whose fingerprints differ in ``REACH`` bits at most: in ``d``."""
    at = materialize(anchored(spread(nodes.select("node", "fp"), "node"), nodes.count()), "near-anchors")
    heads = materialize(at.groupBy("anchor").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1"), "near-heads")
    pairs = at.join(heads, "anchor").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}")), x)
    return pairs.withColumn("d", apart("fp_a", "fp_b")).where(F.col("d") <= REACH).select("a", "b", "d")


def shared(rows: DataFrame) -> DataFrame:
    """Rows (token, node) of leading shingles that several rows lead with; ``rows``: (node, light, heavy)."""
    light = rows.select(F.explode("light").alias("token"), "node").withColumn("c", F.count("*").over(Window.partitionBy("token")))
    heavy = rows.select(F.explode("heavy").alias("token"), "node")
    return materialize(light.where("c > 1").select("token", "node").unionByName(heavy).distinct(), "near-shared")


def meeting(tokens: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b, d) of nodes not connected yet that share a token and may be similar: fine parities differ in ``d`` bits."""
    labelled = tokens.join(roots, "node")
    several = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    members = labelled.join(several, "token").join(nodes.select("node", "n", "parity"), "node")
    members = materialize(members, "near-members")
    a, b = (members.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "parity")]) for x in "ab")
    sizes = F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b") - 1e-6
    within = lambda d: (1 + SIMILAR) * d <= (1 - SIMILAR) * (F.col("n_a") + F.col("n_b")) + 1e-6
    # The bound stands in the join's condition: only what passes it becomes a row.
    may = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & sizes & within(apart("parity_a", "parity_b", PARITIES))
    found = a.join(b, (a["token"] == b["token"]) & may).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    for x in "ab":
        found = found.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}")), x)
    return found.withColumn("d", fine_apart("fine_a", "fine_b")).where(within(F.col("d"))).select("a", "b", "d")


def similar_groups(nodes: DataFrame, tokens: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (node, root): connected by similar texts. ``nodes``: (node, n, fp, parity, fine); ``tokens``: (token, node), see :func:`shared`."""
    links, roots = None, materialize(nodes.select("node", F.col("node").alias("root")), "near-roots")

    def verified(pairs: DataFrame) -> None:
        nonlocal links, roots
        if pairs.limit(1).count():
            found = similar(pairs, texts_of)
            links = found if links is None else materialize(links.unionByName(found).distinct(), "near-links")
            roots = rooted(nodes, links)

    def settle(pairs: DataFrame) -> None:
        """Each node's closest partner first: most others are connected then and need no look at their texts."""
        pairs = materialize(pairs, "near-pairs")
        first = materialize(pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).select("best.a", "b"), "near-first")
        verified(first)
        verified(materialize(parted(pairs, roots).join(first, ["a", "b"], "left_anti"), "near-pairs"))

    settle(starred(nodes))
    for one_in in ROUNDS:
        settle(meeting(tokens.where(F.pmod("token", F.lit(one_in)) == 0), nodes, roots))
    return roots


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE) -> DataFrame:
    """``docs`` with the document of smallest id of each group of similar texts; all columns as they came."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, width))

    @F.pandas_udf("node long, n int, fp array<long>, parity array<long>, fine array<long>, light array<long>, heavy array<long>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for texts in batches:
            out = []
            for t in texts:
                h = shingle_set(t, width)
                node = np.uint64(xxh64_intdigest(h.tobytes(), 42)).view(np.int64)
                out.append((node, len(h), wide_fingerprint(h), parities(h), fine_parities(h), *leading(h, frequent.value)))
            yield pd.DataFrame(out, columns=["node", "n", "fp", "parity", "fine", "light", "heavy"])

    # A row is known by its id and its text's hash from here on; texts stay where they are. Equal sets are one node.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), features(text).alias("f"))
    rows = materialize(rows.select("id", "text_hash", "f.*"), "near-rows")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    once = [F.first(c).alias(c) for c in ("n", "fp", "parity", "fine")]
    nodes = materialize(rows.groupBy("node").agg(F.min(key).alias("key"), *once, F.count("*").alias("c")), "near-nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """A node's text is that of its least row."""
        wanted = nodes.join(wanted, "node", "left_semi").select("node", F.col("key.id").alias("of"), F.col("key.text_hash").alias("its"))
        wanted = materialize(wanted, "near-wanted")
        found = docs.select(F.col(id_col).alias("of"), F.xxhash64(text).alias("its"), text.alias("text"))
        if not fits(wanted, 32) and (bits := sieve(wanted, ["of", "its"])):
            # Only texts that are asked for move.
            found = sifted(found, ["of", "its"], bits)
        found = found.withColumnRenamed("of", "id").withColumnRenamed("its", "text_hash")
        found = found.join(if_small(wanted, 32), (F.col("text_hash") == F.col("its")) & F.col("id").eqNullSafe(F.col("of")))
        return found.select("node", "text").dropDuplicates(["node"])

    named = nodes.select("node", "key", "c").join(similar_groups(nodes, shared(rows), texts_of), "node")
    best = named.groupBy("root").agg(F.min(F.struct("key", "node")).alias("best"), F.sum("c").alias("rows")).where("rows > 1")
    judged = named.join(best, "root").select("node", F.when(F.col("node") == F.col("best.node"), F.struct("best.key.id")).alias("stays"))
    gone = rows.join(judged, "node").where(F.col("stays").isNull() | ~F.col("id").eqNullSafe(F.col("stays.id")))
    gone = materialize(gone.select(F.col("id").alias("gone"), F.col("text_hash").alias("its")).distinct(), "near-gone")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    among = (F.col("text_hash") == F.col("its")) & F.col("id").eqNullSafe(F.col("gone"))
    if not fits(gone, 32):
        judged = rows.select("id", "text_hash").distinct().join(gone, among, "left").select("id", "text_hash", F.col("its").isNotNull().alias("goes"))
        cascaded = cascade(materialize(judged, "near-judged"), ["id", "text_hash"], "goes")
        if cascaded is not None:
            return told(keyed, ["id", "text_hash"], cascaded).where("stays").select("doc.*")
    return keyed.join(if_small(gone, 32), among, "left_anti").select("doc.*")
