"""SimHash near-duplicates: fingerprints joined by Golay-code fuzzy keys, and every link verified.

The 64 bits are four segments of 16. Up to three differing bits leave at least one segment equal, and a second one with at
most one error. Either two segments are equal (key: both), or exactly one is and the other three have one error
each (key: the equal one and a Golay codeword index of the next). A segment is padded to 23 bits and decoded to the one codeword of the
perfect Golay code within three bits; decoding also the words one bit away gives up to six indices, and of two segments that
differ in one bit, the first's own index is among the second's. All pairs within three bits so share a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import SLICE, lower_ascii, map_rows, text_or_empty, words_of
from nearfield.llm.components import components
from nearfield.storage import materialise

SEED, MAX_BITS, SEGMENTS = 42, 3, 4
GENERATOR = 0b101011100011  # of the [23, 12, 7] Golay code
#: Keys with more fingerprints than this are linked by shared neighbours instead of pairs.
HOT = 256
BLOCK = 65_536  # shingles counted at once


def _shingles(text: str | None, size: int) -> list[str]:
    """Runs of `size` words in lower case, repeats included; the whole sequence if there are fewer words, nothing without any."""
    words = words_of(lower_ascii(text or ""))
    if not words:
        return []
    return [" ".join(s) for s in zip(*[words[i:] for i in range(size)], strict=False)] or [" ".join(words)]


def _another(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes made from one; the first is the hash itself."""
    if not k:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """A signed 64-bit integer whose bits are set where over half of the shingles' XXH64 have them; 0 without words."""
    import xxhash

    shingles = _shingles(text, size)
    if not shingles:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), BLOCK):
        block = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles[at : at + BLOCK]], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp for each row of docs. Null texts have no words."""

    def make():
        return lambda doc_id, text: (doc_id, fingerprint(text, size, seed))

    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), make, "doc_id long, fp long")


def codewords() -> np.ndarray:
    """The 4,096 words of the Golay code, by index: each is a multiple of the generator polynomial."""
    message = np.arange(4096, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return (message << 11) | rest


@lru_cache(maxsize=1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit value its own codeword index, and its up to six nearby indices, padded with -1."""
    words = codewords()
    index = np.full(1 << 23, -1, dtype=np.int16)
    flips = [0, *(1 << i for i in range(23))]
    near = sorted({a ^ b ^ c for a in flips for b in flips for c in flips})  # all errors of at most three bits
    for e in near:
        index[words ^ e] = np.arange(4096)
    value = np.arange(1 << 16, dtype=np.int64)
    found = np.stack([index[value], *(index[value ^ (1 << i)] for i in range(16))], axis=1).astype(np.int64)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return index[value].astype(np.int64), found[:, : int((found >= 0).sum(axis=1).max())]


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> (16 * (SEGMENTS - 1 - i))) & 0xFFFF


PAIRS = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, keys, and whether the row indexes under the key or only looks it up."""
    own, near = golay_keys()
    rows, keys, home = [], [], []
    every = np.arange(len(fp))
    for n, (i, j) in enumerate(PAIRS):
        rows.append(every)
        keys.append((n << 32) | (_segment(fp, i) << 16) | _segment(fp, j))
        home.append(np.ones(len(fp), dtype=bool))
    for i in range(SEGMENTS):
        head = ((len(PAIRS) + i) << 32) | (_segment(fp, i) << 12)
        other = _segment(fp, (i + 1) % SEGMENTS)
        for column in near[other].T:
            some = np.flatnonzero(column >= 0)
            rows.append(some)
            keys.append(head[some] | column[some])
            home.append(column[some] == own[other[some]])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _key_rows(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, keys, home = keys_of(batch["fp"].to_numpy())
            yield pd.DataFrame({"key": keys, "fp": batch["fp"].to_numpy()[rows], "home": home})

    return nodes.select("fp").mapInPandas(run, "key long, fp long, home boolean")


def _ball(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Error masks of one and of two bits that matter within a key: a link is one of the first against one of the second.

    Under a key of two equal segments, all errors of at most three bits in the other two; under a Golay key, one bit in each of the
    three others.
    """
    shift = lambda i: 16 * (SEGMENTS - 1 - i)
    if kind < len(PAIRS):
        free = [np.int64(1) << np.int64(shift(i) + b) for i in range(SEGMENTS) if i not in PAIRS[kind] for b in range(16)]
        two = [a ^ b for n, a in enumerate(free) for b in free[:n]]
        return np.array([0, *free], dtype=np.int64), np.array(two, dtype=np.int64)
    a, b, c = ([np.int64(1) << np.int64(shift(i) + k) for k in range(16)] for i in range(SEGMENTS) if i != kind - len(PAIRS))
    return np.array(a, dtype=np.int64), np.array([x ^ y for x in b for y in c], dtype=np.int64)


def _hot_links(rows: DataFrame) -> DataFrame:
    """Links that give the same components as all pairs within three bits under each key, a bounded number for each row.

    Each fingerprint emits the words within one bit and within two; a word's first one-bit neighbour is linked to all its
    others, which are at most three bits away. Two fingerprints three bits apart share such a word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
            for kind in np.unique(keys >> 32):
                at = np.flatnonzero(keys >> 32 == kind)
                one, two = _ball(int(kind))
                masks, inner = np.concatenate([one, two]), np.arange(len(one) + len(two)) < len(one)
                step = max(1, 100_000 // len(masks))
                for s in range(0, len(at), step):
                    i = np.repeat(at[s : s + step], len(masks))
                    m = len(i) // len(masks)
                    yield pd.DataFrame({"key": keys[i], "word": fps[i] ^ np.tile(masks, m), "fp": fps[i], "inner": np.tile(inner, m)})

    balls = rows.select("key", "fp").distinct().mapInPandas(run, "key long, word long, fp long, inner boolean")
    centre = balls.groupBy("key", "word").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("c"), F.count("*").alias("n")).filter("c is not null and n > 1")
    near = balls.join(centre, ["key", "word"]).filter((F.col("fp") != F.col("c")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("c"))) <= MAX_BITS))
    return near.select(F.col("fp").alias("fa"), F.col("c").alias("fb"))


def _near(nodes: DataFrame, hot: int) -> DataFrame:
    """fa, fb: pairs of fingerprints within three bits; see links."""
    rows = materialise(_key_rows(nodes), "keys")
    heavy = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "hot")
    usual = rows.join(heavy, "key", "left_anti")
    a, b = usual.filter("home").select("key", F.col("fp").alias("fa")), usual.select("key", F.col("fp").alias("fb"))
    # own and nearby indices meet in both directions if two segments differ in one bit, so one direction finds every pair
    near = a.join(b, "key").filter((F.col("fa") < F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS)).select("fa", "fb")
    if not heavy.isEmpty():
        near = near.unionByName(_hot_links(rows.join(heavy, "key", "left_semi")))
    return near.select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb")).distinct()


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for fp, node in (("fa", "x"), ("fb", "y")):
        pairs = pairs.join(nodes.select(F.col("fp").alias(fp), F.col("node").alias(node)), fp)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links between nodes (fp, node; fingerprints distinct) within three bits.

    All of them under keys with at most `hot` rows; under hotter keys enough of them to give the same components.
    """
    return _named(_near(nodes, hot), nodes)


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that chains of links within three bits reach.

    Equal fingerprints are one node, named by their least doc_id, so copies cost one row whatever their number. Texts
    without words (and null ones) have fingerprint zero and link like any other. Repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored. doc_id must be an integer; rows with a null doc_id are their fingerprint's but never name it.
    """
    fps = materialise(fingerprints(docs, size, seed), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes.filter("node is not null"), hot))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Segments of a soft fingerprint, how many of them a key joins, and words of the shingles that links are verified on, with their least similarity.
SOFT_SEGMENTS, TOGETHER, VERIFY_WORDS, SIMILARITY = 5, 3, 5, 0.8
#: Least hashes in a sketch, and the similarity by a sketch below which a pair isn't verified in full (five deviations below 0.8).
SKETCH, SKETCH_LEAST = 64, 0.55
#: Pairs of one centre that go to one task.
CENTRE_PAIRS = 4_096
#: Least hashes of a sketch by which a node's typicality is judged.
TYPICAL = 16
#: Centres that a node meets: so many of the most typical among those of its keys.
CENTRES = 4
#: Nodes and shingles in one part of a key; two parts are compared by one task.
PART_NODES, PART_SHINGLES = 1_024, 1 << 20
DESCRIBED = "doc_id long, node long, size int, sketch array<long>, codes array<int>"


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """The codewords as rows of 23 signs."""
    return (2 * ((codewords()[:, None] >> np.arange(23)) & 1) - 1).astype(np.float32)


def soft_margins(text: str | None) -> np.ndarray:
    """For each bit of the fingerprint of a text's distinct words, how many more words have it set than not."""
    import xxhash

    bits = 23 * SOFT_SEGMENTS
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(words_of(lower_ascii(text or "")))], dtype=np.uint64)
    ones = [np.unpackbits(_another(hashes, k).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64) for k in range(-(-bits // 64))]
    return 2 * np.concatenate(ones)[:bits] - len(hashes)


def soft_codes(margins: np.ndarray) -> np.ndarray:
    """For each row and segment the two nearest codewords, decoded from the margins: a bit counts by how clearly it is set.

    Bits that a small edit turns are those with small margins, so near copies decode alike.
    """
    rows, out = np.arange(len(margins)), np.empty((len(margins), 2 * SOFT_SEGMENTS), dtype=np.int32)
    for i in range(SOFT_SEGMENTS):
        likeness = margins[:, 23 * i : 23 * i + 23].astype(np.float32) @ _signs().T
        for j in range(2):
            out[:, 2 * i + j] = likeness.argmax(axis=1)
            likeness[rows, out[:, 2 * i + j]] = -np.inf
    return out


def shingle_set(text: str | None, size: int = VERIFY_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in _shingles(text, size)], dtype="<u8").view("<i8"))


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit digest of a shingle set, by which documents with equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def described(docs: DataFrame) -> DataFrame:
    """Each row's node (the digest of its shingle set), the set's size and sketch, and the codes of its soft fingerprint."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DESCRIBED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, texts = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                sets = [shingle_set(t) for t in texts]
                codes = soft_codes(np.stack([soft_margins(t) for t in texts]))
                values = [ids, [set_id(s) for s in sets], [len(s) for s in sets], [s[:SKETCH] for s in sets], codes.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(values, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, DESCRIBED)


def _soft_keys(nodes: DataFrame) -> DataFrame:
    """key, node, home: one key for each choice of TOGETHER segments from their nearest codewords (home), and one for each segment
    of the choice that takes its second nearest instead."""
    made = []
    for n, chosen in enumerate(combinations(range(SOFT_SEGMENTS), TOGETHER)):
        for second in (None, *chosen):
            key = F.lit(n).cast("long")
            for s in chosen:
                key = key * 4096 + F.col("codes")[2 * s + (s == second)]
            made.append(F.struct(key.alias("key"), F.lit(second is None).alias("home")))
    return nodes.select("node", F.inline(F.array(*made))).select("key", "node", "home")


def verified(sets: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, size, sketch, shingles) have a Jaccard similarity of at least `similarity`.

    Sizes and then sketches sort out what can't be; only other pairs meet the sets. The b of a pair is joined first; a node that is the
    a of many pairs is sent to several tasks.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_PAIRS).alias("parts"))

    def met(pairs: DataFrame, *names: str) -> DataFrame:
        right = pairs.join(sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names]), "b")
        spread = parts.join(sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names]), "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return right.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts").join(spread.drop("parts"), ["a", "part"]).drop("part")

    sized = met(pairs, "size", "sketch").filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9)
    least = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    common = F.size(F.array_intersect(least, F.array_intersect("sketch_a", "sketch_b")))
    likely = materialise(sized.filter(common >= (similarity - SIMILARITY + SKETCH_LEAST) * F.size(least)).select("a", "b"), "likely")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return met(likely, "size", "shingles").withColumn("_n", both).filter(F.col("_n") >= similarity * (F.col("size_a") + F.col("size_b") - F.col("_n")) - 1e-9).select("a", "b")


def linked_within(node: np.ndarray, component: np.ndarray, home: np.ndarray, part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what all pairs of similar nodes of a key would, at most one for each two components.

    A pair has a home node, is of two parts (if there are two), and of two components, as those are after the links before. Common shingles are counted
    by lists of the nodes that have each; the largest component's nodes are only met by others, and a node with too many shingles that no
    other has is left out, as it can't be similar to any.
    """
    sizes = np.array([len(s) for s in sets])
    apart = len(np.unique(part)) > 1
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(node)), sizes)
    able = np.bincount(owner, weights=held[at] > 1, minlength=len(node)) >= similarity * sizes - 1e-9
    use = (held[at] > 1) & able[owner]
    at, owner = at[use], owner[use]
    held = np.bincount(at, minlength=len(held))
    first, having = np.cumsum(held) - held, owner[np.argsort(at, kind="stable")]
    starts = np.searchsorted(owner, np.arange(len(node) + 1))
    root, out = np.unique(component, return_inverse=True)[1], []
    for x in np.flatnonzero(able & (root != np.bincount(root).argmax())):
        fine = able & (root != root[x]) & (home | home[x])
        if apart:
            fine &= part != part[x]
        if not fine.any():
            continue
        own = at[starts[x] : starts[x + 1]]
        n = held[own]
        common = np.bincount(having[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(node))
        for y in np.flatnonzero(fine & (common >= similarity * (sizes + sizes[x] - common) - 1e-9)):
            if root[y] != root[x]:
                out.append((int(node[x]), int(node[y])))
                root[root == root[y]] = root[x]
    return out


def _settle(sets: DataFrame, blocks: DataFrame, similarity: float) -> DataFrame:
    """node, component: exactly the components of all similar pairs of nodes that share a key (blocks: key, node, home), one of them at home there.

    A key's centre is its most typical home node, whose least hashes most other nodes have; near copies with edits of their own are most like
    that. First a node meets the at most CENTRES most typical of its forty keys' centres, so pairs grow with the nodes alone, however many share its
    keys. Then every key that still holds several components is compared in full by tasks, all pairs of two components (see linked_within). That
    emits links, not pairs, so rows are bounded by the nodes of the keys and their parts.
    """
    often = sets.select("node", F.explode(F.slice("sketch", 1, TYPICAL)).alias("h"))
    often = often.join(often.groupBy("h").agg(F.count("*").alias("n")), "h").groupBy("node").agg(F.sum("n").alias("often"))
    ranked = F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.xxhash64("node").alias("hash"), "node")
    centres = blocks.filter("home").join(often, "node", "left").groupBy("key").agg(F.max(ranked).alias("centre"))
    met = blocks.join(centres, "key").filter("centre.node != node").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("centre"), asc=False), 1, CENTRES).alias("centres"))
    met = met.select(F.col("node").alias("b"), F.explode("centres.node").alias("a"))
    once = met.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p"))
    named = materialise(components(verified(sets, materialise(once.select("p.a", "p.b"), "pairs"), similarity)), "named")

    at = materialise(blocks.join(named, "node", "left").join(sets.select("node", "size"), "node").withColumn("component", F.coalesce("component", "node")), "placed")
    parts = F.ceil(F.greatest(F.count("*") / PART_NODES, F.sum("size") / PART_SHINGLES))
    open_ = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), parts.alias("parts")).filter("lo < hi").select("key", "parts")
    rest = at.drop("size").join(open_, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    rest = rest.select("key", "p", "q", "part", "node", "component", "home").join(sets.select("node", "shingles"), "node")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["part"].isin([group["p"].iloc[0], group["q"].iloc[0]])].sort_values("node")
        found = linked_within(*[group[c].to_numpy() for c in ("node", "component", "home", "part")], list(group["shingles"]), similarity)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    links = materialise(rest.groupBy("key", "p", "q").applyInPandas(run, "a long, b long"), "links")
    return components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, component_id: groups of documents that chains of verified links connect, each named by its least doc_id.

    Documents with equal sets of five-word shingles are one node, the least of them. The fingerprint of a document's distinct words is
    cut into five segments, each decoded to nearby words of the Golay code, whose indices in threes are its keys: nodes that agree in three segments
    (one of them may be second nearest) are candidates, and linked if their shingles have a Jaccard similarity of 0.8 or more. No
    candidate is left out, whatever the size of a key; see _settle.
    """
    rows = described(docs)
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("size", "sketch", "codes")]), "nodes")
    keys = _soft_keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("m")).filter("n > 1 and m > 0").select("key")
    blocks = materialise(keys.join(shared, "key"), "blocks")
    asked = materialise(nodes.join(blocks.select("node").distinct(), "node").select("node", "doc_id", "size", "sketch"), "asked")

    def make():
        def of(text):
            shingles = shingle_set(text)
            return set_id(shingles), shingles

        return of

    texts = docs.join(asked.select("doc_id"), "doc_id", "left_semi").select(text_or_empty().alias("text"))
    shingles = map_rows(texts, make, "node long, shingles array<long>").dropDuplicates(["node"])
    sets = materialise(asked.drop("doc_id").join(shingles, "node"), "sets")
    found = _settle(sets, blocks, similarity)
    named = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select(F.col("doc_id").alias("node"), "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that carry the least doc_id of their group (see similar_groups), one row for each such id (of several, the one whose
    text has the least hash), with all their columns.

    Rows with a null doc_id can't be compared by it and stay.
    """
    found = similar_groups(docs.filter("doc_id is not null"), similarity)
    kept = materialise(found.filter("node = component_id").select(F.col("node").alias("doc_id")).distinct(), "kept")
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_nf_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")))
    return named.filter("_nf_n = 1").drop("_nf_n").unionByName(docs.filter("doc_id is null"))
