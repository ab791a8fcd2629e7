"""LM scoring with a weighted backoff automaton over smoothed word trigrams.

The texts are packed into blocks. Each block sends its distinct words, word pairs and triples, as sorted hashes with their training
counts, to buckets by hash range; a bucket adds the counts of all blocks and answers each of them in the order asked, without
the hashes. With the answers, a block builds the part of the automaton that its own texts can reach, and walks each text through it once.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import SLICE, lower_ascii, text_or_empty, words_of
from nearfield.storage import materialise

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of text for each bucket of counts, which so hold about as many keys each at any size of the corpus.
BUCKET_CHARS = 8_000_000
#: Tokens that the next lower order weighs in the distribution over what follows one word, and what follows two.
MU = (1_000.0, 20.0)
#: Bits of the hashes by which words, pairs and triples are known.
KEY_BITS = 56
END, START = 0, 1  # local numbers; words follow
HELD_OUT_MODULUS, HELD_OUT = 7, 2


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_MODULUS == HELD_OUT


def _planes(values: np.ndarray) -> bytes:
    """Compressed integers, byte by byte position: high bytes of small numbers cost next to nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _deltas(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, "<u8"), dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ORDERS = ("words", "pairs", "triples")


def encode_texts(ids: list, texts: Sequence[str]) -> bytes:
    """Ids, lengths, word numbers and the words' hashes by number: all that the later steps need of the texts."""
    import xxhash

    numbers = {"": END}
    numbers["\0start"] = START  # no word holds this: it stands for what precedes a text
    flat, lengths = array("I"), []
    for text in texts:
        words = words_of(lower_ascii(text))
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        flat.extend(map(numbers.__getitem__, words))
        flat.append(END)
        lengths.append(len(words) + 1)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in numbers), dtype=np.uint64, count=len(numbers)) >> np.uint64(64 - KEY_BITS)
    return pickle.dumps((ids, lengths, _planes(np.frombuffer(flat, dtype=np.uint32)), _planes(hashed)), protocol=5)


class Block:
    """Texts as local word numbers, with the sorted distinct keys of their words, word pairs and triples, from what encode_texts made.

    A text's first word makes a pair with START, its second one a triple; `at` has the key of each step, -1 where the step has none.
    """

    def __init__(self, payload: bytes):
        self.ids, self.lengths, flat, hashed = pickle.loads(payload)
        self.words, hashed = _unplanes(flat, "<u4").astype(np.int64), _unplanes(hashed, "<u8")
        self.ends = np.cumsum(self.lengths, dtype=np.int64)
        self.starts = self.ends - np.array(self.lengths, dtype=np.int64)
        self.previous = np.roll(self.words, 1)
        self.previous[self.starts] = START
        third = np.ones(len(self.words), dtype=bool)
        third[self.starts] = False
        self.third = np.flatnonzero(third)
        shift = np.uint64(64 - KEY_BITS)
        pairs = _mix(hashed[self.previous], hashed[self.words])
        self.keys, self.at = {}, {}
        self.keys["words"], self.word_at = np.unique(hashed, return_inverse=True)
        self.at["words"] = self.word_at[self.words]
        self.keys["pairs"], self.at["pairs"] = np.unique(pairs >> shift, return_inverse=True)
        self.keys["triples"], found = np.unique(_mix(pairs[self.third - 1], hashed[self.words[self.third]]) >> shift, return_inverse=True)
        self.at["triples"] = np.full(len(self.words), -1, dtype=np.int64)
        self.at["triples"][self.third] = found

    def counts(self) -> dict[str, np.ndarray]:
        """How often training texts hold each key."""
        flags = np.repeat([not held_out(i) for i in self.ids], self.lengths).astype(bool)
        return {order: np.bincount(self.at[order][flags & (self.at[order] >= 0)], minlength=len(self.keys[order])).astype(np.uint64) for order in ORDERS}


class Automaton:
    """The root, a state for each word and one for each word pair that was seen in training.

    Arcs carry log10 probabilities. A seen triple is an arc from its first pair's state to its second's, a seen pair one from its first
    word's state to the pair's; any state without an arc for a word fails, at a log10 weight, to the state of its last word, and that
    to the root, which has an arc for every word (unseen ones have the probability of a word never met). Each distribution so sums
    to 1 over known words and the unknown one. States and arcs are known by the block's numbers of words, pairs and triples.
    """

    NO_ARC = 1.0  # no log10 of a probability is above 0

    def __init__(self, block: Block, counts: dict[str, np.ndarray], tokens: int, types: int, mu: tuple[float, float] = MU):
        words, pairs, triples = (counts[order].astype(np.float64) for order in ORDERS)
        self.count = words[block.word_at]
        once = (self.count + 1.0) / (tokens + types + 1.0)
        context = self.count.copy()
        context[START] = self.count[END]  # every training text begins once and ends once

        def first(order: str) -> np.ndarray:  # where each distinct key first stands
            at = block.at[order]
            where = np.flatnonzero(at >= 0)[::-1]
            out = np.zeros(len(block.keys[order]), dtype=np.int64)
            out[at[where]] = where
            return out

        two, three = first("pairs"), first("triples")
        left, right = block.previous[two], block.words[two]
        twice = (pairs + mu[0] * once[right]) / (context[left] + mu[0])
        before, last = block.at["pairs"][three - 1], block.at["pairs"][three]  # the triple's two pairs
        thrice = (triples + mu[1] * twice[last]) / (pairs[before] + mu[1])
        self.root = np.log10(once)
        self.pair_arc = np.where(pairs > 0, np.log10(twice), self.NO_ARC)
        self.triple_arc = np.where(triples > 0, np.log10(thrice), self.NO_ARC)
        self.word_failure = np.log10(mu[0] / (context + mu[0]))
        self.pair_failure = np.log10(mu[1] / (pairs + mu[1]))

    def walk_all(self, block: Block) -> list[float]:
        """For every text of the block, one traversal from the start state: take the state's arc, or fail until there is one."""
        none = self.NO_ARC
        root, pair_arc, triple_arc, word_failure, pair_failure = (x.tolist() for x in (self.root, self.pair_arc, self.triple_arc, self.word_failure, self.pair_failure))
        scores = []
        for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            at_pair, pair, last, total = False, -1, START, 0.0  # the state: a pair's, or that of the last word
            for word, to, triple in zip(*(x[a:b].tolist() for x in (block.words, block.at["pairs"], block.at["triples"])), strict=True):
                arc = none
                if at_pair:
                    arc = triple_arc[triple]
                    if arc == none:
                        total += pair_failure[pair]
                if arc == none:
                    arc = pair_arc[to]
                    at_pair = arc != none
                    if not at_pair:
                        arc = word_failure[last] + root[word]
                total += arc
                pair, last = to, word
            scores.append(total)
        return scores


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0

    def row():
        return pa.RecordBatch.from_pydict({"payload": pa.array([encode_texts(ids, texts)], pa.binary()), "chars": pa.array([size], pa.int64())})

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                if ids and size + len(text) > BLOCK_CHARS:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
    if ids:
        yield row()


def _limits(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted keys of each bucket begin and end; buckets are equal ranges of the hash."""
    edges = [(b << KEY_BITS) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]]).astype(np.int64)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, mu: tuple[float, float] = MU) -> DataFrame:
    """Train on the texts that aren't held out (see held_out) and score every whole text; one row for each row of docs.

    base_score is the add-one unigram score; score is the trigram automaton's log10 probability of the text and its end. Null and
    empty texts are an end alone. Repeated rows count and score each time; an empty table gives no rows; other columns are
    ignored. Counts cover all training texts; a triple costs one entry for each block that holds it, however often it occurs
    there, so common ones don't pile up. There are as many buckets as the texts' length asks for. Keys are hashes of 56 bits.
    """
    spark = docs.sparkSession
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_pack_blocks, "payload binary, chars long")
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    n_blocks, chars = blocks.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    buckets, n_blocks = 1 + chars // BUCKET_CHARS, max(1, n_blocks)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, payload in zip(batch["block"], batch["payload"], strict=True):
                block = Block(payload)
                counts = block.counts()
                made = {"bucket": np.arange(buckets), "block": np.full(buckets, number)}
                for order in ORDERS:
                    cut = _limits(block.keys[order], buckets)[1:-1]
                    made[order] = [_deltas(k) for k in np.split(block.keys[order], cut)]
                    made[f"{order}_count"] = [_planes(c) for c in np.split(counts[order], cut)]
                yield pd.DataFrame(made)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        n = len(group)
        out = {"block": group["block"], "bucket": group["bucket"], "tokens": [0] * n, "types": [0] * n}
        for order in ORDERS:
            keys, own = [_undeltas(d) for d in group[order]], np.concatenate([_unplanes(d, "<u8") for d in group[f"{order}_count"]])
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(at, weights=own, minlength=len(found)).astype(np.uint64)
            out[order] = [_planes(x) for x in np.split(totals[at] - own, np.cumsum([len(k) for k in keys])[:-1])]  # what all others add
            if order == "words":
                out["tokens"][0], out["types"][0] = int(totals.sum()), int(np.count_nonzero(totals))
        return pd.DataFrame(out)

    columns = ", ".join(f"{order} binary, {order}_count binary" for order in ORDERS)
    asked = blocks.select("block", "payload").mapInPandas(ask, f"bucket long, block long, {columns}").repartition(buckets, "bucket")
    answers = asked.groupBy("bucket").applyInPandas(answer, "block long, bucket long, words binary, pairs binary, triples binary, tokens long, types long")
    answers = materialise(answers, "answers")
    total = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(total[0] or 0), int(total[1] or 0)

    def walk(block_rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block, ordered = Block(block_rows["payload"].iloc[0]), replies.sort_values("bucket")
        counts = block.counts()
        for order in ORDERS:
            counts[order] = counts[order] + np.concatenate([_unplanes(d, "<u8") for d in ordered[order]])
        automaton = Automaton(block, counts, tokens, types, mu)
        return pd.DataFrame(
            {
                "doc_id": pd.array(block.ids, dtype="Int64"),
                "held_out": [held_out(i) for i in block.ids],
                "n_tokens": block.lengths,
                "n_known": np.add.reduceat((automaton.count > 0)[block.words].astype(np.int64), block.starts),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(automaton.root[block.words], block.starts),
                "score": automaton.walk_all(block),
            }
        )

    sent = blocks.select("block", "payload").repartition(n_blocks, "block").groupBy("block")
    replies = answers.select("block", "bucket", *ORDERS).repartition(n_blocks, "block").groupBy("block")
    return sent.cogroup(replies).applyInPandas(walk, SCORES)
