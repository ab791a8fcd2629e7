"""Byte-level BPE: encoding in overlapping chunks, and decoding by concatenating raw bytes."""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import map_rows, text_or_empty

#: Characters in a chunk, and how far a chunk reads on into the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Runs of white space from here on are encoded by themselves: the library's pattern engine backtracks over each character of a run.
LONG_RUN = 20_000
# Fixed value: the characters of Unicode's White_Space property, which is what both pattern engines mean by white space.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file, or of a tokeniser file whose merges are numbered in the order of their ids."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if ids != sorted(ids):
        raise ValueError(f"{path}: merges aren't in the order of their ids, so ranks can't replace them")
    kept = {"".join(m) for m in merges} | set(to_byte)
    return {bytes(map(to_byte.__getitem__, token)): i for token, i in model["vocab"].items() if token in kept}


_BLANK = regex.compile(f"[{BLANK}]")


@lru_cache(maxsize=65_536)
def _kind(c: str) -> str | None:
    """L, N, S or O (letter, number, white space, other) of a character on which all Unicode versions agree, else None.

    The pattern engine of the library and that of Python know different versions. Characters that had their class in the oldest
    version at hand, and still have it, are safe.
    """
    if _BLANK.match(c):
        return "S"
    now, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if now[0] != old[0] or now == "Cn" or c.isspace():
        return None
    return now[0] if now[0] in "LN" else "O"


def is_seam(before: str, after: str) -> bool:
    """Whether any pre-tokenisation parts these neighbours, whatever stands around them.

    No match of the pattern holds a letter, a number or another sign followed by one of another kind, except that a sign may
    be the apostrophe of a contraction; white space may begin a match of any kind.
    """
    a, b = _kind(before), _kind(after)
    return a in ("L", "N", "O") and b is not None and a != b and (a, b) != ("O", "L")


class ByteBPE:
    """Encodes each match of the public pattern separately, without special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self._encoding = tiktoken.Encoding("nearfield", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self._long = regex.compile(f"[{BLANK}]{{{LONG_RUN},}}")

    def encode(self, text: str) -> list[int]:
        """The library's ids. A long run of white space is one match, less its last character if something follows."""
        if len(text) < LONG_RUN:
            return self._encoding.encode_ordinary(text)
        ids, at = [], 0
        for m in self._long.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            ids += self._encoding.encode_ordinary(text[at : m.start()])
            ids += self._encoding._core_bpe.encode_single_piece(text[m.start() : end].encode())
            at = end
        return ids + self._encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pattern's matches, which cover the whole text."""
        return [m.end() for m in self._pattern.finditer(text)]


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def chunk_spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the chunks of a text; each but the last reads `overlap` characters into the next."""
    return [(s, min(length, s + chunk + overlap)) for s in range(0, max(length, 1), chunk)]


def edges(bpe: ByteBPE, text: str, start: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of one chunk that are seams, as places in the whole text, in its first and in its last `overlap` characters."""
    found = [b for b in bpe.boundaries(text) if (b < overlap or chunk <= b < chunk + overlap) and 0 < b < len(text) and is_seam(text[b - 1], text[b])]
    return [start + b for b in found if b < overlap], [start + b for b in found if b >= chunk]


def stitch(heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    """Where the pieces begin: the first boundary that a chunk and the one before both have.

    From there on both agree for good, as matching goes left to right. Two chunks without a common boundary (one run that is longer than the
    overlap) become one piece, and stitching goes on with the next seam.
    """
    return [0, *(min(common) for head, tail in zip(heads[1:], tails, strict=False) if (common := set(head).intersection(tail)))]


def to_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _split(frame: DataFrame, schema: str, cut) -> DataFrame:
    """One output row for each (number, value...) that cut(text, extra) yields; the key is carried along."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, *values = (c[row].as_py() for c in batch.columns)
                made = list(zip(*((key, *x) for x in cut(*values)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=t.type) for v, t in zip(made, out, strict=True)], schema=out)

    return frame.mapInArrow(run, schema)


def encode_long(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, ids for distinct long texts (key, text): chunks and pieces of one text are worked on by different tasks."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = _split(texts.select("key", "text"), "key binary, n long, start long, text string", lambda t: ((i, s, t[s:e]) for i, (s, e) in enumerate(chunk_spans(len(t), chunk, overlap))))

    def edge_rows():
        bpe = codec(path)
        return lambda key, n, start, text: (key, n, *edges(bpe, text, start, chunk, overlap))

    seen = map_rows(chunks.repartition(parts, "key", "n"), edge_rows, "key binary, n long, head array<long>, tail array<long>")
    order = Window.partitionBy("key").orderBy("n")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    cut = seen.withColumn("cut", F.when(F.col("n") == 0, F.lit(0)).otherwise(met)).filter(F.col("cut").isNotNull())
    cuts = cut.groupBy("key").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    pieces = _split(texts.join(cuts, "key").select("key", "text", "cuts"), "key binary, n long, text string", lambda t, c: ((i, t[a:b]) for i, (a, b) in enumerate(zip(c, [*c[1:], len(t)], strict=True))))

    def encode_rows():
        bpe = codec(path)
        return lambda key, n, text: (key, n, to_bytes(bpe.encode(text)))

    encoded = map_rows(pieces.repartition(parts, "key", "n"), encode_rows, "key binary, n long, ids binary")

    def concatenate(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("n")
        return pd.DataFrame({"key": [ordered["key"].iloc[0]], "ids": [b"".join(ordered["ids"])]})

    return encoded.groupBy("key").applyInPandas(concatenate, "key binary, ids binary")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every whole text.

    A text of at most one chunk is encoded where it is read. Of longer ones, each distinct text is cut into
    overlapping chunks that are pre-tokenised in parallel; the pieces between resynchronised boundaries are encoded in
    parallel and their ids concatenated. Chunks that meet within one run longer than the overlap are one piece. Null texts are empty; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    path = vocabulary

    def make():
        bpe = codec(path)
        return lambda doc_id, text: (doc_id, to_bytes(bpe.encode(text)))

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = map_rows(rows.filter(F.length("text") <= chunk), make, f"doc_id {kind}, ids binary")
    long = rows.filter(F.length("text") > chunk).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    whole = encode_long(long.select("key", "text").dropDuplicates(["key"]), path, chunk, overlap)
    return short.unionByName(long.select("doc_id", "key").join(whole, "key").select("doc_id", "ids"))


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the raw bytes that the ids stand for, concatenated; null ids give null."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    path = vocabulary

    def make():
        bpe = codec(path)
        return lambda doc_id, ids: (doc_id, ids, None if ids is None else bpe.decode(np.frombuffer(ids, dtype="<u4").tolist()))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, ids binary, decoded binary")
