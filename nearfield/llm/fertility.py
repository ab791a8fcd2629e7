"""Quality rules by tokeniser fertility: how well two public vocabularies fit a text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.bpe import codec
from nearfield.llm.common import map_rows, words_of

_SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8  # words


@dataclass(frozen=True)
class Band:
    """What a language's texts look like to the vocabulary.

    chars_per_token is the accepted range of long texts; a text of n tokens gets SLACK / sqrt(n) more on either side, as short
    texts scatter more. min_entropy is the least share of ENTROPY_BITS (of log2 n for texts too short to reach them). min_both,
    less the same slack, is the least sum of characters per token and ENTROPY_WEIGHT times that share: junk is low in both.
    chars_per_second is the range, with the same slack, of characters per token of the second vocabulary.
    """

    chars_per_token: tuple[float, float]
    max_byte_share: float
    min_entropy: float
    min_both: float = 0.0
    chars_per_second: tuple[float, float] = (0.0, float("inf"))


SLACK, ENTROPY_BITS, ENTROPY_WEIGHT = 7.0, 7.0, 3.0
# One band for each language, then for each script, then for everything else. The lower ends for the four
# languages and of their entropy lie below every text marked good among the labelled rows; min_both, with its weight, is fitted
# on those of sf0.1 so that at most 0.5 % of the good rows of a language lie below it; the second vocabulary's lower ends lie just below
# all of those good rows. Scripts have no labelled rows.
BANDS: Mapping[str, Band] = {
    "en": Band((2.16, 7.0), 0.10, 0.78, 5.15, (2.29, 4.0)),
    "de": Band((2.19, 7.0), 0.10, 0.78, 5.17, (2.38, 4.0)),
    "fr": Band((1.93, 7.0), 0.10, 0.78, 4.83, (2.09, 4.0)),
    "es": Band((1.89, 7.0), 0.10, 0.78, 4.81, (2.11, 4.0)),
    "latin": Band((1.3, 8.0), 0.20, 0.60),
    "cyrillic": Band((1.0, 6.0), 0.20, 0.60),
    "greek": Band((0.7, 4.0), 0.30, 0.60),
    "arabic": Band((0.7, 4.0), 0.40, 0.60),
    "hebrew": Band((0.7, 4.0), 0.40, 0.60),
    "devanagari": Band((0.5, 4.0), 0.60, 0.50),
    "han": Band((0.4, 3.0), 0.70, 0.50),
    "kana": Band((0.4, 3.0), 0.70, 0.50),
    "hangul": Band((0.3, 3.0), 0.80, 0.40),
    "other": Band((0.2, 8.0), 1.00, 0.40),
}
# First and last code points of the blocks that name a script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
SEGMENT = 4096  # words given to the tokeniser at once
MOST_WORDS = 400_000
#: Words of ASCII and of Latin letters with marks, which no vocabulary normalises into blanks.
_PLAIN = re.compile("[!-~\u00c0-\u024f]+")


def script_of(text: str) -> str:
    """The script with most letters in the text; other if no block is met."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = {name: sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in blocks) for name, blocks in SCRIPTS.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "other"


def repeated_window_words(words: Sequence[str], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words (a power of two) which occurs twice or more, first occurrences included.

    Windows get exact numbers by doubling: a number for each pair of neighbouring half windows.
    """
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return repeated_windows(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)), size)


def repeated_windows(codes: np.ndarray, size: int = WINDOW) -> int:
    """`repeated_window_words` of words given by numbers."""
    n = len(codes)
    if n <= size:
        return 0
    width = 1
    while width < size:
        pairs = codes[:-width] * (int(codes.max()) + 1) + codes[width:]
        found, codes = np.unique(pairs, return_inverse=True)
        width *= 2
        if len(found) == len(codes):  # all differ, and so will all longer windows
            return 0
    again = np.bincount(codes)[codes] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    edge[starts] += 1
    np.add.at(edge, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif words_of(line):
            seen.add(line)
    return n


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.fromiter((model.is_byte(i) for i in range(model.get_piece_size())), dtype=bool, count=model.get_piece_size())
    return model, is_byte


class Lexicon:
    """What two vocabularies make of words, remembered for about MOST_WORDS words; a text's words are looked up once for all measures.

    The first vocabulary, with byte fallback, takes words joined by blanks. None of its pieces crosses a blank, so the ids of plain
    words are remembered one by one; a segment with any other word, which it may normalise together with its neighbours, is encoded
    as a whole. The second, byte-level one takes each word with a blank before it.
    """

    def __init__(self, first: str, second: str):
        self._model, self.is_byte = _vocabulary(first)
        self._second = codec(second).encode
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        # by number: characters, tokens of the second vocabulary, whether plain, and where its ids end
        self._chars, self._tokens, self._plain, self._ends, self._ids = array("q"), array("q"), array("b"), array("q", [0]), array("q")

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """A number for each word, valid until the next call."""
        if len(self._numbers) > MOST_WORDS:
            self._forget()
        known = self._numbers
        for w in set(words).difference(known):
            known[w] = len(known)
            self._chars.append(len(w))
            self._tokens.append(len(self._second(f" {w}")))
            plain = _PLAIN.fullmatch(w) is not None
            self._plain.append(plain)
            if plain:
                self._ids.extend(self._model.EncodeAsIds(w))
            self._ends.append(len(self._ids))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def totals(self, numbers: np.ndarray) -> tuple[int, int]:
        """Characters and tokens of the second vocabulary."""
        return int(np.frombuffer(self._chars, dtype=np.int64)[numbers].sum()), int(np.frombuffer(self._tokens, dtype=np.int64)[numbers].sum())

    def counts(self, words: Sequence[str], numbers: np.ndarray) -> np.ndarray:
        """How often each id of the first vocabulary occurs."""
        counts = np.zeros(len(self.is_byte), dtype=np.int64)
        plain, ends, every = np.frombuffer(self._plain, dtype=np.int8), np.frombuffer(self._ends, dtype=np.int64), np.frombuffer(self._ids, dtype=np.int64)
        for at in range(0, len(words), SEGMENT):
            part = numbers[at : at + SEGMENT]
            if plain[part].all():
                first, size = ends[part], ends[part + 1] - ends[part]
                ids = every[np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)]
            else:
                ids = np.asarray(self._model.encode(" ".join(words[at : at + SEGMENT]), num_threads=1), dtype=np.int64)
            counts += np.bincount(ids, minlength=len(counts))
        return counts


lexicon = lru_cache(maxsize=2)(Lexicon)


def measure(counts: np.ndarray, is_byte: np.ndarray) -> tuple[int, int, float]:
    """Tokens, byte-fallback tokens and entropy in bits of the token distribution, from the counts of all ids."""
    total = int(counts.sum())
    if not total:
        return 0, 0, 0.0
    p = counts[counts > 0] / total
    return total, int(counts[is_byte].sum()), float(max(0.0, -(p * np.log2(p)).sum()))


def fits(band: Band, chars: int, tokens: int, byte_tokens: int, entropy: float, second: int) -> bool:
    """Whether a text of `chars` characters in words is within the band, by its tokens (byte_tokens of them bytes) and by those of the second vocabulary."""
    low, high = band.chars_per_token
    slack, share, ratio = SLACK / tokens**0.5, entropy / min(ENTROPY_BITS, float(np.log2(tokens))), chars / tokens
    both = ratio + ENTROPY_WEIGHT * share >= band.min_both - slack
    low2, high2 = band.chars_per_second
    also = low2 - SLACK / second**0.5 <= chars / second <= high2 + SLACK / second**0.5
    return low - slack <= ratio <= high + slack and byte_tokens <= band.max_byte_share * tokens and share >= band.min_entropy and both and also


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, n_byte_tokens long, entropy double, band string, n_tokens_second long"
)


def judge(text: str | None, lang: str | None, path: str, second: str, bands: Mapping[str, Band] = BANDS) -> tuple:
    """All of SCHEMA but the id; path and second are the two vocabularies. Texts that fail the base rules have no further verdict."""
    text = text or ""
    words = words_of(text)
    known = lexicon(path, second)
    n, numbers = len(words), known.numbers(words)
    chars, others = known.totals(numbers) if words else (0, 0)
    repeats = repeated_windows(numbers)
    failed = n < 20 or 100 * repeats > 30 * n
    tokens, byte_tokens, entropy = measure(known.counts(words, numbers), known.is_byte) if words else (0, 0, 0.0)
    name = lang if lang in bands else script_of(text)
    name = name if name in bands else "other"
    kept = not failed and fits(bands[name], chars, tokens, byte_tokens, entropy, others)
    return n, chars, len(_SYMBOL.findall(text)), duplicate_lines(text), repeats, failed, kept, tokens, byte_tokens, entropy, name, others


def _paths(vocabulary: str | None, second: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("piece_bpe_32k.model"), second or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(docs: DataFrame, vocabulary: str | None = None, bands: Mapping[str, Band] = BANDS, second: str | None = None) -> DataFrame:
    """One row of measures and the verdict `kept` for each row of docs, in a single pass without a shuffle.

    The base rules reject texts of fewer than 20 words or with over 30 % of their words in repeated 8-word windows; the
    band of the text's language, else of its script, rejects by characters per token, byte-fallback share, normalised token
    entropy, the first and last together, and characters per token of a second vocabulary. Null and empty texts have no words and fail the base. Repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored, and a missing lang column leaves the choice of band to the script.
    """
    paths = _paths(vocabulary, second)
    lang: Column = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")

    def make():
        return lambda doc_id, text, lang: (doc_id, *judge(text, lang, *paths, bands))

    return map_rows(docs.select("doc_id", "text", lang.alias("lang")), make, SCHEMA)


def keep(docs: DataFrame, vocabulary: str | None = None, bands: Mapping[str, Band] = BANDS, second: str | None = None) -> DataFrame:
    """The rows of docs that `quality` would mark as kept, with all their columns, in one pass without a shuffle or join."""
    import pyarrow as pa

    paths = _paths(vocabulary, second)
    kept = SCHEMA.split(", ").index("kept boolean") - 1

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * len(texts)
            yield batch.filter(pa.array([judge(t, x, *paths, bands)[kept] for t, x in zip(texts, langs, strict=True)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
