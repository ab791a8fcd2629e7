"""Every operator against a brute-force version, on awkward rows and on generated ones."""

import collections
import dataclasses
import hashlib
import itertools
import math
import random
import re
import sys
import urllib.parse
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import public_tokenizers
from helpers import PROSE, awkward, doc, empty
from helpers import DOC_SCHEMA as SCHEMA

from nearfield.llm import bpe, chat_format, components, fertility, forest, language_model, packing, queries, secret_scan, sharding, simhash, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]


# 1 -------------------------------------------------------------------------------------------------------------------


def brute_repeats(words):
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_repeated_windows():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        assert fertility.repeated_window_words(words) == brute_repeats(words)


def test_quality_measures(spark):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in fertility.quality(awkward(spark)).collect())
    want = collections.Counter()
    for i, t in texts(spark):
        t = t or ""
        w, lines = WORD.findall(t), t.split("\n")
        dup = sum(bool(WORD.search(x)) and x in lines[:n] for n, x in enumerate(lines))
        rep = brute_repeats(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(w) < 20 or 100 * rep > 30 * len(w))] += 1
    assert got == want
    assert fertility.quality(empty(spark)).count() == 0


def test_quality_verdicts(spark):
    junk = " ".join(w for w in PROSE.split()[:9] for _ in range(7))
    docs = spark.createDataFrame([doc(1, PROSE), doc(2, junk), doc(3, None)], SCHEMA)
    assert {r["doc_id"]: r["kept"] for r in fertility.quality(docs).collect()} == {1: True, 2: False, 3: False}
    kept = fertility.keep(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert fertility.script_of("Привет мир") == "cyrillic" and fertility.script_of("123") == "other"


def test_fertility_measures_and_verdicts(spark, sf_dir):
    """Tokens, bytes, entropy, band and verdict anew from both libraries, over whole texts."""
    import sentencepiece

    model, e = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), reference_encoding()
    odd = [doc(9_001, "\u16a0\u16b1\u16a2 " * 3 + " ".join(f"ᚠᚱᚢ{i}" for i in range(40))), doc(9_002, "Привет " + " ".join(f"слово{i}" for i in range(30)), lang="ru"), doc(9_003, " ".join(f"{i:x}{i * 7919:x}" for i in range(200)), lang="en")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, SCHEMA).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in fertility.quality(docs).collect()}
    verdicts = collections.Counter()
    for r in docs.collect():
        words, g = WORD.findall(r["text"] or ""), got[r["doc_id"]]
        if len(words) > 4_000:
            continue  # longer ones are tokenised in parts
        ids = model.encode(" ".join(words)) if words else []
        n, counts, chars = len(ids), collections.Counter(ids), sum(map(len, words))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
        second = sum(len(e.encode_ordinary(f" {w}")) for w in words)
        assert (g["n_tokens"], g["n_byte_tokens"], g["n_tokens_second"]) == (n, sum(model.is_byte(i) for i in ids), second) and abs(g["entropy"] - entropy) < 1e-9
        if not g["base_failed"]:
            b = fertility.BANDS[g["band"]]
            slack, slack2, share = 7 / math.sqrt(n), 7 / math.sqrt(second), entropy / min(7, math.log2(n))
            rules = [b.chars_per_token[0] - slack <= chars / n <= b.chars_per_token[1] + slack, g["n_byte_tokens"] / n <= b.max_byte_share, share >= b.min_entropy, chars / n + 3 * share >= b.min_both - slack, b.chars_per_second[0] - slack2 <= chars / second <= b.chars_per_second[1] + slack2]
            assert g["kept"] == all(rules) and g["band"] == (r["lang"] if r["lang"] in fertility.BANDS else fertility.script_of(r["text"]))
            verdicts.update([i for i, ok in enumerate(rules) if not ok])
        else:
            assert not g["kept"]
    assert got[9_002]["band"] == "cyrillic" and got[9_001]["n_byte_tokens"] > 0 and not got[9_003]["kept"] and len(verdicts) >= 2


def test_quality_against_labels(sf_dir):
    import pyarrow.parquet as pq

    sf_dir = Path(sf_dir).parent / "sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    path, kept = fertility._paths(None, None), {0: [], 1: []}
    for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist():
        if r["doc_id"] in labels and r["lang"] in ("en", "de", "fr", "es"):
            verdict = dict(zip([c.split()[0] for c in fertility.SCHEMA.split(", ")][1:], fertility.judge(r["text"], r["lang"], *path), strict=True))
            if not verdict["base_failed"]:
                kept[labels[r["doc_id"]]].append(verdict["kept"])
    assert len(kept[0]) >= 10 and sum(kept[0]) <= 0.1 * len(kept[0])
    assert sum(kept[1]) >= 0.98 * len(kept[1])


# 2 -------------------------------------------------------------------------------------------------------------------


def reference_encoding():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [32_768, 200])
def test_bpe_matches_library(spark, chunk):
    ids = bpe.encode_documents(awkward(spark), chunk=chunk, overlap=60)
    got = collections.Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.decode_documents(ids).collect())
    e = reference_encoding()
    assert got == collections.Counter((i, bpe.to_bytes(e.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts(spark))
    assert bpe.encode_documents(empty(spark)).count() == 0


def cut_up(codec, text, chunk, overlap):
    spans = bpe.chunk_spans(len(text), chunk, overlap)
    seen = [bpe.edges(codec, text[s:e], s, chunk, overlap) for s, e in spans]
    cuts = bpe.stitch([h for h, _ in seen], [t for _, t in seen])
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


NEW_LETTER = "\U00018da7"  # no letter yet in the oldest Unicode version at hand


def test_stitching_any_text():
    rng = random.Random(2)
    codec, e = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), reference_encoding()
    signs = ["a", "b's", "'s", "'", " ", "  ", "\n", "1", "é", "!", "\u3000", "日", NEW_LETTER, "\x1c", "\u200b", "x" * 15, " " * 15]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 300)))
        pieces = cut_up(codec, text, 40, 12)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


@pytest.mark.parametrize("run", ["x" * 1_500, " " * 1_500, NEW_LETTER * 1_500, "日本語" * 500, "!" * 1_500])
def test_a_run_over_a_seam_joins_two_chunks_only(run):
    codec, e = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), reference_encoding()
    rng = random.Random(11)
    text = " ".join(rng.choice(["some", "words", "don't", "12", "naïve", "日本", f"a{NEW_LETTER}a"]) for _ in range(70_000))
    for seam in (1, 4):
        at = seam * bpe.CHUNK - 200
        whole = text[:at] + run + text[at:]
        pieces = cut_up(codec, whole, bpe.CHUNK, bpe.OVERLAP)
        assert len(pieces) == len(bpe.chunk_spans(len(whole), bpe.CHUNK, bpe.OVERLAP)) - 1
        assert [i for p in pieces for i in codec.encode(p)] == e.encode_ordinary(whole)


def test_long_blank_runs():
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for text in ("a" + " " * 60_000 + "b", "a" + " " * 25_000 + f"a{NEW_LETTER}a", "\n" * 30_000, f"{NEW_LETTER}'s" + "\t\u3000" * 12_000 + "\x1c's", "\r\n" * 20_000 + "'re " + " " * 20_000):
        assert codec.decode(codec.encode(text)) == text.encode()
        assert codec.encode(text) == reference_encoding().encode_ordinary(text)
    assert codec.decode(codec.encode(" " * 1_000_000)) == b" " * 1_000_000


# 3 -------------------------------------------------------------------------------------------------------------------


def optimum(items, capacity):
    items = sorted(items, reverse=True)

    def fits(i, rooms):
        if i == len(items):
            return True
        return any(fits(i + 1, tuple(sorted([*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]]))) for j in {rooms.index(r) for r in rooms if r >= items[i]})

    return next(n for n in range(len(items) + 1) if fits(0, (capacity,) * n))


def test_bin_completion_is_optimal():
    rng = random.Random(3)
    for _ in range(120):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity if rng.random() < 0.3 else capacity // 2) for _ in range(rng.randrange(11))]
        counts = collections.Counter(items)
        plan = packing.bin_completion(counts, capacity)
        used = collections.Counter()
        for filling, times in plan:
            assert sum(x * k for x, k in filling) <= capacity
            for x, k in filling:
                used[x] += k * times
        best = optimum(items, capacity)
        assert used == counts and sum(n for _, n in plan) == best >= packing.lower_bound(counts, capacity)


def packed(counts, capacity=2048):
    plan, used = packing.bin_completion(counts, capacity), collections.Counter()
    for filling, times in plan:
        assert sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            used[x] += k * times
    assert used == counts
    return sum(n for _, n in plan), sum(n for _, n in packing.best_fit(counts, capacity)), packing.lower_bound(counts, capacity)


def test_many_lengths():
    """Hundreds of lengths: never worse than best fit, and near the bound."""
    rng = random.Random(12)
    n, fit, bound = packed(collections.Counter(rng.randint(1, 2048) for _ in range(20_000)))
    assert bound <= n <= fit and n <= 1.002 * bound
    n, fit, bound = packed(collections.Counter(rng.randint(400, 900) for _ in range(5_000)))
    assert bound <= n < fit  # best fit wastes much here
    pieces = []
    for _ in range(400):  # sequences that are filled up, cut in three: the optimum is known
        a, b = sorted(rng.sample(range(200, 1_800), 2))
        pieces += [x for x in (a, b - a, 2048 - b) if x]
    counts = collections.Counter(pieces)
    n, fit, bound = packed(counts)
    assert len(counts) > 64 and 400 == bound <= n <= fit and n <= 402


def test_dominated_fillings():
    assert packing._dominates((7, 5), (5, 4, 3)) and not packing._dominates((5, 4, 3), (7, 5)) and packing._dominates((5,), ()) and not packing._dominates((5, 5), (6,))
    counts = np.bincount([10, 6, 4, 3, 3, 2], minlength=21)
    assert packing.fillings(counts, 10, 20, 20)[0] == (6, 4)


def test_packing(spark):
    got = packing.pack_documents(awkward(spark), capacity=64).collect()
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = collections.Counter()
    for i, text in texts(spark):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, n, a, b - a, zlib.crc32(bpe.to_bytes(ids[a:b])))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for _, members in groups(got, "sequence_id").items():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_documents(empty(spark)).count() == 0


def groups(found, column):
    out = collections.defaultdict(list)
    for r in found:
        out[r[column]].append(r)
    return out


# 4 -------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints(spark):
    assert [f"{r['fp'] % 2**64:016x}" for r in simhash.fingerprints(awkward(spark)).collect()] == [f"{brute_fingerprint(t):016x}" for _, t in texts(spark)]


def test_golay_keys_meet():
    own, near = simhash.golay_keys()
    rng = np.random.default_rng(4)
    for v in rng.integers(0, 1 << 16, 300):
        for bit in range(16):
            assert own[v ^ (1 << bit)] in near[v]


@pytest.mark.parametrize("hot", [256, 2])
def test_links_and_components(spark, hot):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {0}
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    links = {(r["a"], r["b"]) for r in simhash.links(nodes, hot).collect()}
    if hot > 2:
        assert links == {(j, i) for i, j in edges}
    assert links <= {(j, i) for i, j in edges}
    found = {r["node"]: r["component"] for r in components.components(simhash.links(nodes, hot)).collect()}
    want = brute_components(range(len(fps)), edges)
    assert {n: found.get(n, n) for n in want} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (7, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward(spark)).collect())
    t = texts(spark)
    fps = {n: brute_fingerprint(x) for n, (_, x) in enumerate(t)}
    want = brute_components(range(len(t)), [(i, j) for i in fps for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    least = {c: min(t[n][0] for n in want if want[n] == c and t[n][0] is not None) for c in set(want.values())}
    assert got == collections.Counter((t[n][0], f"{fps[n]:016x}", least[want[n]]) for n in want)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def five(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def soft_keys(texts_of):
    """Home keys and all keys of each text."""
    home, every = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in texts_of.items():
        code = simhash.soft_codes(simhash.soft_margins(t)[None, :])[0].reshape(-1, 2)
        for chosen in itertools.combinations(range(5), 3):
            for second in (None, *chosen):
                key = (chosen, tuple(int(code[s][int(s == second)]) for s in chosen))
                every[i].add(key)
                if second is None:
                    home[i].add(key)
    return home, every


def linked_components(texts_of):
    home, every = soft_keys(texts_of)
    sets, ids = {i: five(t) for i, t in texts_of.items()}, sorted(texts_of)
    pairs = [(a, b) for a in ids for b in ids if a < b and similarity(sets[a], sets[b]) >= 0.8]
    return brute_components(ids, [(a, b) for a, b in pairs if sets[a] == sets[b] or home[a] & every[b] or home[b] & every[a]]), brute_components(ids, pairs), pairs


def edited(rng, lengths, groups, copies, edits):
    made = []
    for _ in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice(lengths))]
        for _ in range(copies):
            copy = list(words)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            made.append(" ".join(copy))
    rng.shuffle(made)
    return made


def test_soft_codes_are_the_nearest_words():
    rng = np.random.default_rng(13)
    margins = rng.integers(-9, 10, (20, 115))
    words = simhash.codewords()
    signs = np.array([[1 if w >> b & 1 else -1 for b in range(23)] for w in words])
    assert len(set(words.tolist())) == 4096 and min(bin(int(w)).count("1") for w in words[1:]) == 7
    for row, codes in zip(margins, simhash.soft_codes(margins), strict=True):
        for i in range(5):
            like = signs @ row[23 * i : 23 * i + 23]
            assert like[codes[2 * i]] == like.max() and like[codes[2 * i + 1]] == np.sort(like)[-2]


@pytest.mark.parametrize("centres", [4])
def test_similar_groups(spark, monkeypatch, centres):
    monkeypatch.setattr(simhash, "CENTRES", centres)
    monkeypatch.setattr(simhash, "CENTRE_PAIRS", 3)
    made = edited(random.Random(8), [60, 150, 400], 12, 6, [0, 1, 1, 3, 8])
    docs = spark.createDataFrame([doc(1000 + n * 7 % 997, t) for n, t in enumerate(made)] + [doc(5, ""), doc(4, None)], SCHEMA)
    texts_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, truly, _ = linked_components(texts_of)
    got = {r["node"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == {i: want[i] for i in got} and {want[i] for i in texts_of} == set(got.values())
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert len(set(want.values())) <= 1.02 * len(set(truly.values()))
    assert simhash.keep_one(empty(spark)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(awkward(spark)).collect()).count(5) <= 1


def test_similar_groups_of_one_crowded_key(spark):
    """Texts that share almost all of their distinct words, and so their keys, but fall into groups by other passages."""
    rng, common = random.Random(5), [f"c{i}" for i in range(400)]
    made = []
    for g in range(8):
        order = rng.sample(common, len(common))
        for _ in range(12):
            copy = list(order)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                copy[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            made.append(" ".join(copy))
    texts_of = dict(enumerate(made))
    home, _ = soft_keys(texts_of)
    assert max(collections.Counter(k for ks in home.values() for k in ks).values()) > 40
    got = {r["node"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([doc(i, t) for i, t in texts_of.items()], SCHEMA)).collect()}
    want, truly, _ = linked_components(texts_of)
    assert got == {i: want[i] for i in got} and len(set(truly.values())) == len(set(got.values())) == 8


def test_a_large_group_of_near_copies(spark):
    """Hundreds of copies of one text, each with its own edits; many are unlike most others, and some are near copies of those."""
    rng, made = random.Random(22), []
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        made.append(copy)
    for copy in made[:60]:
        copy = list(copy)
        copy[rng.randrange(150)] = "again"
        made.append(copy)
    texts_of = {i: " ".join(w) for i, w in enumerate(made)}
    _, truly, pairs = linked_components(texts_of)
    got = {r["node"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([doc(i, t) for i, t in texts_of.items()], SCHEMA)).collect()}
    least = {t: min(i for i in texts_of if texts_of[i] == t) for t in texts_of.values()}
    named = {i: got[least[t]] for i, t in texts_of.items()}
    assert sum(named[a] == named[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert all(truly[i] == truly[c] for i, c in named.items())
    assert len(set(named.values())) <= 1.1 * len(set(truly.values()))


def test_links_of_a_crowded_key_that_no_centre_has(spark, monkeypatch):
    """Copies of one text, each with its own near copy that is like it alone; keys are compared in parts."""
    monkeypatch.setattr(simhash, "PART_NODES", 16, raising=False)
    rng = random.Random(31)
    base = [f"w{i}" for i in range(150)]
    made = [base]
    for n in range(30):
        at = rng.sample(range(5, 145, 7), 5)
        parent, child = list(base), list(base)
        for k, i in enumerate(at):
            child[i] = f"x{n}-{k}"
            if k < 3:
                parent[i] = child[i]
        made += [parent, child]
    texts_of = {i: " ".join(w) for i, w in enumerate(made)}
    home, _ = soft_keys(texts_of)
    assert max(collections.Counter(k for ks in home.values() for k in ks).values()) > 12
    want, _, pairs = linked_components(texts_of)
    assert len(pairs) >= 60 and collections.Counter(want.values())[0] > 50
    got = {r["node"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([doc(i, t) for i, t in texts_of.items()], SCHEMA)).collect()}
    assert got == want


def test_pairs_with_centres_grow_with_the_nodes(spark, monkeypatch):
    """A node of a crowd meets a fixed number of centres, however many keys it has and nodes they hold; tasks find the other links."""
    rng, base = random.Random(17), [f"w{i}" for i in range(150)]
    made = [base]
    for n in range(120):
        copy = list(base)
        for k, i in enumerate(rng.sample(range(150), rng.randrange(1, 9))):
            copy[i] = f"x{n}-{k}"
        made.append(copy)
    texts_of, rows, materialise = {i: " ".join(w) for i, w in enumerate(made)}, collections.Counter(), simhash.materialise

    def counted(df, name="table"):
        out = materialise(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    got = {r["node"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([doc(i, t) for i, t in texts_of.items()], SCHEMA)).collect()}
    assert got == linked_components(texts_of)[0]
    assert 100 < rows["pairs"] <= simhash.CENTRES * rows["nodes"]
    assert rows["blocks"] > 10 * rows["nodes"]


def test_linked_within():
    rng = np.random.default_rng(4)
    common = np.arange(40)
    sets = [np.unique(np.concatenate([rng.choice(common, 40 - e, replace=False), rng.integers(100, 10**6, e)])) for e in rng.integers(0, 9, 60)]
    sets[7] = np.array([], dtype=np.int64)
    node, home = rng.permutation(60), rng.random(60) < 0.6
    for component in (node, node % 11, node * 0):
        for part in (np.zeros(60, dtype=int), np.arange(60) % 2):
            got = simhash.linked_within(node, component, home, part, sets, 0.8)
            near = [(i, j) for i in range(60) for j in range(i) if similarity(set(sets[i]), set(sets[j])) >= 0.8 and len(sets[i]) and (home[i] or home[j]) and (part[i] != part[j] or not part.any())]
            known = [(int(node[i]), int(node[j])) for i in range(60) for j in range(60) if component[i] == component[j]]
            assert {tuple(sorted(p)) for p in got} <= {tuple(sorted((int(node[i]), int(node[j])))) for i, j in near}
            assert brute_components(range(60), known + got) == brute_components(range(60), known + [(int(node[i]), int(node[j])) for i, j in near])
            assert len(got) < max(1, len(set(component)))


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs alone, with no third copy to help: at a similarity of 0.8 to 0.9, nine in ten and more are found."""
    rng = random.Random(21)
    made = edited(rng, [100, 200, 300], 400, 2, [1, 2, 3, 4, 5])
    texts_of = dict(enumerate(made))
    sets = {i: five(t) for i, t in texts_of.items()}
    by_word = collections.defaultdict(set)
    for i, x in sets.items():
        for sh in x:
            by_word[sh].add(i)
    pairs = {tuple(sorted(p)) for members in by_word.values() for p in itertools.combinations(members, 2)}
    near = [(a, b) for a, b in pairs if 0.8 <= similarity(sets[a], sets[b]) < 0.9]
    got = {r["node"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([doc(i, t) for i, t in texts_of.items()], SCHEMA)).collect()}
    assert len(near) > 100 and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    assert all(similarity(sets[i], sets[c]) >= 0.8 for i, c in got.items())


# 5 -------------------------------------------------------------------------------------------------------------------


def test_hilbert_curve_is_a_path():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        index = sharding.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark):
    got = sharding.hilbert_shards(awkward(spark)).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(spark))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1 and set(sizes) <= set(range(8))
    for members in groups(got, "shard").values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    assert sharding.hilbert_shards(empty(spark)).count() == 0


def test_shards_are_runs_of_the_curve_and_prune(spark, sf_dir):
    sf_dir = Path(sf_dir).parent / "sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.hilbert_shards(docs).collect()
    raw = {r["doc_id"]: r for r in docs.collect()}
    cells = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], len((r["text"] or "").encode()) + 1) for r in raw.values()], "doc_id long, source string, lang string, size long")
    cells = cells.select("doc_id", sharding.category(F.col("source"), 10).alias("a"), sharding.category(F.col("lang"), 10).alias("b"), sharding.magnitude(F.col("size"), 10).alias("c")).collect()
    index = dict(zip([r["doc_id"] for r in cells], sharding.hilbert_index(np.array([[r["a"], r["b"], r["c"]] for r in cells]), 10).tolist(), strict=True))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(index.values()) and all(r["curve_index"] == index[r["doc_id"]] for r in got)
    held = {s: [raw[r["doc_id"]].asDict() for r in members] for s, members in groups(got, "shard").items()}

    def read(column, value):  # shards whose range of the column lets the value in, as file statistics would
        return sum(min(m[column] or "" for m in ms) <= value <= max(m[column] or "" for m in ms) and any((m[column] or "") == value for m in ms) for ms in held.values())

    for column in ("source", "lang"):
        values = {m[column] or "" for ms in held.values() for m in ms}
        assert np.mean([read(column, v) for v in values]) <= 0.6 * len(held)  # any equal deal that ignores the column lets each value into all


# 6 -------------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def secret_docs(spark):
    rng = random.Random(6)
    parts = ["token", "secret:", " = ", "API_KEY", "apikey='", "passWD=", '"', "abcdefgh1", "abc", "AKIA", "AKIAABCDEFGHIJKL", "0" * 31, "f" * 40, " ", "é😀", "\n", "=", "ſecret=abcdefghij", "password: token: abcdefghij"]
    made = [doc(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(150)]
    return awkward(spark).unionByName(spark.createDataFrame(made, SCHEMA))


def test_secrets(spark):
    docs = secret_docs(spark)
    got = collections.Counter((r["doc_id"], r["spans"], r["base_sha256"], r["n_assign"]) for r in secret_scan.digest_spans(secret_scan.secret_spans(docs)).collect())
    want = collections.Counter()
    for r in docs.collect():
        s = brute_spans(r["text"] or "")
        want[(r["doc_id"], s, hashlib.sha256(s.encode()).hexdigest(), s.count("assign:"))] += 1
    assert got == want
    assert secret_scan.secret_spans(empty(spark)).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    docs = secret_docs(spark)
    old = docs.filter("doc_id < 130")
    first = secret_scan.scan_ledger(old, None, secret_scan.RULES[:2]).persist()
    second = secret_scan.scan_ledger(docs, first).persist()
    seen = {bytes(r["blob"]) for r in first.collect()}
    for r in second.collect():
        assert r["scanned"] == (["hex@1"] if bytes(r["blob"]) in seen else ["assign@1", "access@1", "hex@1"])
    whole = first.unionByName(second)
    assert secret_scan.scan_ledger(docs, whole).count() == 0
    spans = secret_scan.digest_spans(secret_scan.secret_spans(docs, findings=secret_scan.findings_of(whole)))
    assert {(r["doc_id"], r["spans"]) for r in spans.collect()} == {(r["doc_id"], brute_spans(r["text"] or "")) for r in docs.collect()}


def test_a_stored_ledger_grows_by_what_is_new(spark, tmp_path):
    docs = secret_docs(spark)
    ledger = secret_scan.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.rows() is None
    ledger.update(docs.filter("doc_id < 130"), secret_scan.RULES[:2])
    before = ledger.rows().count()
    newer = [dataclasses.replace(r, version=2) if r.kind == "hex" else r for r in secret_scan.RULES]
    for rules in (secret_scan.RULES, newer):
        rows = ledger.update(docs, rules)
    blobs = len({(t or "") for _, t in [(r["doc_id"], r["text"]) for r in docs.collect()]})
    assert rows.count() == before + blobs + blobs  # hex@1 or all three for each blob, then hex@2 for each
    assert ledger.update(docs, newer).count() == rows.count()
    spans = secret_scan.digest_spans(secret_scan.secret_spans(docs, findings=secret_scan.findings_of(ledger.rows().filter("not array_contains(scanned, 'hex@2')"))))
    assert {(r["doc_id"], r["spans"]) for r in spans.collect()} == {(r["doc_id"], brute_spans(r["text"] or "")) for r in docs.collect()}


def test_redaction(spark):
    docs = secret_docs(spark)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = collections.Counter()
    for (i, t), n in before.items():
        clean, at = "", 0
        for s in [x.split(":") for x in brute_spans(t or "").split(",") if x]:
            a, b = int(s[1]), int(s[2])
            if a >= at:
                clean += t[at:a] + secret_scan.REDACTED
            at = max(at, b)
        want[(i, None if t is None else clean + t[at:])] += n
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


# 7 -------------------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, formatted string, _t string"


def chat(spark):
    nasty = [r"\### Assistant: </turn> ok", "&lt;&amp;<next>", "<turn:user>", "", None, "a\nb", "😀 é"]
    made = [(i % 5, i // 5, ["user", "assistant", "assistant", "system", None, "ro>le&"][i * 7 % 6], nasty[i % 7], "x", "y") for i in range(60)]
    return spark.createDataFrame([*made, made[3], (None, 1, "user", "hi", "", ""), (9, None, "assistant", "late", "", ""), (9, 2, "assistant", "x", "", "")], CHAT)


def test_chat_round_trip(spark):
    got = {r["conv_id"]: r for r in chat_format.digest_conversations(chat_format.format_conversations(chat(spark))).collect()}
    for conv, turns in groups(chat(spark).collect(), "conv_id").items():
        turns = sorted(((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "") for r in turns))
        all_text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(chat(spark).limit(0)).count() == 0


def test_chat_merges_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(df).first()["formatted"] == "<turn:user>a<next>b</turn><turn:assistant>c</turn>"


# 8 -------------------------------------------------------------------------------------------------------------------


def test_language_model(spark):
    made = [doc(i, " ".join(random.Random(i).choice(["the Cat", "sat", "on", "a mat", f"w{i % 9}"]) for _ in range(20))) for i in range(200, 260)]
    docs = awkward(spark).unionByName(spark.createDataFrame(made, SCHEMA))
    data = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(LOWER)), None]) for r in docs.collect()]

    def out(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2

    count, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in data:
        if not out(i):
            count.update(t)
            pairs.update(zip([0, *t], t, strict=False))
            triples.update(zip([0, *t], t, t[1:], strict=False))
    n, v, mu = sum(count.values()), len(count), (10.0, 3.0)

    def once(w):
        return (count[w] + 1) / (n + v + 1)

    def twice(h, w):
        return (pairs[h, w] + mu[0] * once(w)) / ((count[None] if h == 0 else count[h]) + mu[0])

    def thrice(g, h, w):
        return (triples[g, h, w] + mu[1] * twice(h, w)) / (pairs[g, h] + mu[1])

    def score(t):
        return math.log10(twice(0, t[0])) + sum(math.log10(thrice(g, h, w)) for g, h, w in zip([0, *t], t, t[1:], strict=False))

    want = sorted((str(i), out(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10(once(w)) for w in t), 8), round(score(t), 8)) for i, t in data)
    got = sorted((str(r[0]), *r[1:5], round(r[5], 8), round(r[6], 8)) for r in rows(language_model.score_documents(docs, mu)))
    assert got == want
    for g, h in ((0, "the"), ("the", "cat"), ("sat", "nowhere"), ("nowhere", "on")):  # distributions over known words and the unknown one
        assert abs(sum(thrice(g, h, w) for w in [*count, "unknown"]) - 1) < 1e-9
        assert abs(sum(twice(h, w) for w in [*count, "unknown"]) - 1) < 1e-9
    assert language_model.score_documents(empty(spark)).count() == 0


def test_buckets_and_blocks_change_nothing(spark, monkeypatch):
    docs = awkward(spark).unionByName(spark.createDataFrame([doc(i, f"{PROSE} number {i}") for i in range(300, 340)], SCHEMA)).coalesce(2)
    want = sorted((str(r[0]), *r[1:]) for r in rows(language_model.score_documents(docs)))
    monkeypatch.setattr(language_model, "BUCKET_CHARS", 1_000)
    got = sorted((str(r[0]), *r[1:]) for r in rows(language_model.score_documents(docs.repartition(7))))
    assert [(*r[:5], round(r[5], 8), round(r[6], 8)) for r in got] == [(*r[:5], round(r[5], 8), round(r[6], 8)) for r in want]


def test_language_model_beats_unigrams(spark, sf_dir):
    scored = [r for r in queries.op8_backoff_automaton(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)


# 9 -------------------------------------------------------------------------------------------------------------------


def brute_nearest(vectors, k=10):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], dtype=np.float64)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:k]
        yield ids[q], [(int(ids[j]), d[j]) for j in order]


def test_forest_recall(spark):
    rng = np.random.default_rng(9)
    vectors = [(int(i), rng.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]
    vectors += [(int(i), vectors[1][1]) for i in range(3000, 3600)]  # one hot vector
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, rank int, leaf string")
    got = groups(forest.nearest(df, sample_rows=800).collect(), "query_id")
    hits = total = 0
    for q, want in brute_nearest(vectors):
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r["vec_id"] for r in found}
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & {i for i, _ in want})
        total += len(want)
    assert hits / total >= 0.9


def test_forest_awkward_vectors(spark):
    data = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (200, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(rows(forest.nearest(df)))
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, math.sqrt(2)), (100, 1, 0, math.sqrt(2)), (100, 2, 1, math.sqrt(2))]
    assert forest.nearest(df.limit(0)).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = [
        ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/de", "example.com", "/de", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("ftp://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://planet/fr/", "planet", "/fr/", None, "allow"),
        ("http://x.org/free-porn/", "x.org", "/free-porn/", None, "block"),
        ("http://x.org/pornography", "x.org", "/pornography", None, "allow"),
        ("http://casino.org/poker?jackpot", "casino.org", "/poker", None, "block"),
        ("http://x.org/win/free-chat", "x.org", "/win/free-chat", None, "allow"),
        ("http://x.org/naked", "x.org", "/naked", None, "allow"),
        ("http://x.org/p%6Frn/", "x.org", "/p%6Frn/", None, "block"),
        ("http://casino.org/casino/casino", "casino.org", "/casino/casino", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_url_terms_by_brute_force(spark):
    rng = random.Random(14)
    terms = [*url_filter.STRICT, *url_filter.SOFT]
    assert len(terms) > 200 and len(set(terms)) == len(terms) and len(set(url_filter.SOFT.values())) > 2
    parts = [*rng.sample(terms, 40), "xx", "sexual", "win", "naked", "PoKer", "é", "%73ex", "%C3%A9", "a", "1"]
    urls = ["http://h.org/" + "".join(rng.choice(parts) + rng.choice(["", "-", "/", ".", "_", "?", "9"]) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    got = {r["page_id"]: r for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    blocked = 0
    for i, u in enumerate(urls):
        text = urllib.parse.unquote(u).translate(LOWER)
        there = {t for t in terms if any(not text[m.start() - 1].isalnum() and not text[m.start() + len(t) : m.start() + len(t) + 1].isalnum() for m in re.finditer(f"(?={re.escape(t)})", text))}
        strict, soft = there & set(url_filter.STRICT), there & set(url_filter.SOFT)
        weight = sum(url_filter.SOFT[t] for t in soft)
        verdict = "block" if strict or (len(soft) >= 2 and weight >= 4) else "allow"
        assert (got[i]["n_strict"], got[i]["n_soft"], got[i]["soft_weight"], got[i]["verdict"]) == (len(strict), len(soft), weight, verdict), u
        blocked += verdict == "block"
    assert 50 < blocked < 550


# very long texts, and many of everything --------------------------------------------------------------------------------


def test_one_very_long_text(spark):
    """Two megabytes of text with a secret at its end, beside short ones: whole texts count everywhere."""
    words = [f"w{i % 977}x{i % 31}" for i in range(200_000)]
    long = " ".join(words) + ' token="abcdefgh12345"\n' + "é" * 70_000 + " " * 30_000 + "end"
    docs = spark.createDataFrame([doc(1, long), doc(2, PROSE), doc(3, long)], SCHEMA)
    q = {r["doc_id"]: r for r in fertility.quality(docs).collect()}
    assert q[1]["n_words"] == len(WORD.findall(long)) and q[1][1:] == q[3][1:]
    e = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_documents(docs).collect()}
    assert got[1] == got[3] and e.decode(np.frombuffer(got[1], "<u4").tolist()) == long.encode()
    assert got[1] == bpe.to_bytes(reference_encoding().encode_ordinary(long))
    pieces = packing.pack_documents(docs).collect()
    ends = {i: max(r["start"] + r["length"] for r in pieces if r["doc_id"] == i) for i in (1, 2, 3)}
    assert ends[1] == ends[3] == len(bpe.codec(public_tokenizers.path("byte_bpe_50k.json")).encode(long)) + 1
    same = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert same[3]["component_id"] == 1 and same[1]["fingerprint"] == f"{brute_fingerprint(long):016x}"
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.digest_spans(secret_scan.secret_spans(docs)).collect()}
    assert spans[1] == spans[3] == brute_spans(long) and spans[1].startswith("assign:")
    scored = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    assert scored[1]["n_tokens"] == len(WORD.findall(long)) + 1 and scored[1]["score"] == scored[3]["score"]


def test_many_secrets_in_one_text(spark):
    text = "\n".join(f"token = value{i:08d}" for i in range(3_000))
    docs = spark.createDataFrame([doc(1, text)], SCHEMA)
    assert secret_scan.digest_spans(secret_scan.secret_spans(docs)).first()["spans"] == brute_spans(text)
    assert secret_scan.redact(docs).first()["text"] == "\n".join([secret_scan.REDACTED] * 3_000)


def test_a_long_conversation(spark):
    made = [(1, i, "user" if i % 3 else "assistant", f"turn {i} <next>") for i in range(2_000)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    r = chat_format.digest_conversations(chat_format.format_conversations(df)).first()
    assert r["n_turns"] == 2_000 and r["turns_sha256"] == hashlib.sha256("".join(f"{b}\n{t}\n" for _, _, b, t in made).encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256("".join(t for _, _, b, t in made if b == "assistant").encode()).hexdigest()
