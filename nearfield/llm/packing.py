"""Best-fit packing: bin completion by branch and bound over the histogram of lengths.

A corpus has as many pieces as it likes, but at most `capacity` different lengths. The search works on their counts, so its
input has at most `capacity` rows at every scale, and a filling is chosen for as many sequences at once as the counts allow.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.bpe import codec, to_bytes
from nearfield.llm.common import map_rows, text_or_empty
from nearfield.storage import global_rank, materialise

CAPACITY = 2048
#: Nodes of the search, and how often on the way best fit is tried on what is left.
NODES, PROBE = 8_000, 16
#: Fillings kept at one node, and steps of their enumeration.
KEEP, STEPS = 8, 800

#: A filling: lengths with how many of each, longest first; and a plan: fillings with how many sequences use each.
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def best_fit(counts: Mapping[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, on groups of sequences that are filled alike."""
    groups: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if not n:
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((filling, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                room, filling, n = capacity, (), -(-left // (capacity // length))
            else:
                room = rooms[at]
                filling, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            put(room - each * length, (*filling, (length, each)), full)
            left, n = left - full * each, n - full
            if n and left and left < each:  # the last one gets what is left
                put(room - left * length, (*filling, (length, left)), 1)
                left, n = 0, n - 1
            if filling:
                put(room, filling, n)
    return [x for room in rooms for x in groups[room]]


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by the long pieces that can't share one, with the short ones
    that don't fit beside them, for every threshold between short and long."""
    lengths = np.array(sorted(x for x, n in counts.items() if n), dtype=np.int64)
    if not len(lengths):
        return 0
    n = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    number, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lengths * n)])
    middle = int(np.searchsorted(lengths, capacity // 2, side="right"))
    short = np.arange(middle + 1)  # how many lengths are too short to count
    least = np.where(short < middle, lengths[np.minimum(short, len(lengths) - 1)], capacity // 2 + 1)
    long = np.maximum(middle, np.searchsorted(lengths, capacity - least, side="right"))
    alone, half = number[-1] - number[long], number[long] - number[middle]
    room = half * capacity - (volume[long] - volume[middle])
    over = volume[middle] - volume[short] - room
    return int(max(-(-int(volume[-1]) // capacity), int((alone + half + np.maximum(0, -(-over // capacity))).max())))


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b, longest first, each find a place in the room that the pieces of a take.

    Tried by best fit, so a yes is sure and a no may leave a branch that wasn't needed.
    """
    rooms = sorted(a)
    if sum(rooms) < sum(b):
        return False
    for x in b:
        at = bisect_left(rooms, x)
        if at == len(rooms):
            return False
        insort(rooms, rooms.pop(at) - x)
    return True


def fillings(counts: np.ndarray, largest: int, capacity: int, most_waste: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill up a sequence that begins with the largest piece, least waste first.

    counts[x] is the number of pieces of length x left. Each further piece is first the longest that fits; fillings that depart from that
    once come next, then those that do twice, and so on, until KEEP of them waste nothing, STEPS are done or none is
    left. Only fillings that waste at most most_waste are kept, KEEP at most.
    """
    cap = capacity - largest
    left = counts[: cap + 1].copy()
    if largest <= cap:
        left[largest] -= 1
    rising = np.flatnonzero(left).tolist()
    number = {x: int(left[x]) for x in rising}
    found: dict[tuple[int, ...], int] = {}
    steps, whole = STEPS, 0

    def extend(room: int, most: int, chosen: tuple[int, ...], departures: int) -> bool:
        """Whether any path used up its departures."""
        nonlocal steps, whole
        steps -= 1
        fits = ended = False
        for j in range(bisect_right(rising, min(room, most)) - 1, -1, -1):
            x = rising[j]
            if not number[x]:
                continue
            if fits and not departures:
                break
            if steps <= 0 or whole >= KEEP:
                return True
            number[x] -= 1
            ended |= extend(room - x, x, (*chosen, x), departures - fits)
            number[x] += 1
            fits = True
        if fits or departures:
            return ended
        if room <= most_waste and chosen not in found:
            if not any(x <= room and number[x] for x in rising[: bisect_right(rising, room)]):
                found[chosen] = room
                whole += not room
        return True

    departures = 0
    while extend(cap, cap, (), departures) and steps > 0 and whole < KEEP:
        departures += 1
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f))):
        if not any(_dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == KEEP:
            break
    return kept


def _branches(left: np.ndarray, capacity: int, spare: int) -> Iterator[tuple[Filling, int]]:
    """Fillings around the largest piece left, tightest first, each for as many sequences as it goes and then for one."""
    largest, made = int(np.flatnonzero(left)[-1]), []
    for f in fillings(left, largest, capacity, spare):
        whole = (largest, *f)
        filling: Filling = tuple((x, whole.count(x)) for x in sorted(set(whole), reverse=True))
        most = min(int(left[x]) // k for x, k in filling)
        lost = capacity - sum(whole)
        if lost:
            most = min(most, spare // lost)
        made += [(filling, times) for times in dict.fromkeys((most, 1)) if times]
    return iter(made)


def bin_completion(counts: Mapping[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Pack a histogram {length: count} of pieces of at most capacity into as few sequences as `nodes` nodes can show.

    Each node completes sequences around the largest piece left, with undominated fillings in order of waste. A branch ends
    when its waste exceeds what one sequence fewer than the incumbent allows, or where it meets a state that was seen with as few
    sequences. Best fit gives the first incumbent and, on the way down, others; the search stops at the lower bound. The result is
    never worse than best fit. The rules are the same for all histograms.
    """
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    best = best_fit(counts, capacity)
    best_n, bound, total = sum(m for _, m in best), lower_bound(counts, capacity), sum(x * n for x, n in counts.items())
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in counts.items():
        left[x] = n

    def rest() -> dict[int, int]:
        return {int(x): int(left[x]) for x in np.flatnonzero(left)}

    def apply(filling: Filling, times: int) -> None:
        for x, k in filling:
            left[x] -= k * times

    plan: Plan = []
    frames: list[Iterator[tuple[Filling, int]]] = []
    used = waste = visited = 0
    seen: dict[bytes, int] = {}
    entering = True
    while best_n > bound and visited < nodes:
        if entering:
            visited += 1
            entering = False
            spare = (best_n - 1) * capacity - total - waste
            remains = rest()
            if not remains:
                if used < best_n:
                    best, best_n = list(plan), used
                frames.append(iter(()))
                continue
            state = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
            if spare < 0 or used + lower_bound(remains, capacity) >= best_n or seen.get(state, used + 1) <= used:
                frames.append(iter(()))
                continue
            seen[state] = used
            if visited % PROBE == 1:
                tail = best_fit(remains, capacity)
                if (n := used + sum(m for _, m in tail)) < best_n:
                    best, best_n = [*plan, *tail], n
                    spare = (best_n - 1) * capacity - total - waste
            frames.append(_branches(left, capacity, spare))
        if not frames:
            break
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            if plan and len(plan) > len(frames) - 1 and frames:
                filling, times = plan.pop()
                apply(filling, -times)
                used, waste = used - times, waste - times * (capacity - sum(x * k for x, k in filling))
            continue
        filling, times = step
        apply(filling, times)
        plan.append(step)
        used, waste = used + times, waste + times * (capacity - sum(x * k for x, k in filling))
        entering = True
    return best


def tokenise_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids: each text's ids and end_id, cut into pieces of capacity if longer.

    The first piece of a cut document takes the odd rest. Null and empty texts are the end id alone; repeated rows give
    repeated pieces; an empty table gives no rows; other columns are ignored.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = vocabulary

    def make():
        bpe = codec(path)

        def cut(doc_id, text):
            ids = to_bytes([*bpe.encode(text), end_id])
            n = len(ids) // 4
            first = n % capacity or capacity
            ends = range(first, n + 1, capacity)
            starts = [0, *ends[:-1]]
            return doc_id, [{"piece": i, "start": a, "length": b - a, "ids": ids[4 * a : 4 * b]} for i, (a, b) in enumerate(zip(starts, ends, strict=True))]

        return cut

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_rows(docs.select("doc_id", text_or_empty().alias("text")), make, f"doc_id {kind}, pieces array<struct<piece:int,start:long,length:long,ids:binary>>")
    return rows.select("doc_id", F.inline("pieces"))


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """sequence_id and offset for pieces with `length` and `_nth`, a gapless number from 0 within each length.

    The plan becomes runs: for one length, the pieces from some number on take one place each in neighbouring sequences.
    There are as many runs as different pieces in the fillings, however many sequences there are.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, k in filling:
            for _ in range(k):
                runs.setdefault(length, []).append((used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    tables = {length: np.array(r, dtype=np.int64).T for length, r in runs.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        sequence_id, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        lengths, numbers = length.to_numpy(), nth.to_numpy()
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            first, seq, off = tables[int(x)]
            run = np.searchsorted(first, numbers[at], side="right") - 1
            sequence_id[at] = seq[run] + numbers[at] - first[run]
            offset[at] = off[run]
        return pd.DataFrame({"sequence_id": sequence_id, "offset": offset})

    found = pieces.withColumn("_nf_at", where(F.col("length"), F.col("_nth")))
    return found.withColumns({"sequence_id": F.col("_nf_at.sequence_id"), "offset": F.col("_nf_at.offset")}).drop("_nf_at", "_nth")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces (doc_id, piece, length, anything else) with sequence_id and offset.

    Two shuffle-light passes: a histogram of lengths goes to the driver (at most capacity rows), where the packing is
    decided; then pieces are numbered within their length and look up their place.
    """
    spark = pieces.sparkSession
    ranked = global_rank(pieces, ["length", F.xxhash64("doc_id", "piece"), "doc_id", "piece"], "_nf_rank")
    counts = {int(r[0]): int(r[1]) for r in ranked.groupBy("length").agg(F.count("*")).collect()}
    first, total = [], 0
    for length in sorted(counts):
        first.append((length, total))
        total += counts[length]
    starts = F.broadcast(spark.createDataFrame(first, "length long, _nf_first long"))  # at most capacity rows
    numbered = ranked.join(starts, "length").withColumn("_nth", F.col("_nf_rank") - F.col("_nf_first")).drop("_nf_rank", "_nf_first")
    return place(numbered, bin_completion(counts, capacity, nodes))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row for each piece."""
    pieces = tokenise_pieces(docs, vocabulary, capacity)
    narrow = materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(narrow, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
