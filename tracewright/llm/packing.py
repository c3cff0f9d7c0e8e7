"""Best-fit packing: a configuration linear program over the length histogram.

The histogram of piece lengths has at most `capacity` rows whatever the corpus holds, so the program
over it is solved on the driver: multiplicative weights keep a price per length, a knapsack dynamic
program finds the dearest configurations at these prices, and the fractional numbers of configurations
are rounded. What rounding leaves is packed best fit, longest first, also by histogram. The plan (at
most a few thousand configurations, never a row per piece) goes back to the executors, where each piece
finds its place from its rank among the pieces of its length.

Defined results: a null or empty text is one piece that holds the closing id alone; repeated rows are
pieces of their own; words are known by a keyed hash and their bytes, so different ones never share ids;
a long text is tokenised step by step, so only a word without a blank is held whole; an
empty table gives no row; other columns of the input are left out.
"""

from __future__ import annotations

import re
import secrets
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_keys, keyed_hashes, read, same_bytes, staged, steps, word_spans

CAPACITY = 2048
CLOSING_ID = 0
#: Bytes in which a Python worker remembers the ids of words; words beyond them are encoded in each step anew.
REMEMBERED_BYTES = 20 << 20
#: Pieces that one part of a length holds or so, and parts at least, so that a length which a third of all pieces have is ranked by many tasks.
PART_PIECES, PARTS = 100_000, 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict[str, object] = {}


class _WordIds:
    """Ids of words as one array, and a place in it for each word's 64-bit hash, sorted. Words beyond the bound last for one step.

    A word takes the ids of one with its hash only if their bytes are the same.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.ends_part = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_part[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.keys = hash_keys(secrets.randbits(64))
        self.bytes, self.begin, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)  # of known words

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Words of Latin letters with ASCII marks behind are one or two parts, each closed by one end-of-word id, so all of them go in one call."""
        parts, simple, rest = [], [], []
        for i, word in enumerate(words):
            core = word.rstrip(_MARKS)
            if _LETTERS.fullmatch(core):
                simple.append((i, 1 + (len(core) < len(word))))
                parts.append(core)
                if len(core) < len(word):
                    parts.append(word[len(core) :])
            else:
                rest.append(i)
        out: list = [None] * len(words)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.ends_part[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the tokenizer does not close each word with one end-of-word id")
        part = start = 0
        for i, n in simple:
            part += n
            out[i] = ids[start : ends[part - 1]]
            start = ends[part - 1]
        for i, enc in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(enc.ids, dtype=np.uint32)
        return out

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a step, one after another, and where each row's begin."""
        start, end, rows = word_spans(data, at)
        kinds, sample, which = np.unique(self._hashes(data, start, end), return_index=True, return_inverse=True)
        length = (end - start).astype(np.int64)
        odd = np.flatnonzero(~same_bytes(data, start, data, start[sample[which]], length, length[sample[which]]))  # words whose hash another has
        place = np.searchsorted(self.known, kinds)
        old = place < len(self.known)
        old[old] = self.known[place[old]] == kinds[old]
        taken = old.copy()  # hashes that known words have
        old[old] = same_bytes(data, start[sample[old]], self.bytes, self.begin[place[old]].astype(np.int64), length[sample[old]], self.length[place[old]])
        first, size, ids = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64), self.ids
        first[old], size[old] = self.first[place[old]], self.size[place[old]]
        if not old.all() or len(odd):
            raw, new, fit = data.tobytes(), ~old, ~taken
            learnt = self._encode([raw[start[k] : end[k]].decode() for k in (*sample[new], *odd)])
            sizes = np.array([len(x) for x in learnt])
            place_of = len(ids) + np.cumsum(sizes) - sizes
            n = int(new.sum())
            size[new], first[new] = sizes[:n], place_of[:n]
            ids = np.concatenate([ids, *learnt])
            if self.known.nbytes * 3 + self.bytes.nbytes + ids.nbytes <= REMEMBERED_BYTES and fit.any():
                sizes_of = length[sample[fit]]
                begin = np.cumsum(sizes_of) - sizes_of
                own = data[np.repeat(start[sample[fit]] - begin, sizes_of) + np.arange(sizes_of.sum())]  # the bytes of the new words, one after another
                begin += len(self.bytes)
                both = ((self.known, kinds[fit]), (self.first, first[fit]), (self.size, size[fit]), (self.begin, begin), (self.length, sizes_of))
                self.known, self.first, self.size, self.begin, self.length = (np.insert(x, place[fit], y.astype(x.dtype)) for x, y in both)
                self.bytes = np.concatenate([self.bytes, own])
                self.ids = ids
            which = which.copy()
            which[odd] = len(kinds) + np.arange(len(odd))
            size, first = np.concatenate([size, sizes[n:]]), np.concatenate([first, place_of[n:]])
        size, first = size[which], first[which]
        until = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(first - until[:-1], size) + np.arange(until[-1])], until[rows]

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return keyed_hashes(data, start, end, self.keys)


#: ASCII marks but the apostrophe, which can begin a part of its own; letters that lower-case one to one and are composed already.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _word_ids(path: str) -> _WordIds:
    """One memory per Python worker and tokenizer file."""
    if path not in _tokenizers:
        _tokenizers[path] = _WordIds(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of `capacity`: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _word_ids(tokenizer_path)
        held, done = np.zeros(0, np.uint32), 0  # of a document that goes on: its ids not cut yet, and how many are
        for batch, data, at, more in steps(batches, "text"):
            ids, first = memory.of(data, at)
            rows = []
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.concatenate([held, ids[first[row] : first[row + 1]], *([] if more else [[CLOSING_ID]])]).astype("<u4")
                whole = len(own) // capacity * capacity if more else len(own)
                for start in range(0, whole, capacity):
                    part = own[start : start + capacity]
                    rows.append((doc_id, (done + start) // capacity, done + start, len(part), zlib.crc32(part.tobytes())))
                held, done = (own[whole:], done + whole) if more else (held[:0], 0)
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the most value that fits into each room from 0 to capacity."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        k = np.searchsorted(lengths, room, side="right")
        best[room] = max(best[room - 1], (value[:k] + best[room - lengths[:k]]).max()) if k else best[room - 1]
    return best


def _column(lengths: np.ndarray, value: np.ndarray, counts: np.ndarray, best: np.ndarray, capacity: int, first: int) -> Counter:
    """The dearest configuration that holds the length at index `first`, using no length more often than it occurs."""
    used: Counter = Counter({first: 1})
    room, left = capacity - int(lengths[first]), value.copy()
    if counts[first] <= 1:
        left[first] = -np.inf
    while room >= lengths[0]:
        k = np.searchsorted(lengths, room, side="right")
        worth = left[:k] + best[room - lengths[:k]]
        i = int(worth.argmax())
        if worth[i] <= 0:
            break
        used[i] += 1
        room -= int(lengths[i])
        if used[i] >= counts[i]:
            left[i] = -np.inf
    return used


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 120, width: int = 12, step: float = 0.25, steepness: float = 6.0) -> list[tuple[float, Counter]]:
    """Fractional numbers of configurations that cover the histogram, by multiplicative weights.

    A length's weight falls exponentially with the share of its pieces that is covered. Each round prices
    all rooms once and takes `width` columns, one for each of the least covered lengths.
    """
    found: dict[frozenset, float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        open_ = covered < 1
        if not open_.any():
            break
        value = lengths * np.exp(-steepness * covered) * open_
        best = _price(lengths, value, capacity)
        need = np.argsort(covered - 1e-6 * lengths / capacity, kind="stable")
        for i in need[:width]:
            if covered[i] >= 1:
                continue
            column = _column(lengths, value, counts, best, capacity, int(i))
            items = np.array(list(column)), np.array(list(column.values()))
            amount = step * (counts[items[0]] / items[1]).min()
            found[frozenset(column.items())] += amount
            covered[items[0]] += amount * items[1] / counts[items[0]]
    return [(x, Counter(dict(c))) for c, x in found.items()]


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """Best fit, longest first, over a histogram: bins with the same contents are one entry."""
    done: Counter = Counter()
    room_of: dict[int, Counter] = defaultdict(Counter)  # free room -> contents -> bins
    for length in sorted(left, reverse=True):
        m = left[length]
        while m > 0:
            rooms = [r for r, bins in room_of.items() if r >= length and bins]
            if rooms:
                room = min(rooms)
                contents, bins = next(iter(room_of[room].items()))
            else:
                room, contents, bins = capacity, (), m
            each = min(m, room // length)
            take = min(bins, m // each)
            if room < capacity:
                room_of[room][contents] -= take
                room_of[room] += Counter()
            new = tuple(sorted((Counter(dict(contents)) + Counter({length: each})).items()))
            room_of[room - each * length][new] += take
            m -= take * each
    for bins in room_of.values():
        done.update(bins)
    return [(n, Counter(dict(c))) for c, n in done.items()]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 120) -> list[tuple[int, Counter]]:
    """Configurations and how often each is used: the program's numbers rounded down or, where a full one still fits, up; the rest best fit."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    columns = sorted(configuration_program(lengths, counts, capacity, rounds), key=lambda c: (-c[0], sorted(c[1].items())))
    plans = []
    for up in (False, True):
        rest, plan = counts.copy(), []
        for x, column in columns:
            i, m = np.array(list(column)), np.array(list(column.values()))
            full = int((lengths[i] * m).sum()) == capacity
            n = min(int(np.ceil(x) if up and full else np.floor(x + 1e-9)), int((rest[i] // m).min()))
            if n > 0:
                rest[i] -= n * m
                plan.append((n, Counter({int(lengths[k]): v for k, v in column.items()})))
        plans.append(plan + best_fit({int(k): int(v) for k, v in zip(lengths, rest) if v}, capacity))
    return min(plans, key=lambda plan: sum(n for n, _ in plan))


def _places(plan: list[tuple[int, Counter]]) -> dict[str, np.ndarray]:
    """A row for each configuration and length: from which rank of that length on it takes pieces, and where they stand."""
    taken: Counter = Counter()
    sequence, rows = 0, []
    for n, column in plan:
        offset = 0
        for length, times in sorted(column.items(), reverse=True):
            rows.append((length, taken[length], sequence, times, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "times", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 120) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must give the same rows each time they are read (staged)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(pack_histogram(histogram, capacity, rounds))
    n = max(PARTS, -(-max(histogram.values(), default=0) // PART_PIECES))
    parts = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    before = parts.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = int(places["rank"].max(initial=0)) + 1
        keys = places["length"].astype(object) * base + places["rank"] if base * (capacity + 1) >= 1 << 62 else places["length"] * base + places["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(keys, length * base + np.minimum(rank, base - 1), side="right") - 1
            nth = rank - places["rank"][k]
            sequence = places["sequence"][k] + nth // places["times"][k]
            offset = places["offset"][k] + nth % places["times"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ordered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return ordered.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
