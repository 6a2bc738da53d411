"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised to levels that grow geometrically; an n-gram of level q is entered into one
Bloom filter q times, with the numbers 1 to q. A reader probes for 1, 2, .. until one is missing and so finds
the level, never too low and too high with the filter's small rate of false positives. Every worker holds
the filter if that is small. A larger one stays in its segments, each in a task of its own: the n-grams of the
texts are sent there, and their levels come back to the texts. A word's probability interpolates orders: with c(h) the count of the history, c(hw) that of
history and word, and m(h) = ``BREADTH`` * c(h) ^ ``POWER`` + 1,

    P(w | h) = (c(hw) + m(h) P(w | shorter h)) / (c(h) + m(h)),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

all of it counts read from the filter, each held to at most those of its own parts.

Beside it stands a base score from exact counts. Words that make up at least one in ``FREQUENT`` of all are
at most that many, so their counts are sent along; the others are rare, hence in no part of the data hot, and
are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import id_remainder, map_columns, mixed, stored

ORDER = 2
BREADTH, POWER = 2.0, 0.9
#: Size of the filter: bits and hash functions per entry (about 0.4 % false positives), and bits of a filter
#: that is sent to every worker. A larger one is probed where its segments lie, of so many bits at most.
ENTRY_BITS, HASHES = 12, 6
MAX_BITS = 1 << 30
SEGMENT_BITS = 1 << 23
#: A word with at least this share of all tokens, one in .., has its exact count sent to every worker.
FREQUENT = 1 << 22
#: Parts of the filter that are made apart; bytes of text per bucket of n-grams.
SEGMENTS = 1024
BUCKET_BYTES = 1 << 22
MAX_TASKS = 1 << 16
#: Bytes of text whose n-grams look up levels together, that ask one segment in a task, and that are scored in one.
CHUNK_BYTES, ASKING_BYTES, SCORED_BYTES = 1 << 22, 1 << 23, 1 << 24
#: Tokens that are looked at at a time, and characters of a text that are split at a time.
_TOGETHER, _SLICE = 1 << 19, 1 << 22

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# no word holds a blank
_START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))


def level_floors() -> np.ndarray:
    """The least count of each level from 1 on: 1, 2, 3, 4, 6, 8, 12, 16, 24, .."""
    powers = [1 << i for i in range(62)]
    return np.array(sorted({*powers, *(3 * p // 2 for p in powers[1:])}), dtype=np.int64)


_FLOORS = level_floors()
#: The middle of the counts of each level, 0 for level 0.
_COUNT_OF = np.concatenate(([0.0], (_FLOORS[:-1] + _FLOORS[1:] - 1) / 2))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_FLOORS, counts, side="right")


def pieces_of(text: str, order: int) -> Iterator[tuple[np.ndarray, int]]:
    """The hashes of a text's tokens, its words and an end, in pieces (hashes, skip): the first ``skip`` of a
    piece are the history of the others, the last tokens of the piece before or the start of the text."""
    history = np.array([_START], dtype=np.uint64)
    at = 0
    while True:
        stop = at + _SLICE
        # a piece ends before white space, so no word is cut
        while stop < len(text) and not (text[stop] == " " or "\t" <= text[stop] <= "\r"):
            stop += 1
        words = text[at:stop].encode("utf-8", "surrogatepass").translate(_LOWER).split()
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        last = stop >= len(text)
        codes = np.concatenate((history, codes, [_END])) if last else np.concatenate((history, codes))
        yield codes, len(history)
        if last:
            return
        at, history = stop, codes[max(0, len(codes) - max(1, order - 1)) :]


class Pieces:
    """Pieces of many texts, one after the other."""

    def __init__(self, pieces: list[tuple[np.ndarray, int]]):
        self.codes = np.concatenate([c for c, _ in pieces])
        sizes = np.array([len(c) for c, _ in pieces])
        self.piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.token = self.place >= np.repeat([s for _, s in pieces], sizes)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the ``n`` tokens that end at each place; only places from n - 1 on have one."""
        key = np.full(len(self.codes), n, dtype=np.uint64)
        for back in range(n - 1, -1, -1):
            before = self.codes if back == 0 else np.concatenate((np.zeros(back, np.uint64), self.codes[:-back]))
            key = mixed(key ^ before)
        return key


def parts_of(texts: Iterable[str | None], order: int) -> Iterator[tuple[int, list[int], list]]:
    """The pieces of texts, some hundred thousand tokens at a time: texts begun so far, text of each piece, pieces."""
    docs, held, size, number = [], [], 0, 0
    for text in texts:
        number += 1
        for piece in pieces_of(text or "", order):
            docs.append(number - 1)
            held.append(piece)
            size += len(piece[0])
            if size >= _TOGETHER:
                yield number, docs, held
                docs, held, size = [], [], 0
    if held:
        yield number, docs, held


def asked(flat: Pieces, order: int) -> np.ndarray:
    """The different n-grams of some pieces, sorted."""
    return np.unique(np.concatenate([flat.grams(n)[flat.place >= n - 1] for n in range(1, order + 1)]))


def _answered(keys: np.ndarray, levels: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda some: levels[np.searchsorted(keys, some)]


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _partial_counts(order: int, bits: int):
    """Counts of the n-grams of some texts, sorted, a row per bucket and order."""

    def counted(pieces: list) -> dict:
        flat = Pieces(pieces)
        out: dict[str, list] = {"bucket": [], "n": [], "keys": [], "counts": []}
        for n in range(1, order + 1):
            keys, counts = np.unique(flat.grams(n)[flat.token & (flat.place >= n - 1)], return_counts=True)
            bucket = _bucket_of(keys, bits)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                out["bucket"].append(int(bucket[start]))
                out["n"].append(n)
                out["keys"].append(keys[start:end].view(np.int64))
                out["counts"].append(counts[start:end].astype(np.int64))
        return out

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                for piece in pieces_of(text or "", order):
                    held.append(piece)
                    size += len(piece[0])
                    if size >= _TOGETHER:
                        yield counted(held)
                        held, size = [], 0
        if held:
            yield counted(held)

    return run


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _merge_bucket(order: int):
    """All counts of a bucket: a row per order, with the number of n-grams of each level."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "n": [], "keys": [], "counts": [], "total": [], "levels": []}
        orders = table["n"].to_numpy()
        for n in range(1, order + 1):
            rows = table.filter(pa.array(orders == n))
            if not len(rows):
                continue
            keys, counts = _summed(_lists(rows["keys"]).view(np.uint64), _lists(rows["counts"]))
            out["bucket"].append(table["bucket"][0].as_py())
            out["n"].append(n)
            out["keys"].append(keys.view(np.int64))
            out["counts"].append(counts)
            out["total"].append(int(counts.sum()))
            out["levels"].append(np.bincount(levels_of(counts)))
        return pa.table(
            [pa.array(out[name], type=kind) for name, kind in _MERGED_TYPES.items()], names=list(_MERGED_TYPES)
        )

    return run


_MERGED_TYPES = {
    "bucket": pa.int32(), "n": pa.int32(), "keys": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()),
    "total": pa.int64(), "levels": pa.list_(pa.int64()),
}
_MERGED = "bucket int, n int, keys array<bigint>, counts array<bigint>, total bigint, levels array<bigint>"


def ngram_counts(texts: DataFrame, order: int) -> DataFrame:
    """Counts of all n-grams up to ``order`` of ``texts`` (text), in buckets of bounded size."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    partial = map_columns(
        texts.select("text"), _partial_counts(order, bits), "bucket int, n int, keys array<bigint>, counts array<bigint>"
    )
    # as many tasks as buckets: a given number is not merged by adaptive execution
    dealt = partial.repartition(min(1 << bits, MAX_TASKS), "bucket")
    return stored(dealt.groupBy("bucket").applyInArrow(_merge_bucket(order), _MERGED), "ngrams")


class LogBloom:
    """The filter: ``segments`` parts of ``segment_bits`` bits, entries for levels from ``least`` to ``most``.

    ``bits`` is absent while only positions are wanted. A ``short`` filter knows keys by the 32 bits below those
    of their segment, which are what is sent to one: of 2**20 entries, two agree by chance in one of 4,000."""

    short = False

    def __init__(self, segments: int, segment_bits: int, least: int, most: int, bits: bytes | None = None):
        self.segments, self.segment_bits = segments, segment_bits
        self.least, self.most, self.bits = least, most, bits

    def shortened(self, keys: np.ndarray) -> np.ndarray:
        return (keys << np.uint64(self.segments.bit_length() - 1)) >> np.uint64(32)

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return _bucket_of(keys, self.segments.bit_length() - 1)

    def _walk(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and stride of the hashes of the entries (key, level)."""
        if self.short:
            keys = self.shortened(keys)
        start = mixed(keys ^ np.uint64(level * 0xC2B2AE3D27D4EB4F % 2**64))
        return start, mixed(start ^ np.uint64(0x165667B19E3779F9)) | np.uint64(1)

    def _bit(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.segment_bits)) >> np.uint64(32)

    def positions(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """The bit of each entry (key, level) within its segment, one hash function after the other."""
        start, stride = self._walk(keys, level)
        for _ in range(HASHES):
            yield self._bit(start)
            start = start + stride

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 where it has no entry: probes level by level until one is missing."""
        words = np.frombuffer(self.bits, dtype="<u8")
        base = self.segment(keys) * (self.segment_bits // 64)
        found = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        for level in range(self.least, self.most + 1):
            start, stride = self._walk(keys[left], level)
            for _ in range(HASHES):
                bit = self._bit(start)
                word = words[base[left] + (bit >> np.uint64(6)).astype(np.int64)]
                hit = (word >> (bit & np.uint64(63))) & np.uint64(1) == 1
                left, start, stride = left[hit], (start + stride)[hit], stride[hit]
            if not len(left):
                break
            found[left] = level
        return found


def filter_bits(levels: dict[tuple[int, int], int]) -> int:
    """Bits for all entries of so many n-grams of each (order, level)."""
    return ENTRY_BITS * sum(n * level for (_, level), n in levels.items())


def plan_filter(levels: dict[tuple[int, int], int], segments: int, max_bits: int | None = None) -> LogBloom:
    """The filter for so many n-grams of each (order, level): sizes follow from the number of entries.

    It holds all levels, unless ``max_bits`` asks for a smaller one without the lowest."""
    most = max((level for _, level in levels), default=0)
    least = 1
    while True:
        entries = sum(n * (level - least + 1) for (_, level), n in levels.items() if level >= least)
        if max_bits is None or entries * ENTRY_BITS <= max_bits or least > most:
            break
        least += 1
    segment_bits = 64 * max(1, math.ceil(entries * ENTRY_BITS / segments / 64))
    return LogBloom(segments, segment_bits, least, most)


def _fill(shape: LogBloom):
    """The bits of each segment that the n-grams of a task set: rows of sorted keys give runs of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, counts = (batch.column(name) for name in ("keys", "counts"))
            for row in range(len(batch)):
                _set_bits(
                    made, shape, keys[row].values.to_numpy().view(np.uint64), levels_of(counts[row].values.to_numpy())
                )
        for segment, words in made.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["segment", "bits"]
            )

    return run


def _set_bits(made: dict[int, np.ndarray], shape: LogBloom, keys: np.ndarray, level: np.ndarray) -> None:
    some, level = keys[level >= shape.least], level[level >= shape.least]
    if not len(some):
        return
    segment = shape.segment(some)
    first, last = int(segment[0]), int(segment[-1])
    flags = np.zeros((last - first + 1) * shape.segment_bits, dtype=bool)
    for q in range(shape.least, int(level.max()) + 1):
        at = (segment[level >= q] - first) * shape.segment_bits
        for bit in shape.positions(some[level >= q], q):
            flags[at + bit.astype(np.int64)] = True
    words = np.packbits(flags, bitorder="little").view("<u8").reshape(last - first + 1, -1)
    for i, own in enumerate(words):
        made[first + i] = made[first + i] | own if first + i in made else own.copy()


def _either(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b.as_buffer(), dtype="<u8") for b in table["bits"]])
    return pa.table([table["segment"].slice(0, 1), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])


class BloomLm:
    """What a worker needs to score texts: the filter, totals and the counts of frequent words."""

    def __init__(self, bloom: LogBloom, order: int, texts: int, tokens: int, types: int, frequent: pa.Table):
        self.bloom, self.order = bloom, order
        self.texts, self.tokens, self.types = texts, tokens, types
        keys = frequent["key"].to_numpy().view(np.uint64)
        by_key = np.argsort(keys)
        self.keys, self.counts = keys[by_key], frequent["count"].to_numpy()[by_key]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def exact(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words by their hashes, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.counts[at], 0), known

    def probabilities(self, flat: Pieces, words: np.ndarray, word: np.ndarray, levels: Callable) -> np.ndarray:
        """Of every token at its place; ``words`` are the different ones, ``word`` the one at each place,
        ``levels`` gives those of n-grams."""
        chance = shorter = None
        for n in range(1, self.order + 1):
            has = flat.place >= n - 1
            if n == 1:
                count = _COUNT_OF[levels(words)][word]
                count[flat.codes == _START] = self.texts
                count = np.minimum(count, max(self.tokens, self.texts))
                chance = np.minimum((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)), 1.0)
            else:
                keys, at = np.unique(flat.grams(n)[has], return_inverse=True)
                count = np.zeros(len(flat.codes))
                count[has] = _COUNT_OF[levels(keys)][at]
                history = np.concatenate(([0.0], shorter[:-1]))
                count = np.minimum(np.minimum(count, history), shorter)
                weight = BREADTH * history**POWER + 1
                chance = np.where(has, (count + weight * chance) / (history + weight), chance)
            shorter = count
        return chance

    def score_batch(self, texts: Iterable[str | None], answers: list[np.ndarray] | None = None) -> dict[str, list]:
        """Columns of all texts; ``answers`` are the levels of ``asked`` of each part, if the filter is elsewhere."""
        sums: list[list] = []  # n_tokens, n_known, base, score, rare words, times
        for i, (number, docs, held) in enumerate(parts_of(texts, self.order)):
            sums.extend([0, 0, 0.0, 0.0, [], []] for _ in range(number - len(sums)))
            flat = Pieces(held)
            levels = self.bloom.levels if answers is None else _answered(asked(flat, self.order), answers[i])
            self._add(docs, flat, sums, levels)
        names = ("n_tokens", "n_known", "base", "score", "rare", "times")
        return {name: [s[i] for s in sums] for i, name in enumerate(names)}

    def _add(self, docs: list[int], flat: Pieces, sums: list[list], levels: Callable) -> None:
        first = docs[0]
        doc = np.array(docs)[flat.piece] - first
        n = docs[-1] - first + 1
        words, at = np.unique(flat.grams(1), return_inverse=True)
        chance = np.log10(self.probabilities(flat, words, at, levels))[flat.token]
        doc, at = doc[flat.token], at[flat.token]
        counts, known = self.exact(words)
        known_here = known[at]
        adds = (
            np.bincount(doc, minlength=n),
            np.bincount(doc[known_here & (counts[at] > 0)], minlength=n),
            np.bincount(doc[known_here], weights=self.base(counts)[at][known_here], minlength=n),
            np.bincount(doc, weights=chance, minlength=n),
        )
        for k, values in enumerate(adds):
            for i, value in enumerate(values.tolist()):
                sums[first + i][k] += value
        pairs, times = np.unique(doc[~known_here] * np.int64(len(words)) + at[~known_here], return_counts=True)
        owner, word = np.divmod(pairs, max(1, len(words)))
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        rare = words.view(np.int64)[word]
        for start, end in zip(starts, [*starts[1:], len(owner)]):
            sums[first + int(owner[start])][4].extend(rare[start:end].tolist())
            sums[first + int(owner[start])][5].extend(times[start:end].tolist())


def learn_bloom_lm(
    texts: DataFrame, order: int = ORDER, max_bits: int = MAX_BITS
) -> tuple[BloomLm, DataFrame, DataFrame | None]:
    """The model of ``texts`` (text), the exact counts (key, count) of the words it does not hold, and its
    filter (segment, bits; more rows of a segment are parts of it) if that takes more than ``max_bits``.

    A null text is an empty one, which is a single end. The counts of all n-grams are kept as a table; what
    is collected is at most ``max_bits`` of filter and ``FREQUENT`` words.
    """
    spark = texts.sparkSession
    counts = ngram_counts(texts, order)
    number = texts.count()
    tokens, types = (
        counts.where("n = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    )
    # a row per order and level
    by_level = (
        counts.select("n", F.posexplode("levels").alias("level", "number"))
        .where("level > 0 AND number > 0")
        .groupBy("n", "level")
        .agg(F.sum("number").alias("number"))
        .collect()
    )
    buckets = counts.agg(F.max("bucket")).first()[0] or 0
    levels = {(r.n, r.level): r.number for r in by_level}
    needed = filter_bits(levels)
    split = needed > max_bits
    segments = 1 << int(buckets).bit_length()
    # a bucket is not spread over more segments than its own, so few parts of a segment are made
    segments = max(segments, 1 << math.ceil(math.log2(max(2, needed / SEGMENT_BITS)))) if split else min(SEGMENTS, segments)
    bloom = plan_filter(levels, segments)
    bloom.short = split
    parts = counts.select("keys", "counts").mapInArrow(_fill(bloom), "segment int, bits binary")
    if not split:
        whole = parts.groupBy("segment").applyInArrow(_either, "segment int, bits binary")
        size = bloom.segment_bits // 8
        bits = bytearray(segments * size)
        for row in whole.toLocalIterator():
            bits[row.segment * size : (row.segment + 1) * size] = row.bits
        bloom.bits = bytes(bits)

    words = counts.where("n = 1").select(F.explode(F.arrays_zip("keys", "counts")).alias("word")).select(
        F.col("word.keys").alias("key"), F.col("word.counts").alias("count")
    )
    often = F.col("count") * FREQUENT >= F.lit(int(tokens)).cast("decimal(38,0)")
    model = BloomLm(bloom, order, number, int(tokens), int(types), words.where(often).toArrow())
    return model, words.where(~often), parts if split else None


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk, some megabytes of text, and their place in it."""
    chunk, place, size = TaskContext.get().partitionId() << 33, 0, 0
    for batch in batches:
        chunks, places = [], []
        for length in pc.binary_length(batch.column("text")).fill_null(0).to_pylist():
            if size >= CHUNK_BYTES:
                chunk, place, size = chunk + 1, 0, 0
            chunks.append(chunk)
            places.append(place)
            place, size = place + 1, size + length + 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), *batch.columns],
            names=["chunk", "place", *batch.schema.names],
        )


_ASKS = "chunk bigint, first int, number int, part int, segment int"


def _ask(order: int, shape: LogBloom):
    """The n-grams of rows of a chunk that lie together (from place ``first`` on, ``number`` rows), a row per part
    of them and segment. Tasks may cut a chunk: both its runs of rows ask."""

    def asks(chunk: int, first: int, texts: list[pa.StringScalar]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, held) in enumerate(parts_of((t.as_py() for t in texts), order)):
            keys = asked(Pieces(held), order)
            segment = shape.segment(keys)
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            n = len(starts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(starts, len(keys)), pa.int32()),
                pa.array(shape.shortened(keys).astype(np.uint32).view(np.int32)),
            )
            same = (np.full(n, chunk), *(np.full(n, v, np.int32) for v in (first, len(texts), part)))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, same), pa.array(segment[starts].astype(np.int32)), lists],
                names=["chunk", "first", "number", "part", "segment", "keys"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, texts = None, 0, []
        for batch in batches:
            chunks, places = batch.column("chunk").to_pylist(), batch.column("place").to_pylist()
            for chunk, place, text in zip(chunks, places, batch.column("text")):
                if chunk != now or place != first + len(texts):
                    if texts:
                        yield from asks(now, first, texts)
                    now, first, texts = chunk, place, []
                texts.append(text)
        if texts:
            yield from asks(now, first, texts)

    return run


def _answer(shape: LogBloom):
    """The levels, a byte each, of the n-grams that ask a segment."""

    def run(asks: pa.Table, parts: pa.Table) -> pa.Table:
        bits = _either(parts)["bits"][0].as_py() if len(parts) else bytes(shape.segment_bits // 8)
        levels = LogBloom(1, shape.segment_bits, shape.least, shape.most, bits).levels(
            _lists(asks["keys"]).view(np.uint32).astype(np.uint64)
        )
        ends = np.cumsum(pc.list_value_length(asks["keys"].combine_chunks()).to_numpy(zero_copy_only=False))
        held = pa.BinaryArray.from_buffers(
            pa.binary(), len(asks),
            [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(levels.astype(np.uint8))],
        )
        return asks.select(["chunk", "first", "number", "part", "segment"]).append_column("levels", held)

    return run


def _score_chunk(model: Broadcast):
    """The rows of a chunk scored by the levels that came back."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("place")
        answers = answers.sort_by([(name, "ascending") for name in ("first", "part", "segment")])
        runs: dict[tuple[int, int], list[list[bytes]]] = {}
        keys = zip(*(answers[name].to_pylist() for name in ("first", "number", "part")))
        for (first, number, part), levels in zip(keys, answers["levels"]):
            found = runs.setdefault((first, number), [])
            if part == len(found):
                found.append([])
            found[part].append(levels.as_py())
        tables = []
        for (first, number), found in runs.items():
            rows = docs.slice(first, number)
            levels = [np.frombuffer(b"".join(f), dtype=np.uint8) for f in found]
            out = model.value.score_batch((t.as_py() for t in rows["text"]), levels)
            columns = [pa.array(out[name], type=t) for name, t in _SCORED_TYPES.items()]
            tables.append(
                pa.table([rows["id"], rows["held_out"], *columns], names=["id", "held_out", *_SCORED_TYPES])
            )
        return pa.concat_tables(tables)

    return run


_SCORED_TYPES = {
    "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
    "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int64()),
}


def _score_apart(rows: DataFrame, sent: Broadcast, parts: DataFrame, schema: str) -> DataFrame:
    """Rows (id, held_out, text) scored by a filter that lies in segments: each is probed in a task of its own,
    in more where many texts ask."""
    model = sent.value
    shape = model.bloom
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    chunks = stored(rows.mapInArrow(_chunked, f"chunk bigint, place int, {types}"), "chunks")
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deals = max(1, math.ceil(size / shape.segments / ASKING_BYTES))
    asks = chunks.select("chunk", "place", "text").mapInArrow(
        _ask(model.order, shape), f"{_ASKS}, keys array<int>"
    )
    asks = asks.withColumn("deal", F.pmod(F.hash("chunk"), F.lit(deals)))
    parts = parts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    # given numbers of tasks, which adaptive execution does not merge
    tasks = min(shape.segments * deals, MAX_TASKS)
    by = ["segment", "deal"]
    answers = (
        asks.repartition(tasks, *by)
        .groupBy(*by)
        .cogroup(parts.repartition(tasks, *by).groupBy(*by))
        .applyInArrow(_answer(shape), f"{_ASKS}, levels binary")
    )
    tasks = min(max(1, math.ceil(size / SCORED_BYTES)), MAX_TASKS)
    return (
        chunks.repartition(tasks, "chunk")
        .groupBy("chunk")
        .cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
        .applyInArrow(_score_chunk(sent), schema)
    )


def score_documents(
    docs: DataFrame,
    folds: int = 5,
    held_out_fold: int = 1,
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The log10 probability of every whole text under a model of the rows whose crc32 of the id modulo
    ``folds`` is not ``held_out_fold``.

    Tokens are the words, A-Z lower-cased, and one end. Returns ``id_col``, held_out, n_tokens, n_known
    (tokens that occur in training), train_tokens, base_score (add-half unigrams, exact counts) and score,
    a row per row of ``docs``. A null text is an empty one: a single end. Rows without an id are scored but
    not held out, and teach nothing; repeated rows teach each time. Where nothing is learnt every token has
    probability 1. Words are known by 64-bit hashes. A filter of more than ``max_bits`` holds all levels too; it
    is not sent to the workers, but the n-grams of the texts are sent to its segments.
    """
    spark = docs.sparkSession
    fold = id_remainder(F.col(id_col), folds)
    model, rare_counts, parts = learn_bloom_lm(
        docs.where(fold != held_out_fold).select(F.col(text_col).alias("text")), order, max_bits
    )
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = sent.value.score_batch(batch["text"])
            yield {"id": batch["id"], "held_out": batch["held_out"], **out}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    schema = (
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
        "rare array<bigint>, times array<bigint>"
    )
    found = map_columns(rows, run, schema) if parts is None else _score_apart(rows, sent, parts, schema)
    scored = stored(found.withColumn("row", F.monotonically_increasing_id()), "scores")
    sent.destroy()  # the scores are written, nothing reads the model again
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("word")).select(
        "row", F.col("word.rare").alias("key"), F.col("word.times").alias("times")
    )
    count = F.coalesce("count", F.lit(0))
    below = F.lit(model.tokens + 0.5 * (model.types + 1))
    added = (
        rare.join(rare_counts, "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((count + 0.5) / below)).alias("more_base"),
        )
    )
    return scored.join(added, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
