"""Best-fit packing of tokenised documents by a linear grouping scheme.

Texts are tokenised in tasks. What is planned on the driver is only the histogram of piece lengths, which has one
entry a length however many documents there are. The plan says for runs of equally long pieces which sequences they
go to; pieces are numbered within their length by a distributed count and look their run up.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, numbered, running

CAPACITY = 2048
END_ID = 0
#: Pieces above this share of a sequence are grouped and configured; the others fill what is left by best fit. The number
#: of groups that takes the fewest sequences is used: few make few configurations, many waste little by rounding.
LARGE = 1 / 8
GROUPS = (64, 512, 4096)
#: Words kept per worker with their ids, from task to task; when half are new, those not met since the last time go.
KNOWN_WORDS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of whole texts by way of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order; words
    recur, so most are looked up. Plain words are cut as the tokenizer's own pattern does and only the parts that are
    new go through its model; words with rarer characters (below U+0250 all are in normal form) or special strings go
    through the tokenizer whole.
    """

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), known
        self.model = self.tokenizer.model
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.bytes = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if (ids := self.old_parts.get(part)) is not None:
            self.parts[part] = ids
            return ids
        text = part if part.isascii() else "".join(map(self.bytes.__getitem__, part.encode()))
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])
        self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if (ids := self.old_words.get(word)) is not None:
            self.words[word] = ids
            return ids
        if max(word) >= "ɐ" or "<|" in word or not word.isprintable():
            ids = self._whole(word)
        else:
            parts = self.parts
            ids = b"".join([parts.get(p) or self._part(p) for p in self.cut(word.lower())])
        self.words[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        for odd in "\x1c\x1d\x1e\x1f":  # blanks for Python, not for the tokenizer
            if odd in text:
                return self._whole(text)
        if len(self.words) > self.known // 2:
            self.words, self.old_words = {}, self.words
        if len(self.parts) > self.known // 2:
            self.parts, self.old_parts = {}, self.parts
        get, word = self.words.get, self._word
        return b"".join([found if (found := get(w)) is not None else word(w) for w in text.split()])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's tokenizer: workers are used again, and so are the words that they know."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise every text, end it with ``end_id`` and cut what is longer than a sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, end = word_ids(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def _configurations(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Fill sequences with rounded sizes: (sizes, how many sequences), until ``counts`` (size: pieces) is used up.

    The largest size left is completed to the fullest sum that the others can reach; the configuration found is used
    as often as its sizes last. Reachable sums are bit sets by number of pieces, so a step costs a few thousand shifts.
    """
    left = dict(sorted(counts.items(), reverse=True))
    while left:
        seed = next(iter(left))
        room, chosen, barred = capacity - seed, [seed], set()
        while True:
            sizes = [s for s in left if s <= room and s not in barred and (s != seed or left[s] > 1)]
            layers, mask = [1], (1 << (room + 1)) - 1
            while sizes and len(layers) <= room // sizes[-1]:
                layer = 0
                for s in sizes:
                    layer |= layers[-1] << s
                layers.append(layer & mask)
                if not layers[-1]:
                    break
            best = max(range(len(layers)), key=lambda k: (layers[k].bit_length(), -k))
            chosen, rest = [seed], layers[best].bit_length() - 1
            for k in range(best, 0, -1):
                pick = next(s for s in sizes if s <= rest and layers[k - 1] >> (rest - s) & 1)
                chosen.append(pick)
                rest -= pick
            short = [s for s in set(chosen) if chosen.count(s) > left[s]]
            if not short:
                break
            if set(short) == {seed}:
                barred.add(seed)
            barred |= set(short) - {seed}
        times = min(left[s] // chosen.count(s) for s in set(chosen))
        for s in chosen:
            left[s] -= times
            if not left[s]:
                left.pop(s)
        yield chosen, times


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """The plan of :func:`grouped_plan` with the fewest sequences; of equal ones that with the fewest groups."""
    plans = [grouped_plan(histogram, capacity, g, large) for g in groups]
    return min(plans, key=lambda runs: max((first + hi - lo for _, lo, hi, first, _ in runs), default=0))


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, one past the last, first sequence, slot) that place all pieces of all lengths.

    Large pieces in order of length are cut into ``groups`` of equal cardinality, each rounded up to its longest piece.
    Configurations of rounded sizes are chosen, actual pieces take their slots, and small pieces go to the sequence with
    the tightest room that holds them. There are at most ``capacity`` lengths and ``groups`` sizes, so the plan is bounded whatever the number of documents.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # free tokens: (first sequence, how many, next slot)
    if n := histogram.get(capacity, 0):
        runs.append((capacity, 0, n, 0, 0))
        sequences = n
    lengths = [x for x in sorted(histogram) if large * capacity < x < capacity]
    total = sum(histogram[x] for x in lengths)
    members: dict[int, list[list[int]]] = defaultdict(list)  # rounded size: [length, next number, one past the last]
    done, each = 0, max(1, -(-total // groups))
    cells: list[list[int]] = []
    for x in lengths:
        at = 0
        while at < histogram[x]:
            take, group = min(histogram[x] - at, each - done % each), done // each
            cells.append([group, x, at, at + take])
            at, done = at + take, done + take
    top: dict[int, int] = {}
    for group, x, *_ in cells:
        top[group] = max(top.get(group, 0), x)
    for group, x, lo, hi in cells:
        members[top[group]].append([x, lo, hi])
    counts = {size: sum(hi - lo for _, lo, hi in cells) for size, cells in members.items()}
    for sizes, times in _configurations(counts, capacity):
        used = [(sequences, sequences + times, 0)]  # stretches of these sequences and the tokens in them
        for slot, size in enumerate(sizes):
            spots, need, at = [], times, sequences
            while need:
                cell = members[size][-1] if slot % 2 else members[size][0]
                take = min(need, cell[2] - cell[1])
                runs.append((cell[0], cell[1], cell[1] + take, at, slot))
                spots.append((at, at + take, cell[0]))
                cell[1] += take
                need, at = need - take, at + take
                if cell[1] == cell[2]:
                    members[size].pop(-1 if slot % 2 else 0)
            edges = sorted({e for a, b, _ in (*used, *spots) for e in (a, b)})
            used = [(a, b, next(u for x, y, u in used if x <= a < y) + next(u for x, y, u in spots if x <= a < y)) for a, b in zip(edges, edges[1:])]
        for a, b, u in used:
            room[capacity - u].append((a, b - a, len(sizes)))
        sequences += times
    free = [r for r in room if r]
    heapq.heapify(free)
    for x in sorted((x for x in histogram if x <= large * capacity), reverse=True):
        at, n = 0, histogram[x]
        while at < n:
            fit = min((r for r in room if r >= x and room[r]), default=None)
            if fit is None:
                many = -(-(n - at) // (capacity // x))
                room[capacity].append((sequences, many, 0))
                sequences += many
                continue
            first, many, slot = room[fit].pop()
            take = min(many, n - at)
            runs.append((x, at, at + take, first, slot))
            if take < many:
                room[fit].append((first + take, many - take, slot))
            room[fit - x].append((first, take, slot + 1))
            at += take
    return runs


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and has the end token alone. Rows that repeat are packed as often. An empty table gives no rows.
    A text may be of any length: its pieces are cut one after the other. Equally long pieces are numbered by a hash of
    their ids, then by id, piece and row.
    """
    table = numbered(pieces(docs, path or vocabulary(), id_col, text_col, capacity, end_id))
    table = materialise(table.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")), "op10-pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = table.sparkSession.createDataFrame(plan(histogram, capacity), "run_length long, lo long, hi long, first_sequence long, slot long")
    placed = running(table, ["length"], "h", ["doc_id", "piece", "row"], F.lit(1), "number")
    found = placed.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    found = found.withColumn("sequence_id", F.col("first_sequence") + F.col("number") - F.col("lo"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
