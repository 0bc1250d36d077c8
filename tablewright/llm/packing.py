"""Hierarchical multi-length packing of documents into training sequences.

A document's full windows are sequences by themselves. What remains of it goes to the tier of the smallest window
it fits. From the longest tier down, each document opens a window of its tier, the largest pieces of the shorter
tiers that fit go into the gap, and a cut piece closes it, so windows end exactly full. What is left at the end of
a block of documents is laid end to end and cut at powers of two. Sequences of a tier are then dealt to step
groups of even attention cost. A block holds a bounded number of tokens, lies in one task, and needs no other: texts
are never shuffled, and a document of any length or any number of copies is no hot spot.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS_KEPT, Splitter, byte_symbols

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
GROUP_SEQUENCES = 64
BLOCK_TOKENS = 4_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class ModelIds(dict):
    """Word -> the library model's ids as little-endian unsigned 32-bit bytes; forgets all beyond a bound."""

    def __init__(self, path: str):
        super().__init__()
        self.splitter = Splitter(path)
        self.model = self.splitter.library.model
        self.written = {byte: symbol for symbol, byte in byte_symbols().items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        symbols = word.encode().decode("latin-1").translate(self.written)
        found = np.array([token.id for token in self.model.tokenize(symbols)], "<u4").tobytes()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        parts = []
        for part in self.splitter.parts(text):
            if isinstance(part, int):
                parts.append(part.to_bytes(4, "little"))
            else:
                parts.extend(map(self.__getitem__, self.splitter.words(part)))
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def model_ids(path: str) -> ModelIds:
    return ModelIds(path)


class Pool:
    """Pieces (document, start, length) of the shorter tiers, found by length."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, int, int]]] = {}
        self.lengths: list[int] = []

    def add(self, piece: tuple[int, int, int]) -> None:
        held = self.of.setdefault(piece[2], [])
        if not held:
            insort(self.lengths, piece[2])
        held.append(piece)

    def take(self, at_most: int, least: int = 1) -> tuple[int, int, int] | None:
        """The longest piece of ``least`` to ``at_most`` tokens."""
        place = bisect_right(self.lengths, at_most) - 1
        if place < 0 or self.lengths[place] < least:
            return None
        return self._pop(place)

    def shortest(self, at_most: int) -> tuple[int, int, int] | None:
        return self._pop(0) if self.lengths and self.lengths[0] <= at_most else None

    def _pop(self, place: int) -> tuple[int, int, int]:
        length = self.lengths[place]
        piece = self.of[length].pop()
        if not self.of[length]:
            del self.lengths[place]
        return piece


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces) of documents with these token counts; a piece is (document, start, length).

    Every token lies in one piece. Every sequence is as long as a tier, but for the last ones, whose lengths
    are powers of two, so nothing is padded.
    """
    longest = tiers[0]
    sequences, pool = [], Pool()
    for document, size in enumerate(sizes):
        whole = size - size % longest
        sequences.extend((longest, [(document, at, longest)]) for at in range(0, whole, longest))
        if size > whole:
            pool.add((document, whole, size - whole))
    left: list[tuple[int, int, int]] = []
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while (opener := pool.take(tier, below + 1)) is not None:
            window, gap = [opener], tier - opener[2]
            while gap and (piece := pool.take(gap)) is not None:
                window.append(piece)
                gap -= piece[2]
            if gap and (piece := pool.shortest(tier)) is not None:  # longer than the gap: its head closes the window
                document, start, length = piece
                window.append((document, start, gap))
                pool.add((document, start + gap, length - gap))
                gap = 0
            if gap:
                left.extend(window)
            else:
                sequences.append((tier, window))
    room = sum(piece[2] for piece in left)
    target, window, filled = 0, [], 0
    for document, start, length in left:
        while length:
            if not filled:
                target = longest if room >= longest else 1 << (room.bit_length() - 1)
            part = min(length, target - filled)
            window.append((document, start, part))
            start, length, filled, room = start + part, length - part, filled + part, room - part
            if filled == target:
                sequences.append((target, window))
                window, filled = [], 0
    return sequences


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], members: int = GROUP_SEQUENCES) -> list[int]:
    """A group number for each sequence: groups hold one tier and even shares of its attention cost, the
    sequences of falling cost dealt forth and back."""
    groups, first = [0] * len(sequences), 0
    for tier in sorted({tier for tier, _ in sequences}, reverse=True):
        own = [i for i, (t, _) in enumerate(sequences) if t == tier]
        own.sort(key=lambda i: (-sum(piece[2] ** 2 for piece in sequences[i][1]), i))
        n = -(-len(own) // members)
        for place, i in enumerate(own):
            turn, seat = divmod(place, n)
            groups[i] = first + (seat if turn % 2 == 0 else n - 1 - seat)
        first += n
    return groups


def packed_rows(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Null and empty texts are documents of the end id alone. Repeated rows and null ids are packed as documents
    of their own. sequence_id and step_group are the task number and a count inside the task. No rows give no
    rows. Columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = model_ids(path), TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        held: list[bytes] = []
        sequence, group, tokens = base, base, 0

        def block() -> pa.RecordBatch:
            nonlocal sequence, group
            sizes = [len(raw) // 4 for raw in held]
            packed = pack(sizes)
            groups = step_groups(packed)
            rows = []
            for number, (tier, window) in enumerate(packed):
                offset = 0
                for document, start, length in window:
                    crc = zlib.crc32(memoryview(held[document])[start * 4 : (start + length) * 4])
                    rows.append((names[document], start, length, crc, sizes[document], sequence + number, offset, tier, group + groups[number]))
                    offset += length
            sequence, group = sequence + len(packed), group + max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in SCHEMA.split(", ")])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                raw = coder.encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                names.append(name.as_py())
                held.append(raw)
                tokens += len(raw) // 4
                if tokens >= block_tokens:
                    yield block()
                    names, held, tokens = [], [], 0
        if held:
            yield block()

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, SCHEMA)
