"""Token counts by batch encoding in Arrow functions that return lengths only.

A batch of texts is cut into pieces at safe boundaries (in front of a space, where the vocabulary's splitter always
cuts), pieces are dealt to sub-batches of even bytes, and the library encodes a sub-batch's words that are new to
the worker in one call. Only numbers leave the function.
"""

from __future__ import annotations

import functools
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS_KEPT, Splitter

PIECE_CHARS = 65_536
BATCH_BYTES = 1 << 20
TOKEN_LIMIT = 2048


class LibraryWords:
    """Words of texts and what the library makes of each of them; a word is encoded alone, as the splitter would."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer, normalizers

        self.splitter = Splitter(path)
        self.library = Tokenizer.from_file(path)
        self.library.normalizer = normalizers.Sequence([])  # words are normalised, and doing so twice may change them
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        fresh = list(words.difference(self.known))
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = list(words)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            found = self.library.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w, len(e)) for w, e in zip(part, found))


@functools.lru_cache(maxsize=2)
def library_words(path: str) -> LibraryWords:
    return LibraryWords(path)


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut in front of spaces or line ends into pieces of about ``size`` characters; a run without
    either stays whole."""
    cut, at = [], 0
    while len(text) - at > size:
        places = [p for p in (text.find(" ", at + size), text.find("\n", at + size)) if p >= 0]
        if not places:
            break
        cut.append(text[at : min(places)])
        at = min(places)
    return [*cut, text[at:]]


def balanced(items: list[tuple[int, str]], limit: int = BATCH_BYTES) -> list[list[tuple[int, str]]]:
    """(owner, piece) items in sub-batches of at most about ``limit`` bytes, evenly filled: the longest first,
    each to the sub-batch that holds least."""
    sizes = [len(piece.encode("utf-8", "surrogatepass")) for _, piece in items]
    wanted = max(1, -(-sum(sizes) // limit))
    heap = [(0, i) for i in range(wanted)]
    batches: list[list[tuple[int, str]]] = [[] for _ in range(wanted)]
    for place in sorted(range(len(items)), key=lambda i: -sizes[i]):
        held, i = heapq.heappop(heap)
        batches[i].append(items[place])
        heapq.heappush(heap, (held + sizes[place], i))
    return batches


def lengths(texts: list[str], path: str) -> np.ndarray:
    """Token counts of whole texts."""
    coder = library_words(path)
    total = np.zeros(len(texts), np.int64)
    items = [(i, piece) for i, text in enumerate(texts) for piece in pieces(text)]
    for batch in balanced(items):
        split = []
        for owner, piece in batch:
            for part in coder.splitter.parts(piece):
                if isinstance(part, int):
                    total[owner] += 1
                else:
                    split.append((owner, coder.splitter.words(part)))
        coder.learn(set(chain.from_iterable(words for _, words in split)))
        for owner, words in split:
            total[owner] += sum(map(coder.known.__getitem__, words))
    return total


def counted_rows(docs: DataFrame, path: str, token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``token_limit`` tokens), one row per row of ``docs``.

    Null texts are empty: no bytes, no tokens. Texts are counted whole, long ones in pieces. Repeated rows
    count alike, no rows give no rows. Columns other than doc_id and text are ignored; no shuffle is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = lengths([text or "" for text in batch.column(2).to_pylist()], path)
            columns = [batch.column(0), batch.column(1), pa.array(counts), pa.array(counts > token_limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long"), size.alias("n_bytes"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
