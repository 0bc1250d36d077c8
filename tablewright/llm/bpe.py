"""BPE by backtracking: exact merges in linear time, and decoding by an offset table.

All tokens of the vocabulary are the words of an Aho-Corasick automaton. One pass over a word gives the longest
token at every place; the encoder takes it if it is compatible with the token before it, otherwise the next
shorter token, otherwise it steps back. Two tokens are compatible if encoding their joined text gives these two
tokens again, which a table answers (filled on demand by undoing merges in order). The result is the merge
order's own. Words are encoded once and remembered per worker up to a bound.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 700_000
END = "\u0100"  # stands for the end of a word; texts are held as one character per byte, so it is free

# Fixed values of the vocabulary file's own splitter: its contractions, and the special strings found first.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
# Letters and blanks among the characters that the fast splitter takes, lower-cased.
_SPACES = "\\t-\\r \\x85\\xa0"
# Texts with other characters are normalised and split by the library: decompositions, numbers that are no digits,
# scripts beyond Latin and general punctuation.
_FAR = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
_fast_words = re.compile(f"{CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^{_SPACES}0-9{_LETTERS}]+").findall


def byte_symbols() -> dict[str, int]:
    """Printable stand-in character of every byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Splitter:
    """Cuts a text into words and special token ids, as the vocabulary file's normaliser and splitter do."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {token.content: i for i, token in self.library.get_added_tokens_decoder().items()}
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def parts(self, text: str) -> list[str | int]:
        """The text between special strings, and the ids of those."""
        if not any(mark in text for mark in self.special):
            return [text]
        return [self.special.get(part, part) for part in self._marks.split(text) if part]

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        low = text.lower()
        if text.isascii() or (_FAR.search(text) is None and _FAR.search(low) is None):
            return _fast_words(low)
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]


class Backtracker:
    """Encoder and decoder over one vocabulary file of BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, added = stored["model"], stored["added_tokens"]
        ids, symbols, suffix = model["vocab"], byte_symbols(), model["end_of_word_suffix"]
        size = max([*ids.values(), *(token["id"] for token in added)]) + 1
        self.text = [""] * size
        self.halves = [(i, i) for i in range(size)]
        self.joined: dict[int, int] = {}
        for symbol, byte in symbols.items():
            self.text[ids[symbol]] = chr(byte)
            self.text[ids[symbol + suffix]] = chr(byte) + END
        for left, right in (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]):
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.text[whole] = self.text[a] + self.text[b]
            self.halves[whole] = (a, b)
            self.joined[a << 20 | b] = whole
        self.length = [len(text) for text in self.text]
        of = {text: i for i, text in enumerate(self.text) if text}
        self.shorter = [-1] * size  # the longest other token that the token starts with
        for i, text in enumerate(self.text):
            self.shorter[i] = next((of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in of), -1)
        self.search = ahocorasick.Automaton()
        for text, i in of.items():
            self.search.add_word(text, (len(text), i))
        self.search.make_automaton()
        self.fits: dict[int, bool] = {}
        written = [""] * size
        for symbol, i in ids.items():
            written[i] = symbol
        for token in added:
            written[token["id"]] = token["content"]
        pieces = [(symbol + " ").encode() for symbol in written]
        self.offsets = np.concatenate(([0], np.cumsum([len(piece) for piece in pieces]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges of both sides from the latest on; no earlier merge may reach across the border."""
        limit = 1 << 30
        while True:
            if self.joined.get(left << 20 | right, limit) < limit:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            whole_left, whole_right = inner_left == left, inner_right == right
            if whole_left and whole_right:
                return True
            if whole_right or (left > right and not whole_left):
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word."""
        text = word.encode().decode("latin-1") + END
        n = len(text)
        longest, reach = [-1] * n, [0] * n
        for end, (size, token) in self.search.iter(text):
            at = end - size + 1
            if size > reach[at]:
                reach[at], longest[at] = size, token
        open_at = [True] * (n + 1)
        open_at[n - 1] = False  # the end of a word is no symbol of its own
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                upto = at + self.length[token]
                if open_at[upto] and (not taken or self.compatible(taken[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                at = upto
                token = longest[at] if at < n else -1
            else:
                open_at[at] = False
                last = taken.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return taken

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' strings, a space between them: the file names no decoder of its own."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        return self.bytes[places][:-1].tobytes()


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes; forgets all beyond a bound of words."""

    def __init__(self, encoder: Backtracker):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = np.array(self.encoder.encode_word(word), "<u4").tobytes()
        self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def coder(path: str) -> tuple[Splitter, Backtracker, WordIds]:
    """Splitter, encoder and memory of one vocabulary, made once per worker."""
    encoder = Backtracker(path)
    return Splitter(path), encoder, WordIds(encoder)


def encoded(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit bytes."""
    splitter, _, memory = coder(path)
    parts = []
    for part in splitter.parts(text):
        if isinstance(part, int):
            parts.append(part.to_bytes(4, "little"))
        else:
            parts.extend(map(memory.__getitem__, splitter.words(part)))
    return b"".join(parts)


def coded_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded and decoded again.

    One row per row of ``docs``; null texts are empty and have no tokens. Repeated rows and ids are coded
    alike. No rows give no rows. Columns other than doc_id and text are ignored; no shuffle is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, _ = coder(path)
        for batch in batches:
            sizes, of_ids, of_text = [], [], []
            for text in batch.column(1):
                raw = encoded(text.as_py() or "", path)
                sizes.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(np.frombuffer(raw, "<u4").astype(np.int64))).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
