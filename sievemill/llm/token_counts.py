"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is put through the tokenizer alone. Those that come
back as just their own token are proven whole. While counting, texts are cut at ASCII white space, which
no token crosses, and every different word of some MB of text is worked out once; a word's pre-tokens that are proven whole count one each, and only the rest goes through
the library's merges. Counts of words are remembered in two bounded generations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import _slices
from .shared import arrow_map, spread

LIMIT = 2048
#: Words remembered per generation and worker; longer words than LONG aren't remembered.
REMEMBER, LONG = 300_000, 64
#: Pre-tokens that go through the merges in one call.
TOGETHER = 4_000
WORD_END = "</w>"
#: Signs that are a pre-token by themselves after a word; and nothing.
SIGNS = ("", ".", ",", ";", ":", "!", "?", ")")
#: Fixed by the vocabulary's own pre-tokenizer.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that the library's normaliser only lower-cases, one for one.
PLAIN = regex.compile(r"[\x21-\x7E\xA1-\xAC\xAE-\xFF]+")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def whole_tokens(vocab_path: str) -> frozenset[str]:
    """Vocabulary strings that are proven to encode alone as the one token they name."""
    from tokenizers import Tokenizer

    tokenizer, bytes_of = Tokenizer.from_file(vocab_path), byte_alphabet()
    named: dict[str, int] = {}
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry.endswith(WORD_END) and all(c in bytes_of for c in entry[: -len(WORD_END)]):
            try:
                text = bytes(bytes_of[c] for c in entry[: -len(WORD_END)]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if PLAIN.fullmatch(text) and text == text.lower():
                named[text] = number
    texts = list(named)
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if e.ids == [named[t]])


class WordCounts(dict):
    """Tokens by word; what isn't known yet is worked out, many words at a time, and remembered."""

    def __init__(self, vocab_path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.whole = Tokenizer.from_file(vocab_path), whole
        self.older: dict[str, int] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for entry, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[number] = entry.endswith(WORD_END)

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of pre-tokens, in one call for many: each ends with the only token of it that ends a word."""
        found: dict[str, int] = {}
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                found.update(zip(some, np.diff(ends, prepend=-1).tolist()))
            else:  # not one word end each: then they are asked for one by one
                found.update((p, self.library(p)) for p in some)
        return found

    def work_out(self, words: list[str]) -> list[int]:
        """Tokens of different words. Words of letters, with a sign after them or not, need no pattern to be cut."""
        cut: list[tuple[str, ...] | None] = []
        for word in words:
            body, last = (word, "") if word[-1:].isalpha() else (word[:-1], word[-1:])
            if body.isalpha() and last in SIGNS and max(body) <= "\xff":
                cut.append((body.lower(), last) if last else (body.lower(),))
            else:
                cut.append(None if "<|" in word or not PLAIN.fullmatch(word) else tuple(PRE_TOKEN.findall(word.lower())))
        rest = {p for of in cut if of for p in of} - self.whole
        tokens = self.merged(list(rest))
        known = [self.library(w) if of is None else 0 for w, of in zip(words, cut)]
        for i, of in enumerate(cut):
            for p in of or ():
                known[i] += tokens.get(p, 1)
        return known

    def of_words(self, words: list[str]) -> list[int]:
        """Tokens of different words."""
        found = list(map(self.get, words))
        unknown = [i for i, n in enumerate(found) if n is None]
        for i in unknown:
            found[i] = self.older.get(words[i])
        fresh = [words[i] for i in unknown if found[i] is None]
        tokens = dict(zip(fresh, self.work_out(fresh)))
        for i in unknown:
            word, n = words[i], found[i]
            if n is None:
                n = found[i] = tokens[word]
            if len(word) <= LONG:
                if len(self) >= REMEMBER:
                    self.older = dict(self)
                    self.clear()
                self[word] = n
        return found

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. A word is looked up once, however often the texts hold it."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        of_word = np.array(self.of_words(coded.dictionary.to_pylist()), np.int64)
        upto = np.concatenate([[0], np.cumsum(of_word[coded.indices.to_numpy()])]) if len(coded) else np.zeros(1, np.int64)
        at = words.offsets.to_numpy()
        return upto[at[1:] - at[0]] - upto[at[:-1] - at[0]]


_counters: dict[tuple, WordCounts] = {}


def _counter(vocab_path: str, whole: frozenset[str]) -> WordCounts:
    key = (vocab_path, len(whole))
    if key not in _counters:
        _counters[key] = WordCounts(vocab_path, whole)
    return _counters[key]


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row per row.

    A null text is empty: 0 bytes, 0 tokens. Special strings in a text count as the library counts
    them. Repeated rows and null ids pass through; other columns play no part. The proven strings go
    to the tasks as a broadcast value; they are bounded by the vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocab_path, whole.value)
        for batch in batches:
            for part in _slices(batch, 1):
                texts = part.column(1).fill_null("")
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
