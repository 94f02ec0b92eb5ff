"""Ids of a vocabulary of the tokenizers library, for packing and for files.

Texts are encoded many at a time. A single space between two characters that
are no white space always begins a pre-token, and so does a line break there,
so a text is its words one after the other. Arrow cuts a batch of texts into
words and numbers the distinct ones; only words that this worker has not met
are merged, all of them in one call. The ids of the texts are then gathered by
arrays. Texts for which the cut is not as simple (other white space, runs of
it, added tokens such as ``<|endoftext|>``) are encoded whole by the library.

New words are merged by rank, which is faster than the library's merges and
the same if ids ascend with the merges and every token, taken alone, is merged
to itself: bytes that have become two neighbours x, y whose union is a token
were merged inside it in the order in which that token alone is merged, so x, y
is that token's own last merge. Both conditions are checked for the vocabulary;
where they fail, and for words in scripts that were given characters of late
(the two libraries may classify those differently), the library merges.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from .common import remembered  # noqa: E402
from .pretokens import BYTE_CHARS, OTHER_WS  # noqa: E402

#: White space that a text cannot be cut at by its single spaces and line breaks.
_HARD = "^[ \n]| $|  | \n|\n |\n\n|[\t\r\x0b\x0c" + OTHER_WS + "]"


def valid_text(column: pa.Array) -> pa.Array:
    """The column as valid UTF-8, with replacement characters where it is not; null is empty."""
    column = pc.fill_null(column, "")
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()], pa.string())


#: Pattern of the library's byte-level pre-tokenizer (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATER = re.compile("[\u0530-\U0010ffff]")


def merged_by_rank(tokenizer: Tokenizer) -> tiktoken.Encoding | None:
    """An encoder by ranks that gives the ids of ``tokenizer``, None unless that is certain."""
    whole = json.loads(tokenizer.to_str())
    model, cut = whole["model"], whole["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or whole["normalizer"] or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return None
    if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"):
        return None
    vocabulary, bytes_of = model["vocab"], {c: b for b, c in BYTE_CHARS.items()}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    single = [i for t, i in vocabulary.items() if len(t) == 1]
    if len(single) != 256 or merged != sorted(set(merged)) or merged and merged[0] <= max(single) or len(single) + len(merged) != len(vocabulary):
        return None
    if any(c not in bytes_of for t in vocabulary for c in t) or any(len(tokenizer.model.tokenize(t)) != 1 for t in vocabulary):
        return None
    ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class _Words:
    """Numbered words with their ids."""

    def __init__(self):
        self.known: dict[str, int] = {"": 0}
        self.count = np.zeros(1 << 12, np.int32)
        self.start = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def add(self, words: list[str], count: np.ndarray, ids: np.ndarray) -> None:
        first, end = len(self.known), len(self.known) + len(words)
        for name, need in (("count", end), ("start", end), ("ids", self.used + len(ids))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, len(held)) - len(held) // 2, held.dtype)]))
        self.count[first:end] = count
        self.start[first:end] = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(words, range(first, end), strict=True))

    def gather(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these words has, and all of them in a row."""
        n = self.count[word]
        stop = np.cumsum(n, dtype=np.int64)
        total = int(stop[-1]) if len(n) else 0
        return n, self.ids[np.repeat(self.start[word] - stop + n, n) + np.arange(total)]


class BatchEncoder:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, each followed by ``end_id``.

    Words are kept in two generations: when the younger one is full the older
    one goes, and what is met again moves up. So memory is bounded and common
    words stay.
    """

    def __init__(self, path: str, end_id: int, most: int = 450_000, at_once: int = 10_000):
        self.tokenizer, self.end, self.most, self.at_once = Tokenizer.from_file(path), end_id, most, at_once
        added = {str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.hard = "|".join([_HARD, *map(re.escape, sorted(added))])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids with which a word or a line begins
        for token, i in vocabulary.items():
            self.begins[i] = token[0] == BYTE_CHARS[32] or token == BYTE_CHARS[10]
        self.ranked = merged_by_rank(self.tokenizer)
        self.words, self.older = _Words(), _Words()
        self._learn(["\n"])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met before; a word stands behind a space, or begins with a line break."""
        joined = "".join(w if w[0] == "\n" else " " + w for w in words)
        if self.ranked is None or _LATER.search(joined):
            found = self.whole(joined)
        else:
            found = self.ranked.encode_to_numpy(joined, disallowed_special=())
        at = np.flatnonzero(self.begins[found])
        if len(at) != len(words):
            single = [self.whole(w if w[0] == "\n" else " " + w) for w in words]
            self.words.add(words, np.array([len(x) for x in single]), np.concatenate(single))
        else:
            self.words.add(words, np.diff(np.append(at, len(found))), found)

    def _numbers(self, distinct: np.ndarray) -> np.ndarray:
        """The number of each word among ``words``."""
        number = np.fromiter(map(self.words.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        old = np.fromiter(map(self.older.known.get, distinct[new], repeat(-1)), np.int64, len(new))
        again, new = new[old >= 0], new[old < 0]
        first = len(self.words.known)
        self.words.add(distinct[again].tolist(), *self.older.gather(old[old >= 0]))
        for i in range(0, len(new), self.at_once):
            self._learn(distinct[new[i : i + self.at_once]].tolist())
        number[again] = first + np.arange(len(again))
        number[new] = first + len(again) + np.arange(len(new))
        return number

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one entry more than texts)."""
        if len(self.words.known) > self.most // 2:
            self.words, self.older = _Words(), self.words
        texts = valid_text(column)
        hard = pc.match_substring_regex(texts, self.hard)
        easy = pc.if_else(hard, "", texts) if pc.any(hard).as_py() else texts
        # every text begins with a line break here, whose id becomes the end of the text before
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", easy, ""), "\n", " \n"), " ")
        words = cut.flatten().dictionary_encode()
        word = self._numbers(words.dictionary.to_numpy(zero_copy_only=False))[words.indices.to_numpy()]
        n, flat = self.words.gather(word)
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        begin = np.append(0, np.cumsum(n, dtype=np.int64))[first]
        flat[begin[:-1]] = self.end
        flat = np.append(flat[1:], np.uint32(self.end)) if len(flat) else flat
        slow = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        if len(slow):
            pieces, low, size = [], 0, np.diff(begin)
            for i in slow.tolist():
                own = self.whole(texts[i].as_py())
                pieces += [flat[low : begin[i]], own]
                low = begin[i]
                size[i] += len(own)
            flat, begin = np.concatenate([*pieces, flat[low:]]), np.append(0, np.cumsum(size))
        return flat, begin


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> BatchEncoder:
    """The one of this worker, so that words met once outlive a task."""
    return BatchEncoder(path, end_id)


remembered(encoder.cache_clear)
