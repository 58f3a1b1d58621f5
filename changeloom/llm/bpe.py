"""Byte-level BPE ids over Arrow batches: every distinct word of a batch is encoded once by the tokenizers library.

A byte-level BPE cuts a text into pieces before it merges. No piece runs from a non-space into the space behind it, and
none goes on behind a run of letters. So a text may be cut before every single space and wherever a run of ASCII
letters ends in another ASCII character, and the ids of the parts, end to end, are the ids of the text. Texts in which a
space touches other white space, or that may hold an added token, are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_offsets, text_bytes

#: Distinct words kept from batch to batch, and the longest of them in bytes.
CACHE_WORDS, CACHE_WORD_BYTES = 300_000, 64
#: Bytes of text to encode at a time: the more, the more words are there again.
ENCODED_BYTES = 2 << 20
#: Words that the library gets as one string.
JOINED_WORDS = 50_000
_LETTER, _WHITE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WHITE[9:14] = _WHITE[28:33] = True


@functools.cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def id_bytes(tokenizer_path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    return out


class BatchEncoder:
    """``encode(texts)`` gives all ids as one int32 array and the offsets of each text's ids."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_sizes = np.array([len(b) for b in id_bytes(path)], np.int64)
        self.words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.ids, self.sizes, self.n_words = [], [], 0

    def _learn(self, words: list[str], sizes: np.ndarray, plain: np.ndarray) -> None:
        """Words of these sizes in bytes. Those that start with their only space (``plain``) are encoded end to end, and cut by the bytes of the ids."""
        outer = [words[k] for k in np.flatnonzero(~plain).tolist()]
        inner, sizes = [words[k] for k in np.flatnonzero(plain).tolist()], sizes[plain]
        for a in range(0, len(inner), JOINED_WORDS):
            part = inner[a : a + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(sizes[a : a + JOINED_WORDS])
            behind = np.cumsum(self.id_sizes[ids])
            cuts = np.searchsorted(behind, ends) + 1
            if behind[-1] != ends[-1] or (behind[cuts - 1] != ends).any():
                outer += part
            else:
                self._keep(part, ids, np.diff(cuts, prepend=0))
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(outer, add_special_tokens=False)] if outer else []
        if rows:
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            self._keep(outer, np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes)

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.words.update(zip(words, range(self.n_words, self.n_words + len(words)), strict=True))
        self.n_words += len(words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings without nulls."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data, at = text_bytes(texts), byte_offsets(texts)
        odd = self._whole(texts, data, at)
        if odd.all():
            return self._direct(texts)
        if odd.any():
            plain = pc.if_else(pa.array(odd), "", texts)
            data, at = text_bytes(plain), byte_offsets(plain)
        letter, begins = _LETTER[data], data == 32
        begins[1:] |= letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
        begins[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begins)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.n_words > CACHE_WORDS:
            self._forget()
        new = np.fromiter((w not in self.words for w in words), bool, len(words))
        strings = list(itertools.compress(words, new))
        if strings:
            sizes, plain = self._shapes(coded.dictionary, words)
            self._learn(strings, sizes[new], plain[new])
        if len(self.ids) > 1:
            self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        if words:
            slot = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
            by_word = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.sizes[0])]).astype(np.int32)), pa.array(self.ids[0]))
            taken = by_word.take(pa.array(slot[coded.indices.to_numpy()]))
            out, offsets = taken.values.to_numpy(), taken.offsets.to_numpy()[np.searchsorted(starts, at)].astype(np.int64)
        else:
            out, offsets = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        for w in strings:
            if len(w) > CACHE_WORD_BYTES:
                del self.words[w]  # long parts would fill the cache
        if odd.any():
            return self._merge(texts, odd, out, offsets)
        return out, offsets

    @staticmethod
    def _shapes(dictionary: pa.Array, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each word, and whether it begins with a space and has neither white space behind that nor at its end."""
        data, at = text_bytes(dictionary), byte_offsets(dictionary)
        sizes = np.diff(at)
        plain = (sizes > 1) & (data[at[:-1]] == 32)
        for ends in (at[:-1] + 1, at[1:] - 1):
            byte = data[np.minimum(ends, len(data) - 1)]
            plain &= ~_WHITE[byte]
            for k in np.flatnonzero(plain & (byte >= 0x80)).tolist():
                plain[k] = not (words[k][1].isspace() or words[k][-1].isspace())
        return sizes, plain

    def _whole(self, texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that can't be cut at single spaces."""
        spaces = np.flatnonzero(data == 32)
        spaces = spaces[spaces > 0]
        before = data[spaces - 1]
        touch = (before == 32) | ((before >= 9) & (before <= 13))
        far = np.flatnonzero(before >= 0x80)
        touch[far] = self._odd_white(data, spaces[far] - 1)
        at_text = np.searchsorted(at, spaces[touch], side="right") - 1
        at_text = at_text[spaces[touch] > at[at_text]]  # a text's first byte touches nothing
        odd = np.zeros(len(texts), bool)
        odd[at_text] = True
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return odd

    @staticmethod
    def _odd_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether these bytes end white space outside ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000)."""
        c, b, a = (data[np.maximum(at - k, 0)] for k in range(3))
        out = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        out |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        out |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        return out | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)

    def _direct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])

    def _merge(self, texts: pa.Array, odd: np.ndarray, out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = self._direct(texts.filter(pa.array(odd)))
        parts, k = [], 0
        for i, x in enumerate(odd.tolist()):
            parts.append(ids[at[k] : at[k + 1]] if x else out[offsets[i] : offsets[i + 1]])
            k += x
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
