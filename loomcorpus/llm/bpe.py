"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where the hash of the last eight bytes falls on a given
value, so a passage that documents share is cut alike in all of them. What stands in a chunk between its
first and last white space is encoded once and kept under its bytes. A word that a cut goes through is repaired: a window of it and a
word on either side is encoded again, and grows by a word on either side until its first and last words have exactly the tokens
that the chunks gave them; between these stand the tokens of the join. White space there always is: the vocabulary's normaliser
never composes over a blank, its pattern drops white space, and no added token holds any.

A new chunk is put together from its words, of which the library encodes the ones that aren't kept. Where the file's normaliser and pattern
are known, words that differ in capitals or in the marks behind them share what is kept (`fold`); windows are encoded as they stand.

Caches live in the Python worker, are bounded by bytes and go when the task ends; they only save time. A lost executor loses
its cache and nothing else. Null text: no tokens, an empty decoded text, as of an empty one. Texts are read whole; repeated rows and null ids each
come out; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

#: Multiplier of the hash, and the number of its top bits that are nought at a cut: chunks of 256 bytes on average.
_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), 8
_SPACES = frozenset(common.SPACE)
_IS_SPACE = np.isin(np.arange(256), list(common.SPACE))
_BLANKS = [bytes([x]) for x in common.SPACE]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes that the caches of words and of chunks may take, about. A word longer than WORD_MAX bytes is encoded and not kept.
WORDS, CHUNKS, WORD_MAX, ENTRY = 32 << 20, 24 << 20, 256, 130
#: Texts of TOGETHER words that the library encodes at a time: what it returns takes many times their bytes.
AT_ONCE, TOGETHER = 8, 256
#: Bytes of chunks whose words are looked up together.
RUN = 1 << 20
#: What `fold` knows: ASCII and the letters below U+0100, which NFC leaves alone; marks that end a word behind a letter or a digit; the
#: normaliser and the pattern for which neither capitals nor such marks change what stands before them. (The apostrophe is no such mark.)
_LATIN = re.compile(rb"(?:[\x00-\x7f]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+").fullmatch
_MARKS = re.compile(rb"[!-&(-/:-@](?<=[a-z0-9\x80-\xbf].)[!-&(-/:-@]*(?!\S)")
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def cuts(text: bytes) -> np.ndarray:
    """Offsets at which the rolling hash cuts the text, without 0 and its end."""
    n = len(text) - 7
    if n <= 1:
        return np.empty(0, np.int64)
    window = np.ndarray((n,), "<u8", text, 0, (1,))
    at = np.flatnonzero(window * _MIX < np.uint64(1 << (64 - _BITS))) + 8
    return at[at < len(text)]


def parts(text: bytes) -> np.ndarray:
    """A row (start, end, start and end of its window) for each part of a text: words that cuts go through, with a word on either
    side, if there are, and what stands between, whose window is -1, -1."""
    cut = cuts(text)
    if not len(cut):
        return np.array([[0, len(text), -1, -1]][: len(text)], np.int64)
    blank = np.ones(len(text) + 2, bool)
    np.take(_IS_SPACE, np.frombuffer(text, np.uint8), out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    since, until = edges[::2], edges[1::2]  # of the words
    apart = blank[cut] | blank[cut + 1]
    within = since.searchsorted(cut[~apart], "right") - 1  # the words that cuts go through
    within = within[np.diff(within, prepend=-1) > 0]
    first, last = since[within], until[within]
    ends = np.concatenate([[0, len(text)], cut[apart], first, last])
    ends.sort()
    ends = ends[np.diff(ends, prepend=-1) > 0]
    out = np.full((len(ends) - 1, 4), -1, np.int64)
    out[:, 0], out[:, 1] = ends[:-1], ends[1:]
    at = ends.searchsorted(first)
    out[at, 2] = np.concatenate([[0], since])[within]
    out[at, 3] = np.concatenate([until, [len(text)]])[within + 1]
    return out


def spans(text: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a join) of the parts of a text."""
    for a, b, start, _ in parts(text).tolist():
        yield a, b, start >= 0


def _word_start(text: bytes, low: int, stop: int) -> int:
    """Where the word that holds the byte before `stop` starts, not before `low`; looked for in steps, so time follows the word."""
    step = 64
    while True:
        since = max(low, stop - step)
        at = max(text.rfind(s, since, stop) for s in _BLANKS)
        if at >= 0 or since == low:
            return at + 1 if at >= 0 else low
        step *= 4


def around(text: bytes, a: int, b: int, words: int = 1) -> tuple[tuple[int, int], list[bytes], list[bytes]]:
    """((start, end) of a window, the words in it before text[a:b], those after): so many words on either side, if there are."""
    left, right, start, end = [], [], a, b
    for _ in range(words):
        stop = start
        while stop > 0 and text[stop - 1] in _SPACES:
            stop -= 1
        if not stop:
            start = 0
            break
        start = _word_start(text, 0, stop)
        left.insert(0, text[start:stop])
    for _ in range(words):
        m = _WORD.search(text, end)
        if m is None:
            end = len(text)
            break
        end = m.end()
        right.append(m.group())
    return (start, end), left, right


class _Words(dict):
    """What a word gives; a word that isn't kept is made and not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        return self.make(word)


def _taken(word: bytes) -> int:
    """Bytes that a kept word takes, about."""
    return ENTRY + 4 * len(word)


class Codec:
    """Encodes with a tokenizers file; ids as little-endian unsigned 32-bit bytes, decoded text as UTF-8.

    A file without a decoder decodes to its tokens joined by blanks, so parts decode on their own; with
    a decoder, the whole text's ids are decoded at once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = self.library.decoder is None
        self.names = np.array([f"{self.library.id_to_token(i)} ".encode() for i in range(self.library.get_vocab_size())], object)
        self.folds = self._foldable()
        self.ids = _Words(self._word)
        self.old: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.windows: dict[bytes, bytes] = {}
        self.of_words = self.of_chunks = 0
        common.give_back()  # what reading the file took

    def _foldable(self) -> bool:
        """Whether the file has the normaliser and the pattern that `fold` is made for, and no added token without "<|"."""
        has = [json.loads(x.__getstate__()) if x else None for x in (self.library.normalizer, self.library.pre_tokenizer)]
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        return has == [_NORMALISER, {"type": "Sequence", "pretokenizers": [_PATTERN, _BYTES]}] and all("<|" in x for x in added)

    def fold(self, part: bytes) -> bytes:
        """Whole words, in small letters and with a blank before the marks that end a word, where that gives the same ids for sure: fewer
        different words are left. Others come as they are."""
        if not self.folds or b"<|" in part or not (part.isascii() or _LATIN(part)):
            return part
        return _MARKS.sub(rb" \g<0>", part.lower())

    def _word(self, word: bytes) -> bytes:
        """The ids of a word that isn't among the young."""
        if (got := self.old.get(word)) is not None:
            return got
        parts = self.fold(word).split() if len(word) <= WORD_MAX else [word]
        return self._ids(word) if parts == [word] else b"".join(map(self.ids.__getitem__, parts))

    def _ids(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, texts: list[bytes]) -> list[np.ndarray]:
        """The parts of the texts, whose chunks and whose joins' windows are encoded, many at a time."""
        if self.of_chunks > CHUNKS // 2:
            self._drop_chunks()
        found, windows, chunks, near, held = [parts(t) for t in texts], set(), set(), set(), 0
        for text, rows in zip(texts, found, strict=True):
            for a, b, start, end in rows.tolist():
                if start >= 0:
                    windows.add(text[start:end])
                    near.update(text[start:a].split(), text[b:end].split())
                elif (part := text[a:b].strip()) and part not in self.chunks:
                    chunks.add(part)
                    held += len(part)
                    if held > RUN:
                        self._learn_chunks(chunks, near)
                        chunks, near, held = set(), set(), 0
        self._learn_chunks(chunks, near)
        self.windows, new = {}, list(windows)
        for k in range(0, len(new), 64 * AT_ONCE):
            run = new[k : k + 64 * AT_ONCE]
            codes = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in run], add_special_tokens=False)
            self.windows |= {w: np.array(c.ids, "<u4").tobytes() for w, c in zip(run, codes, strict=True)}
        return found

    def _drop_chunks(self) -> None:
        self.chunks.clear()
        self.of_chunks = 0

    def _learn_chunks(self, chunks: Iterable[bytes], near: Iterable[bytes] = ()) -> None:
        """Keeps the ids of the chunks, and those of the words in them and of the words `near`."""
        if self.of_chunks > CHUNKS:
            self._drop_chunks()
        folded = [*map(self.fold, chunks), self.fold(b" ".join(near)).strip()]
        lists = pc.ascii_split_whitespace(pa.array(folded, pa.large_binary()).view(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        codes = self._codes(words.dictionary.view(pa.large_binary()).to_pylist())
        # The different words' ids one after another, and from these the ids of all words in their order.
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        which = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        at = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], size[which]) + np.arange(ends[-1])
        raw, ends = np.frombuffer(b"".join(codes), "<u4")[at].tobytes(), (4 * ends[lists.offsets.to_numpy()]).tolist()
        for part, a, b in zip(chunks, ends, ends[1:]):  # noqa: B905
            self.chunks[part] = got = raw[a:b]
            self.of_chunks += ENTRY + len(part) + len(got)

    def _codes(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of different words. Kept words are of two ages: when the young take half of the room, they are the old, and
        the old that weren't met since then go."""
        codes = list(map(self.ids.get, words))
        if missing := [w for w, ids in zip(words, codes, strict=True) if ids is None]:
            if self.of_words > WORDS // 2:
                self.old, self.ids, self.of_words = self.ids, _Words(self._word), 0
            got = {w: ids for w in missing if (ids := self.old.get(w)) is not None}
            got |= self._learn_words([w for w in missing if w not in got])
            kept = [w for w in missing if len(w) <= WORD_MAX]
            self.ids.update((w, got[w]) for w in kept)
            self.of_words += sum(map(_taken, kept))
            codes = [got[w] if ids is None else ids for w, ids in zip(words, codes, strict=True)]
        return codes

    def _learn_words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """What the library makes of the words; of those up to WORD_MAX bytes, many at a time."""
        got = {w: self._ids(w) for w in new if len(w) > WORD_MAX}
        some = [w for w in new if len(w) <= WORD_MAX] if got else new
        for k in range(0, len(some), AT_ONCE * TOGETHER):
            runs = [some[j : j + TOGETHER] for j in range(k, min(len(some), k + AT_ONCE * TOGETHER), TOGETHER)]
            said = [b" ".join([*run, b""]).decode("utf-8", "replace") for run in runs]
            codes = self.library.encode_batch(said, add_special_tokens=False)
            for run, text, code in zip(runs, said, codes, strict=True):
                raw, starts = np.array(code.ids, "<u4").tobytes(), [x[0] for x in code.offsets]
                blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
                ends = (4 * np.searchsorted(starts, blanks)).tolist()
                got.update(zip(run, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))  # noqa: B905
        return got

    def inner(self, part: bytes) -> bytes:
        """The ids of whole words between white space."""
        if (got := self.chunks.get(part)) is None:
            self._learn_chunks([part])
            got = self.chunks[part]
        return got

    def join(self, text: bytes, a: int, b: int, window: tuple[int, int] | None = None) -> bytes:
        """The ids of the word text[a:b] that a cut goes through, from a window that agrees with the words on either side.
        `window`: that with a word on either side, where it is known."""
        words = 1
        while True:
            if window is None:
                (start, end), left, right = around(text, a, b, words)
            else:
                (start, end), window = window, None
                left, right = text[start:a].split(), text[b:end].split()
            part = text[start:end]
            if (got := self.windows.get(part)) is None:
                got = self._ids(part)
            first, last = b"".join(map(self.ids.__getitem__, left)), b"".join(map(self.ids.__getitem__, right))
            if got.startswith(first) and got.endswith(last) and len(got) >= len(first) + len(last):
                return got[len(first) : len(got) - len(last)]
            if start == 0 and end == len(text):
                raise ValueError("a join that its whole text doesn't repair")
            words += 1

    def encode(self, text: bytes, found: np.ndarray | None = None) -> tuple[bytes, bytes]:
        """The ids and the decoded text of the whole text. `found`: its parts, where they are known."""
        ids: list[bytes] = []
        for a, b, start, end in (parts(text) if found is None else found).tolist():
            if start >= 0:
                ids.append(self.join(text, a, b, (start, end)))
            elif part := text[a:b].strip():
                ids.append(self.inner(part))
        whole = b"".join(ids)
        numbers = np.frombuffer(whole, "<u4")
        if self.plain:
            return whole, b"".join(self.names[numbers].tolist())[:-1]
        return whole, self.library.decode(numbers.tolist(), skip_special_tokens=False).encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for every row of `docs` (doc_id, text)."""

    def step(texts: list[bytes]) -> dict:
        found = codec(tokenizer).learn(texts)
        both = [codec(tokenizer).encode(t, x) for t, x in zip(texts, found, strict=True)]
        return {"ids": [np.frombuffer(x[0], "<i4") for x in both], "decoded": [x[1].decode() for x in both]}

    return common.scan(docs, step, "ids array<int>, decoded string", codec.cache_clear)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` gives, hashed where it is made."""

    def step(texts: list[bytes]) -> dict:
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t, found in zip(texts, codec(tokenizer).learn(texts), strict=True):
            ids, said = codec(tokenizer).encode(t, found)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(said).hexdigest())
        return out

    return common.scan(docs, step, "n_tokens long, ids_sha256 string, decoded_sha256 string", codec.cache_clear)
