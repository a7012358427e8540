"""Whole-text encoding with a cache of chunks.

A single space, or a line feed, between two characters that are not white space always starts a new pre-token in the
byte-level pattern; in the word pattern white space only separates. So a text can be cut there, each distinct chunk
encoded once, and the ids joined again: the result equals encoding the whole text. Arrow splits a batch of texts and
numbers its distinct chunks, so only those are looked up one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Texts with white space that touches other white space or an edge, or that is neither space nor line feed (RE2).
_AWKWARD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^ | $"
#: Texts whose lower case is the same character by character, before and after normalisation: no combining marks, no
#: dotted capital I, no sigma.
_LOWERED = r"^[\x00-\x7f\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}]*$"
#: Chunks of Latin letters alone are one pre-token after the line feed, and a mark after them is another.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_DELIMITER = "\x01"


class ChunkEncoder:
    """Token ids, and where tokens start, of whole texts.

    ``byte_level``: chunks after the first carry the space before them, or begin with their line feed. ``starts``:
    whether :meth:`token_starts` will be asked for. ``limit``: distinct chunks kept; beyond it those met in fewest calls are
    forgotten, which costs time but never changes a result.
    """

    def __init__(self, path: str, byte_level: bool, starts: bool = False, limit: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level, self.with_starts, self.limit = byte_level, starts, limit
        # the same model without the pattern, for chunks known to be one pre-token each
        self.plain = Tokenizer.from_file(path)
        if not byte_level:
            self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(_DELIMITER), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        #: tokens that begin a chunk (byte level: space or line feed first), or end one (word pattern)
        edge = (lambda t: t[0] in "ĠĊ") if byte_level else (lambda t: t.endswith("</w>"))
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if edge(t)]] = True
        #: marks that end many chunks; each must be one token, which starts where the letters before it end
        marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.marks = {m: ids[0] for m, ids in marks.items() if len(ids) == 1}
        self._clear()

    def _clear(self) -> None:
        """A chunk's number leads to a slice of ``ids`` and ``starts``."""
        self.number: dict[str, int] = {}
        self.first_number: dict[str, int] = {}
        self.numbered = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16 if self.with_starts else 0, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.met = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _forget(self) -> None:
        """Keep at most half as many chunks as ``limit``, those met in most calls, and halve what is counted of them."""
        met = self.met[: self.numbered]
        as_often = np.append(np.cumsum(np.bincount(met)[::-1])[::-1], 0)
        least = max(2, int(np.argmax(as_often <= self.limit // 2)))
        kept = np.flatnonzero(met >= least)
        number, first_number, with_starts = self.number, self.first_number, self.with_starts
        ids, ends = self._gather(kept, self.ids)
        starts = self._gather(kept, self.starts)[0] if with_starts else None
        halved = met[kept] >> 1
        place = np.full(self.numbered, -1)
        place[kept] = np.arange(len(kept))
        self._clear()
        for old, new in ((number, self.number), (first_number, self.first_number)):
            new.update((c, to) for c, to in zip(old, place[np.fromiter(old.values(), np.int64, len(old))].tolist()) if to >= 0)
        self.numbered = len(kept)
        self._store(np.arange(len(kept)), ids, starts, np.diff(ends))
        self.met[: len(kept)] = halved

    def _store(self, numbers: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids, self.starts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.ids, self.starts))
        while self.numbered > len(self.begin):
            self.begin, self.count, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.count, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        if self.with_starts:
            self.starts[self.used : self.used + len(ids)] = starts
        self.count[numbers] = counts
        self.begin[numbers] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _lead(self, chunk: str) -> str:
        """What stands before a chunk in its text, beyond what the chunk itself holds."""
        return " " if self.byte_level and chunk[:1] != "\n" else ""

    def _encode(self, tokenizer: Tokenizer, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Ids and, where asked for, token starts of texts. Without starts the library skips its bookkeeping."""
        if not self.with_starts:
            return [(np.array(e.ids, np.uint32), None) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        found = tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(np.array(e.ids, np.uint32), np.array([o[0] for o in e.offsets], np.int64)) for e in found]

    def _single(self, numbers: list[int], texts: list[str]) -> None:
        """Texts encoded one by one."""
        if texts:
            got = self._encode(self.tokenizer, texts)
            counts = np.array([len(ids) for ids, _ in got])
            starts = np.concatenate([at for _, at in got]) if self.with_starts else None
            self._store(np.array(numbers), np.concatenate([ids for ids, _ in got]), starts, counts)

    def _letters(self, chunks: list[str]) -> None:
        """Chunks of one pre-token (after their line feed), many a call, cut at the tokens that begin or end one."""
        for i in range(0, len(chunks), 256):
            part = chunks[i : i + 256]
            pieces = [_DELIMITER + c if c[0] != "\n" else _DELIMITER + "\n" + _DELIMITER + c[1:] for c in part]
            if self.byte_level:
                pieces = [_DELIMITER + " " + c if c[0] != "\n" else p for c, p in zip(part, pieces)]
            ids, at = self._encode(self.plain, ["".join(pieces)])[0]
            edges = np.flatnonzero(self.edge[ids])
            bounds = np.append(edges, len(ids)) if self.byte_level else np.append(0, edges + 1)
            counts = np.diff(bounds)
            if len(counts) != len(part):
                raise ValueError("the tokenizer does not mark the edges of words")
            starts = None
            if at is not None:
                length = np.fromiter(map(len, pieces), np.int64, len(part))
                # a delimiter stands before each piece, and another after a line feed
                starts = at - np.repeat(np.cumsum(length) - length + 1, counts)
                fed = np.repeat(np.fromiter((c[0] == "\n" for c in part), bool, len(part)), counts)
                starts -= fed & (starts > 0)
            self._store(np.array([self.number[c] for c in part]), ids, starts, counts)

    def _compose(self, chunks: list[str]) -> None:
        """Chunks of a known core and one mark: the core's tokens and the mark's."""
        core = np.array([self.number[c[:-1]] for c in chunks])
        n = len(chunks)
        flat, ends = self._gather(core, np.arange(self.used))
        at = np.insert(flat, ends[1:], 0)
        last = ends[1:] + np.arange(n)
        ids = self.ids[at]
        ids[last] = [self.marks[c[-1]] for c in chunks]
        starts = None
        if self.with_starts:
            starts = self.starts[at]
            starts[last] = [len(self._lead(c)) + len(c) - 1 for c in chunks]
        self._store(np.array([self.number[c] for c in chunks]), ids, starts, np.diff(ends) + 1)

    def _others(self, chunks: list[str]) -> None:
        """Any other chunks, joined and cut by character offsets, or alone where white space at an edge would touch a neighbour."""
        alone = [c for c in chunks if not c or c[-1].isspace() or (c[0].isspace() and not (self.byte_level and c[0] == "\n" and not c[1].isspace()))]
        self._single([self.number[c] for c in alone], [self._lead(c) + c for c in alone])
        left = set(alone)
        run = [c for c in chunks if c not in left]
        for i in range(0, len(run), 256):
            part = run[i : i + 256]
            pieces = [self._lead(c) + c for c in part] if self.byte_level else [c + " " for c in part]
            begin = np.cumsum([0] + [len(p) for p in pieces])
            got = self.tokenizer.encode("".join(pieces), add_special_tokens=False)
            at = np.array([o[0] for o in got.offsets], dtype=np.int64)
            counts = np.diff(np.searchsorted(at, begin))
            self._store(np.array([self.number[c] for c in part]), np.array(got.ids, np.uint32), at - np.repeat(begin[:-1], counts), counts)

    def _learn(self, chunks: list[str]) -> None:
        """Number and encode chunks that are not known yet."""
        array = pa.array(chunks, pa.string())
        letters = pc.match_substring_regex(array, f"^\n?[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        marks = re.escape("".join(self.marks))
        marked = pc.match_substring_regex(array, f"^\n?[{_LETTERS}]+[{marks}]$").to_numpy(zero_copy_only=False) if marks else np.zeros(len(chunks), bool)
        if not self.byte_level:  # a line feed is white space like any other there
            fed = pc.starts_with(array, "\n").to_numpy(zero_copy_only=False)
            letters, marked = letters & ~fed, marked & ~fed
        whole = [chunks[i] for i in np.flatnonzero(letters)]
        composed = [chunks[i] for i in np.flatnonzero(marked)]
        rest = [chunks[i] for i in np.flatnonzero(~letters & ~marked)]
        for c in chunks:
            self.number[c] = self.numbered
            self.numbered += 1
        for c in composed:  # cores that no text held by themselves
            if c[:-1] not in self.number:
                self.number[c[:-1]] = self.numbered
                self.numbered += 1
                whole.append(c[:-1])
        self._letters(whole)
        self._others(rest)
        if composed:
            self._compose(composed)

    def _numbers(self, values: pa.Array) -> np.ndarray:
        """The number of each chunk; new ones are encoded."""
        coded = values.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [c for c in different if c not in self.number]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, different), np.int64, len(different))
        self.met[numbers] += 1
        return numbers[coded.indices.to_numpy()]

    def _first_numbers(self, chunks: list[str]) -> np.ndarray:
        """First chunks of texts have nothing before them, so they are numbered apart at the byte level."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.first_number]
        for c in new:
            self.first_number[c] = self.numbered
            self.numbered += 1
        self._single([self.first_number[c] for c in new], new)
        numbers = np.fromiter(map(self.first_number.__getitem__, chunks), np.int64, len(chunks))
        self.met[np.unique(numbers)] += 1
        return numbers

    def _split(self, texts: list[str] | pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts in a row, and where each text's begin."""
        array = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.byte_level:
            awkward = pc.match_substring_regex(array, _AWKWARD).to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(pc.replace_substring(array, "\n", " \n"), " ")
            if awkward.any():
                parts, sizes = [], []
                at = 0
                ends = cut.offsets.to_numpy()
                for i in np.flatnonzero(awkward):  # rows between awkward ones stay as Arrow cut them
                    parts += [cut.values.slice(ends[at], ends[i] - ends[at]), pa.array(_SAFE.split(array[i].as_py()), pa.string())]
                    sizes += [np.diff(ends[at : i + 1]), [len(parts[-1])]]
                    at = i + 1
                parts.append(cut.values.slice(ends[at], ends[-1] - ends[at]))
                sizes.append(np.diff(ends[at:]))
                return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return cut.values, cut.offsets.to_numpy()
        array = pc.if_else(pc.match_substring_regex(array, _LOWERED), pc.utf8_lower(array), array)
        cut = pc.split_pattern(pc.replace_substring(array, "\n", " "), " ")
        return cut.values, cut.offsets.to_numpy()

    def _look_up(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if self.numbered > self.limit:
            self._forget()
        chunks, begin = self._split(texts)
        numbers = self._numbers(chunks)
        if self.byte_level:
            heads = begin[:-1]
            numbers[heads] = self._first_numbers(chunks.take(pa.array(heads)).to_pylist())
        return numbers, chunks, begin

    def _gather(self, numbers: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[numbers] - (ends - counts), counts)
        return flat[at], np.concatenate([[0], ends])

    def encode_flat(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and the last ends."""
        numbers, _, begin = self._look_up(texts)
        flat, ends = self._gather(numbers, self.ids)
        return flat, ends[begin]

    def encode_parts(self, texts: list[str] | pa.Array, most: int = 500_000):
        """``lo, hi`` and what ``encode_flat`` gives of the texts from ``lo`` to ``hi``, which hold ``most`` ids at most or are one text."""
        numbers, _, begin = self._look_up(texts)
        before = np.concatenate([[0], np.cumsum(self.count[numbers])])[begin]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + most, "right")) - 1)
            flat, ends = self._gather(numbers[begin[lo] : begin[hi]], self.ids)
            yield lo, hi, flat, ends[begin[lo : hi + 1] - begin[lo]]
            lo = hi

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.encode_flat(texts)
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def token_starts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the character at which each token starts, in order (byte level only)."""
        numbers, chunks, begin = self._look_up(texts)
        flat, ends = self._gather(numbers, self.starts)
        length = pc.utf8_length(chunks).to_numpy() + ~pc.starts_with(chunks, "\n").to_numpy(zero_copy_only=False)
        heads = begin[:-1]
        length[heads] = pc.utf8_length(chunks.take(pa.array(heads))).to_numpy()
        upto = np.cumsum(length) - length
        upto -= np.repeat(upto[heads], np.diff(begin))
        flat = flat + np.repeat(upto, self.count[numbers])
        ends = ends[begin]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def text_batches(texts, size: int = 8_000_000):
    """Slices of a list of texts holding about ``size`` characters each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def array_batches(texts: pa.Array, size: int = 8_000_000):
    """Slices of an array of texts holding at most ``size`` bytes each, or one text."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi
