"""Whole-text tokenization inside tasks, with a bounded cache of encoded chunks.

Text is cut at ASCII white space; the tokenizer maps white space to a space and
never joins across it, so the ids of a text are the ids of its chunks in order.
A chunk seen before is looked up; the cache has two generations, so that frequent
chunks outlive its limit. A new chunk that is a run of Latin letters
between runs of ASCII punctuation is encoded by the tokenizer's own BPE model,
run by run (that is what its normaliser and pre-tokenizer make of it), and runs are
cached in lower case, so a word is encoded once whatever its case and punctuation; every
other chunk, and every text with a control character that only Python calls
white space, goes through the whole tokenizer. ``tests/llm`` compares all three
ways with whole-text encoding.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Most chunks of a generation of a task's cache, and most runs (results do not depend on it).
CACHE_CHUNKS = 300_000

TOKENIZER = "word_bpe_49k.json"

#: Punctuation of a simple chunk after its word, and before it (an apostrophe there may belong to a contraction).
_AFTER = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_BEFORE = _AFTER.replace(b"'", b"")
_ODD = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")


@cache
def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself if printable Latin-1, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _among(some: bytes) -> np.ndarray:
    """Whether each byte is one of ``some``."""
    out = np.zeros(256, bool)
    out[list(some)] = True
    return out


_IS_SPACE, _IS_AFTER, _IS_BEFORE = _among(b" \t\n\v\f\r"), _among(_AFTER), _among(_BEFORE)
_IS_UPPER = _among(bytes(range(0x41, 0x5B)))
_IS_LETTER = _IS_UPPER | _among(bytes(range(0x61, 0x7B)))
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is C3, and those of the capitals among them.
_IS_LATIN = _among(bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)))
_IS_LATIN_UPPER = _among(bytes(x for x in range(0x80, 0x9F) if x != 0x97))


def _sums(flags: np.ndarray) -> np.ndarray:
    """Number of set flags before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ``size`` numbers from each ``start``, one stretch after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _parts(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Whether each chunk is a run of Latin letters between punctuation, lengths of prefix, word and suffix of these, their bytes in lower case)."""
    data = np.frombuffer(b" ".join(chunks) + b" ", np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    inner = np.append(-1, np.flatnonzero(~_IS_AFTER[data]))  # the spaces between are neither
    stop = np.maximum(inner[np.searchsorted(inner, end) - 1] + 1, begin)
    inner = np.flatnonzero(~_IS_BEFORE[data])
    start = np.minimum(inner[np.searchsorted(inner, begin)], stop)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & _IS_LATIN[data[1:]]
    other = ~(_IS_LETTER[data] | second)
    other[:-1] &= ~second[1:]
    marked = np.zeros(len(data), bool)
    marked[:-1] = (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # <| may begin a token of its own
    other, marked = _sums(other), _sums(marked)
    simple = (start < stop) & (other[start] == other[stop]) & (marked[begin] == marked[end])
    lower = data + np.where(_IS_UPPER[data] | second & _IS_LATIN_UPPER[data], np.uint8(0x20), np.uint8(0))
    return simple, np.stack([start - begin, stop - start, end - stop], 1)[simple], lower[np.repeat(simple, sizes + 1) & (data != 0x20)]


def _listed(words: pa.Array) -> list[bytes]:
    """The values of a binary array without spaces (one split is several times faster than ``to_pylist``)."""
    if not len(words):
        return []
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    spaced = np.full(edges[-1] - edges[0] + len(words), 0x20, np.uint8)
    place = np.ones(len(spaced), bool)
    place[edges[1:] - edges[0] + np.arange(len(words))] = False
    spaced[place] = np.frombuffer(words.buffers()[2], np.uint8)[edges[0]:edges[-1]]
    return spaced.tobytes().split(b" ")[:-1]


def split_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Runs of bytes other than ASCII white space: (number of each in the distinct ones, these, runs in each text)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[joined]
    first = ~space
    first[1:] &= space[:-1]
    data = joined[~space]
    edges = np.append(np.flatnonzero(first[~space]), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(np.flatnonzero(first), np.concatenate([[0], ends])))
    return words.indices.to_numpy(), _listed(words.dictionary), counts


class Encoder:
    """Encodes texts (UTF-8) to ids; one per worker process and tokenizer file."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        #: The short way holds for a lower-casing byte-level BPE with word ends, as its file must say.
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.short = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("type") == "BPE" and all(
            x["content"].startswith("<|") for x in spec.get("added_tokens", []))
        if not self.short:
            raise ValueError(f"{path}: only tokenizers that drop white space and lower-case are cut into chunks")
        self.letters = _byte_letters()
        self.limit = cache_chunks
        self.runs: dict[bytes, list[int]] = {}  # by lower-case bytes
        self._start()
        self.older, self.older_at, self.older_ids = {}, self.at, self.ids

    def _start(self) -> None:
        """A new generation of chunks."""
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, np.int64)  # end of each chunk's ids in self.ids; the start is the end before
        self.ids = np.zeros(1 << 18, np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32)

    def _run(self, run: bytes) -> list[int]:
        """Ids of a new pre-token in lower case."""
        if len(self.runs) > self.limit:
            self.runs = {}
        form = run.decode() if run.isascii() else run.decode("latin-1").translate(self.letters)
        found = self.runs[run] = [t.id for t in self.model.tokenize(form)]
        return found

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and the number of each."""
        simple, sizes, data = _parts(chunks)
        held, sizes = sizes > 0, sizes.ravel()
        edges = np.append(0, np.cumsum(sizes[sizes > 0])).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        known = [self.runs.get(r) or self._run(r) for r in _listed(runs.dictionary)]
        other = [self.whole.encode(chunks[i].decode("utf-8", "replace"), add_special_tokens=False).ids for i in np.flatnonzero(~simple)]
        count = np.array([len(x) for x in chain(known, other)], np.int64)
        start = np.cumsum(count) - count
        # the pieces of all chunks in order: runs of the simple ones, whole ones of the others
        n = np.ones(len(chunks), np.int64)
        n[simple] = held.sum(1)
        piece, mine = np.zeros(int(n.sum()), np.int64), np.repeat(simple, n)
        piece[mine], piece[~mine] = runs.indices.to_numpy(), len(known) + np.arange(len(other))
        ids = np.array([*chain.from_iterable(known), *chain.from_iterable(other)], self.ids.dtype)[_spread(start[piece], count[piece])]
        return ids, np.diff(np.append(0, np.cumsum(count[piece]))[np.append(0, np.cumsum(n))])

    def _learn(self, new: list[bytes]) -> None:
        """Number new chunks and append their ids."""
        n, place = len(self.known), np.array([self.older.get(c, -1) for c in new], np.int64)
        total, ids, size = int(self.at[n]), self.ids[:0], np.zeros(len(new), np.int64)
        fresh = place < 0
        if fresh.any():
            ids, size[fresh] = self._chunks([c for c, f in zip(new, fresh.tolist()) if f])
        if not fresh.all():
            start = np.zeros(len(new), np.int64)
            start[fresh] = np.cumsum(size[fresh]) - size[fresh]
            old = place[~fresh]
            start[~fresh], size[~fresh] = len(ids) + self.older_at[old], self.older_at[old + 1] - self.older_at[old]
            ids = np.concatenate([ids, self.older_ids])[_spread(start, size)]
        self.known.update(zip(new, range(n, n + len(new))))
        while n + len(new) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while total + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at[n + 1:n + 1 + len(new)] = total + np.cumsum(size)
        self.ids[total:total + len(ids)] = ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self.known) > self.limit:
            self.older, self.older_at, self.older_ids = self.known, self.at, self.ids
            self._start()
        odd = {i: self.whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids
               for i, t in enumerate(texts) if any(c in t for c in _ODD)}
        codes, chunks, counts = split_words([b"" if i in odd else t for i, t in enumerate(texts)] if odd else texts)
        at = np.array([self.known.get(c, -1) for c in chunks], np.int64)
        if new := [chunks[i] for i in np.flatnonzero(at < 0).tolist()]:
            at[at < 0] = len(self.known) + np.arange(len(new))
            self._learn(new)
        at = at[codes]
        start, size = self.at[at], self.at[at + 1] - self.at[at]
        ids = self.ids[_spread(start, size)]
        edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        n_ids = np.diff(edge)
        if odd:
            parts = [np.asarray(odd[i], ids.dtype) if i in odd else ids[edge[i]:edge[i + 1]] for i in range(len(texts))]
            ids, n_ids = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, n_ids


@cache
def encoder(path: str) -> Encoder:
    """This worker's encoder; reused by the tasks it runs."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids as unsigned 32-bit with ``end`` after each text, and the new counts."""
    out = np.full(len(ids) + len(counts), end, "<u4")
    place = np.ones(len(out), bool)
    place[np.cumsum(counts + 1) - 1] = False
    out[place] = ids
    return out, counts + 1
