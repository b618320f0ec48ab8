"""Exact token ids at the speed of a dictionary: texts are cut where the tokenizer always cuts, and each distinct piece
is encoded by its library once."""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .text import mix

#: Distinct pieces that one worker remembers; then only those that came back are kept. A full table takes about 60 MB.
PIECES = 1_000_000
#: Bytes of text that are cut and looked up together, and the longest piece that is remembered.
BLOCK, LONGEST = 1 << 18, 64

_BLANKS = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_BLANK = np.zeros(256, dtype=bool)
_ASCII_BLANK[[32, *range(9, 14)]] = True
_IS_LETTER, _IS_PUNCT = np.uint8(1), np.uint8(2)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(string.ascii_letters.encode())] = _IS_LETTER
_CLASS[list(string.punctuation.encode())] = _IS_PUNCT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = 21


class _Hashes:
    """Two independent 64-bit hashes of any slices of a block, from running sums of random byte values."""

    def __init__(self):
        rng = np.random.default_rng(99)
        self.bytes = rng.integers(0, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) <= len(data):
            n = 1 << int(len(data)).bit_length()
            base = 0xD1342543DE82EF95
            for name, r in (("powers", base), ("inverses", pow(base, -1, 1 << 64))):
                setattr(self, name, np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n - 1, r, dtype=np.uint64))]))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        out = []
        for values in self.bytes:
            np.cumsum(values.take(data) * self.powers[: len(data)], out=sums[1:])
            h = (sums.take(end) - sums.take(start)) * self.inverses.take(start) + (end - start).astype(np.uint64)
            out.append(mix(h))
        return np.maximum(out[0], np.uint64(1)), out[1]


class _Table:
    """Pieces by their two hashes in open addressing, looked up side by side; the ids of all pieces lie in one pool."""

    def __init__(self, dtype: str):
        self.dtype = np.dtype(dtype)
        self.key, self.at = np.zeros(1 << _BITS, dtype=np.uint64), np.zeros(1 << _BITS, dtype=np.int32)
        self._clear()

    def _clear(self) -> None:
        self.key[:] = 0
        self.n = 0
        self.first, self.second = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)
        self.off, self.len, self.uses = (np.zeros(1024, dtype=np.int32) for _ in range(3))
        self.pool, self.end = np.zeros(4096, dtype=self.dtype), 0

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entries of the pieces, -1 where there is none."""
        slot = (first >> np.uint64(64 - _BITS)).view(np.int64)
        out = np.full(len(first), -1, dtype=np.int64)
        open_ = np.arange(len(first))
        while len(open_):
            key = self.key.take(slot[open_])
            same = np.flatnonzero(key == first[open_])
            hit = open_[same]
            entry = self.at.take(slot[hit]).astype(np.int64)
            out[hit] = np.where(self.second.take(entry) == second[hit], entry, -2)
            open_ = open_[(key != 0) & (key != first[open_])]
            slot[open_] = (slot[open_] + 1) & ((1 << _BITS) - 1)
        return out

    def _room(self, n: int, ids: int) -> None:
        for name, need in (("first", n), ("second", n), ("off", n), ("len", n), ("uses", n), ("pool", ids)):
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(max(need, 2 * len(old)), dtype=old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def add(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray, ids: np.ndarray, uses: np.ndarray | None = None) -> None:
        """Enter distinct new pieces."""
        n = len(first)
        self._room(self.n + n, self.end + len(ids))
        entry = np.arange(self.n, self.n + n)
        self.first[entry], self.second[entry], self.len[entry] = first, second, sizes
        self.off[entry] = self.end + np.cumsum(sizes) - sizes
        self.uses[entry] = 0 if uses is None else uses
        self.pool[self.end : self.end + len(ids)] = ids
        self.n, self.end = self.n + n, self.end + len(ids)
        slot, todo = (first >> np.uint64(64 - _BITS)).view(np.int64).copy(), np.arange(n)
        while len(todo):
            free = todo[self.key[slot[todo]] == 0]
            self.key[slot[free]] = first[free]  # of several in one slot the last stays
            mine = free[self.key[slot[free]] == first[free]]
            self.at[slot[mine]] = entry[mine]
            todo = np.setdiff1d(todo, mine, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << _BITS) - 1)

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after the other, and how many each has."""
        size = self.len.take(entry).astype(np.int64)
        end = np.cumsum(size)
        place = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.off.take(entry) - (end - size), size)
        return self.pool.take(place), size

    def shrink(self) -> None:
        """Keep the pieces that came back since they were entered, if they leave room; else begin anew."""
        keep = np.flatnonzero(self.uses[: self.n] > 1)
        if len(keep) > PIECES // 2:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: PIECES // 2]]
        ids, sizes = self.ids(keep)
        first, second = self.first[keep], self.second[keep]
        self._clear()
        self.add(first, second, sizes, ids)


class TokenStream:
    """Ids of whole texts as the ``tokenizers`` library gives them, without added special tokens.

    Special strings inside a text are recognised as the library does by default. Texts in which cutting at spaces might
    change a result (special strings, runs of blanks, control characters) go to the library whole, as do all texts of
    tokenizers whose rules are not known to allow cuts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            raw = f.read()
        self.version = hashlib.sha256(raw).hexdigest()
        self.library = Tokenizer.from_str(raw.decode("utf-8"))
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.specials = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        #: What every special string begins with; texts without it hold none.
        self.mark = os.path.commonprefix(self.specials)
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.n_ids <= 1 << 16 else "<u4"
        self.kind = _kind(raw)
        self.table, self.hashes = _Table(self.dtype), _Hashes()

    def _whole(self, text: str) -> bytes:
        return np.array(self._library(text), dtype=self.dtype).tobytes()

    def _library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _token(self, shown: str) -> list[int]:
        """The ids of one pre-token, by the library's BPE model; non-ASCII text stands in its byte alphabet."""
        if not shown.isascii():
            shown = shown[:1].replace("\u0120", " ") + shown[1:]
            shown = shown.encode("utf-8").decode("latin-1").translate(_ALPHABET)
        return [t.id for t in self.model.tokenize(shown)]

    def _piece(self, piece: str) -> list[int]:
        """The ids of any piece: those of one word of letters by the model, of all others by the whole library."""
        lead = self.kind == "bytes" and piece[0] == " "
        core = piece[1:] if lead else piece
        if not core.isalpha():
            return self._library(piece)
        if self.kind == "words":
            low = unicodedata.normalize("NFC", core).lower()
            return self._token(low) if low.isalpha() and "\u03a3" not in core else self._library(piece)
        return self._token(("\u0120" if lead else "") + core)

    def _plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pieces are ASCII letters, after a blank if the tokenizer keeps it."""
        letters = np.concatenate([[0], np.cumsum(_CLASS.take(data) == _IS_LETTER)])
        first = start + (data.take(start) == 32)
        return (letters.take(end) - letters.take(first) == end - first) & (end > first)

    def _may_cut(self, text: str) -> bool:
        if self.kind == "whole" or self.mark in text and any(s in text for s in self.specials):
            return False
        if self.kind == "words":
            return True
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _blank(text))

    def _slices(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of texts that lie one after the other, from ``edge`` to ``edge``; none is empty or crosses an edge."""
        kind = _CLASS.take(data)
        turn = np.flatnonzero((kind[:-1] << np.uint8(1)) & kind[1:]) + 1  # pre-tokens end where letters meet punctuation
        mark = np.zeros(len(data) + 1, dtype=bool)
        mark[edge] = mark[turn] = True
        if self.kind == "words":
            blank = _ASCII_BLANK.take(data)
            mark[:-1] |= blank
            mark[1:] |= blank
            cut = np.flatnonzero(mark)
            start, end = cut[:-1], cut[1:]
            real = ~blank.take(start)
            return start[real], end[real]
        line = np.flatnonzero(data == 10)  # a blank goes with what follows, a line end stands alone
        mark[:-1] |= data == 32
        mark[line] = mark[line + 1] = True
        cut = np.flatnonzero(mark)
        return cut[:-1], cut[1:]

    def ids_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned integers of type ``dtype``; a null text is an empty one."""
        out: list[np.ndarray] = [np.zeros(0, dtype=self.dtype)] * len(texts)
        held, raw, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._may_cut(text):
                out[i] = np.frombuffer(self._whole(text), dtype=self.dtype)
                continue
            held.append(i)
            raw.append(text.encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            if size >= BLOCK:
                for j, ids in zip(held, self._block(raw)):
                    out[j] = ids
                held, raw, size = [], [], 0
        if raw:
            for j, ids in zip(held, self._block(raw)):
                out[j] = ids
        return out

    def _block(self, raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if self.kind == "words":
            data = _LOWER.take(data)  # this tokenizer lower-cases
        edge = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        start, end = self._slices(data, edge)
        if not len(start):
            return [np.zeros(0, dtype=self.dtype)] * len(raw)
        if self.table.n > PIECES:
            self.table.shrink()
        first, second = self.hashes.of(data, start, end)
        entry = self.table.find(first, second)
        entry[end - start > LONGEST] = -2
        new = np.flatnonzero(entry == -1)
        if len(new):
            order = new[np.argsort(first[new], kind="stable")]
            one = order[np.append(True, np.diff(first[order].view(np.int64)) != 0)]
            made = self._make(data, start[one], end[one])
            sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            self.table.add(first[one], second[one], sizes, np.fromiter(chain.from_iterable(made), dtype=self.dtype, count=int(sizes.sum())))
            entry[new] = self.table.find(first[new], second[new])
        odd = np.flatnonzero(entry < 0)  # too long, or the same first hash as another piece
        known = entry[entry >= 0] if len(odd) else entry
        self.table.uses[known] += 1  # once a block, however often
        ids, size = self.table.ids(np.maximum(entry, 0))
        if len(odd):
            parts = np.split(ids, np.cumsum(size)[:-1])
            for i, made in zip(odd.tolist(), self._make(data, start[odd], end[odd])):
                parts[i] = np.array(made, dtype=self.dtype)
                size[i] = len(made)
            ids = np.concatenate(parts)
        total = np.concatenate([[0], np.cumsum(size)])
        return np.split(ids, total[np.searchsorted(start, edge[1:-1], "left")])

    def _make(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """The ids of pieces, by the library."""
        plain, lead = self._plain(data, start, end), data.take(start) == 32
        low = data.tobytes().decode("latin-1")  # one character a byte: right for plain pieces
        tokenize, raw = self.model.tokenize, data.tobytes()
        out = []
        for s, e, p, b in zip(start.tolist(), end.tolist(), plain.tolist(), lead.tolist()):
            if p:
                out.append([t.id for t in tokenize("\u0120" + low[s + 1 : e] if b else low[s:e])])
            else:
                out.append(self._piece(raw[s:e].decode("utf-8", "surrogatepass")))
        return out

    def ids_packed(self, text: str | None) -> bytes:
        return self.ids_batch([text])[0].tobytes()

    def count(self, text: str | None) -> int:
        return len(self.ids_batch([text])[0])


def _blank(text: str) -> bool:
    """Whether a text has white space other than blanks and line ends."""
    if text.isascii():
        return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return bool(_BLANKS.search(text))


def _alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


_ALPHABET = _alphabet()


def _kind(raw: bytes) -> str:
    """How texts may be cut: "words" if white space only separates, "bytes" for byte-level pieces with their leading
    blank, "whole" for all else."""
    spec = json.loads(raw)
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec["model"]
    odd = model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
    if odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "bytes"
    steps, norms = pre.get("pretokenizers") or [{}], norm.get("normalizers") or []
    split = steps[0]
    words = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") == _WORDS
    rest = [s for s in steps[1:] if s.get("type") != "ByteLevel" or s.get("use_regex") or s.get("add_prefix_space")]
    if words and len(steps) == 2 and not rest and [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"].get("Regex") == r"\s+":
        return "words"
    return "whole"


_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def stream(path: str) -> TokenStream:
    """One stream for each file and process, kept by reused Python workers."""
    return TokenStream(path)
