"""Byte-level BPE of many texts at once: each distinct unit is encoded once and its ids are looked up.

The pre-tokenizer of a byte-level BPE cuts text before it merges anything, so text may be cut beforehand
wherever that pre-tokenizer is sure to cut. Units are found for a whole slice of texts by array operations
on bytes; Arrow's dictionary names the distinct ones (by their bytes, not by a hash), only those not
known yet go through the tokenizers library, and ids of all texts are gathered in one step.

Where a cut isn't sure (characters beyond Latin-1 letters, apostrophes, control characters) none is made
and the longer unit goes to the library as it is. Texts that hold an added token are one unit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Classes of bytes: letters, digits, marks, the apostrophe, the space, other white space; 0 is anything unsure.
LETTER, DIGIT, MARK, QUOTE, BLANK, BREAK = 1, 2, 3, 4, 5, 6
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = MARK
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[ord("'")] = QUOTE
CLASS[9:14] = BREAK
CLASS[32] = BLANK
#: CUT[8 * before + here]: a pre-token surely ends between two bytes of these classes.
CUT = np.zeros(64, bool)
for _a in (LETTER, DIGIT, MARK):
    for _b in (LETTER, DIGIT, MARK):
        CUT[8 * _a + _b] = _a != _b
for _a in (LETTER, DIGIT, MARK, QUOTE):
    CUT[8 * _a + BLANK] = CUT[8 * _a + BREAK] = CUT[8 * BREAK + _a] = True
CUT[8 * LETTER + QUOTE] = CUT[8 * DIGIT + QUOTE] = True
#: A word of these letters, after a space or not.
WORD = re.compile(rb" ?(?=.)[A-Za-z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][A-Za-z]*)*", re.DOTALL)


def _spelling() -> np.ndarray:
    """The public byte-to-character rule of byte-level BPE: printable bytes stand for themselves, others for
    characters from 256 on; here the new line stays, it parts words."""
    own = np.zeros(256, bool)
    own[33:127] = own[161:173] = own[174:256] = True
    out = np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u4")
    out[10] = 10
    return out


SPELT = _spelling()
#: Units of at most LONG bytes are kept between calls, KEPT of them at most (a dictionary doubles beyond 1,398,101);
#: words that go to the merging model in one call.
LONG, KEPT, JOINED = 128, 1_300_000, 300


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in ``data``, the bytes of texts that begin at ``offsets[:-1]``; text starts are unit starts.

    A run of white space before a known character gives up its last character: a space belongs to what
    follows, any other stands alone.
    """
    n = len(data)
    kind = CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    # the two-byte letters À to ÿ, without the signs for times and division
    lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)] if len(lead) else lead
    kind[lead] = kind[lead + 1] = LETTER
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1:n] = CUT[(kind[:-1] << np.uint8(3)) | kind[1:]]
    space = kind >= BLANK
    runs = np.flatnonzero(space[1:-1] & space[:-2]) + 1 if n > 2 else np.zeros(0, np.int64)
    known = (kind[runs + 1] > 0) & ~space[runs + 1] if len(runs) else np.zeros(0, bool)
    runs = runs[known]
    begins = offsets[:-1]
    if len(runs):
        runs = runs[~np.isin(runs + 1, begins)]
        cut[runs] = True
    cut[begins] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of texts by a vocabulary file of the tokenizers library; ids of short units are kept between calls."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        shape = json.loads(self.tok.to_str())
        before = shape.get("pre_tokenizer") or {}
        self.cuts = shape.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and shape.get("truncation") is None and (shape.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
        self.parting = _parting(shape["model"]) if self.cuts else None
        self.merging = Tokenizer(self.tok.model)  # the same model behind no pre-tokenizer
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)  # row k has ids[at[k] : at[k + 1]]

    def put(self, row: int, ids: np.ndarray, size: np.ndarray) -> None:
        """Ids of rows from ``row`` on."""
        begin = int(self.at[row])
        ends = begin + np.cumsum(size)
        while len(self.at) < row + len(size) + 1:
            self.at = np.concatenate((self.at, np.zeros(len(self.at), np.int64)))
        while len(self.ids) < int(ends[-1]):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.at[row + 1 : row + len(size) + 1] = ends
        self.ids[begin : int(ends[-1])] = ids

    def library(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of units, number of ids of each). Words are single pre-tokens: they go to the vocabulary's merging model itself."""
        fits = WORD.fullmatch
        word = np.fromiter((self.cuts and fits(u) is not None for u in units), bool, len(units))
        size = np.zeros(len(units), np.int64)
        parts = []
        if word.any():
            found, size[word] = self.merged([u for u, w in zip(units, word.tolist(), strict=True) if w])
            parts.append((word, found))
        if not word.all():
            found, size[~word] = _flat([e.ids for e in self.tok.encode_batch_fast([u.decode() for u, w in zip(units, word.tolist(), strict=True) if not w], add_special_tokens=False)])
            parts.append((~word, found))
        if len(parts) == 1:
            return parts[0][1], size
        ids = np.zeros(int(size.sum()), np.uint32)
        for at, found in parts:
            ids[np.repeat(at, size)] = found
        return ids, size

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``library`` for words: many at once, parted by a character that the vocabulary never merges, if it has one."""
        if self.parting is None:
            merge = self.tok.model.tokenize
            spelt = SPELT[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            return _flat([[t.id for t in merge(w)] for w in spelt])
        letters, parting = SPELT.copy(), self.parting[1]
        letters[10] = ord(self.parting[0])
        parts = []
        for k in range(0, len(words), JOINED):
            text = letters[np.frombuffer(b"\n".join([*words[k : k + JOINED], b""]), np.uint8)].tobytes().decode("utf-32-le")
            parts.append(np.array(self.merging.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        found = np.concatenate(parts)
        own = found != parting
        return found[own], np.diff(np.flatnonzero(~own), prepend=-1) - 1

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each) of texts whose UTF-8 bytes are data[offsets[k]:offsets[k + 1]]."""
        full = np.diff(offsets) > 0
        begins = offsets[:-1][full]
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = unit_starts(data, np.append(begins, len(data))) if self.cuts else begins
        raw = data.tobytes()
        whole = [k for token in self.added for k in _places(raw, token)]
        if whole:
            rows = np.unique(np.searchsorted(begins, whole, "right") - 1)
            inside = np.isin(np.searchsorted(begins, starts, "right") - 1, rows) & ~np.isin(starts, begins)
            starts = starts[~inside]
        edges = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        row, unit = self.numbers(distinct), np.asarray(units.indices)
        size = (self.at[row + 1] - self.at[row])[unit]
        ends = np.cumsum(size)
        take = np.repeat(self.at[row][unit] - ends + size, size)
        take += np.arange(len(take))
        first = np.searchsorted(starts, begins)
        count = np.zeros(len(offsets) - 1, np.int64)
        count[full] = np.add.reduceat(size, first)
        return self.ids[take], count

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Rows of units; long ones stand behind the kept rows until the next call."""
        row = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(row < 0)
        new = [distinct[k] for k in missing]
        if len(self.rows) + len(new) > KEPT and self.rows:
            self.forget()
            return self.numbers(distinct)
        short = np.fromiter((len(u) <= LONG for u in new), bool, len(new))
        new = [u for u, s in zip(new, short, strict=True) if s] + [u for u, s in zip(new, short, strict=True) if not s]
        if new:
            n = len(self.rows)
            self.put(n, *self.library(new))
            row[np.concatenate((missing[short], missing[~short]))] = np.arange(n, n + len(new))
            self.rows.update(zip(new[: int(short.sum())], range(n, n + int(short.sum())), strict=True))
        return row

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [t.encode() for t in texts]
        ids, count = self.flat(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))
        ends = np.cumsum(count)
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), count.tolist(), strict=True)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size


def _parting(model: dict) -> tuple[str, int] | None:
    """(character, id) of a byte that words don't hold and no merge does, so that words on its two sides are merged as if alone."""
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merged = {c for pair in model["merges"] for c in (pair if isinstance(pair, str) else "".join(pair))}
    for b in [*range(10), *range(11, 32), *range(33, 65), *range(192, 256)]:
        c = chr(SPELT[b])
        if b != 0xC3 and c not in merged and c in model["vocab"]:
            return c, model["vocab"][c]
    return None


def _places(raw: bytes, token: bytes) -> list[int]:
    out, at = [], raw.find(token)
    while at >= 0:
        out.append(at)
        at = raw.find(token, at + 1)
    return out


#: Encoders by vocabulary file, kept between the tasks of a worker.
_KEPT: dict[str, Encoder] = {}


def hub_encoder(path: str) -> Callable[[], Encoder]:
    """Maker of a worker's encoder for a vocabulary file."""

    def make() -> Encoder:
        if path not in _KEPT:
            _KEPT[path] = Encoder(path)
        return _KEPT[path]

    return make
