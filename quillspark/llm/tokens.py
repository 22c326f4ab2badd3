"""Encoding of whole Arrow columns with a public tokenizer file.

Plain texts (letters up to U+024F, digits, ASCII marks, lone spaces and line
breaks) are cut into pre-tokens with numpy, a block of texts at a time.  A
pre-token's ids come from a direct-mapped table; only those not in it go to the
merge model of the ``tokenizers`` library.  Every other text goes through the
library's whole pipeline.  Tables are per worker and of bounded size.
"""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .bpe import byte_alphabet
from .wordvec import _POW, blocks, mix

#: Slots of the table of known pre-tokens, and ids it may hold.
SLOTS = 1 << 20
POOL = 1 << 23

_LETTER, _DIGIT, _MARK, _SPACE, _BREAK = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)  # 0: not plain
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
_CLASS[32], _CLASS[10] = _SPACE, _BREAK
#: First bytes of U+0080..U+00BF and of everything from U+0280 on.
_FAR = np.zeros(256, bool)
_FAR[[0xC2, *range(0xCA, 256)]] = True
_LOADED: dict[str, "ColumnEncoder"] = {}


class ColumnEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.library.get_vocab_size()
        self.style = _style(spec)
        self.specials = [np.frombuffer(t["content"].encode()[:2], np.uint8) for t in spec.get("added_tokens", [])]
        self.model = self.library.model
        self.stand_in = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at, self.len = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def encode(self, column: pa.Array):
        """Yield ``(row, ids)`` in row order; null counts as empty."""
        for base, buf, offs in blocks(column):
            plain, ids, cuts = self._block(buf, offs)
            for i in range(len(offs) - 1):
                if plain[i]:
                    yield base + i, ids[cuts[i] : cuts[i + 1]]
                else:
                    text = buf[offs[i] : offs[i + 1]].tobytes().decode()
                    yield base + i, np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _block(self, buf: np.ndarray, offs: np.ndarray):
        rows = len(offs) - 1
        if self.style == "whole" or not len(buf):
            return np.diff(offs) == 0, np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        cls = _CLASS[buf]
        odd = (cls == 0) | _FAR[buf]
        odd[:-1] |= (buf[:-1] == 0xC9) & (buf[1:] > 0x8F)
        odd[:-1] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        odd[:-1] |= (buf[:-1] == 0xC4) & (buf[1:] == 0xB0)
        for pair in self.specials:
            odd[:-1] |= (buf[:-1] == pair[0]) & (buf[1:] == pair[-1])
        heads = offs[:-1][np.diff(offs) > 0]
        gap = cls >= _SPACE
        if self.style == "bytes":  # white space must stand alone, and not last
            odd[:-1] |= gap[:-1] & gap[1:]
            odd[offs[1:][np.diff(offs) > 0] - 1] |= gap[offs[1:][np.diff(offs) > 0] - 1]
            start = gap.copy()
            start[1:] |= (cls[1:] != cls[:-1]) & (cls[:-1] != _SPACE)
            start[heads] = True
        else:  # white space is dropped, digits stand alone
            start = cls == _DIGIT
            start[1:] |= cls[1:] != cls[:-1]
            start[heads] = True
            start &= ~gap
        bad = np.zeros(rows, bool)
        where = np.flatnonzero(odd)
        bad[np.searchsorted(offs, where, "right") - 1] = True
        ws = np.flatnonzero(start)
        first = np.searchsorted(ws, offs)
        if not len(ws):
            return ~bad, np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        pos = np.arange(len(buf), dtype=np.int32)
        pos[ws[0] :] -= np.repeat(ws, np.diff(np.append(ws, len(buf)))).astype(np.int32)
        long = np.flatnonzero(pos >= len(_POW))
        power = _POW[np.minimum(pos, len(_POW) - 1)]
        if len(long):
            power[long] = mix(pos[long].astype(np.uint64)) | np.uint64(1)
        value = buf.astype(np.uint64) + np.uint64(1)
        if self.style == "words":
            value[gap] = 0
        key = mix(np.add.reduceat(value * power, ws)) | np.uint64(1)
        # words of texts that are not plain are not looked up
        word_row = np.repeat(np.arange(rows), np.diff(first))
        ok = ~bad[word_row]
        if self.used > POOL // 2:
            self._clear()
        slot = ((key >> np.uint64(17)) & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == key
        at, length = self.at[slot], self.len[slot]
        miss = np.flatnonzero(~hit & ok)
        if len(miss):
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            ends = np.append(ws[1:], len(buf))
            new_at, new_len = np.zeros(len(one), np.int64), np.zeros(len(one), np.int32)
            for k, w in enumerate(miss[one]):
                ids = self._ids(buf[ws[w] : ends[w]].tobytes())
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.append(self.pool, np.zeros(max(POOL, len(ids)), np.uint32))
                self.pool[self.used : self.used + len(ids)] = ids
                new_at[k], new_len[k] = self.used, len(ids)
                self.used += len(ids)
            at[miss], length[miss] = new_at[back], new_len[back]
            s = slot[miss[one]]
            self.keys[s], self.at[s], self.len[s] = key[miss[one]], new_at, new_len
        length = np.where(ok, length, 0)
        total = np.append(0, np.cumsum(length, dtype=np.int64))
        ids = self.pool[np.repeat(at - total[:-1], length) + np.arange(total[-1])]
        return ~bad, ids, total[first]

    def _ids(self, word: bytes) -> list[int]:
        if self.style == "words":
            word = word.strip(b" \n").decode().lower().encode()
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.stand_in))]


def _style(spec: dict) -> str:
    """``bytes``: plain byte-level file; ``words``: lower case, white space
    dropped, single digits; ``whole``: anything else."""
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or any(len(t["content"]) < 2 or t["content"][:2].isalnum() for t in spec.get("added_tokens", [])):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "bytes"
    if pre.get("type") == "Sequence" and model.get("end_of_word_suffix") and norm:
        split = pre["pretokenizers"][0]
        if split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and "[\\p{N}]|" in split["pattern"].get("Regex", ""):
            return "words"
    return "whole"


def encoder(path: str) -> ColumnEncoder:
    """The encoder of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ColumnEncoder(path)
    return _LOADED[path]
