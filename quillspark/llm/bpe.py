"""Byte-level BPE as a streaming transducer.

The pre-tokeniser is a state machine over character classes and the merges run
on a window of bytes.  :func:`sufficient_lookahead` computes from the merge list
how many bytes to the right can still change a token, so a window emits every
token that ends that far before its end and keeps the rest: memory is bounded by
the window however long a text or a run of letters is.  Decoding is a state
machine as well: bytes in, text out, with at most three bytes carried over.

Words repeat, so whole words (pieces cut at lone spaces) also go through a
bounded cache of their ids.
"""
from __future__ import annotations

import heapq
import json
import re
import struct
from bisect import bisect_left

import numpy as np

#: Bytes of a pre-token that are merged at once, at least.
WINDOW = 2048
#: Characters fed to the transducer at once.
CHUNK = 1 << 16
_NEVER = 1 << 60
#: Entries of a generation of the caches of pieces and of words.
CACHE = 120_000
LONGEST = 128

_AWKWARD = re.compile(r"\s | \s")
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of plain letters, digits and marks, and their pre-tokens: what the
#: state machine would give, found by a pattern.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(rf" ?[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*")
_PARTS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
_LOADED: dict[str, "Bpe"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 characters stand
    for themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: list[int]) -> int:
    """Bytes after a token that can still decide whether it stays.

    ``merges`` lists ``(left, right, result)`` by rank, ``size`` bytes by token.
    A token x is lost to the right when a merge (s, d) applies first, s being a
    token on x's right edge while x forms, which in turn needs d to form and to
    survive to its right until then.  Ranks fall along such a chain, so one pass
    over the ranks adds up its longest extent.
    """
    made = {m[2]: r for r, m in reversed(list(enumerate(merges)))}
    ranks: dict[int, list[int]] = {}  # left token -> ranks seen, and the running maximum of extents
    reach: dict[int, list[int]] = {}

    def extent(token: int, before: int) -> int:
        """Bytes from the start of ``token`` that decide it up to ``before``."""
        far, at, until = 0, token, before
        while True:
            known = ranks.get(at)
            if known and (i := bisect_left(known, until)):
                far = max(far, reach[at][i - 1])
            if at not in made or made[at] >= until:
                return size[token] + far
            until, at = made[at], merges[made[at]][1]

    most = 0
    for rank, (left, right, _) in enumerate(merges):
        e = extent(right, rank)
        ranks.setdefault(left, []).append(rank)
        reach.setdefault(left, []).append(max(e, reach[left][-1]) if reach.get(left) else e)
        most = max(most, e)
    return most


class Generations(dict):
    """A bounded cache of ``make(key)``: a full generation becomes the old one,
    what is used again moves to the new one."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Bpe:
    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * top
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.rank_of = {pair: r for pair, (r, _) in self.rank.items()}
        self.made = [vocab[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], [len(x) for x in self.bytes])
        self.window = max(WINDOW, 4 * self.lookahead)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest_special = max([1, *map(len, self.special)])
        self._classes: dict[str, str] = {}
        self._probe = ByteLevel(add_prefix_space=False)
        self.words = Generations(CACHE, self._word)
        self.pieces = Generations(CACHE, self._piece)
        self.spaced = Generations(CACHE, lambda piece: self._piece(" " + piece))

    # -- merges ---------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Ids of a byte string, lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, made = self.rank_of.get, self.made
        ranks = [get(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            at, new = ranks.index(best), made[best]
            ids[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], new), _NEVER)
            if at < len(ranks):
                ranks[at] = get((new, ids[at + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if r := rank.get((new, ids[nxt[j]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[nxt[j]]))
            if (p := prv[i]) >= 0 and (r := rank.get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, r[1], ids[p], new))
        return [x for x in ids if x >= 0]

    # -- pre-tokeniser --------------------------------------------------
    def klass(self, c: str) -> str:
        """L letter, N number, S white space, O other, as the library's own
        tables have it (asked once per character)."""
        k = self._classes.get(c)
        if k is None:
            one = lambda s: len(self._probe.pre_tokenize_str(s)) == 1
            k = "L" if one("a" + c) else "N" if one("1" + c) else "O" if one("!" + c) else "S"
            self._classes[c] = k
        return k

    def fragments(self, text: str, last: bool):
        """``(pre-token text, whether it ends here)``; a pre-token may come in
        several parts.  Without ``last`` the unread rest is returned as
        ``(rest, None)`` because more text decides it."""
        i, n = 0, len(text)
        while i < n:
            if not last and n - i < 4:
                break
            c = text[i]
            if c == "'":
                two = text[i : i + 3]
                if two[1:3] in ("re", "ve", "ll"):
                    yield two, True
                    i += 3
                    continue
                if two[1:2] in ("s", "t", "m", "d") and two[1:2]:
                    yield two[:2], True
                    i += 2
                    continue
            k = self.klass(c)
            j = i + 1
            if k == "S":
                if c == " " and j < n and (k2 := self.klass(text[j])) != "S":
                    k, j = k2, j + 1
                else:
                    while j < n and self.klass(text[j]) == "S":
                        j += 1
                    if j == n and not last:
                        if j - i > 64:  # a run of white space: all but its last character is one pre-token
                            yield text[i : j - 4], False
                            i = j - 4
                        break
                    if j < n and j - i > 1:
                        j -= 1
                    yield text[i:j], True
                    i = j
                    continue
            while j < n and self.klass(text[j]) == k:
                j += 1
            if j == n and not last:
                if j - i > 8:
                    yield text[i:j], False
                    i = j
                break
            yield text[i:j], True
            i = j
        if not last:
            yield text[i:], None

    # -- encoder --------------------------------------------------------
    def _word(self, text: str) -> bytes:
        ids = self.merge(text.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, text: str) -> bytes:
        """Ids of a whole piece (LONGEST characters at most)."""
        if _SIMPLE.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _PARTS.findall(text)))
        return b"".join([self.words[p] for p, _ in self.fragments(text, True)])


class Encoder:
    """``feed(text)`` and ``finish()`` yield ids (little-endian u32) as soon as
    nothing that may follow can change them."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.rest, self.run, self.buffer = bpe, "", None, b""

    def feed(self, text: str, last: bool = False):
        text, bpe = self.rest + text, self.bpe
        self.rest = ""
        if bpe.cut is None:
            yield from self._plain(text, last)
            return
        hold = 0 if last else bpe.longest_special - 1
        at = 0
        for m in bpe.cut.finditer(text):
            yield from self._plain(text[at : m.start()], True)
            yield np.array([bpe.special[m[0]]], "<u4").tobytes()
            at = m.end()
        text = text[at:]
        if hold:  # the start of a special token may stand at the end
            for k in range(min(hold, len(text)), 0, -1):
                if any(s.startswith(text[-k:]) for s in bpe.special):
                    yield from self._plain(text[:-k], False)
                    self.rest += text[-k:]
                    return
        yield from self._plain(text, last)

    def finish(self):
        yield from self.feed("", True)

    def _plain(self, text: str, last: bool):
        bpe = self.bpe
        if self.run is not None:  # inside a long pre-token
            i = 0
            while i < len(text) and bpe.klass(text[i]) == self.run:
                i += 1
            if self.run == "S" and not (i == len(text) and last):
                i -= 1  # the last one belongs to what follows
                if i == len(text) - 1:
                    yield from self._bytes(text[:i], False)
                    self.rest = text[i:]
                    return
            yield from self._bytes(text[:i], i < len(text) or last)
            if i == len(text) and not last:
                return
            self.run, text = None, text[i:]
        if not text:
            return
        if _AWKWARD.search(text):
            pieces = _LONE.split(text)
        else:
            pieces = text.split(" ")
        tail = None if last else pieces.pop()  # what follows may belong to it
        if pieces and max(map(len, pieces)) <= LONGEST:
            yield bpe.pieces[pieces[0]] + b"".join(map(bpe.spaced.__getitem__, pieces[1:]))
        else:
            for k, p in enumerate(pieces):
                if len(p) > LONGEST:
                    yield from self._stream((" " + p) if k else p, True)
                else:
                    yield bpe.spaced[p] if k else bpe.pieces[p]
        if tail is not None:
            yield from self._stream((" " + tail) if pieces else tail, False)

    def _stream(self, text: str, last: bool):
        for part, ended in self.bpe.fragments(text, last):
            if ended is None:
                self.rest = part
            else:
                yield from self._bytes(part, ended)
                if not ended:
                    self.run = self.bpe.klass(part[-1])

    def _bytes(self, part: str, ended: bool):
        """Bytes of one pre-token, whole or in parts, through the window."""
        bpe, data = self.bpe, part.encode()
        at = 0
        while len(self.buffer) + len(data) - at > bpe.window:
            take = bpe.window - len(self.buffer)
            self.buffer += data[at : at + take]
            at += take
            yield self._stable()
        self.buffer += data[at:]
        if ended and self.buffer:
            ids, self.buffer = bpe.merge(self.buffer), b""
            yield np.array(ids, "<u4").tobytes()

    def _stable(self) -> bytes:
        bpe = self.bpe
        safe, done, out = len(self.buffer) - bpe.lookahead, 0, []
        for i in bpe.merge(self.buffer):
            if done + len(bpe.bytes[i]) > safe:
                break
            done += len(bpe.bytes[i])
            out.append(i)
        self.buffer = self.buffer[done:]
        return np.array(out, "<u4").tobytes()


class Decoder:
    """Ids to text: ``feed`` returns the text that is complete, bytes of an
    unfinished character (three at most) wait for the next call; what is not
    UTF-8 becomes U+FFFD, one for each maximal part."""

    def __init__(self, bpe: Bpe):
        self.table, self.held = bpe.bytes, b""

    def feed(self, ids: bytes) -> str:
        data = self.held + b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        cut = len(data) - _unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


def _unfinished(data: bytes) -> int:
    """Length of the started but unfinished character at the end."""
    for back in range(1, min(3, len(data)) + 1):
        b = data[-back]
        if b >= 0xC0:
            return back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
        if b < 0x80:
            return 0
    return 0


def load(path: str) -> Bpe:
    """The transducer's tables, built once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(bpe: Bpe, text: str | None):
    """Ids of a text, chunk by chunk."""
    enc, text = Encoder(bpe), text or ""
    for at in range(0, len(text), CHUNK):
        yield from enc.feed(text[at : at + CHUNK])
    yield from enc.finish()
