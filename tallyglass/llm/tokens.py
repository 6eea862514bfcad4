"""Exact tokenization with the ``tokenizers`` library, each different piece once.

A text is cut where no token of the tokenizer can reach across, and the pieces are
looked up in a table, for some megabytes of text at a time; only pieces not seen
before run through the library's own normalizer, pre-tokenizer and model. Prose
repeats its words, so most of the library's work falls away; the ids are the library's.

Where cuts are made: before a space between two other characters, and before a line
end between two characters that aren't white space. Both supported pre-tokenizers end
a pre-token there. Texts with other spacing (two spaces together, or white space beyond
ASCII, which the library may treat otherwise than Python) are encoded whole by the library.

The table is open addressing in flat arrays: a piece of up to 16 bytes is its own key,
so a lookup is exact and takes some 40 bytes of memory; longer pieces are in a dictionary.

Strings of special tokens count as ordinary text (``encode_special_tokens``), as the
README of the tokenizer files has it; a text can't end a document by naming the end token.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

from tallyglass.llm import textcore as tc

#: Pieces in the table, and words and runs of marks in each of two generations of the memo; a full table starts anew.
PIECES, PRETOKENS = 1_000_000, 60_000
#: Text bytes that are looked up at once.
AT_ONCE = 1 << 20
#: White space other than the ASCII kinds, and control characters that Python and Unicode class differently.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
#: A run of ASCII punctuation is one pre-token of both kinds; the apostrophe is left out, it begins contractions.
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
#: Letters and perhaps marks, and perhaps the same again after one line end.
_PLAIN = re.compile(rf"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")


class _Memo:
    """Values by key, computed when missing, forgotten in two generations."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value


class _Table:
    """Spans of a pool of ids by piece: (prefix, bytes), prefixes from 0 to 2."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self._resize(1 << 12)
        self.used = self.size = 0
        self.pool = np.empty(1 << 14, self.dtype)
        self.long: dict[tuple[int, bytes], int] = {}

    def _resize(self, slots: int) -> None:
        self.mask = slots - 1
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.kind = np.zeros(slots, np.uint8)  # 0: free; 1 + prefix + 4 * length
        self.at = np.zeros(slots, np.int64)  # place in the pool << 28 | number of ids

    def _slots(self, low: np.ndarray, high: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The slot of each key, or the complement of the free slot where it would go."""
        spot = (tc.mix(low ^ tc.mix(high + kind.astype(np.uint64))) & np.uint64(self.mask)).astype(np.int64)
        out = np.empty(len(spot), np.int64)
        todo = np.arange(len(spot))
        while len(todo):
            there = self.kind[spot]
            same = (there == kind) & (self.low[spot] == low) & (self.high[spot] == high)
            done = same | (there == 0)
            out[todo[done]] = np.where(same[done], spot[done], ~spot[done])
            keep = ~done
            todo, low, high, kind, spot = todo[keep], low[keep], high[keep], kind[keep], spot[keep] + 1 & self.mask
        return out

    def add_ids(self, ids: list[bytes]) -> np.ndarray:
        """The spans of some strings of ids, which go to the pool."""
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        own = np.frombuffer(b"".join(ids), self.dtype)
        if self.size + len(own) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.size], np.empty(max(self.size, len(own) + (1 << 14)), self.dtype)))
        self.pool[self.size : self.size + len(own)] = own
        at = (self.size + np.cumsum(n) - n) << 28 | n
        self.size += len(own)
        return at

    def put(self, low: np.ndarray, high: np.ndarray, kind: np.ndarray, at: np.ndarray) -> None:
        """Keys that are different from each other and not in the table."""
        if self.used + len(low) > (self.mask + 1) // 2:
            old = np.flatnonzero(self.kind)
            held = self.low[old], self.high[old], self.kind[old], self.at[old]
            slots = self.mask + 1
            while self.used + len(low) > slots // 2:
                slots *= 2
            self._resize(slots)
            self.used = 0
            self.put(*held)
        self.used += len(low)
        while len(low):
            free = ~self._slots(low, high, kind)
            _, first = np.unique(free, return_index=True)  # one of the keys that want a slot gets it
            spot = free[first]
            self.low[spot], self.high[spot], self.kind[spot], self.at[spot] = low[first], high[first], kind[first], at[first]
            rest = np.ones(len(low), bool)
            rest[first] = False
            low, high, kind, at = low[rest], high[rest], kind[rest], at[rest]


class TextEncoder:
    """Ids of whole texts in ``dtype``, equal to ``encode(text, add_special_tokens=False)`` with special strings as ordinary text."""

    def __init__(self, path: str, dtype: str = "<u4", share: float = 1.0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self._code = {2: "H", 4: "I"}[self.dtype.itemsize]
        model = self.tokenizer.model
        self._model = model
        self._normalizer, self._pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self._special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the cut before a space is only known to be safe for these two kinds of pre-tokenizer
        kinds = str(self._pre)
        self._cuts = "ByteLevel" in kinds
        self._spaced = self._cuts and self._normalizer is None
        self._lower = self._normalizer is not None
        self._table = _byte_letters()
        self._space = self._table[32] if self._spaced else ""
        most = max(1000, int(PRETOKENS * share))
        self._pretokens = _Memo(self._tokenize, most // 4)
        self._words = _Memo(lambda w: self._tokenize(self._word(w)), most)
        self._spaced_words = _Memo(lambda w: self._tokenize(self._space + self._word(w)), most)
        self._table_of_pieces = _Table(max(1000, int(PIECES * share)), self.dtype)

    def _tokenize(self, mapped: str) -> bytes:
        return array(self._code, [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> str:
        """A run of letters as the model reads it."""
        if self._lower:
            word = word.lower()
        return word if word.isascii() else word.encode().decode("latin-1").translate(self._table)

    def _plain(self, first: _Memo, plain: re.Match) -> bytes:
        """Letters and marks: the pre-tokens are known by inspection. Keys are plain words, which take the least memory."""
        word, stop, word2, stop2 = plain.groups()
        get = self._pretokens.get
        out = first.get(word)
        if stop:
            out += get(stop)
        if word2:
            out += (get(self._table[10]) if self._spaced else b"") + self._words.get(word2)
            if stop2:
                out += get(stop2)
        return out

    def _piece(self, prefix: int, piece: str) -> bytes:
        """The ids of a piece; ``prefix`` says what stands before it: nothing (0), a space (1) or a line end (2) of its own."""
        if prefix < 2 and piece.isalpha() and piece.isascii():
            return (self._spaced_words if prefix else self._words).get(piece)
        plain = _PLAIN.fullmatch(piece)
        if prefix == 1:
            return self._plain(self._spaced_words, plain) if plain is not None else self._any(" " + piece)
        out = self._plain(self._words, plain) if plain is not None else self._any(piece)
        return out if prefix == 0 else self._pretokens.get(self._table[10]) + out

    def _any(self, piece: str) -> bytes:
        text = self._normalizer.normalize_str(piece) if self._normalizer is not None else piece
        return b"".join([self._pretokens.get(p) for p, _ in self._pre.pre_tokenize_str(text)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    @staticmethod
    def _odd(text: str) -> bool:
        return any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD.search(text) is not None

    def encode(self, text: str) -> bytes:
        """The ids of one text, as little-endian bytes."""
        return self.encode_all([text.encode()])[0].tobytes()

    def encode_all(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts (UTF-8; None is empty), one text after another, and how many each has."""
        counts, ids, i = np.zeros(len(texts), np.int64), [], 0
        while i < len(texts):  # a megabyte or one text at a time
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") < AT_ONCE):
                size += len(texts[j] or b"")
                j += 1
            self._some(texts[i:j], counts[i:j], ids)
            i = j
        return (np.concatenate(ids) if ids else np.zeros(0, self.dtype)), counts

    def _some(self, texts: list[bytes | None], counts: np.ndarray, ids: list[np.ndarray]) -> None:
        run, places = [], []
        for k, raw in enumerate(texts):
            if not raw:
                continue
            if self._cuts and b"  " not in raw:
                text = raw.decode()
                if not self._odd(text) and not any(s in text for s in self._special):
                    for part in _parts(raw.translate(_LOWER_ASCII) if self._lower else raw):
                        run.append(part)
                        places.append(k)
                        if len(part) >= AT_ONCE:
                            self._run(run, places, counts, ids)
                            run, places = [], []
                    continue
            if run:
                self._run(run, places, counts, ids)
                run, places = [], []
            ids.append(np.frombuffer(self.whole(raw.decode()), self.dtype))
            counts[k] = len(ids[-1])
        if run:
            self._run(run, places, counts, ids)

    def _run(self, texts: list[bytes], places: list[int], counts: np.ndarray, ids: list[np.ndarray]) -> None:
        """Texts of plain spacing, by their pieces."""
        data = b"\xff" + b"\xff".join(texts) + b"\xff"
        codes = np.frombuffer(data, np.uint8)
        white = _WHITE[codes]
        line = np.zeros(len(codes), bool)
        line[1:-1] = (codes[1:-1] == 10) & ~white[:-2] & ~white[2:]
        edge = np.flatnonzero((codes == 32) | (codes == 255) | line)
        starts, lengths = edge[:-1] + 1, np.diff(edge) - 1
        prefix = _PREFIX[codes[edge[:-1]]] if self._spaced else np.zeros(len(starts), np.uint8)
        at = self._spans(data, starts, lengths, prefix)
        n = at & (1 << 28) - 1
        np.add.at(counts, places, np.add.reduceat(n, np.flatnonzero(codes[edge[:-1]] == 255)))
        first = np.cumsum(n) - n
        ids.append(self._table_of_pieces.pool[np.repeat((at >> 28) - first, n) + np.arange(int(n.sum()))])

    def _spans(self, data: bytes, starts: np.ndarray, lengths: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The span in the pool of each piece; unknown pieces are made."""
        table = self._table_of_pieces
        if table.used + len(table.long) > table.most:
            table.clear()
        at = np.empty(len(starts), np.int64)
        short = np.flatnonzero(lengths <= 16)
        lanes = np.ndarray((len(data) + 8,), "<u8", data + bytes(16), 0, (1,))
        s, n = starts[short], lengths[short]
        low, high = lanes[s] & tc.lane_mask(n), lanes[s + 8] & tc.lane_mask(n - 8)
        kind = (1 + prefix[short] + 4 * n).astype(np.uint8)
        slots = table._slots(low, high, kind)
        known = slots >= 0
        at[short[known]] = table.at[slots[known]]
        new = np.flatnonzero(~known)
        if len(new):
            keys = np.empty(len(new), [("low", np.uint64), ("high", np.uint64), ("kind", np.uint8)])
            keys["low"], keys["high"], keys["kind"] = low[new], high[new], kind[new]
            _, one, which = np.unique(tc.mix(keys["low"] ^ tc.mix(keys["high"] + keys["kind"].astype(np.uint64))), return_index=True, return_inverse=True)
            if not (keys[one][which] == keys).all():  # two pieces of one hash
                _, one, which = np.unique(keys, return_index=True, return_inverse=True)
            chosen = new[one]
            make = self._piece
            spans = table.add_ids([make(p, data[a:b].decode()) for p, a, b in zip(prefix[short[chosen]].tolist(), s[chosen].tolist(), (s[chosen] + n[chosen]).tolist(), strict=True)])
            table.put(low[chosen], high[chosen], kind[chosen], spans)
            at[short[new]] = spans[which]
        for i in np.flatnonzero(lengths > 16).tolist():
            key = int(prefix[i]), data[starts[i] : starts[i] + lengths[i]]
            span = table.long.get(key)
            if span is None:
                span = self._long(table, *key)
            at[i] = span
        return at

    def _long(self, table: _Table, prefix: int, piece: bytes) -> int:
        span = int(table.add_ids([self._piece(prefix, piece.decode())])[0])
        if len(piece) < 256:  # longer ones hardly come again
            table.long[prefix, piece] = span
        return span


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that begin with a space between two other characters."""
    a = 0
    while len(text) - a > 2 * AT_ONCE:
        cut = _PART.search(text, a + AT_ONCE)
        if cut is None:
            break
        yield text[a : cut.start() + 1]
        a = cut.start() + 1
    yield text[a:]


#: A character that isn't white space, before a space and another such.
_PART = re.compile(rb"[^\x09-\x0d\x20](?= [^\x09-\x0d\x20])")
_LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ASCII white space, and the mark between texts.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, 255])
_PREFIX = np.zeros(256, np.uint8)
_PREFIX[32], _PREFIX[10] = 1, 2


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ENCODERS: dict[tuple[str, str, float], TextEncoder] = {}


def encoder(path: str, dtype: str = "<u4", share: float = 1.0) -> TextEncoder:
    """The process's encoder for a tokenizer file: its memo lives as long as the worker.

    ``share`` scales table and memo (about 100 MB when full): less memory for more work, the ids are the same.
    """
    if (path, dtype, share) not in _ENCODERS:
        _ENCODERS[path, dtype, share] = TextEncoder(path, dtype, share)
    return _ENCODERS[path, dtype, share]


def forget() -> None:
    """Free the memos, in stages that don't tokenize."""
    _ENCODERS.clear()


def id_type(path: str) -> str:
    """The least type that holds a tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def public_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine (executors have the same package)."""
    import public_tokenizers

    return public_tokenizers.path(name)
