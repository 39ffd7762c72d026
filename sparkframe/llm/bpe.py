"""Token ids of whole texts by the tokenizers library, at the cost of each distinct word once.

The vocabulary's pre-tokens never reach over a blank that follows something else, so a text is cut
there, and each distinct piece is encoded once a worker. Texts in which a blank follows another
white-space character, or which hold a special token's opening, are encoded whole.

Pieces of 16 bytes or less are looked up together, by their bytes themselves, in a table of open
addresses; longer ones are rare and stand in a dictionary.
"""

from __future__ import annotations

import os
import re

import numpy as np

from sparkframe.llm.tokens import KEPT, U64, bytes_of, give_back, mix, slices, spread

_DOUBLE = re.compile(r"\s |<\|")
#: Last bytes of white space: in ASCII, and of characters beyond it (other characters end in these too).
_WHITE, _MAYBE_WHITE = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_MAYBE_WHITE[[*{chr(c).encode()[-1] for c in range(0x80, 0x3001) if chr(c).isspace()}]] = True
#: Distinct pieces that a worker remembers before it begins anew.
_REMEMBERED = 1_000_000
_PIECE_CHARS = 6_000
_SHORT = 16
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U64)


class _Table:
    """Codes of short pieces. A row has a piece's bytes, padded with zeros, and its size beside code + 1; 0 is free."""

    def __init__(self, bits: int = 16):
        self.bits, self.n, self.rows = bits, 0, np.zeros((1 << bits, 3), U64)

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + size)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each piece's code, or -1."""
        out, left, slot = np.full(len(low), -1), np.arange(len(low)), self._slots(low, high, size)
        while len(left):
            row = self.rows[slot]
            same = (row[:, 0] == low[left]) & (row[:, 1] == high[left]) & (row[:, 2] >> U64(40) == size[left]) & (row[:, 2] > 0)
            out[left[same]] = (row[same, 2] & U64((1 << 40) - 1)).astype(np.int64) - 1
            on = ~same & (row[:, 2] > 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.rows) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, codes: np.ndarray) -> None:
        """Add pieces that differ from each other and from all there."""
        self._put(np.stack([low, high, size << U64(40) | (codes + 1).astype(U64)], axis=1))

    def _put(self, new: np.ndarray) -> None:
        if 2 * (self.n + len(new)) > len(self.rows):
            old = self.rows[self.rows[:, 2] > 0]
            self.__init__(max(self.bits + 1, int(2 * (self.n + len(new))).bit_length()))
            self._put(old)
        self.n += len(new)
        slot = self._slots(new[:, 0], new[:, 1], new[:, 2] >> U64(40))
        while len(new):
            free = np.flatnonzero(self.rows[slot, 2] == 0)
            self.rows[slot[free]] = new[free]  # of several for one place the last stays
            there = self.rows[slot, 2] == new[:, 2]
            new, slot = new[~there], (slot[~there] + 1) & (len(self.rows) - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.bytes_per_id = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self):
        self.table = self.long = self.flat = self.at = None
        give_back()
        self.table, self.long, self.used, self.n = _Table(), {}, 0, 0
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros((2, 1 << 16), np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep_all(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the next pieces' ids, ``sizes`` of them each, which stand end to end."""
        n, used = self.n + len(sizes), self.used + len(ids)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > self.at.shape[1]:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)], axis=1)
        self.flat[self.used : used] = ids
        self.at[0, self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.at[1, self.n : n] = sizes
        self.n, self.used = n, used

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces, each with a blank before it, many in one text. Their codes count on from ``n``."""
        groups, size = [[]], 0
        for p in pieces:
            if size > _PIECE_CHARS:
                groups.append([])
                size = 0
            groups[-1].append(p)
            size += len(p) + 1
        joined = [" " + " ".join(g) for g in groups]
        for group, text, ids in zip(groups, joined, self._whole(joined), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 0x20)[1:], len(raw))  # pieces hold no blank
            reached = np.cumsum(self.bytes_per_id[ids])
            cut = np.searchsorted(reached, ends)
            if cut[-1] < len(ids) and (reached[cut] == ends).all():
                self._keep_all(ids, np.diff(cut + 1, prepend=0))
            else:
                parts = self._whole([" " + p for p in group])
                self._keep_all(np.concatenate(parts), np.array([len(x) for x in parts], np.int64))

    def _codes(self, data: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The codes of pieces of ``data``, which ``raw`` has too; pieces not met before are learnt."""
        size, codes = end - begin, np.full(len(begin), -1)
        short = np.flatnonzero(size <= _SHORT)
        lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(2 * _SHORT, np.uint8)]), 8)
        low, high = (lanes[begin[short] + k].view("<u8").ravel() & _LOW[np.clip(size[short] - k, 0, 8)] for k in (0, 8))
        key = low, high, size[short].astype(U64)
        codes[short] = self.table.find(*key)
        for k in np.flatnonzero(size > _SHORT).tolist():
            codes[k] = self.long.get(raw[begin[k] : end[k]], -1)
        absent = np.flatnonzero(codes < 0)
        if not len(absent):
            return codes
        fresh = [raw[a:b] for a, b in zip(begin[absent].tolist(), end[absent].tolist(), strict=True)]
        new = {p: self.n + k for k, p in enumerate(dict.fromkeys(fresh))}
        self._learn([p.decode() for p in new])
        codes[absent] = np.fromiter(map(new.__getitem__, fresh), np.int64, len(fresh))
        self.long.update((p, c) for p, c in new.items() if len(p) > _SHORT)
        some = absent[size[absent] <= _SHORT]
        _, one = np.unique(codes[some], return_index=True)
        pick = np.searchsorted(short, some[one])
        self.table.add(*(x[pick] for x in key), codes[some[one]])
        return codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and where each text's begin (one more at the end)."""
        parts = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64)))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for the UTF-8 bytes of texts that begin at ``offsets``."""
        if self.n > _REMEMBERED:
            self._forget()
        raw, rows = data.tobytes(), len(offsets) - 1
        text = lambda k: raw[offsets[k] : offsets[k + 1]].decode()
        blank = np.flatnonzero(data == 0x20)
        row = np.searchsorted(offsets, blank, "right") - 1
        # Texts to be encoded whole.
        before = np.where(blank > offsets[row], data[blank - 1], 0)
        whole = np.zeros(rows, bool)
        whole[row[_WHITE[before]]] = True
        open_ = np.flatnonzero(data[:-1] == 0x3C)
        open_ = open_[data[open_ + 1] == 0x7C]
        whole[np.searchsorted(offsets, open_, "right") - 1] = True
        for k in np.unique(row[_MAYBE_WHITE[before]]).tolist():
            whole[k] = whole[k] or bool(_DOUBLE.search(text(k)))
        alone = np.flatnonzero(whole).tolist()
        done = dict(zip(alone, self._whole([text(k) for k in alone]), strict=True)) if alone else {}
        # Others: what stands before the first blank, and the pieces after each.
        end = np.minimum(np.append(blank[1:], len(data)), offsets[row + 1]) if len(blank) else blank
        first = np.searchsorted(blank, offsets)
        stop = np.where(np.diff(first) > 0, np.append(blank, 0)[first[:-1]], offsets[1:])
        heads = {k: raw[offsets[k] : stop[k]].decode() for k in np.flatnonzero(~whole & (stop > offsets[:-1])).tolist()}
        if heads:
            known = sorted(set(heads.values()))
            firsts = dict(zip(known, self._whole(known), strict=True))
            done |= {k: firsts[h] for k, h in heads.items()}
        cut = ~whole[row]
        codes = self._codes(data, raw, blank[cut] + 1, end[cut])
        sizes = self.at[1, codes]
        body = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=body[1:])
        edge = np.append(0, np.cumsum(np.where(whole, 0, np.diff(first))))
        lead = np.array([len(done[k]) if k in done else 0 for k in range(rows)], np.int64)
        n = lead + body[edge[1:]] - body[edge[:-1]]
        bounds = np.append(0, np.cumsum(n))
        out = np.empty(bounds[-1], np.uint32)
        to = spread(bounds[:-1] + lead, n - lead)
        out[to] = self.flat[spread(self.at[0, codes], sizes)]
        for k, ids in done.items():
            out[bounds[k] : bounds[k] + len(ids)] = ids
        return out, bounds


_encoders: dict[str, Encoder] = {}
KEPT.append(_encoders)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_chunks(batch, text: str, path: str, most: int = 1 << 20):
    """For each part (i, j) of an Arrow batch of about ``most`` bytes: its ids and bounds."""
    data, offsets = bytes_of(batch.column(text))
    own = encoder(path)
    for i, j in slices(offsets, most):
        yield i, j, *own.encode_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
