"""SentencePiece encoding and decoding with batched Viterbi in numpy.

The segmentation of a text is the sequence of model pieces with the largest
sum of piece scores (the unigram rule); at equal sums a piece that begins
earlier wins.  A character without a piece of its own becomes its UTF-8 byte
pieces.  Pieces never reach from a solid character into a following space, so
words are encoded one by one and each distinct word once.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from sentencepiece import SentencePieceProcessor

from lodestar.llm.textkit import _U, _mix
from lodestar.llm.units import UnitEncoder, blank_only

SPACE = "▁"
_B = _U(0x100000001B3)
_LEN = _U(0x9E3779B97F4A7C15)
GROUP_CELLS = 1 << 18
#: Below the worst piece by this much: the library's fixed penalty of an unknown character.
UNKNOWN_PENALTY = 10.0


def _code_points(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(_U)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), _U)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _B + codes[:, i] + _U(1)
    return out


class PieceTable:
    """A model file's pieces: sorted hashed keys, scores, and the bytes behind each id."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        if any(a != SPACE and b == SPACE for i in usual for a, b in zip(names[i], names[i][1:], strict=False)):
            raise ValueError("the model has pieces that reach into a following space")
        self.longest = max(len(names[i]) for i in usual)
        by_length = defaultdict(list)
        for i in usual:
            by_length[len(names[i])].append(i)
        keys, ids = [], []
        for length, own in by_length.items():
            keys.append(self._key(_prefix_hashes(_code_points([names[i] for i in own], length))[:, length], length))
            ids += own
        keys, ids = np.concatenate(keys), np.array(ids, np.int32)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        scores = np.array([model.get_score(i) for i in range(n)])
        self.scores = scores[self.ids]
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = all(model.is_byte(i) for i in self.byte_ids)
        spelled = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_len = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len

    @staticmethod
    def _key(h: np.ndarray, length: int) -> np.ndarray:
        return _mix(h + _U(length * int(_LEN) & (1 << 64) - 1))

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words of equal length advance together."""
        out: list[list[int]] = [[] for _ in words]
        groups = defaultdict(list)
        for i, word in enumerate(words):
            if word:
                groups[len(word)].append(i)
        for n, own in groups.items():
            step = max(1, GROUP_CELLS // n)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                for i, ids in zip(part, self._together([words[i] for i in part], n), strict=True):
                    out[i] = ids
        return out

    def _together(self, words: list[str], n: int) -> list[list[int]]:
        w, reach = len(words), min(n, self.longest)
        codes = _code_points(words, n)
        h = _prefix_hashes(codes)
        # found[l - 1]: for each start, where the piece of l characters is in the table, or -1
        found, power = [], np.ones(1, _U)
        for length in range(1, reach + 1):
            power = power * _B
            key = self._key(h[:, length:] - h[:, : n + 1 - length] * power, length)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == key, at, -1))
        best = np.full((n + 1, w), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, w), np.int32)
        for end in range(1, n + 1):
            for length in range(min(end, reach), 0, -1):
                at = found[length - 1][:, end - length]
                gain = np.where(at >= 0, self.scores[at], self.unknown if length == 1 else -np.inf)
                score = best[end - length] + gain
                better = score > best[end]
                best[end][better] = score[better]
                back[end][better] = length
        ids: list[list[int]] = [[] for _ in words]
        place, live = np.full(w, n), np.arange(w)
        while live.size:
            here = place[live]
            length = back[here, live]
            for i, a, k in zip(live.tolist(), (here - length).tolist(), length.tolist(), strict=True):
                at = found[k - 1][i, a]
                if at >= 0:
                    ids[i].append(int(self.ids[at]))
                elif self.byte_fallback:
                    ids[i] += [self.byte_ids[b] for b in reversed(words[i][a].encode("utf-8", "replace"))]
                else:
                    ids[i].append(self.unknown_id)
            place[live] = here - length
            live = live[place[live] > 0]
        for x in ids:
            x.reverse()
        return ids

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, row offsets) of rows of ids; the space put before each text is gone again."""
        lens = self.spelled_len[ids]
        stop = np.cumsum(lens)
        total = int(stop[-1]) if len(stop) else 0
        raw = self.spelled[np.repeat(self.spelled_at[ids] - (stop - lens), lens) + np.arange(total)]
        offsets = np.concatenate([[0], stop])[at]
        full = offsets[:-1] < offsets[1:]
        drop = offsets[:-1][full]
        drop = drop[raw[drop] == 0x20]
        keep = np.ones(total, bool)
        keep[drop] = False
        return raw[keep], offsets - np.searchsorted(drop, offsets)


_tables: dict[str, tuple[PieceTable, UnitEncoder]] = {}


def piece_table(path: str) -> tuple[PieceTable, UnitEncoder]:
    """The table and the text encoder of a model file; one for each worker."""
    if path not in _tables:
        table = PieceTable(path)

        def encode(units: list[bytes], first: list[bool]) -> list[list[int]]:
            return table.segment([((" " if lead else "") + raw.decode("utf-8", "replace")).replace(" ", SPACE) for raw, lead in zip(units, first, strict=True)])

        _tables[path] = table, UnitEncoder(encode, blank_only, mark_first=True)
    return _tables[path]
