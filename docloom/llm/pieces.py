"""SentencePiece merge encoding by a prefix table.

Every prefix of a merge encoding ends in one certain token, so a table of that *last token* for each prefix
determines the whole encoding.  For each position an automaton lists the pieces that end there; the one that
is compatible with the last token of the prefix before it is entered in the table, and the ids are read off
backwards from the end.  Two tokens are compatible if the merge order would not have joined anything across
their border.

Pieces never have the space mark after another character, and characters that occur in no longer piece never
merge, so a text falls into independent segments; finished segments are remembered up to a bounded number.
"""

from __future__ import annotations

import re

import numpy as np
import sentencepiece

from .common import remembered

MARK = "▁"
#: Words remembered by each Python worker before the memory is emptied, and bits of the memory of token pairs.
REMEMBER, PAIR_BITS = 120_000, 21
#: In a prefix table: a character that joins nothing.
OTHER = -2


class PieceTable:
    """Encoder and decoder of one merge-type SentencePiece model."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte.values())] = True
        normal = [i for i in range(n) if not special[i] and not self.is_byte[i]]
        self.id = {self.piece[i]: i for i in normal}
        # rank 0 merges first
        order = sorted((i for i in normal), key=lambda i: -model.get_score(i))
        self.rank = {i: r for r, i in enumerate(order)}
        joined = {c for p in self.id if len(p) > 1 for c in p}
        inner = any(MARK in p.lstrip(MARK) for p in self.id)
        if inner:
            raise ValueError("pieces with an inner space mark need unsplit texts")
        plain = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        # a run of space marks with the joinable characters after it, or one character that joins nothing
        self.segment = re.compile(f"{MARK}+[{plain}]*|[{plain}]+|[^{MARK}{plain}]")
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self.split: dict[int, tuple[int, int]] = {}
        for p, i in self.id.items():
            if len(p) > 1 and (parts := self._last_merge(p)) is not None:
                self.split[i] = parts
        self._automaton(joined)
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.known: dict[str, bytes] = {}
        self.text = [("" if special[i] else p.replace(MARK, " ")) for i, p in enumerate(self.piece)]
        for b in range(128):
            self.text[self.byte[b]] = chr(b)
        self.high = self.is_byte.copy()  # bytes that are no character of their own
        self.high[[self.byte[b] for b in range(128)]] = False
        self.silent = np.array(special)
        self.fallback = self.is_byte.copy()  # without line breaks and tabs, for which there is no piece
        self.fallback[[self.byte[b] for b in (9, 10, 13)]] = False

    def _automaton(self, joined: set[str]) -> None:
        """A dense automaton over the characters that join: following it from each position lists the pieces that match there."""
        letters = sorted(joined)
        self.code = np.zeros(max(map(ord, letters)) + 1, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k for k, c in enumerate(letters, 1)}
        nodes, edges, token = {"": 0}, [], [-1]
        for p, i in sorted(self.id.items()):
            if len(p) == 1 and p not in joined or len(p) > 1 and i not in self.split:
                continue
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    token.append(-1)
                    edges.append((nodes[p[: k - 1]], number[p[k - 1]], nodes[p[:k]]))
            token[nodes[p]] = i
        a, c, b = map(np.array, zip(*edges))
        self.step = np.zeros((len(nodes), len(letters) + 1), np.uint16 if len(nodes) < 1 << 16 else np.int32) if len(nodes) * len(letters) < 40_000_000 else Sparse(a, c, b, len(letters) + 1)
        if not isinstance(self.step, Sparse):
            self.step[a, c] = b
        self.token = np.array(token, np.int32)
        self.longest = max(map(len, nodes))

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two tokens whose merge makes the piece, None if the merge order never arrives at it."""
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.rank.get(self.id.get(a + b, -1), 1 << 30) for a, b in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == 1 << 30:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if any(p not in self.id for p in parts):
            return None
        return self.id[parts[0]], self.id[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart: undo their merges from the latest on and look for one across the border that would have come first."""
        rank, split, piece, ids = self.rank, self.split, self.piece, self.id
        until = 1 << 31  # merges across the border with a rank below this come before the one undone last
        while True:
            across = ids.get(piece[left] + piece[right])
            if across is not None and rank[across] < until:
                return False
            a, b = (rank[t] if t in split else -1 for t in (left, right))
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges, the left one comes first
                until, left = a, split[left][1]
            elif b > a:
                until, right = b + 1, split[right][0]
            else:
                until, right = b + 1, split[right][0]

    def _follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of tokens, through a direct-mapped memory of pairs."""
        key = left.astype(np.int64) << 20 | right
        slot = ((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - PAIR_BITS)
        stale = np.flatnonzero(self.pair_key[slot] != key)
        if not len(stale):
            return self.pair_fits[slot]
        out = self.pair_fits[slot]
        missing, back = np.unique(key[stale], return_inverse=True)
        fits = np.array([self.compatible(k >> 20, k & 0xFFFFF) for k in missing.tolist()], bool)
        out[stale] = fits[back]
        self.pair_key[slot[stale]], self.pair_fits[slot[stale]] = key[stale], out[stale]
        # two of these keys may share a slot: what stands there now must be one key with its own answer
        held = stale[self.pair_key[slot[stale]] == key[stale]]
        self.pair_fits[slot[held]] = out[held]
        return out

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of segments, as little-endian 32-bit integers: all prefix tables of segments of about one length are filled at once."""
        out: list[bytes] = [b""] * len(segments)
        order = sorted(range(len(segments)), key=lambda k: len(segments[k]))
        at = 0
        while at < len(order):
            longest = max(8, len(segments[order[at]]) * 5 // 4)
            end = at
            while end < len(order) and end - at < 50_000 and len(segments[order[end]]) <= longest and (end - at) * longest < 500_000 or end == at:
                end += 1
            part = order[at:end]
            for k, ids in zip(part, self._encode_alike([segments[k] for k in part])):
                out[k] = ids
            at = end
        return out

    def _encode_alike(self, segments: list[str]) -> list[bytes]:
        count, size = len(segments), np.array([len(s) for s in segments])
        width = int(size.max())
        flat = np.frombuffer("".join([s.ljust(width, "\0") for s in segments]).encode("utf-32-le"), "<u4").reshape(count, width)
        code = np.zeros((count, width), np.int32)
        small = flat < len(self.code)
        code[small] = self.code[flat[small]]
        alone = (code == 0) & (np.arange(width) < size[:, None])  # joins nothing, or no piece at all
        last = np.full((count, width + 1), -1, np.int32)
        length = np.zeros((count, width + 1), np.int32)
        for start in range(width):
            rows = np.flatnonzero((size > start) & ((length[:, start] > 0) if start else True))
            single = rows[alone[rows, start]]
            last[single, start + 1], length[single, start + 1] = OTHER, 1
            state = np.zeros(len(rows), np.int32)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                state = self.step[state, code[rows, end - 1]]
                live = state > 0
                if not live.all():
                    rows, state = rows[live], state[live]
                if not len(rows):
                    break
                token = self.token[state]
                hit = np.flatnonzero((token >= 0) & (length[rows, end] == 0))
                if not len(hit):
                    continue
                row, token = rows[hit], token[hit]
                if start:
                    before = last[row, start]
                    fits = np.ones(len(row), bool)
                    pair = before >= 0  # nothing merges with a character that joins nothing
                    fits[pair] = self._follow(before[pair], token[pair])
                    row, token = row[fits], token[fits]
                last[row, end], length[row, end] = token, end - start
        at, columns, owners, places = size.copy(), [], [], []
        rows = np.flatnonzero(at > 0)
        while len(rows):
            here = at[rows]
            if (length[rows, here] == 0).any():
                raise ValueError("no token ends a prefix")
            columns.append(last[rows, here])
            owners.append(rows)
            places.append(here)
            at[rows] = here - length[rows, here]
            rows = rows[at[rows] > 0]
        ids, owner, place = np.concatenate(columns), np.concatenate(owners), np.concatenate(places)
        by = np.lexsort((place, owner))
        ids, owner, place = ids[by], owner[by], place[by]
        odd = np.flatnonzero(ids == OTHER)
        bounds = np.searchsorted(owner, np.arange(count + 1))
        packed = ids.astype("<u4").tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k in np.unique(owner[odd]).tolist():
            a, b = bounds[k], bounds[k + 1]
            tokens = []
            for token, end in zip(ids[a:b].tolist(), place[a:b].tolist()):
                if token != OTHER:
                    tokens.append(token)
                    continue
                char = segments[k][end - 1]
                i = self.id.get(char)
                tokens += [i] if i is not None else [self.byte[x] for x in char.encode()]
            out[k] = np.array(tokens, "<u4").tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, without begin and end ids, as little-endian 32-bit integers."""
        words = [self._words(t) for t in texts]
        known = self.known
        missing = list(set().union(*words).difference(known))
        if len(known) + len(missing) > REMEMBER:
            # keep what these texts use
            known = self.known = {w: ids for w in set().union(*words) if (ids := known.get(w)) is not None}
        if missing:
            parts = [self.segment.findall(w) for w in missing]
            ids = iter(self.encode_segments([s for p in parts for s in p]))
            for w, p in zip(missing, parts):
                known[w] = next(ids) if len(p) == 1 else b"".join([next(ids) for _ in p])
        out = [b"".join([known[w] for w in ws]) for ws in words]
        if len(known) > 2 * REMEMBER:
            known.clear()
        return out

    def _words(self, text: str) -> list[str]:
        """Cuts at which no piece can cross: before each run of space marks."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids: control ids are silent, runs of byte pieces are read as UTF-8, one space of the first piece goes."""
        ids = np.asarray(ids, dtype=np.int64)
        text = self.text
        if not self.high[ids].any():
            out = "".join(map(text.__getitem__, ids.tolist()))
        else:
            parts, run = [], bytearray()
            for i, b in zip(ids.tolist(), self.high[ids].tolist()):
                if b:
                    run.append(int(self.piece[i][3:5], 16))
                    continue
                if run:
                    parts.append(utf8(bytes(run)))
                    run.clear()
                parts.append(text[i])
            if run:
                parts.append(utf8(bytes(run)))
            out = "".join(parts)
        if out.startswith(" "):
            spoken = ids[~self.silent[ids]]
            if not self.is_byte[spoken[0]]:
                return out[1:]
        return out


class Sparse:
    """Transitions of a large automaton, found by hash-free binary search."""

    def __init__(self, a, c, b, width):
        key = a.astype(np.int64) * width + c
        order = np.argsort(key)
        self.key, self.to, self.width = key[order], b[order].astype(np.int32), width

    def __getitem__(self, at):
        state, code = at
        key = state.astype(np.int64) * self.width + code
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[place] == key, self.to[place], 0)


def utf8(run: bytes) -> str:
    """Bytes as UTF-8, every byte that belongs to no character as U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@remembered(2)
def table(model_file: str) -> PieceTable:
    """One table for each model and Python worker."""
    return PieceTable(model_file)
