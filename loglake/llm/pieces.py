"""SentencePiece encoding and decoding with exact N-best segmentation.

A text becomes a lattice whose edges are vocabulary pieces; forward Viterbi scores of every node are the
exact heuristic of a backward A* search, which therefore yields segmentations best first. No piece of the
vocabulary runs from another character into a space mark, so the lattice falls apart before each run of
spaces: every distinct part is solved once per slice, all parts side by side in numpy, and the N best of a text
are the best sums over its parts. Only the N-1 parts whose runner-up costs least can differ from
their best in any of them; A* runs on those.

Spaces are the mark U+2581 in the vocabulary and byte 0x20 here; a literal U+2581 is spelled in byte pieces,
as is any character without a piece, so decoding returns the very text. Scores are integers, sums exact.
Ties: the longer last piece wins in Viterbi; in A* the order of discovery, which depends on the part alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import Rolling, in_small_batches, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Below the worst piece, as the score of a character that only byte pieces can spell.
UNKNOWN_BELOW = 10
#: Parts of at most so many bytes are solved side by side, depth by depth; longer ones edge by edge.
SHORT = 64
_HASH = Rolling(1000)
#: Bytes of the character that a byte starts; 0 inside one.
_CHAR = np.repeat(np.array([1, 0, 2, 3, 4], np.int8), [128, 64, 32, 16, 16])


@dataclass
class Vocabulary:
    """Pieces as bytes with 0x20 for the space mark; ``byte`` maps a byte value to its piece."""

    pieces: list[bytes]
    scores: np.ndarray
    byte: np.ndarray
    usable: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        byte, pieces, usable = np.full(256, -1, np.int32), [], np.zeros(n, bool)
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte[int(name[3:5], 16)] = i
                pieces.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                pieces.append(b"")
            else:
                usable[i] = True
                pieces.append(name.replace("▁", " ").encode())
        return cls(pieces, np.array([round(model.get_score(i)) for i in range(n)], np.int64), byte, usable)

    @classmethod
    def of(cls, scored: dict[str, int]) -> Vocabulary:
        """A small vocabulary for tests: 256 byte pieces first, then the given ones."""
        names = list(scored)
        pieces = [bytes([b]) for b in range(256)] + [n.replace("▁", " ").encode() for n in names]
        usable = np.array([False] * 256 + [True] * len(names))
        return cls(pieces, np.array([0] * 256 + [scored[n] for n in names], np.int64), np.arange(256, dtype=np.int32), usable)

    def compiled(self) -> Lattice:
        return Lattice(self)


class Lattice:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        ids = np.flatnonzero(vocabulary.usable)
        if any(b" " in vocabulary.pieces[i].lstrip(b" ") for i in ids):
            raise ValueError("a piece has a space mark after another character; the lattice does not fall apart at spaces")
        self.unknown = int(vocabulary.scores[ids].min()) - UNKNOWN_BELOW if len(ids) else -UNKNOWN_BELOW
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.maybe = np.zeros(1 << 20, bool)
        lengths = np.array([len(vocabulary.pieces[i]) for i in ids])
        for n in np.unique(lengths).tolist():
            own = ids[lengths == n]
            flat = np.frombuffer(b"".join(vocabulary.pieces[i] for i in own), np.uint8)
            at = np.arange(len(own)) * n
            h = _HASH.spans(_HASH.prefix(flat), at, at + n)
            order = np.argsort(h)
            self.by_length.append((n, h[order], own[order]))
            self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        sizes = np.array([len(p) for p in vocabulary.pieces])
        self.piece_at = np.concatenate([[0], np.cumsum(sizes)])
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)

    # ------------------------------------------------------------ lattice of many parts

    def edges(self, data: np.ndarray, part_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece, score) of all edges; piece -1 stands for one character in byte pieces."""
        n = len(data)
        stop = np.repeat(part_at[1:], np.diff(part_at))
        head = (data & 0xC0) != 0x80
        room = np.where(head, stop - np.arange(n), 0)
        sums = _HASH.prefix(data)
        where = np.flatnonzero(head)
        char_end = np.minimum(np.concatenate([where[1:], [n]]), stop[where])
        starts, ends, pieces = [], [], []
        single = np.zeros(n, bool)
        for length, known, ids in self.by_length:
            where_l = np.flatnonzero(room >= length)
            if not len(where_l):
                continue
            h = _HASH.spans(sums, where_l, where_l + length)
            hit = self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            where_l, h = where_l[hit], h[hit]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            where_l, at = where_l[hit], at[hit]
            starts.append(where_l)
            ends.append(where_l + length)
            pieces.append(ids[at])
        start = np.concatenate([*starts, where[:0]])
        end = np.concatenate([*ends, where[:0]])
        piece = np.concatenate([*pieces, where[:0]])
        end_of = np.zeros(n, np.int64)
        end_of[where] = char_end
        single[start[end == end_of[start]]] = True
        lone = where[~single[where]]
        start = np.concatenate([start, lone])
        end = np.concatenate([end, end_of[lone]])
        score = np.concatenate([self.v.scores[piece], np.full(len(lone), self.unknown, np.int64)])
        piece = np.concatenate([piece, np.full(len(lone), -1, np.int64)])
        return start, end, piece, score

    @staticmethod
    def _viterbi(node_from: np.ndarray, node_to: np.ndarray, score: np.ndarray, depth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best score into each node and the edge it comes by; ``depth`` orders nodes within their part."""
        best, back = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        order = np.lexsort((np.abs(node_to - node_from) * -1, node_to, depth[node_to]))
        source, target, gain = node_from[order], node_to[order], score[order]
        if not len(order):
            return best, back
        level = np.flatnonzero(np.diff(depth[target], prepend=-1))
        for a, b in zip(level, [*level[1:], len(order)], strict=True):
            value = best[source[a:b]] + gain[a:b]
            heads = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            top = np.maximum.reduceat(value, heads)
            width = np.diff([*heads, b - a])
            first = np.flatnonzero(value == np.repeat(top, width))
            keep = first[np.diff(target[a:b][first], prepend=-1) != 0]
            best[target[a:b][heads]] = top
            back[target[a:b][keep]] = order[a:b][keep]
        return best, back

    def solve(self, data: np.ndarray, part_at: np.ndarray) -> Solved:
        """Best segmentation of every part, the cost of its runner-up, and what A* needs."""
        start, end, piece, score = self.edges(data, part_at)
        parts = len(part_at) - 1
        # Nodes: one per byte and one end per part, so that parts do not share nodes.
        shift = np.repeat(np.arange(parts), np.diff(part_at))
        a, b = start + shift[start], end + shift[start]
        n = len(data) + parts
        first, last = part_at[:-1] + np.arange(parts), part_at[1:] + np.arange(parts)
        depth = np.arange(n) - np.repeat(first, np.diff(part_at) + 1)
        alpha, back = self._viterbi(a, b, score, depth, n)
        beta, _ = self._viterbi(b, a, score, np.repeat(np.diff(part_at), np.diff(part_at) + 1) - depth, n)
        on_path = np.zeros(len(start), bool)
        at, counts, steps = last.copy(), np.zeros(parts, np.int64), []
        live = np.flatnonzero(at > first)
        while len(live):
            e = back[at[live]]
            on_path[e] = True
            steps.append((live, e))
            counts[live] += 1
            at[live] = a[e]
            live = live[at[live] > first[live]]
        path_at = np.concatenate([[0], np.cumsum(counts)])
        path = np.empty(path_at[-1], np.int64)
        for k, (live, e) in enumerate(steps):
            path[path_at[live + 1] - 1 - k] = e
        off = np.flatnonzero(~on_path)
        loss = np.full(parts, np.iinfo(np.int64).max)
        owner = shift[start[off]]
        np.minimum.at(loss, owner, alpha[last[owner]] - (alpha[a[off]] + score[off] + beta[b[off]]))
        by_end = np.lexsort((a, b))
        return Solved(self, data, part_at, start, end, piece, score, a, b, first, last, alpha, path, path_at, loss, by_end, np.searchsorted(b[by_end], np.arange(n + 1)))

    def solve_short(self, data: np.ndarray, part_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best score, loss of the runner-up, start byte and piece of each edge of the best paths, their bounds).

        Parts stand in order of falling length, so that those long enough for depth k are the first ones of
        every array and each transition adds contiguous slices.
        """
        size = np.diff(part_at)
        order = np.argsort(-size, kind="stable")
        begin, deepest = part_at[:-1][order], int(size.max())
        alive = np.searchsorted(-size[order], -np.arange(deepest + 2), "right")
        _HASH._grow(deepest + 1)
        sums, chars = [np.zeros(alive[0], np.uint64)], []
        for k in range(deepest):
            byte = data[begin[: alive[k + 1]] + k]
            chars.append(_CHAR[byte])
            sums.append(sums[k][: alive[k + 1]] + _HASH.letters[byte] * _HASH.up[k])
        lengths = sorted({*[x[0] for x in self.by_length], 1, 2, 3, 4})
        tables = {x[0]: x[1:] for x in self.by_length}
        ids: dict[tuple[int, int], np.ndarray] = {}
        for length in lengths:
            if length > deepest:
                break
            depths = range(deepest - length + 1)
            bounds = np.concatenate([[0], np.cumsum([alive[k + length] for k in depths])])
            flat = np.full(bounds[-1], -1, np.int32)
            if length in tables:
                known, own = tables[length]
                h = np.concatenate([(sums[k + length] - sums[k][: alive[k + length]]) * _HASH.down[k] for k in depths])
                h = mix(h)
                hit = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
                good = known[at] == h[hit]
                flat[hit[good]] = own[at[good]]
            if length <= 4:
                wide = np.concatenate([chars[k][: alive[k + length]] for k in depths])
                flat[(flat < 0) & (wide == length)] = -2
            for k in depths:
                ids[length, k] = flat[bounds[k] : bounds[k + 1]]
        worst = -(1 << 60)
        score = np.concatenate([self.v.scores, [self.unknown, worst]])
        gains = {at: score[own] for at, own in ids.items()}
        alpha, back = [np.zeros(alive[0], np.int64)], [np.zeros(alive[0], np.int8)]
        for k in range(1, deepest + 1):
            n = alive[k]
            best, way = np.full(n, worst), np.zeros(n, np.int8)
            for length in reversed(lengths):
                if length <= k:
                    value = alpha[k - length][:n] + gains[length, k - length]
                    better = value > best
                    best[better] = value[better]
                    way[better] = length
            alpha.append(best)
            back.append(way)
        beta: list[np.ndarray] = [np.empty(0)] * (deepest + 1)
        for k in range(deepest, -1, -1):
            best = np.full(alive[k], worst)
            best[alive[k + 1] :] = 0
            for length in lengths:
                if k + length <= deepest:
                    n = alive[k + length]
                    np.maximum(best[:n], beta[k + length] + gains[length, k], out=best[:n])
            beta[k] = best
        node_at = np.concatenate([[0], np.cumsum(alive[: deepest + 1])])
        ways, length_at = np.concatenate(back), np.zeros(node_at[-1], np.int8)
        at, live = size[order].copy(), np.arange(len(order))
        counts, steps = np.zeros(len(order), np.int64), []
        while len(live):
            step = ways[node_at[at[live]] + live].astype(np.int64)
            at[live] -= step
            length_at[node_at[at[live]] + live] = step
            counts[live] += 1
            steps.append((live, at[live].copy(), step))
            live = live[at[live] > 0]
        total = beta[0]
        loss = np.full(len(order), np.iinfo(np.int64).max)
        for (length, k), gain in gains.items():
            n = alive[k + length]
            off = np.flatnonzero((gain > worst) & (length_at[node_at[k] : node_at[k] + n] != length))
            through = alpha[k][off] + gain[off] + beta[k + length][off]
            off, through = off[through > worst // 2], through[through > worst // 2]
            loss[off] = np.minimum(loss[off], total[off] - through)
        path_at = np.concatenate([[0], np.cumsum(counts)])
        start, piece = np.empty(path_at[-1], np.int64), np.empty(path_at[-1], np.int64)
        all_ids = {length: (np.concatenate([[0], np.cumsum([alive[k + length] for k in range(deepest - length + 1)])]), np.concatenate([ids[length, k] for k in range(deepest - length + 1)])) for length in lengths if length <= deepest}
        for k, (live, depth, step) in enumerate(steps):
            put = path_at[live + 1] - 1 - k
            start[put] = begin[live] + depth
            for length in np.unique(step).tolist():
                mine = step == length
                bounds, flat = all_ids[length]
                piece[put[mine]] = flat[bounds[depth[mine]] + live[mine]]
        # Back to the given order of parts.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = counts[place]
        pick = _ranges(path_at[place], width)
        return total[place], loss[place], start[pick], np.maximum(piece[pick], -1), np.concatenate([[0], np.cumsum(width)])

    def spell(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids with characters of piece -1 spelled in bytes, and the number of ids of each edge."""
        width = np.where(piece < 0, end - start, 1)
        out = np.repeat(piece, width)
        lone = piece < 0
        if lone.any():
            out[out < 0] = self.v.byte[data[_ranges(start[lone], end[lone] - start[lone])]]
        return out.astype(np.int32), width

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of pieces, without the space mark that encoding puts before a text."""
        if not len(ids):
            return b""
        at = self.piece_at[ids]
        return self.piece_bytes[_ranges(at, self.piece_at[ids + 1] - at)].tobytes()[1:]


def _ranges(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    total = int(width.sum())
    begin = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(width) else width
    return np.arange(total) + np.repeat(start - begin, width)


@dataclass
class Solved:
    lattice: Lattice
    data: np.ndarray
    part_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    source: np.ndarray
    target: np.ndarray
    first: np.ndarray
    last: np.ndarray
    alpha: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    loss: np.ndarray
    by_end: np.ndarray
    end_at: np.ndarray

    def a_star(self, part: int, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of one part, best first: (score, edges). Fewer if there are fewer."""
        goal, begin = int(self.first[part]), int(self.last[part])
        heap, tick, out = [(-int(self.alpha[begin]), 0, begin, 0, None)], 0, []
        while heap and len(out) < n:
            _, _, node, done, tail = heapq.heappop(heap)
            if node == goal:
                edges = []
                while tail is not None:
                    edges.append(tail[0])
                    tail = tail[1]
                out.append((done, edges))
                continue
            for e in self.by_end[self.end_at[node] : self.end_at[node + 1]].tolist():
                tick += 1
                gained, source = done + int(self.score[e]), int(self.source[e])
                heapq.heappush(heap, (-(gained + int(self.alpha[source])), tick, source, gained, (e, tail)))
        return out


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each, unless it is empty."""
    length = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(length + (length > 0))])
    out = np.full(at[-1], 0x20, np.uint8)
    out[_ranges(at[:-1] + 1, length)] = data[offsets[0] : offsets[-1]]
    return out, at


def parts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the independent parts: row starts, and spaces after another character."""
    cut = np.empty(len(data), bool)
    if len(data):
        cut[0], cut[1:] = True, (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def encode_slice(lattice: Lattice, data: np.ndarray, offsets: np.ndarray, n_best: int) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """For each text its best ids and its ``n_best`` segmentations as (score, ids), best first."""
    text, row_at = marked(data, offsets)
    cuts = parts_of(text, row_at)
    ends = np.concatenate([cuts[1:], [len(text)]]) if len(cuts) else cuts
    h = _HASH.spans(_HASH.prefix(text), cuts, ends) ^ (ends - cuts).astype(np.uint64)
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    size = ends[sample] - cuts[sample]
    part_at = np.concatenate([[0], np.cumsum(size)])
    best, loss, ids, count = _solved(lattice, text, cuts[sample], size)
    id_at = np.concatenate([[0], np.cumsum(count)])
    first = np.searchsorted(cuts, row_at)
    rows = [which[first[r] : first[r + 1]] for r in range(len(offsets) - 1)]
    near = [_cheapest(loss[mine], n_best - 1) for mine in rows]
    found = _alternatives(lattice, text, cuts[sample], size, np.unique(np.concatenate([np.empty(0, np.int64), *[mine[p] for mine, p in zip(rows, near, strict=True)]])), n_best)
    for mine, places in zip(rows, near, strict=True):
        flat = ids[_ranges(id_at[mine], count[mine])]
        total = int(best[mine].sum())
        options: list[tuple[int, tuple]] = [(0, ())]
        for p in places.tolist():
            ways = found[int(mine[p])]
            options = sorted(((lost + ways[0][0] - value, (*taken, (p, k)) if k else taken) for lost, taken in options for k, (value, _) in enumerate(ways)), key=lambda o: o[0])[:n_best]
        out, bound = [(total, flat)], np.concatenate([[0], np.cumsum(count[mine])])
        for lost, taken in options[1:]:
            pieces, last = [], 0
            for p, k in taken:
                pieces += [flat[bound[last] : bound[p]], found[int(mine[p])][k][1]]
                last = p + 1
            out.append((total - lost, np.concatenate([*pieces, flat[bound[last] :]])))
        yield flat, out


def _solved(lattice: Lattice, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best score, loss of the runner-up, ids and number of ids of every part."""
    n = len(size)
    best, loss, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    spelled = []
    for own in (np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)):
        if not len(own):
            spelled.append(np.empty(0, np.int32))
            continue
        at = np.concatenate([[0], np.cumsum(size[own])])
        data = text[_ranges(begin[own], size[own])]
        if size[own[0]] <= SHORT:
            best[own], loss[own], start, piece, path_at = lattice.solve_short(data, at)
            end = start + np.where(piece < 0, _CHAR[data[start]], 0)
        else:
            s = lattice.solve(data, at)
            best[own], loss[own], start, piece, path_at, end = s.alpha[s.last], s.loss, s.start[s.path], s.piece[s.path], s.path_at, s.end[s.path]
        ids, width = lattice.spell(data, start, end, piece)
        count[own] = np.diff(np.concatenate([[0], np.cumsum(width)])[path_at])
        spelled.append(ids)
    if not len(spelled[1]):
        return best, loss, spelled[0], count
    order = np.concatenate([np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)])
    at = np.zeros(n, np.int64)
    at[order] = np.concatenate([[0], np.cumsum(count[order])[:-1]])
    return best, loss, np.concatenate(spelled)[_ranges(at, count)], count


def _cheapest(loss: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest losses, the first ones of equal losses, in order of place; parts with one way do not count."""
    k = min(k, len(loss))
    if not k:
        return np.empty(0, np.int64)
    near = np.flatnonzero(loss <= np.partition(loss, k - 1)[k - 1])
    near = near[np.argsort(loss[near], kind="stable")[:k]]
    return np.sort(near[loss[near] < np.iinfo(np.int64).max])


def _alternatives(lattice: Lattice, text: np.ndarray, begin: np.ndarray, size: np.ndarray, chosen: np.ndarray, n_best: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """A* on the chosen parts: (score, ids) of each segmentation, best first."""
    if not len(chosen):
        return {}
    data = text[_ranges(begin[chosen], size[chosen])]
    s = lattice.solve(data, np.concatenate([[0], np.cumsum(size[chosen])]))
    out = {}
    for k, part in enumerate(chosen.tolist()):
        out[part] = [(value, lattice.spell(data, s.start[e], s.end[e], s.piece[e])[0]) for value, e in ((v, np.array(e)) for v, e in s.a_star(k, n_best))]
    return out


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, n_best: int = N_BEST, keep_ids: bool = True) -> DataFrame:
    """``docs`` plus its pieces. Null and empty texts have no piece and one segmentation of score 0.

    Added: n_pieces, best_score, n_best_scores (best first), n_best_sha256 (of the ids as little-endian int32),
    round_trip (the ids decode to the text), and ids if ``keep_ids``. The model is read on the driver and
    shipped, so executors need no file. Input columns of these names are replaced.
    """
    vocabulary = Vocabulary.load(model)
    added = [("n_pieces", "bigint", pa.int64()), ("best_score", "bigint", pa.int64()), ("n_best_scores", "array<bigint>", pa.list_(pa.int64())), ("n_best_sha256", "array<string>", pa.list_(pa.string())), ("round_trip", "boolean", pa.bool_())]
    added += [("ids", "array<int>", pa.list_(pa.int32()))] if keep_ids else []
    docs = in_small_batches(docs).drop(*[a[0] for a in added])
    schema = StructType([*docs.schema, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in added))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = vocabulary.compiled()
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(text), 3 << 20):
                cols: list[list] = [[] for _ in added]
                for k, (flat, options) in enumerate(encode_slice(lattice, data, offsets, n_best)):
                    own = data[offsets[k] : offsets[k + 1]].tobytes()
                    row = [len(flat), options[0][0], [v for v, _ in options], [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for _, x in options], lattice.decode(flat) == own, flat]
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in batch.columns], *[pa.array(c, a[2]) for c, a in zip(cols, added, strict=True)]], names=[*batch.schema.names, *[a[0] for a in added]]
                )

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that its ids spell; null ids give null. Byte runs that are no UTF-8 become U+FFFD."""
    vocabulary = Vocabulary.load(model)
    rows = rows.drop(text)
    schema = StructType([*rows.schema, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = vocabulary.compiled()
        for batch in batches:
            made = [None if x.as_py() is None else lattice.decode(np.array(x.as_py(), np.int64)).decode(errors="replace") for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, schema)
