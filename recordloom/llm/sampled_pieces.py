"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

Every segmentation of a text into vocabulary pieces is a path of a lattice; its probability is
proportional to exp(alpha * sum of piece scores). Perturbed A-star search emits the k paths of
largest Gumbel-perturbed log probability, which are k distinct samples without replacement:
the queue holds regions of the path space with the perturbed maximum of each; the best region
yields its maximum, a path drawn from the region, and is split into the regions that leave
this path at each of its units. The maximum of a part is a Gumbel truncated at that of the whole.

A piece holds blanks only at its front, so the lattice of a text is a chain of small lattices,
one per unit (blanks and the characters behind them). Equal units share one, which a task keeps from
chunk to chunk. All
randomness is a hash of row key, sample number and position: a row gives the same samples in
any batch, partition or retry.

Defined cases: a null or empty text has one segmentation, the empty one, with inclusion 1;
texts with fewer than k segmentations give all of them; a literal block mark (U+2581) and
characters outside the vocabulary become byte pieces, so decoding gives back every text;
repeated rows get the same samples; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_batches, read_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# A chunk takes about 200 bytes a character; equal units are shared in it.
CHUNK_CHARS = 250_000
# Characters of units whose lattices are kept, at about 70 bytes each, up to twice that with room to grow;
# with more, they are made anew.
KEPT_CHARS = 600_000
# Units of a text that a split looks at together with those of other texts.
BLOCK = 192
# Pieces whose bytes are gathered at once when decoding.
DECODE_PIECES = 100_000
_DENSE = 256


def load_pieces(model: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kinds: piece, byte, other."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=read_bytes(model))
    rows = []
    for i in range(processor.get_piece_size()):
        kind = "byte" if processor.is_byte(i) else "other" if processor.is_control(i) or processor.is_unknown(i) else "piece"
        rows.append((processor.id_to_piece(i), processor.get_score(i), kind))
    return rows


_GAMMA = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def row_key(*parts: int) -> int:
    """One number from several: each is mixed in by a splitmix64 step."""
    return mixed_in(0, *parts)


def mixed_in(state: int, *parts: int) -> int:
    """``row_key`` of the parts that made ``state`` and these."""
    for part in parts:
        z = (state + part + _GAMMA) & _WORD
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _WORD
        state = z ^ (z >> 31)
    return state


def stream_states(keys, places) -> np.ndarray:
    """States at some places of the splitmix64 streams that start at the keys (unsigned 64-bit)."""
    return keys + (places + 1).astype(np.uint64) * np.uint64(_GAMMA)


def mixed(states: np.ndarray) -> np.ndarray:
    """The number of each state of a stream."""
    z = states ^ (states >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def hashed(keys, places) -> np.ndarray:
    """The numbers at some places of the splitmix64 streams that start at the keys (unsigned 64-bit)."""
    return mixed(stream_states(keys, places))


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def chance_of(bits: int) -> float:
    return ((bits >> 11) + 0.5) / (1 << 53)


def trie_of(pieces: list[tuple[str, float, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent and code point of each node but the root, in order, and the piece that ends in each node (-1: none)."""
    children: dict[tuple[int, str], int] = {}
    ends = [-1]
    for i, (piece, _, kind) in enumerate(pieces):
        if kind != "piece":
            continue
        at = 0
        for c in piece.replace(MARK, " "):
            to = children.setdefault((at, c), len(ends))
            if to == len(ends):
                ends.append(-1)
            at = to
        ends[at] = i
    return np.array([at for at, _ in children], np.int64), np.array([ord(c) for _, c in children], np.int64), np.array(ends, np.int32)


class Vocabulary:
    """A trie over code points (``trie_of`` the pieces, if not given), walked for many positions at once."""

    def __init__(self, pieces: list[tuple[str, float, str]], alpha: float, trie: tuple | None = None):
        self.size = len(pieces)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        texts = {i: p.replace(MARK, " ") for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        self.longest = max(map(len, texts.values()), default=1)
        # Blanks carry a marker score far below all others: it counts as the least regular score,
        # and so does a character spelled in bytes.
        least = min((s for _, s, kind in pieces if kind == "piece" and s > -1e6), default=0.0)
        self.weight = np.array([alpha * max(s, least) for _, s, _ in pieces])
        self.byte_weight = alpha * least
        self.weight[list(self.byte_ids.values())] = self.byte_weight
        # What a character outside the vocabulary is called in a lattice: its byte piece if it has
        # one byte, else a number from ``size`` on.
        self.one_byte = np.array([self.byte_ids.get(b, self.size + b) for b in range(128)], dtype=np.int32)
        parents, codes, self.ends = trie or trie_of(pieces)
        nodes = np.arange(1, len(parents) + 1, dtype=np.int32)
        # Code points below _DENSE by table, others by sorted keys (node, code point).
        self.table = np.zeros((len(self.ends), _DENSE), dtype=np.int32)
        low = codes < _DENSE
        self.table[parents[low], codes[low]] = nodes[low]
        keys = (parents[~low] << 21) | codes[~low]
        order = np.argsort(keys)
        self.rare_keys, self.rare_nodes = (keys[order], nodes[~low][order]) if len(keys) else (np.array([-1], np.int64), np.zeros(1, np.int32))
        # Two characters side by side are those of a node and its parent.
        inner = parents > 0
        first, second = codes[parents[inner] - 1], codes[inner]
        self.pairs = np.unique((first << 21) | second) if inner.any() else np.array([-1], np.int64)
        self.dense_pairs = np.zeros((_DENSE, _DENSE), dtype=bool)
        low = (first < _DENSE) & (second < _DENSE)
        self.dense_pairs[first[low], second[low]] = True
        spelled = {i: t.encode() for i, t in texts.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        # Bytes of all pieces in a row; ids that spell nothing, and the place behind the last id, have none.
        self.spelled = np.frombuffer(b"".join([spelled.get(i, b"") for i in range(self.size)]), dtype=np.uint8)
        self.spelled_size = np.array([len(spelled.get(i, b"")) for i in range(self.size)] + [0], dtype=np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size

    def joins(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether some piece has the two characters side by side."""
        low = (first < _DENSE) & (second < _DENSE)
        out = self.dense_pairs[np.where(low, first, 0), np.where(low, second, 0)]
        keys = (first[~low] << 21) | second[~low]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        out[~low] = self.pairs[at] == keys
        return out

    def spelling(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < 128, self.one_byte[np.minimum(codes, 127)], self.size + codes).astype(np.int32)

    def weights(self, pieces: np.ndarray) -> np.ndarray:
        """Weights of piece ids; numbers from ``size`` on are characters spelled in bytes."""
        return np.where(pieces < self.size, self.weight[np.minimum(pieces, self.size - 1)], self.byte_weight)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Child of each node, 0 if there is none."""
        low = codes < _DENSE
        if low.all():
            return self.table[nodes, codes]
        out = np.zeros(len(nodes), dtype=np.int32)
        out[low] = self.table[nodes[low], codes[low]]
        keys = (nodes[~low].astype(np.int64) << 21) | codes[~low]
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        out[~low] = np.where(self.rare_keys[at] == keys, self.rare_nodes[at], 0)
        return out

    def decode(self, ids) -> str:
        """Text of a segmentation; the blank put before every text is taken away again."""
        return self.decode_all([np.array([i for i in ids if i is not None], dtype=np.int64)])[0]

    def decode_all(self, rows: list[np.ndarray]) -> list[str]:
        """Texts of many segmentations, DECODE_PIECES pieces (or one row) at a time."""
        out, start, pieces = [], 0, 0
        for at, row in enumerate(rows):
            if at > start and pieces + len(row) > DECODE_PIECES:
                out += self._decoded(rows[start:at])
                start, pieces = at, 0
            pieces += len(row)
        return out + self._decoded(rows[start:]) if rows else out

    def _decoded(self, rows: list[np.ndarray]) -> list[str]:
        ids = np.concatenate(rows)
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        size = self.spelled_size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        data = self.spelled[np.repeat(self.spelled_at[ids] - (end - size), size) + np.arange(total)].tobytes()
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(r) for r in rows])])].tolist()
        return [data[a + (data[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]


class Lattices:
    """Edges of many units in one table: position, reach, piece, and the chance to take it.

    ``reach[p]`` to ``reach[p + 1]`` are the edges of position p; ``upto`` is the running sum of
    their chances. Positions of a unit are consecutive, with one closing position.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        self.counted: dict[tuple[int, int], int] = {}
        self.behind: dict[tuple[int, int], int] = {}
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.end = self.begin + lengths
        codes = np.frombuffer("\0".join(units).encode("utf-32-le") + b"\0\0\0\0", dtype=np.uint32).astype(np.int64)
        n = len(codes)
        stop = np.repeat(self.end, lengths + 1)  # of the unit that holds a position
        inside = np.flatnonzero(np.arange(n) < stop)
        at, node = inside, np.zeros(len(inside), dtype=np.int32)
        found = []
        single = np.zeros(n, dtype=bool)
        for length in range(1, vocabulary.longest + 1):
            node = vocabulary.step(node, codes[at + length - 1])
            ids = vocabulary.ends[node]
            hit = ids >= 0
            found.append((length, at[hit], ids[hit]))
            if length == 1:
                single[at[hit]] = True
            alive = (node > 0) & (at + length < stop[at])
            at, node = at[alive], node[alive]
            if not len(at):
                break
        spelled = inside[~single[inside]]
        found.append((1, spelled, vocabulary.spelling(codes[spelled])))
        # Each position gets its edges in one stretch, the longest (mostly the likeliest) first.
        degree = np.zeros(n, dtype=np.int64)
        for _, at, _ in found:
            degree[at] += 1
        self.reach = np.concatenate([[0], np.cumsum(degree)])
        free = self.reach[1:].copy()
        self.length, self.piece = np.empty(self.reach[-1], np.int32), np.empty(self.reach[-1], np.int32)
        for length, at, ids in found:
            free[at] -= 1
            self.length[free[at]], self.piece[free[at]] = length, ids
        self.used = (len(units), n, len(self.piece))  # units, positions, edges
        weight = vocabulary.weights(self.piece)
        # Backward sums, for all units at once, from the last character to the first.
        rest = np.zeros(n)
        self.log_chance, self.upto = np.empty(len(weight)), np.empty(len(weight))
        distance = (stop - np.arange(n))[inside]
        order = inside[np.argsort(distance, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(distance)[1:])]) if len(inside) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            where = order[lo:hi]
            size = degree[where]
            first = np.cumsum(size) - size
            edge = np.repeat(self.reach[where] - first, size) + np.arange(first[-1] + size[-1])
            value = weight[edge] + rest[np.repeat(where, size) + self.length[edge]]
            top = np.maximum.reduceat(value, first)
            value = np.exp(value - np.repeat(top, size))
            total = np.add.reduceat(value, first)
            rest[where] = top + np.log(total)
            value /= np.repeat(total, size)
            running = np.cumsum(value)
            self.upto[edge] = running - np.repeat(running[first] - value[first], size)
            self.log_chance[edge] = np.log(np.maximum(value, 1e-300))
            self.upto[edge[first + size - 1]] = 2.0  # rounding never leads past the last edge

    def extend(self, more: Lattices) -> None:
        """Put the units of another table behind the own ones; arrays have room to grow."""
        units, positions, edges = self.used
        for name, used, values in (
            ("begin", units, more.begin + positions), ("end", units, more.end + positions), ("reach", positions + 1, more.reach[1:] + edges),
            ("length", edges, more.length), ("piece", edges, more.piece), ("log_chance", edges, more.log_chance), ("upto", edges, more.upto),
        ):
            own, to = getattr(self, name), used + len(values)
            if to > len(own):
                own = np.empty(2 * to, own.dtype)
                own[:used] = getattr(self, name)[:used]
                setattr(self, name, own)
            own[used:to] = values
        self.used = tuple(a + b for a, b in zip(self.used, more.used))

    def draw(self, units: np.ndarray, seeds: np.ndarray, places: np.ndarray):
        """A path through each unit: (tokens of a unit, all pieces in order, log probabilities).

        The random number of a step is a hash of the row's seed and the place in its text.
        """
        count = np.empty(len(units), dtype=np.int64)
        logs = np.empty(len(units))
        steps = []
        who, log = np.arange(len(units)), np.zeros(len(units))
        position, end = self.begin[units], self.end[units]
        state = stream_states(seeds, places)
        while len(who):
            u = uniform(mixed(state))
            edge = self.reach[position]
            open_ = np.flatnonzero(u > self.upto[edge])
            while len(open_):
                on = edge[open_] + 1
                edge[open_] = on
                open_ = open_[u[open_] > self.upto[on]]
            steps.append((who, self.piece[edge]))
            log += self.log_chance[edge]
            length = self.length[edge]
            position += length
            inside = position < end
            done = who[~inside]
            count[done], logs[done] = len(steps), log[~inside]
            left = np.flatnonzero(inside)
            who, position, end, log = who[left], position[left], end[left], log[left]
            state = state[left] + length[left].astype(np.uint64) * np.uint64(_GAMMA)
        first = np.concatenate([[0], np.cumsum(count)])
        pieces = np.empty(first[-1], dtype=np.int32)
        for i, (who, taken) in enumerate(steps):
            pieces[first[who] + i] = taken
        return count, pieces, logs

    def draw_other(self, unit: int, excluded: list[tuple], chances: list[float], numbers) -> tuple[tuple, float]:
        """A path of one unit that is none of ``excluded``: edges are weighed less what is excluded behind them."""
        position, end, reached, path, log = int(self.begin[unit]), int(self.end[unit]), 1.0, (), 0.0
        inside = list(zip(excluded, chances))  # what begins with the path so far
        while position < end:
            lo, hi = int(self.reach[position]), int(self.reach[position + 1])
            pieces, logs, lengths = (x[lo:hi].tolist() for x in (self.piece, self.log_chance, self.length))
            masses, step = [], len(path)
            for piece, chance, length in zip(pieces, logs, lengths):
                mass = reached * math.exp(chance)
                behind = [c for x, c in inside if x[step] == piece]
                # A branch that holds nothing but excluded paths has no mass, whatever the rounding.
                if behind:
                    mass = 0.0 if self._paths_behind(position + length, end, len(behind)) <= len(behind) else max(mass - sum(behind), 0.0)
                masses.append(mass)
            total = sum(masses)
            if total <= 0.0:  # all that is left is below rounding: take the first branch that isn't exhausted
                masses = [1.0 if self._open(path + (piece,), position + length, end, excluded) else 0.0 for piece, length in zip(pieces, lengths)]
                total = sum(masses)
            goal, chosen = next(numbers) * total, None
            for i, mass in enumerate(masses):
                if mass > 0.0:
                    chosen = i
                    goal -= mass
                    if goal <= 0.0:
                        break
            path += (pieces[chosen],)
            inside = [(x, c) for x, c in inside if x[step] == pieces[chosen]]
            log += logs[chosen]
            reached *= math.exp(logs[chosen])
            position += lengths[chosen]
        return path, log

    def _open(self, path: tuple, position: int, end: int, excluded: list[tuple]) -> bool:
        behind = sum(x[: len(path)] == path for x in excluded)
        return self._paths_behind(position, end, behind) > behind

    def _paths_behind(self, position: int, end: int, enough: int) -> int:
        """Number of paths from a position, counted no further than just over ``enough``."""
        known = self.behind.get((position, enough))
        if known is not None:
            return known
        reach = self.reach[position : end + 1].tolist()
        lengths = self.length[reach[0] : reach[-1]].tolist()
        ways = [0] * (end - position) + [1]
        for p in range(end - position - 1, -1, -1):
            n = sum([ways[p + length] for length in lengths[reach[p] - reach[0] : reach[p + 1] - reach[0]]])
            ways[p] = min(n, enough + 1)
        self.behind[position, enough] = ways[0]
        return ways[0]

    def paths(self, unit: int, enough: int) -> int:
        known = self.counted.get((unit, enough))
        if known is None:
            known = self.counted[unit, enough] = self._paths_behind(int(self.begin[unit]), int(self.end[unit]), enough)
        return known


def unit_hashes(codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit number of each unit's characters and their places in it."""
    sizes = np.diff(cuts)
    place = np.arange(len(codes)) - np.repeat(cuts[:-1], sizes)
    return np.add.reduceat(hashed(codes.astype(np.uint64) << np.uint64(32), place), cuts[:-1])


class Known:
    """Lattices of the units met so far, up to KEPT_CHARS characters (or one chunk)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.lattices: Lattices | None = None
        self.chars = 0

    def numbered(self, whole: str, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Number of each unit in the table of lattices, which gets those it lacks."""
        different, first, place = np.unique(unit_hashes(codes, cuts), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        lacking = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != different) if len(self.hashes) else np.arange(len(different))
        if len(lacking):
            begins = np.sort(first[lacking])
            chars = int((cuts[begins + 1] - cuts[begins]).sum())
            if self.lattices is not None and self.chars + chars > KEPT_CHARS:
                self.__init__(self.vocabulary)
                return self.numbered(whole, codes, cuts)
            more = Lattices(self.vocabulary, [whole[a:b] for a, b in zip(cuts[begins].tolist(), cuts[begins + 1].tolist())])
            if self.lattices is None:
                self.lattices = more
            else:
                self.lattices.extend(more)
            numbers = len(self.numbers) + np.searchsorted(begins, first[lacking])
            self.hashes, self.numbers = np.insert(self.hashes, at[lacking], different[lacking]), np.insert(self.numbers, at[lacking], numbers)
            self.chars += chars
        return self.numbers[np.searchsorted(self.hashes, different)][place]


def units_of(texts: list[str], vocabulary: Vocabulary) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row with their code points, the cuts between units, and how many units each text has (an empty text none).

    A blank is put before each text; units are cut where no piece joins two characters.
    """
    whole = "".join([" " + t for t in texts if t])
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    cut = np.ones(len(codes) + 1, dtype=bool)
    if len(codes):
        cut[1:-1] = ~vocabulary.joins(codes[:-1], codes[1:])
        cut[begins[lengths > 0]] = True
    at = np.flatnonzero(cut) if len(codes) else np.zeros(1, np.int64)
    counts = np.searchsorted(at, begins + lengths) - np.searchsorted(at, begins)
    return whole, codes, at, counts


def truncated_gumbel(location, bound, u):
    """Gumbel of a location given that it is below a bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(value, bound))


class Search:
    """The queue of one text: its emitted samples and the regions still to be opened."""

    def __init__(self, seed: int, k: int):
        self.state, self.k = row_key(seed), k
        self.queue: list = []
        self.samples: list[dict] = []
        self.next: tuple | None = (-math.log(-math.log(chance_of(mixed_in(self.state, 7)))), 0, -1, (), ())

    def open(self, region, sample, lattices, units) -> tuple[tuple, tuple, float]:
        """What is excluded where a region begins, with its chances, and the log probability of the rest there."""
        _, start, _, excluded, chances = region
        gone = excluded + (sample["paths"](start),)
        shares = chances + (math.exp(sample["unit_logs"][start]),)
        left = max(0.0, 1.0 - sum(shares))
        # Little mass may be none, whatever the rounding: then paths are counted.
        full = left < 1e-9 and lattices.paths(int(units[start]), len(gone)) <= len(gone)
        return gone, shares, -math.inf if full else sample["prefix"][start] + math.log(max(left, 1e-300))

    def split(self, region, sample, lattices, units, gone, shares, peaks) -> None:
        """Queue what the region holds beside the sample just drawn from it; ``peaks`` are those of its first units."""
        bound, start = region[:2]
        number = len(self.samples) - 1
        prefix = sample["prefix"]
        wanted = self.k + 1
        # The noise of a 53-bit number is below 38: units that far behind can't be among the best.
        floor, stop = -math.inf, len(prefix) - 1
        best, at = np.arange(len(peaks)), start + len(peaks)
        while True:
            if len(peaks) > wanted:
                kept = np.argpartition(-peaks, wanted)[:wanted]
                best, peaks = best[kept], peaks[kept]
                floor = peaks.min()
            if at >= stop or prefix[at] + 38.0 <= floor:
                break
            to = min(stop, at + BLOCK)
            key = np.uint64(mixed_in(self.state, 11, number))
            location = beside(prefix[at:to], sample["unit_logs"][at:to])
            found = truncated_gumbel(location, bound, uniform(hashed(key, np.arange(at, to))))
            best, peaks = np.concatenate([best, np.arange(at - start, to - start)]), np.concatenate([peaks, found])
            at = to
        for i, peak in zip(best.tolist(), peaks.tolist()):
            if peak == -math.inf:
                continue
            at = start + i
            if i and sample["unit_logs"][at] > -1e-9 and lattices.paths(int(units[at]), 1) <= 1:
                continue
            # What is excluded behind the start is looked up when the region is taken from the queue.
            heapq.heappush(self.queue, (-peak, at, number, *((gone, shares) if i == 0 else ((), ()))))

    def advance(self) -> None:
        self.next = None
        if self.queue:
            peak, at, number, excluded, chances = heapq.heappop(self.queue)
            if not excluded:
                sample = self.samples[number]
                excluded, chances = (sample["paths"](at),), (math.exp(sample["unit_logs"][at]),)
            self.next = (-peak, at, number, excluded, chances)


def beside(prefix: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probability to follow a path up to each unit and to leave it there."""
    with np.errstate(divide="ignore"):
        return prefix + np.log(-np.expm1(np.minimum(logs, 0.0)))


def split_all(searches: list[Search], regions: list[tuple], lattices: Lattices, rows: list[np.ndarray]) -> None:
    """Split the region that each search has drawn its last sample from; the first BLOCK units of all at once."""
    samples = [s.samples[-1] for s in searches]
    spans = [(r[1], min(len(x["prefix"]) - 1, r[1] + BLOCK)) for r, x in zip(regions, samples)]
    sizes = np.array([b - a for a, b in spans])
    ends = np.cumsum(sizes)
    location = beside(
        np.concatenate([x["prefix"][a:b] for x, (a, b) in zip(samples, spans)]), np.concatenate([x["unit_logs"][a:b] for x, (a, b) in zip(samples, spans)])
    )
    # Where a region begins, earlier choices stay excluded too.
    opened = [s.open(r, x, lattices, units) for s, r, x, units in zip(searches, regions, samples, rows)]
    location[ends - sizes] = [rest for _, _, rest in opened]
    keys = np.array([mixed_in(s.state, 11, len(s.samples) - 1) for s in searches], dtype=np.uint64)
    places = np.arange(len(location)) + np.repeat(np.array([a for a, _ in spans]) - (ends - sizes), sizes)
    bounds = np.repeat(np.array([r[0] for r in regions]), sizes)
    peaks = truncated_gumbel(location, bounds, uniform(hashed(np.repeat(keys, sizes), places)))
    for search, region, sample, units, (gone, shares, _), end, size in zip(searches, regions, samples, rows, opened, ends.tolist(), sizes.tolist()):
        search.split(region, sample, lattices, units, gone, shares, peaks[end - size : end])


def sample_chunk(vocabulary: Vocabulary, texts: list[str], seeds: list[int], k: int, known: Known | None = None) -> list[list[dict]]:
    """Samples (ids, log_prob, inclusion) of every text, best first; ``known`` keeps lattices for further chunks."""
    whole, codes, cuts, counts = units_of(texts, vocabulary)
    if not whole:
        return [[{"ids": np.empty(0, np.int32), "log_prob": 0.0, "inclusion": 1.0}] for _ in texts]
    known = known or Known(vocabulary)
    every = known.numbered(whole, codes, cuts)
    rows = np.split(every, np.cumsum(counts)[:-1])
    lattices = known.lattices
    sizes = lattices.end[: lattices.used[0]] - lattices.begin[: lattices.used[0]]
    searches = [Search(seed, k) if len(units) else None for seed, units in zip(seeds, rows)]
    starts = [np.concatenate([[0], np.cumsum(sizes[units])[:-1]]).astype(np.int64) if len(units) else None for units in rows]
    for number in range(k):
        active = [i for i, s in enumerate(searches) if s is not None and s.next is not None]
        if not active:
            break
        # All units behind the point where each text leaves its earlier sample are drawn together.
        froms = [searches[i].next[1] + (searches[i].next[2] >= 0) for i in active]
        units = np.concatenate([rows[i][f:] for i, f in zip(active, froms)])
        places = np.concatenate([starts[i][f:] for i, f in zip(active, froms)])
        keys = np.array([mixed_in(searches[i].state, 3, number) for i in active], dtype=np.uint64)
        lengths = np.array([len(rows[i]) - f for i, f in zip(active, froms)])
        count, pieces, logs = lattices.draw(units, np.repeat(keys, lengths), places)
        unit_at = np.concatenate([[0], np.cumsum(lengths)])
        piece_at = np.concatenate([[0], np.cumsum(count)])
        regions = [searches[i].next for i in active]
        for j, i in enumerate(active):
            search, (lo, hi) = searches[i], unit_at[j : j + 2]
            region = search.next
            peak, start, parent, excluded, chances = region
            parts = (count[lo:hi], pieces[piece_at[lo] : piece_at[hi]], logs[lo:hi])
            if parent >= 0:
                old = search.samples[parent]
                state = mixed_in(search.state, 5, number)
                stream = (chance_of(mixed_in(state, step)) for step in range(1 << 30))
                path, log = lattices.draw_other(int(rows[i][start]), list(excluded), list(chances), stream)
                kept = int(old["first"][start])
                parts = (
                    np.concatenate([old["count"][:start], [len(path)], parts[0]]),
                    np.concatenate([old["ids"][:kept], np.array(path, dtype=np.int32), parts[1]]),
                    np.concatenate([old["unit_logs"][:start], [log], parts[2]]),
                )
            first, prefix = running(parts[0]), running(parts[2])
            sample = {"count": parts[0], "ids": parts[1], "unit_logs": parts[2], "first": first, "prefix": prefix, "peak": peak, "log_prob": float(prefix[-1])}
            sample["paths"] = lambda at, s=sample: tuple(s["ids"][s["first"][at] : s["first"][at + 1]].tolist())
            search.samples.append(sample)
        split_all([searches[i] for i in active], regions, lattices, [rows[i] for i in active])
        for i in active:
            searches[i].advance()
    out = []
    for search in searches:
        if search is None:
            out.append([{"ids": np.empty(0, np.int32), "log_prob": 0.0, "inclusion": 1.0}])
            continue
        # The first value that was not taken decides how likely each sample was to be taken.
        limit = search.next[0] if search.next is not None else -math.inf
        for s in search.samples:
            s["inclusion"] = 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(s["log_prob"] - limit, 700.0)))
            s["ids"] = spell_bytes(s["ids"], vocabulary)
            del s["paths"]
        out.append(search.samples)
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place, and of all."""
    out = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def spell_bytes(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Replace characters outside the vocabulary by their byte pieces."""
    if not len(ids) or ids.max() < vocabulary.size:
        return ids
    special = np.flatnonzero(ids >= vocabulary.size)
    spelled = [[vocabulary.byte_ids[b] for b in chr(i - vocabulary.size).encode("utf-8", "replace")] for i in ids[special].tolist()]
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[special] = [len(x) for x in spelled]
    out = np.repeat(ids, sizes)
    for at, taken in zip((np.cumsum(sizes) - sizes)[special].tolist(), spelled):
        out[at : at + len(taken)] = taken
    return out


SAMPLES = "array<struct<ids:array<int>,log_prob:double,inclusion:double,text_crc32:bigint,round_trip:boolean>>"


def encode_samples(
    docs: DataFrame, k: int = 2, alpha: float = 2e-4, seed: int = 0, id_column: str = "doc_id", text: str = "text", model: str = MODEL
) -> DataFrame:
    """(id, samples): up to ``k`` distinct segmentations per text, drawn without replacement.

    ``samples`` holds piece ids, log probability, and the inclusion score: the chance of the
    sample to be among the k, given the threshold that the search met. Every sample is decoded
    again: ``text_crc32`` is that of the decoded text, ``round_trip`` tells whether it equals the
    input (a null text counts as empty). Narrow: no row moves;
    a task works through its rows in chunks of bounded characters (or one text).
    """
    loaded = load_pieces(model)
    pieces = docs.sparkSession.sparkContext.broadcast((loaded, trie_of(loaded)))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id_column), F.lit(seed)).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    arrow_type = _samples_type()

    def task():
        loaded, trie = pieces.value
        vocabulary = Vocabulary(loaded, alpha, trie)
        known = Known(vocabulary)

        def emit(ids, texts, keys):
            found = sample_chunk(vocabulary, texts, keys, k, known)
            flat = [s for samples in found for s in samples]
            decoded = vocabulary.decode_all([s["ids"] for s in flat])
            equal, crcs, at = [], [], 0
            for t, samples in zip(texts, found):
                crc = zlib.crc32(t.encode("utf-8", "replace"))
                for d in decoded[at : at + len(samples)]:
                    equal.append(d == t)
                    crcs.append(crc if d == t else zlib.crc32(d.encode("utf-8", "replace")))
                at += len(samples)
            inner = np.concatenate([[0], np.cumsum([len(s["ids"]) for s in flat])]).astype(np.int32)
            values = np.concatenate([s["ids"] for s in flat]).astype(np.int32) if flat else np.empty(0, np.int32)
            structs = pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(inner), pa.array(values)),
                    pa.array([s["log_prob"] for s in flat], pa.float64()),
                    pa.array([s["inclusion"] for s in flat], pa.float64()),
                    pa.array(crcs, pa.int64()),
                    pa.array(equal, pa.bool_()),
                ],
                ["ids", "log_prob", "inclusion", "text_crc32", "round_trip"],
            )
            outer = np.concatenate([[0], np.cumsum([len(samples) for samples in found])]).astype(np.int32)
            return {"id": ids, "samples": pa.ListArray.from_arrays(pa.array(outer), structs).cast(arrow_type)}

        def handle(columns):
            texts = columns["text"]
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            start, chars = 0, 0
            for at, n in enumerate(sizes):
                if at > start and chars + n > CHUNK_CHARS:
                    yield one(columns, start, at)
                    start, chars = at, 0
                chars += n
            yield one(columns, start, len(sizes))

        def one(columns, lo, hi):
            part = {c: columns[c].slice(lo, hi - lo) for c in columns}
            return emit(part["id"], [t or "" for t in part["text"].to_pylist()], part["key"].to_pylist())

        return handle

    return map_batches(rows, f"id {kind}, samples {SAMPLES}", task).withColumnRenamed("id", id_column)


def _samples_type():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(f"x {SAMPLES}")).field("x").type


def decode_pieces(rows: DataFrame, id_column: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) of piece id arrays; null ids give null, unknown ids nothing."""
    pieces = rows.sparkSession.sparkContext.broadcast(load_pieces(model))
    narrow = rows.select(F.col(id_column).alias("id"), F.col(ids).cast("array<int>").alias("ids"))

    def task():
        vocabulary = Vocabulary(pieces.value, 1.0)

        def handle(columns):
            yield {"id": columns["id"], "text": [None if x is None else vocabulary.decode(x) for x in columns["ids"].to_pylist()]}

        return handle

    return map_batches(narrow, f"id {narrow.schema['id'].dataType.simpleString()}, text string", task).withColumnRenamed("id", id_column)
