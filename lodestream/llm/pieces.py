"""SentencePiece encoding and decoding: distinct sampled segmentations of whole texts, without replacement.

A text is cut into units (spaces with the word after them, line feeds alone); pieces are looked for inside units. Inside a unit the
lattice of pieces has exact backward masses, so that an edge's conditional probability is known and the mass of all
segmentations of a text is 1. Gumbel top-k then is a perturbed A* search over regions of the whole text's lattice:

* a region fixes the segmentations of the first units, excludes some for the next one, and leaves the rest free;
* its priority is the largest perturbed log-probability inside it, drawn top-down: a truncated Gumbel with its log mass;
* popping a region samples the segmentation that attains the priority and splits off the region that remains at each unit.

Priorities are exact, so each pop is the next result: no step is wasted. All draws are hashes of (seed, row key, sample,
unit, step): results don't depend on batches, partitions or executors.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import map_batches, resident, texts

SPACE = "▁".encode()
#: Spaces and what follows them up to the next space or line feed; line feeds alone; spaces before those or at the end.
UNITS = re.compile(rb"\n| *[^ \n]+| +")
#: Edges of compiled units that a Python worker keeps, and the longest unit (bytes) that it does: bounds its memory.
KEPT_EDGES, KEPT_UNIT = 6_000_000, 48
#: Bytes of text handled at once: what is worked out for its units takes some hundred times as much.
SLICE = 1 << 18
#: Sample numbers of the draws that aren't a sample's own: those of regions, and single ones.
REGIONS, SCALARS = (1 << 32) - 1, (1 << 32) - 2


class Pieces:
    """Vocabulary of a SentencePiece model: pieces with log-probabilities by Zipf's law of their rank, and byte fallback.

    A merge-trained model has ranks, not probabilities; log p = -alpha * ln(rank + 2) serves for them, so larger alpha sharpens the choice.
    """

    def __init__(self, name: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.of: dict[bytes, tuple[int, float]] = {}
        self.byte_id = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.of[piece.encode()] = (i, -alpha * math.log(len(self.of) + 2))
                self.bytes[i] = piece.replace("▁", " ").encode()
        self.fallback = -alpha * math.log(2 * size + 2)
        self.width = np.fromiter(map(len, self.bytes), np.int64, count=size)
        self.begin = np.cumsum(self.width) - self.width
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._trie()

    def _trie(self) -> None:
        """Prefixes of pieces as states: ``row`` gives a state's row of ``next`` (by byte), row 0 leads nowhere; state 1 is the start."""
        state_of = {b"": 1}
        for piece in self.of:
            for n in range(1, len(piece) + 1):
                state_of.setdefault(piece[:n], len(state_of) + 1)
        inner = dict.fromkeys(p[:-1] for p in state_of if p)
        row_of = {prefix: i for i, prefix in enumerate(inner, 1)}
        self.row = np.zeros(len(state_of) + 1, np.int32)
        self.next = np.zeros((len(inner) + 1, 256), np.int32)
        self.ends = np.full(len(state_of) + 1, -1, np.int32)
        self.score = np.zeros(len(self.bytes))
        for prefix, state in state_of.items():
            self.row[state] = row_of.get(prefix, 0)
            if prefix:
                self.next[row_of[prefix[:-1]], prefix[-1]] = state
        for piece, (i, score) in self.of.items():
            self.ends[state_of[piece]], self.score[i] = i, score
        for i in self.byte_id:
            self.score[i] = self.fallback

    def decode(self, ids: list[int]) -> bytes:
        """Text of a segmentation, without the space that encoding puts first."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """As decode, of segmentations that stand one after the other."""
        size = self.width[ids]
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.begin[ids] - (upto - size), size)
        raw = self.spelled[at].tobytes()
        ends = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [raw[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]

    def lattices(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of units, one after the other: first edge of each node (a byte offset, and one after each unit), whether a node is a unit's last;
        of each edge its piece, end node and conditional log-probability. A character without a piece of its own is a chain of its bytes.
        """
        size = np.fromiter(map(len, units), np.int64, count=len(units))
        text = np.frombuffer(b"\n".join(units) + b"\n", np.uint8)  # the byte at a unit's last node is never read
        n = len(text)
        last = np.zeros(n, bool)
        last[np.cumsum(size + 1) - 1] = True
        left = np.repeat(np.cumsum(size + 1) - 1, size + 1) - np.arange(n)  # bytes from a node to its unit's end
        width = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)[text]
        count, single = np.zeros(n, np.int32), np.zeros(n, bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(node: np.ndarray, end: np.ndarray, piece: np.ndarray) -> None:
            found.append((node, end, piece, count[node]))
            count[node] += 1

        at = np.flatnonzero(((text & 0xC0) != 0x80) & ~last)
        state, step = np.ones(len(at), np.int32), 0
        while len(at):
            state = self.next[self.row[state], text[at + step]]
            step += 1
            piece = self.ends[state]
            hit = np.flatnonzero(piece >= 0)
            emit(at[hit], at[hit] + step, piece[hit])
            single[at[hit][width[at[hit]] == step]] = True
            on = np.flatnonzero((self.row[state] > 0) & (left[at] > step))
            at, state = at[on], state[on]
        bare = np.flatnonzero(((text & 0xC0) != 0x80) & ~last & ~single)
        byte_id = np.array(self.byte_id, np.int32)
        for i in range(4):
            node = bare[(width[bare] > i) & (left[bare] > i)] + i
            emit(node, node + 1, byte_id[text[node]])
        first = np.cumsum(count) - count
        node, end, piece, nth = (np.concatenate(x) for x in zip(*found, strict=True))
        place = first[node] + count[node] - 1 - nth  # longest first: draws mostly end there
        edges = np.empty((3, len(node)), np.int64)
        edges[:, place] = node, end, piece
        node, end, piece = edges
        # No edge spans a cut, so what follows one has the same mass for all that comes before it: masses are counted from the next cut, backward, all
        # nodes at 1, 2, ... bytes from theirs together.
        spans = np.cumsum(np.bincount(node + 1, minlength=n + 2)[: n + 2] - np.bincount(end, minlength=n + 2)[: n + 2])
        cut = spans[:n] == 0
        following = np.minimum.accumulate(np.where(cut, np.arange(n), n)[::-1])[::-1]
        distance = np.append(following[1:], n) - np.arange(n)
        far = distance[node]
        mass, score, lp = np.zeros(n), self.score[piece], np.zeros(len(node))
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 65536 else far, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(far[order])) + 1):
            if not len(group):
                continue
            value = score[group] + mass[end[group]]
            head = np.flatnonzero(np.diff(node[group], prepend=-1))
            which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(group))))
            top = np.maximum.reduceat(value, head)
            total = top + np.log(np.add.reduceat(np.exp(value - top[which]), head))
            start = node[group[head]]
            mass[start] = np.where(cut[start], 0.0, total)
            lp[group] = np.minimum(0.0, value - total[which])
        return first, last, piece, end, lp


class _Numbers(dict):
    """Numbers of units, given as they are first asked for; ``new`` lists those that have no lattice yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.given = 0

    def __missing__(self, unit: bytes) -> int:
        self[unit] = self.given
        self.given += 1
        self.new.append(unit)
        return self.given - 1


#: What stands together of an edge, as it is read together: end node (as ~end where that is a unit's last), piece, log-probability, and its probability with
#: those of the edges before it.
EDGE = np.dtype([("end", np.int32), ("piece", np.int32), ("logp", np.float32), ("upto", np.float32)])


class Lattices:
    """Compiled lattices of units, one after the other in flat arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # pages of memory that aren't written yet take none
        self.start = np.zeros(KEPT_EDGES // 8, np.int32)
        self.first, self.last = np.zeros(KEPT_EDGES, np.int32), np.zeros(KEPT_EDGES, bool)
        self.edge = np.zeros(KEPT_EDGES + (1 << 20), EDGE)
        self.clear()

    def clear(self) -> None:
        self.number_of = _Numbers()
        self.units = 0
        self.nodes = self.edges = 0

    def add(self, units: list[bytes]) -> None:
        if not units:
            return
        units = [x.replace(b" ", SPACE) for x in units]
        first, last, piece, end, logp = self.pieces.lattices(units)
        sizes = np.fromiter(map(len, units), np.int64, count=len(units)) + 1
        self._put(("start",), "units", self.nodes + np.cumsum(sizes) - sizes)
        ends = np.append(first[1:], len(piece))
        some = ends > first
        total = np.concatenate(([0.0], np.cumsum(np.exp(logp))))
        upto = total[1:] - np.repeat(total[first[some]], (ends - first)[some])
        upto[ends[some] - 1] = 2.0  # the last edge of a node takes what rounding leaves
        edge = np.empty(len(piece), EDGE)
        edge["piece"], edge["logp"], edge["upto"] = piece, logp, upto
        edge["end"] = np.where(last[end], ~(end + self.nodes), end + self.nodes)
        self._put(("first", "last"), "nodes", first + self.edges, last)
        self._put(("edge",), "edges", edge)

    def follow(self, edge: int) -> int:
        """The node that an edge ends at."""
        end = int(self.edge["end"][edge])
        return end if end >= 0 else ~end

    def _put(self, names: tuple[str, ...], size: str, *values) -> None:
        at = getattr(self, size)
        for name, x in zip(names, values, strict=True):
            old = getattr(self, name)
            if at + len(x) > len(old):
                grown = np.zeros(max(2 * len(old), at + len(x)), old.dtype)
                grown[:at] = old[:at]
                setattr(self, name, grown)
            getattr(self, name)[at : at + len(x)] = x
        setattr(self, size, at + len(values[0]))

    def nodes_of(self, split: list[list[bytes]]) -> np.ndarray:
        """The first node of every unit of texts, one after the other."""
        if self.edges > KEPT_EDGES:
            self.clear()
        numbers = self.number_of
        found = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, count=sum(map(len, split)))
        self.add(numbers.new)
        for x in numbers.new:
            if len(x) > KEPT_UNIT:
                del numbers[x]
        numbers.new = []
        return self.start[found]


def draws(keys: np.ndarray, unit: np.ndarray, step: int, sample: int) -> np.ndarray:
    """Uniform numbers in (0, 1): splitmix64 of the row's key, the sample, the unit and the step."""
    with np.errstate(over="ignore"):
        z = keys + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z += np.uint64(((step << 32) + sample) * 0xD1342543DE82EF95 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(table: Lattices, node: np.ndarray, keys: np.ndarray, unit: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A free sample of every unit: ids in order, how many each unit has, and each unit's log-probability."""
    n = len(node)
    count, logp = np.zeros(n, np.int32), np.zeros(n)
    active, at = np.arange(n), node.astype(np.int32)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    step, upto = 0, table.edge["upto"]
    while len(active):
        u = draws(keys[active], unit[active], step, sample)
        edge = table.first[at]
        move = np.flatnonzero(upto[edge] < u)
        while len(move):
            edge[move] += 1
            move = move[upto[edge[move]] < u[move]]
        found = table.edge[edge]
        taken.append((active, found["piece"].copy()))
        count[active] += 1
        logp[active] += found["logp"]
        at = found["end"]
        on = np.flatnonzero(at >= 0)
        active, at = active[on], at[on]
        step += 1
    offset = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.int32)
    for step, (who, piece) in enumerate(taken):
        ids[offset[who] + step] = piece
    return ids, count, logp


def gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def truncated(mass: float, top: float, u: float) -> float:
    """A Gumbel of location ``mass``, given that it is at most ``top``."""
    if mass == -math.inf:
        return mass
    x = mass - top
    if x > 30:  # the bound is far below: log(exp(x) - log u) is x + log1p(-log(u) exp(-x))
        return top - math.log1p(-math.log(u) * math.exp(-x))
    return mass - math.log(math.exp(x) - math.log(u))


class Path:
    """A segmentation of a text: ids of all units, how many each has, log-probability of each."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, logp: np.ndarray):
        self.ids, self.count, self.logp = ids, count, logp

    def unit(self, i: int) -> tuple[int, ...]:
        end = int(self.count[: i + 1].sum())
        return tuple(self.ids[end - int(self.count[i]) : end].tolist())

    def upto(self, i: int) -> float:
        """Log-probability of the units before ``i``."""
        return float(self.logp[:i].sum())


def another(table: Lattices, node: int, without: dict[tuple[int, ...], float], u) -> tuple[tuple[int, ...], float]:
    """A segmentation of the unit at ``node`` outside ``without`` (to log-probability), drawn edge by edge with the excluded mass taken off each branch."""
    path: tuple[int, ...] = ()
    total = 0.0
    while not table.last[node]:
        first = int(table.first[node])
        weights = []
        for e in range(first, _edges_end(table, node)):
            branch = path + (int(table.edge["piece"][e]),)
            under = [math.exp(lp - total) for seg, lp in without.items() if seg[: len(branch)] == branch]
            # rounding may leave mass where nothing is left, or none where something is: the lattice decides
            weights.append(0.0 if under and _closed(table, e, path, without) else max(1e-15, math.exp(table.edge["logp"][e]) - sum(under)))
        r, upto = u() * sum(weights), list(itertools.accumulate(weights))
        e = first + next((i for i, w in enumerate(weights) if w > 0.0 and r <= upto[i]), max(i for i, w in enumerate(weights) if w > 0.0))
        path += (int(table.edge["piece"][e]),)
        total += float(table.edge["logp"][e])
        node = table.follow(e)
    return path, total


def _edges_end(table: Lattices, node: int) -> int:
    return int(table.first[node + 1])


def _closed(table: Lattices, edge: int, path: tuple[int, ...], without: dict[tuple[int, ...], float]) -> bool:
    """Whether every segmentation through ``edge`` is excluded."""
    branch = path + (int(table.edge["piece"][edge]),)
    node = table.follow(edge)
    if table.last[node]:
        return branch in without
    if not any(seg[: len(branch)] == branch for seg in without):
        return False
    return all(_closed(table, e, branch, without) for e in range(int(table.first[node]), _edges_end(table, node)))


class Search:
    """Top-k of one text. The agenda holds regions by priority: (-priority, order, unit, path, excluded at the unit)."""

    def __init__(self, table: Lattices, nodes: np.ndarray, key: int, first: Path, k: int):
        self.table, self.nodes, self.key, self.k = table, nodes, np.uint64(key), k
        self.agenda: list[tuple] = []
        self.pushed = 0
        self._numbers = np.zeros(0)
        self._drawn = 0
        self.found = [(first, float(first.logp.sum()), gumbel(self.u()))]

    def u(self) -> float:
        if self._drawn == len(self._numbers):
            more = np.arange(self._drawn, self._drawn + 16)
            self._numbers = np.concatenate((self._numbers, draws(np.full(16, self.key), more, 0, SCALARS)))
        self._drawn += 1
        return float(self._numbers[self._drawn - 1])

    def push(self, priority: float, unit: int, path: Path, out: dict[tuple[int, ...], float] | None = None) -> None:
        heapq.heappush(self.agenda, (-priority, self.pushed, unit, path, out))
        self.pushed += 1

    def step(self, rest: Path) -> int:
        """Pops the best region for the next result, with what follows its unit taken from ``rest``; keeps what the region has left at that unit. Gives the unit after it."""
        priority, _, i, path, out = heapq.heappop(self.agenda)
        out = out or {path.unit(i): float(path.logp[i])}
        seg, lp = another(self.table, int(self.nodes[i]), out, self.u)
        head, tail = int(path.count[:i].sum()), int(rest.count[: i + 1].sum())
        new = Path(np.concatenate((path.ids[:head], np.array(seg, np.int32), rest.ids[tail:])), np.concatenate((path.count[:i], [len(seg)], rest.count[i + 1 :])), np.concatenate((path.logp[:i], [lp], rest.logp[i + 1 :])))
        self.found.append((new, float(new.logp.sum()), -priority))
        out = out | {seg: lp}
        left = 1.0 - math.fsum(map(math.exp, out.values()))
        if left <= 1e-4:  # rounding hides small masses: the lattice says whether anything is left
            node = int(self.nodes[i])
            left = 0.0 if all(_closed(self.table, e, (), out) for e in range(int(self.table.first[node]), _edges_end(self.table, node))) else max(left, 1e-12)
        if left > 0.0:
            self.push(truncated(new.upto(i) + math.log(left), -priority, self.u()), i, new, out)
        return i + 1

    def results(self) -> list[tuple[np.ndarray, float, float, float]]:
        """(ids, log-probability, priority, log inclusion score), best priority first. Inclusion is that of Gumbel top-k: 1 - exp(-exp(log p - kappa)), where kappa is the
        (k+1)th priority; 0 in logs if no segmentation is left."""
        kappa = -self.agenda[0][0] if self.agenda else -math.inf
        return [(p.ids, lp, top, _log_inclusion(lp - kappa)) for p, lp, top in self.found]


def branch_off(searches: list[Search], starts: list[int], nth: int) -> None:
    """Regions that remain beside the last path of each search, at each unit from its start on; of each text the best k + 1, as no more can be reached."""
    paths = [s.found[-1][0] for s in searches]
    size = np.array([len(p.logp) for p in paths], np.int64)
    begin = np.cumsum(size) - size
    logp = np.concatenate([p.logp for p in paths])
    unit = np.arange(len(logp)) - np.repeat(begin, size)
    at = np.flatnonzero((logp < 0.0) & (unit >= np.repeat(np.array(starts, np.int64), size)))
    if not len(at):
        return
    which = np.repeat(np.arange(len(paths)), size)[at]
    total = np.cumsum(logp)
    before = total[at] - logp[at] - (total[begin] - logp[begin])[which]
    mass = before + np.log(-np.expm1(logp[at]))
    top = np.array([s.found[-1][2] for s in searches])[which]
    v = -np.log(draws(np.array([s.key for s in searches], np.uint64)[which], unit[at], nth, REGIONS))
    over = mass - top
    # as in truncated(): a bound far below the mass needs the other form
    value = np.where(over > 30.0, top - np.log1p(v * np.exp(-np.maximum(over, 30.0))), mass - np.log(np.exp(np.minimum(over, 30.0)) + v))
    heads = np.flatnonzero(np.diff(which, prepend=-1))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
    for _ in range(max(s.k for s in searches) + 1):
        best = np.maximum.reduceat(value, heads)
        hit = np.flatnonzero((value == best[group]) & (value > -np.inf))
        if not len(hit):
            break
        hit = hit[np.flatnonzero(np.diff(group[hit], prepend=-1))]
        for j, w, i, x in zip(hit.tolist(), which[hit].tolist(), unit[at[hit]].tolist(), value[hit].tolist(), strict=True):
            searches[w].push(x, i, paths[w])
            value[j] = -np.inf


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    if x > 3.7:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


class Sampler:
    def __init__(self, model: str, alpha: float, seed: int):
        self.pieces = Pieces(model, alpha)
        self.table = Lattices(self.pieces)
        self.seed = seed

    def sample(self, batch: list[bytes], keys: list[str], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Up to ``k`` results (see Search.results) of each text, in order. Empty texts have the empty segmentation alone."""
        split = [UNITS.findall(b" " + x) if x else [] for x in batch]
        size = np.array([len(x) for x in split], np.int64)
        node = self.table.nodes_of(split)
        hashed = np.array([xxhash.xxh64_intdigest(x, self.seed) for x in keys], np.uint64)
        end = np.cumsum(size)
        unit = np.arange(len(node)) - np.repeat(end - size, size)
        by_unit = np.repeat(hashed, size)
        starts = end - size

        def drawn(sample: int) -> list[Path]:
            ids, count, logp = walk(self.table, node, by_unit, unit, sample)
            offset = np.concatenate(([0], np.cumsum(count)))
            return [Path(ids[offset[a] : offset[b]], count[a:b], logp[a:b]) for a, b in zip(starts, end, strict=True)]

        searches = [Search(self.table, node[a:b], int(hashed[d]), path, k) if b > a else None for d, (a, b, path) in enumerate(zip(starts, end, drawn(0), strict=True))]
        if live := [d for d, s in enumerate(searches) if s]:
            branch_off([searches[d] for d in live], [0] * len(live), 0)
        for nth in range(1, k):
            live = [d for d in live if searches[d].agenda]
            if not live:
                break
            rest = drawn(nth)
            branch_off([searches[d] for d in live], [searches[d].step(rest[d]) for d in live], nth)
        return [s.results() if s else [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for s in searches]


def sample_segmentations(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 7, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """For each row of ``docs`` up to ``k`` rows: id, sample_no, n_pieces, log_prob, priority, log_inclusion, ids_xxh64, decodes (and ids).

    sample_no counts from 0 in order of priority; segmentations of a row are distinct, and fewer than ``k`` if the text has fewer. ids_xxh64 is the
    hash of the ids as 32-bit little-endian numbers; decodes says whether the ids decode to the text (U+2581 itself decodes to
    a space, as SentencePiece has it). Null counts as empty: one row with no pieces. The row key is the id as text with the text's hash, so
    repeated rows get the same samples. An empty table gives no row; other columns are ignored.
    """
    schema = "id long, sample_no int, n_pieces long, log_prob double, priority double, log_inclusion double, ids_xxh64 string, decodes boolean" + ", ids array<int>" * with_ids

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        kind = (model, alpha, seed)
        sampler, batch, ids = resident(("pieces", *kind), lambda: Sampler(*kind)), texts(part.column("text")), part.column("id").to_pylist()
        keys = [f"{i}:{xxhash.xxh64_hexdigest(x)}" for i, x in zip(ids, batch, strict=True)]
        results = sampler.sample(batch, keys, k)
        flat = [(i, s, len(found), lp, top, inclusion, xxhash.xxh64_hexdigest(found.astype("<i4", copy=False))) for i, of in zip(ids, results, strict=True) for s, (found, lp, top, inclusion) in enumerate(of)]
        counts, whole = np.array([x[2] for x in flat], np.int64), np.concatenate([r[0] for of in results for r in of])
        plain = [x.replace(SPACE, b" ") for x, of in zip(batch, results, strict=True) for _ in of]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)]
        columns.append(pa.array([a == b for a, b in zip(sampler.pieces.decode_all(whole, counts), plain, strict=True)], pa.bool_()))
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(whole, pa.int32())))
        return pa.record_batch(columns, [x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, "text", schema, work, SLICE)
