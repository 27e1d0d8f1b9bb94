"""SentencePiece encoding by sampling without replacement, and decoding.

All segmentations of a text into pieces of the vocabulary form a lattice.  A segmentation's probability is proportional
to the product of its pieces' weights.  Every segmentation gets the Gumbel-perturbed log-probability it would get if all
were listed; the search finds the ``samples`` largest ones without listing them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import compress
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .token_counts import MARK, default_model

SAMPLES = 2
SEED = 20261
RANK_SHIFT = 64.0  # a piece of merge rank r weighs 1 / (r + RANK_SHIFT): early merges are frequent pieces
SHARPNESS = 1.0  # power of that weight
STEP_CHARS = 120_000  # characters whose lattices are built and searched together: about 80 MB while it lasts
#: Noise from 53-bit uniforms lies within -3.7 and 36.8: a node's bound is at most its log-mass and this.
MOST_NOISE = 36.9
FIRST_PLACES = 256  # places of a path whose bounds say how far along the path others can still be among the best
CACHE_NODES = 1_500_000  # lattice nodes a task keeps: about 120 MB if all were of words that come back
SEEN_MARKS = 1 << 22  # one byte each: which units a task has met, by their hash
JOINED_IDS = 65_536  # piece ids that are spelt at once


class Vocabulary:
    """Pieces of a SentencePiece model as a trie over code points, with a log-weight each."""

    def __init__(self, model: str):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        total = sp.get_piece_size()
        self.surface = [b""] * total
        self.byte_id = np.zeros(256, np.int32)
        used = [i for i in range(total) if not (sp.is_control(i) or sp.is_unknown(i))]
        scores = {i: -sp.get_score(i) for i in used}
        worst = max(scores.values(), default=0.0)
        self.byte_weight = -SHARPNESS * math.log(worst + RANK_SHIFT)
        children: dict[int, int] = {}  # by state << 21 | code point
        piece, weight, self.longest, self.inner = [-1], [0.0], 1, set()
        for i in used:
            p = sp.id_to_piece(i)
            if p.startswith("<0x") and sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
                continue
            self.surface[i] = p.replace(MARK, " ").encode()
            if len(p) > 1:
                self.inner.update(p)
            if MARK in p.lstrip(MARK):
                raise ValueError("a blank inside a piece: units of this vocabulary are not separate")
            self.longest = max(self.longest, len(p))
            state = 0
            for c in map(ord, p):
                step = state << 21 | c
                state = children.get(step)
                if state is None:
                    state = children[step] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
            piece[state], weight[state] = i, -SHARPNESS * math.log(scores[i] + RANK_SHIFT)
        keys = np.array(list(children), np.int64)
        to = np.array(list(children.values()), np.int32)
        self.bits = max(4, (2 * len(keys)).bit_length())  # a table of the trie's steps, at most half full
        self.step_key, self.step_to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self.slots(keys)
        while len(keys):
            free = self.step_key[slot] < 0
            self.step_key[slot[free]], self.step_to[slot[free]] = keys[free], to[free]
            rest = self.step_key[slot] != keys
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        self.goes_on = np.zeros(len(piece), bool)  # states that some step leaves
        self.goes_on[np.array(list(children), np.int64) >> 21] = True
        self.root = np.full(0x110000, -1, np.int32)
        for c, t in children.items():
            if c < 1 << 21:
                self.root[c] = t
        self.size = np.array([len(x) for x in self.surface], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def slots(self, keys):
        import numpy as np

        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, keys):
        """Which of the steps (state, code point) the trie has, and the states they lead to."""
        import numpy as np

        slot = self.slots(keys)
        seen = self.step_key[slot]
        more = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(more):
            slot[more] = at = (slot[more] + 1) & ((1 << self.bits) - 1)
            seen[more] = got = self.step_key[at]
            more = more[(got != keys[more]) & (got >= 0)]
        hit = np.flatnonzero(seen == keys)
        return hit, self.step_to[slot[hit]]

    def joined(self, ids):
        """The bytes of all ids, one after the other, and where each id's begin; in the end where the last one's end."""
        import numpy as np

        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        parts = []
        for low in range(0, len(ids), JOINED_IDS):
            high = min(low + JOINED_IDS, len(ids))
            shift = self.begin[ids[low:high]] - ends[low:high]
            parts.append(self.bytes[np.repeat(shift, size[low:high]) + np.arange(int(ends[low]), int(ends[high]))].tobytes())
        return b"".join(parts), ends


def mixed_bits(x):
    """Well-mixed 64-bit numbers from an array of 64-bit counters."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def counters(key, stream: int, place):
    """What the uniforms of all steps have in common: the row's key, the stream and the place in the row."""
    import numpy as np

    x = place.astype(np.uint64)
    x *= np.uint64(0xD1B54A32D192ED03)
    x += np.uint64((stream * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x += key
    return x


def uniforms(counter, step: int = 0):
    """Uniforms in (0, 1), a function of the counters and the step only."""
    import numpy as np

    x = mixed_bits(counter + np.uint64((step * 0x8CB92BA72F3D8DD7) & ((1 << 64) - 1)))
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0 ** -53
    return out


class Lattices:
    """Lattices of text units, built once per distinct unit.

    A unit is a run of blanks with what follows it, or a line end; no piece crosses its border, so a text's lattice is the
    chain of its units' lattices.  ``first[n] .. first[n + 1]`` are the edges that leave node n: ``piece`` (below 0: the bytes of
    the code point -1 - ``piece``), the node they reach and the log-probability of taking them there, ``upto`` their running
    probability.
    """

    def __init__(self, vocabulary: Vocabulary):
        import re

        import numpy as np

        self.v = vocabulary
        apart = "" if "\n" in vocabulary.inner else "\n"
        self.split = re.compile(f" *[^ {apart}]+| +" + (f"|{apart}" if apart else "")).findall
        self.seen = np.zeros(SEEN_MARKS, bool)
        self.reset()

    def reset(self) -> None:
        import numpy as np

        self.start: dict[str, int] = {}
        self.nodes, self.edges, self.kept = 0, 0, (0, 0)
        self.first = np.zeros(1, np.int64)
        self.to = np.zeros(0, np.int64)
        self.piece = np.zeros(0, np.int32)
        self.log = np.zeros(0)
        self.upto = np.zeros(0)
        self.last = np.zeros(0, bool)

    def prepare(self, units: list[str]):
        """The first nodes of the units' lattices.

        Most distinct units never come back.  A unit's lattice stays from the second step on that needs it; others are dropped
        by the next call.
        """
        import numpy as np

        if self.nodes > 2 * CACHE_NODES or self.kept[0] > CACHE_NODES:
            self.reset()
        self.nodes, self.edges = self.kept
        own = dict.fromkeys(units)
        start = dict(zip(own, map(self.start.get, own)))  # of this call's units only: small beside all that is kept
        new = [u for u, node in start.items() if node is None]
        marks = np.fromiter(map(hash, new), np.int64, len(new)) & (SEEN_MARKS - 1)
        before = self.seen[marks]
        self.seen[marks] = True
        again, passing = list(compress(new, before.tolist())), list(compress(new, (~before).tolist()))
        if again:
            found = self.add(again)
            self.start.update(found)
            start.update(found)
            self.kept = self.nodes, self.edges
        if passing:
            start.update(self.add(passing))
        return np.fromiter(map(start.__getitem__, units), np.int64, len(units))

    def room(self, nodes: int, edges: int) -> None:
        """Arrays for so many nodes and edges.  They grow by half at least, so little is copied."""
        import numpy as np

        for names, size, used in ((("to", "piece", "log", "upto"), edges, self.edges), (("last",), nodes, self.nodes),
                                  (("first",), nodes + 1, self.nodes + 1)):
            for name in names:
                old = getattr(self, name)
                if len(old) < size:
                    new = np.empty(max(size, len(old) * 3 // 2), old.dtype)
                    new[:used] = old[:used]
                    setattr(self, name, new)

    def add(self, units: list[str]) -> list[tuple[str, int]]:
        """Build the lattices of new units: edges by walking the trie from all places at once, masses backwards.

        Returns the units with their first nodes.

        Nodes are numbered by their distance from the unit's end, and by unit inside a distance: the masses of one distance
        need those of smaller ones only, and are a few operations on a stretch of all edges.
        """
        import numpy as np

        v = self.v
        units = sorted(units, key=len, reverse=True)
        lengths = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(lengths)
        longest = int(lengths[0])
        some = np.searchsorted(-lengths, -np.arange(longest + 1), "right")  # units at least that long
        offset = np.concatenate([[0], np.cumsum(some)])
        size = int(offset[-1])
        distance = np.repeat(np.arange(longest + 1), some)
        rank = np.arange(size) - np.repeat(offset[:-1], some)
        text = np.frombuffer("".join(units).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        place = ends[rank] - distance  # in the text
        point = np.full(size, -1, np.int32)
        point[some[0]:] = text[place[some[0]:]]
        alive = np.arange(some[0], size)
        state = v.root[point[alive]]
        alive = alive[state >= 0]
        state = state[state >= 0]
        found = []
        for n in range(1, v.longest + 1):
            which = v.piece[state]
            hit = np.flatnonzero(which >= 0)
            found.append((alive[hit], which[hit], v.weight[state[hit]]))
            go = np.flatnonzero(v.goes_on[state] & (distance[alive] > n))
            if not len(go):
                break
            alive = alive[go]
            hit, state = v.step((state[go].astype(np.int64) << 21) | text[place[alive] + n])
            alive = alive[hit]
        bare = np.ones(size, bool)
        bare[:some[0]] = False
        bare[found[0][0]] = False
        bare = np.flatnonzero(bare)
        number = np.bincount(np.concatenate([bare, *[f[0] for f in found]]), minlength=size)
        first = np.concatenate([[0], np.cumsum(number)])
        edges = int(first[-1])
        to, piece, log = np.empty(edges, np.int64), np.empty(edges, np.int32), np.empty(edges)
        spot = first[:-1].copy()
        for n in range(len(found), 0, -1):  # a node's longest piece first: usually the likeliest one
            node, which, weight = found[n - 1]
            at = spot[node]
            to[at], piece[at], log[at] = offset[distance[node] - n] + rank[node], which, weight
            spot[node] += 1
        p = point[bare]
        at = spot[bare]
        to[at], piece[at] = offset[distance[bare] - 1] + rank[bare], -1 - p
        log[at] = v.byte_weight * (1 + (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF))
        mass, chance, totals = np.zeros(size), np.empty(edges), np.ones(size)
        for d in range(1, longest + 1):
            low, high = int(offset[d]), int(offset[d + 1])
            begin, end = int(first[low]), int(first[high])
            starts, counts = first[low:high] - begin, number[low:high]
            value = log[begin:end] + mass[to[begin:end]]
            top = np.maximum.reduceat(value, starts)
            value -= np.repeat(top, counts)
            log[begin:end] = value
            share = np.exp(value, out=chance[begin:end])
            totals[low:high] = total = np.add.reduceat(share, starts)
            mass[low:high] = top + np.log(total)
        chance /= np.repeat(totals, number)
        log -= np.repeat(np.log(totals), number)
        log = np.minimum(log, 0.0)
        run = np.cumsum(chance)
        upto = run - np.repeat(np.concatenate([[0.0], run])[first[:-1]], number)
        upto[first[1:][number > 0] - 1] = 2.0  # whatever is left of the interval
        self.room(self.nodes + size, self.edges + edges)
        here, there = slice(self.nodes, self.nodes + size), slice(self.edges, self.edges + edges)
        self.first[self.nodes:self.nodes + size + 1] = first + self.edges
        self.last[here] = distance == 0
        self.to[there] = to + self.nodes
        self.piece[there], self.log[there], self.upto[there] = piece, log, upto
        begin = offset[lengths] + np.arange(len(units)) + self.nodes
        self.nodes, self.edges = self.nodes + size, self.edges + edges
        return list(zip(units, begin.tolist()))

    def units(self, text: str) -> list[str]:
        return self.split(" " + text.replace(MARK, " ")) if text else []

    def walk(self, node, key, place, stream: int):
        """Sample a way to the end of each unit from ``node`` on.  Returns edges and their units' indices, in order."""
        import numpy as np

        all_edges, all_units, step = [], [], 0
        live = np.arange(len(node))
        live = live[~self.last[node]]
        cur = node[live]
        counter = counters(key, stream, place)
        while len(live):
            u = uniforms(counter[live], step)
            e = self.first[cur]
            over = np.flatnonzero(self.upto[e] < u)
            while len(over):
                e[over] += 1
                over = over[self.upto[e[over]] < u[over]]
            all_edges.append(e)
            all_units.append(live)
            cur = self.to[e]
            go = ~self.last[cur]
            live, cur, step = live[go], cur[go], step + 1
        if not all_edges:
            return np.zeros(0, np.int64), np.zeros(len(node), np.int64)
        unit = np.concatenate(all_units)
        number = np.bincount(unit, minlength=len(node))
        begin = np.cumsum(number) - number
        place_of = begin[unit] + np.repeat(np.arange(len(all_units)), [len(x) for x in all_units])
        edges = np.empty(len(unit), np.int64)
        edges[place_of] = np.concatenate(all_edges)
        return edges, number


def _runs(lengths):
    """0, 1, .. inside each run."""
    import numpy as np

    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Sampler:
    def __init__(self, model: str, samples: int = SAMPLES, seed: int = SEED):
        self.lattices = Lattices(Vocabulary(model))
        self.samples, self.seed = samples, seed

    def sample(self, keys: list[int | None], texts: list[str | None]) -> list[list[tuple]]:
        """For each row its samples, best first: (edges, log-probability, perturbed, inclusion).

        The tree of the search: a node fixes a prefix of pieces and excludes some edges after it.  A node's bound is the
        largest perturbed log-probability below it, drawn from the Gumbel law of its mass cut at its parent's bound.  Taking
        the best node off the heap and following likely edges to the end yields one new segmentation that has just this bound;
        what was not taken along the way becomes new nodes.
        """
        import numpy as np

        lat = self.lattices
        rows = [lat.units(t or "") for t in texts]
        flat = [u for r in rows for u in r]
        size = np.array([len(r) for r in rows], np.int64)
        start = lat.prepare(flat)
        begin = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            seeds = mixed_bits(np.array([(0 if k is None else k) & ((1 << 64) - 1) for k in keys], np.uint64)
                               + np.uint64(self.seed))
        out: list[list[tuple]] = [[] for _ in rows]
        heaps: list[list] = [[] for _ in rows]
        serial = 0
        # the first segmentation: no prefix, no exclusion, all units
        top = -np.log(-np.log(uniforms(counters(seeds, 1, np.zeros(len(rows))))))
        edges, number = lat.walk(start, np.repeat(seeds, size), _runs(size), 2)
        ends = np.concatenate([[0], np.cumsum(number)])
        cut = ends[np.concatenate([begin, [len(start)]])] if len(rows) else ends
        paths = [edges[cut[i]:cut[i + 1]] for i in range(len(rows))]
        tokens = [number[b:b + n] for b, n in zip(begin, size)]  # pieces of each unit
        fixed = [0] * len(rows)
        bounds, turn = list(top), list(range(len(rows)))
        for nth in range(1, self.samples + 1):
            logs = [lat.log[path] for path in paths]
            befores = [np.cumsum(x) - x for x in logs]
            best = self.next_nodes(seeds[turn], logs, befores, np.array(bounds), fixed, nth)
            for i, path, held, bound, step_log, before, few in zip(turn, paths, tokens, bounds, logs, befores, best):
                out[i].append((path, float(before[-1] + step_log[-1]) if len(path) else 0.0, float(bound)))
                for minus_reach, at in few:
                    serial += 1
                    heapq.heappush(heaps[i], (minus_reach, serial, path, held, at, (int(path[at]),), float(before[at])))
            if nth == self.samples:
                break
            bounds, heads, nodes, keys_of, places, counts = [], [], [], [], [], []
            turn = [i for i, heap in enumerate(heaps) if heap]
            popped = [heapq.heappop(heaps[i]) for i in turn]
            leaves = np.array([x[4] for x in popped], np.int64)
            choices = uniforms(counters(seeds[turn], 200 + nth, leaves)).tolist()
            noises = uniforms(counters(seeds[turn], 300 + nth, leaves)).tolist()
            for i, (reach, _, path, held, at, barred, before), u, noise in zip(turn, popped, choices, noises):
                upto = np.cumsum(held)
                u_at = int(np.searchsorted(upto, at, "right"))
                opening = int(upto[u_at - 1]) if u_at else 0  # where that unit's pieces begin
                node = int(lat.to[path[at - 1]]) if at > opening else int(start[begin[i] + u_at])
                choice = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in barred]
                chance = np.exp(lat.log[choice])
                pick = int(min(np.searchsorted(np.cumsum(chance), u * chance.sum()), len(choice) - 1))
                others = chance.sum() - chance[pick]
                if len(choice) > 1 and others > 0:
                    serial += 1
                    again = -math.log(math.exp(reach) - math.log(noise) / math.exp(max(before + math.log(others), -700.0)))
                    heapq.heappush(heaps[i], (-again, serial, path, held, at, (*barred, choice[pick]), before))
                bounds.append(-reach)
                heads.append((np.append(path[:at], choice[pick]), held[:u_at], at - opening + 1))
                nodes.append(np.concatenate([[lat.to[choice[pick]]], start[begin[i] + u_at + 1:begin[i] + size[i]]]))
                places.append(np.arange(u_at, size[i]))
                keys_of.append(np.full(size[i] - u_at, seeds[i]))
                counts.append(size[i] - u_at)
            if not turn:
                break
            edges, number = lat.walk(np.concatenate(nodes), np.concatenate(keys_of), np.concatenate(places), 2 + nth)
            ends = np.concatenate([[0], np.cumsum(number)])
            own = np.concatenate([[0], np.cumsum(counts)])
            cut = ends[own]
            number[own[:-1]] += [h[2] for h in heads]
            paths = [np.concatenate([h[0], edges[cut[j]:cut[j + 1]]]) for j, h in enumerate(heads)]
            tokens = [np.concatenate([h[1], number[own[j]:own[j + 1]]]) for j, h in enumerate(heads)]
            fixed = [len(h[0]) for h in heads]
        done = []
        for i, found in enumerate(out):
            threshold = -heaps[i][0][0] if heaps[i] else -math.inf
            done.append([(p, lp, g, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(lp - threshold, 700.0))))
                         for p, lp, g in found])
        return done

    def next_nodes(self, seeds, logs: list, befores: list, bounds, fixed: list[int], nth: int) -> list[list[tuple]]:
        """For each path the best nodes beside it, at most ``samples``: (-bound, place where the node leaves the path).

        ``logs`` are the log-probabilities of the path's edges, ``befores`` their sums up to each edge, ``bounds`` the path's
        own bounds.  The places of all paths are drawn together.
        """
        import numpy as np

        best: list[list[tuple]] = [[] for _ in logs]
        least, done, turn = [-math.inf] * len(logs), list(fixed), list(range(len(logs)))
        while True:
            # the places from an end on hold a mass of at most before[...]; below the last of the best they cannot come in
            ends = {j: min(done[j] + FIRST_PLACES, len(logs[j])) if least[j] == -math.inf else int(
                np.searchsorted(-befores[j], MOST_NOISE - least[j], "right")) for j in turn}
            turn = [j for j in turn if ends[j] > done[j]]
            if not turn:
                return best
            number = np.array([ends[j] - done[j] for j in turn])
            cut = np.cumsum(number).tolist()
            place = _runs(number) + np.repeat([done[j] for j in turn], number)
            step_log = np.concatenate([logs[j][done[j]:ends[j]] for j in turn])
            rest = np.concatenate([befores[j][done[j]:ends[j]] for j in turn])
            rest += np.log(-np.expm1(np.minimum(step_log, -1e-300)))
            noise = uniforms(counters(np.repeat(seeds[turn], number), 100 + nth, place))
            reach = np.log(np.repeat(np.exp(-bounds[turn]), number) - np.log(noise) * np.exp(-np.maximum(rest, -700.0)))
            reach[step_log > -1e-15] = np.inf
            for j, begin, end in zip(turn, [0, *cut], cut):
                part = reach[begin:end]
                few = np.argpartition(part, self.samples)[:self.samples] if end - begin > self.samples else np.arange(end - begin)
                best[j] += [(r, done[j] + at) for r, at in zip(part[few].tolist(), few.tolist()) if r < math.inf]
                best[j] = sorted(best[j])[:self.samples]
                least[j] = -best[j][-1][0] if len(best[j]) == self.samples else -math.inf
                done[j] = ends[j]

    def ids(self, path):
        """Piece ids of a path of edges."""
        return self.ids_of([path])[0]

    def ids_of(self, paths: list):
        """(piece ids of all paths, one after the other; how many each has).

        A character without a piece becomes its bytes.
        """
        import numpy as np

        lengths = np.array([len(p) for p in paths], np.int64)
        edges = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        piece = self.lattices.piece[edges]
        bare = np.flatnonzero(piece < 0)
        point = -1 - piece[bare]
        wide = np.flatnonzero(point > 0x7F)
        piece[bare] = self.lattices.v.byte_id[np.minimum(point, 0x7F)]
        if not len(wide):
            return piece, lengths
        more = (point[wide] > 0x7FF).astype(np.int64) + (point[wide] > 0xFFFF) + 1
        number = np.ones(len(edges), np.int64)
        number[bare[wide]] += more
        out = np.repeat(piece, number)
        at = (np.cumsum(number) - number)[bare[wide]]
        for a, p in zip(at, point[wide]):
            raw = chr(p).encode("utf-8", "surrogatepass")
            out[a:a + len(raw)] = self.lattices.v.byte_id[np.frombuffer(raw, np.uint8)]
        ends = np.concatenate([[0], np.cumsum(number)])[np.concatenate([[0], np.cumsum(lengths)])]
        return out, np.diff(ends)


def spelt(ids: list[int], surface: list[bytes]) -> bytes:
    """The bytes that piece ids stand for, without the one blank that encoding puts in front."""
    raw = b"".join(itemgetter(*ids, 0)(surface)[:-1]) if ids else b""
    return raw[1:] if raw.startswith(b" ") else raw


def decoded(ids: list[int], surface: list[bytes]) -> str:
    """Text of piece ids."""
    return spelt(ids, surface).decode("utf-8", "replace")


def encode(docs: DataFrame, samples: int = SAMPLES, model: str | None = None, seed: int = SEED, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, sample, ids, log_prob, perturbed, inclusion, exact), up to ``samples`` rows per row of ``docs``.

    The samples of a row are distinct segmentations, drawn without replacement in the order of ``perturbed``.
    ``inclusion`` is the probability that a segmentation reaches the threshold, the next perturbed value; weights
    1 / inclusion make sums over the samples unbiased.  A text with fewer segmentations gives all of them, with inclusion 1.
    ``exact`` says that decoding gave the text back.

    Randomness depends on the key and ``seed`` only, so reruns and repeated rows agree; null keys count as 0.  Null and empty
    texts have one segmentation without pieces.  An empty table gives no rows; extra columns are ignored.
    """
    arrow_rows(docs.sparkSession, 256)
    path = model or default_model()

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sampler = Sampler(path, samples, seed)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(keys):
                end, chars = at, 0
                while end < len(keys) and (end == at or chars + len(texts[end] or "") <= STEP_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                found = sampler.sample(keys[at:end], texts[at:end])
                flat, number = sampler.ids_of([edges for row in found for edges, *_ in row])
                offsets = np.concatenate([[0], np.cumsum(number)])
                raw, places = sampler.lattices.v.joined(flat)
                cuts = places[offsets].tolist()
                columns: list[list] = [[] for _ in range(6)]
                nth = 0
                for k, t, row in zip(keys[at:end], texts[at:end], found):
                    # the vocabulary's own mark for a blank decodes as a blank
                    plain = (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass")
                    for n, (_, log_prob, perturbed, inclusion) in enumerate(row, 1):
                        # without the one blank that encoding puts in front
                        same = raw[cuts[nth] + raw.startswith(b" ", cuts[nth], cuts[nth + 1]):cuts[nth + 1]] == plain
                        nth += 1
                        for column, value in zip(columns, (k, n, log_prob, perturbed, inclusion, same)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32())),
                    pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64()),
                    pa.array(columns[5], pa.bool_())],
                    names=["k", "sample", "ids", "log_prob", "perturbed", "inclusion", "exact"])
                at = end

    narrow = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    return narrow.mapInArrow(mapped, "k long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, "
                                     "exact boolean").withColumnRenamed("k", key)


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with ``out`` in place of the ids: the text they stand for; null ids give a null text."""
    path = model or default_model()
    at = encoded.columns.index(ids)
    kept = [f for f in encoded.schema.fields if f.name not in (ids, out)]

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        surface = Vocabulary(path).surface
        for batch in batches:
            texts = [None if x is None else decoded(x, surface) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())],
                                             names=[*[f.name for f in kept], out])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(mapped, StructType([*kept, StructField(out, StringType())]))
