"""N-best segmentation of texts into the pieces of a SentencePiece model, and decoding.

The first segmentation of a text is the model's own, as its library encodes it; the others are the best of the lattice without it. In the
lattice white space is written as U+2581, a piece is an edge, a path is a segmentation and its score the sum of its pieces' scores.
Viterbi runs forward and leaves the best score up to each place; A-star runs backward with those scores as exact heuristics, so
the paths that reach the start come out best first. A character that no piece covers is its UTF-8 bytes' pieces.

A unigram model's own encoding is the lattice's best path. A merge model's is not in general: it merges by rank, which is no sum over
pieces; there the scores only order the alternatives.

Between two characters that are next to each other in no piece every path has a cut. A text falls into chunks and these into units there; each
distinct chunk is solved once, the new ones of some texts together by arrays, and the N best of a text are merged from the N - 1 chunks whose
second best costs least. A process keeps the chunks met last, so memory is bounded; texts of any length are read whole.

Null and empty texts have no pieces and one segmentation, the empty one, of score 0. Ties: the segmentation whose last differing piece is
longer comes first. A literal U+2581 decodes to a space, as in the library, so such texts don't round-trip. Repeated rows
give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain, count, pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SPACE = "▁"
#: What a character of no piece costs beyond the worst piece, as in the library's own lattice.
PENALTY = 10.0
_CHUNK = re.compile(f"[{SPACE}\n]+[^{SPACE}\n]*")
_BEST = 4
#: Chunks up to so many characters are solved by arrays, so many at once; texts of so many characters or so are met together.
LONG, MANY, TOGETHER = 60, 20_000, 500_000


#: Where the curve of chances by rank bends; from 30 to 1000 it hardly matters.
SHIFT = 100.0


def _chances(scores: dict[int, float]) -> dict[int, float]:
    """The pieces' log-probabilities. A unigram model's scores are these. A merge model's are places in the order of merges (0, -1, -2, ...), which
    don't add up to anything; there the chance of the piece of rank r is taken as 1 / (r + SHIFT) over the sum of all, as words are
    distributed by rank (Zipf and Mandelbrot). Scores that forbid a piece stay.
    """
    used = sorted((s for s in scores.values() if s > -1e8), reverse=True)
    if any(s != -k for k, s in enumerate(used)):
        return scores
    whole = np.log(sum(1 / (k + SHIFT) for k in range(len(used))))
    return {i: float(-np.log(SHIFT - s) - whole) if s > -1e8 else s for i, s in scores.items()}


class Column:
    """An array that grows."""

    def __init__(self, kind: str):
        self.whole, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.whole):
            self.whole = np.append(self.whole[: self.n], np.empty(max(self.n, len(more)), self.whole.dtype))
        self.whole[self.n : self.n + len(more)] = more
        self.n += len(more)


def _gathered(ids: Column, ends: Column, sizes: Column, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chunks at these places, one after the other, and where each chunk's end."""
    size = sizes.whole[at]
    stop = np.cumsum(size)
    return ids.whole[np.repeat(ends.whole[at] - stop, size) + np.arange(stop[-1])], stop


class Segmenter:
    def __init__(self, path: str, limit: int = 1_600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in every]
        self.bytes = {int(self.names[i][3:5], 16): i for i in every if model.is_byte(i)}
        self.model = model
        self.kinds = [0 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) else 1 for i in every]
        own = {i: model.get_score(i) for i in every if self.kinds[i] == 1}
        self.pieces = {self.names[i]: (i, score) for i, score in _chances(own).items()}
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        #: whether no piece goes on over the beginning of a chunk; else a text is one chunk
        self.cut = not any(pair[1] in (SPACE, "\n") and pair[0] not in (SPACE, "\n") for pair in self.inside)
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - PENALTY
        self.scores = {i: score for i, score in self.pieces.values()}
        self.limit = limit
        self._forget()
        #: character -> score (None: the characters so far are no piece), packed id and the characters that may follow, to any depth
        self.trie: dict = {}
        for p, (i, score) in self.pieces.items():
            at = self.trie
            for c in p[:-1]:
                at = at.setdefault(c, [None, b"", {}])[2]
            at.setdefault(p[-1], [None, b"", {}])[:2] = score, i.to_bytes(4, "little")
        for c, step in self.trie.items():
            if step[0] is None:
                step[:2] = self.unknown, self._spelled(c)
        self.text = [bytes([int(self.names[i][3:5], 16)]) if self.kinds[i] == 0 else self.names[i].replace(SPACE, " ").encode() if self.kinds[i] == 1 else b"" for i in every]
        self._tabled()

    # --- a unit ---

    def _spelled(self, character: str) -> bytes:
        """Packed ids of the bytes of a character that no piece covers."""
        return b"".join([self.bytes[c].to_bytes(4, "little") for c in character.encode("utf-8", "surrogatepass")])

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place the edges that end there: where they start, their score and ids."""
        n = len(unit)
        ends: list = [[] for _ in range(n + 1)]
        pieces, begins = self.pieces, self.begins
        for i in range(n):
            j = i + 1
            while j <= n:
                part = unit[i:j]
                found = pieces.get(part)
                if found:
                    ends[j].append((i, found[1], (found[0],)))
                elif j == i + 1:
                    ends[j].append((i, self.unknown, tuple(self.bytes[b] for b in part.encode("utf-8", "surrogatepass"))))
                if part not in begins:
                    break
                j += 1
        return ends

    @staticmethod
    def forward(ends: list) -> tuple[list[float], float]:
        """The best score up to each place, and the second best of the whole (minus infinity if there is one path)."""
        first, second = [0.0], [-np.inf]
        for into in ends[1:]:
            a = b = -np.inf
            for i, score, _ in into:
                x = first[i] + score
                if x > a:
                    a, b = x, a
                elif x > b:
                    b = x
                y = second[i] + score
                if y > b:
                    b = y
            first.append(a)
            second.append(b)
        return first, second[-1]

    def best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit, best first: A-star from its end, the forward scores as heuristic."""
        ends = self.edges(unit)
        first, _ = self.forward(ends)
        tick, out = count(), []
        heap = [(-first[-1], 0, next(tick), len(unit), 0.0, ())]
        while heap and len(out) < n:
            _, _, _, at, tail, ids = heapq.heappop(heap)
            if not at:
                out.append((tail, ids))
                continue
            for i, score, own in ends[at]:
                heapq.heappush(heap, (-(first[i] + score + tail), i, next(tick), i, score + tail, own + ids))
        return out

    def solved(self, unit: str) -> tuple[bytes, float, float]:
        """Packed ids and score of the best segmentation, and what the second best costs more (infinite if there is none).

        As `edges` and `forward`, in one pass over the unit.
        """
        found = self.units.get(unit)
        if found is not None:
            return found
        n, trie, low = len(unit), self.trie, float("-inf")
        first, second, back, last = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1), [b""] * (n + 1)
        first[0] = 0.0
        for i, c in enumerate(unit):
            a, b, j = first[i], second[i], i + 1
            score, own, more = trie.get(c) or (self.unknown, self._spelled(c), None)
            while True:
                if score is not None:
                    x, y = a + score, b + score
                    if x > first[j]:
                        if first[j] > y:
                            y = first[j]
                        first[j], back[j], last[j] = x, i, own
                    else:
                        y = x
                    if y > second[j]:
                        second[j] = y
                if not more or j == n:
                    break
                step = more.get(unit[j])
                if step is None:
                    break
                score, own, more = step
                j += 1
        at, parts = n, []
        while at:
            parts.append(last[at])
            at = back[at]
        parts.reverse()
        found = self.units[unit] = (b"".join(parts), first[n], first[n] - second[n])
        return found

    # --- a text ---

    def split(self, text: str) -> list[str]:
        """The units of a run of characters."""
        joined = list(map(self.inside.__contains__, map(add, text, text[1:])))
        if all(joined):
            return [text]
        cuts = [0, *(k for k, whole in enumerate(joined, 1) if not whole), len(text)]
        return [text[a:b] for a, b in pairwise(cuts)]

    def _forget(self) -> None:
        """chunks has the place of each chunk in the columns: score of the lattice's best, what its second best costs more, score of the library's own
        encoding, whether that decodes to the chunk, and the ids of both, with where they end and how many they are."""
        self.units, self.chunks, self.options = {}, {}, {}
        self.best_score, self.gap, self.own_score, self.same = Column("f8"), Column("f8"), Column("f8"), Column("?")
        self.best_ids, self.own_ids = (Column("<u4"), Column("i8"), Column("i8")), (Column("<u4"), Column("i8"), Column("i8"))

    def _tabled(self) -> None:
        """The trie as arrays: states are numbered from 1, and steps from state to state are found by hash."""
        self.letters = {c: k for k, c in enumerate(sorted({c for p in self.pieces for c in p}), 1)}
        self.letter = np.zeros(max(map(ord, self.letters)) + 2, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in self.letters]] = list(self.letters.values())
        scores, ids, steps, todo = [-np.inf], [-1], [], [(0, self.trie)]
        while todo:
            state, more = todo.pop()
            for c, (score, _, then) in more.items():
                steps.append((state * (len(self.letters) + 1) + self.letters[c], len(scores)))
                if then:
                    todo.append((len(scores), then))
                scores.append(-np.inf if score is None else score)
                ids.append(-1)
        at = {k: v for k, v in steps}
        for p, (i, _) in self.pieces.items():
            state = 0
            for c in p:
                state = at[state * (len(self.letters) + 1) + self.letters[c]]
            ids[state] = i
        self.plain = np.zeros(len(self.letter), bool)  # whether a character is a piece
        self.plain[[ord(c) for c, step in self.trie.items() if c in self.pieces]] = True
        self.id_score = np.array([self.scores.get(i, np.nan) for i in range(len(self.kinds))])
        self.id_bytes = np.array([len(x) for x in self.text])
        self.state_score, self.state_id = np.array(scores), np.array(ids, np.int64)
        size = 1 << (8 * len(steps)).bit_length()
        self.slots, self.slot_key, self.slot_state = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for key, state in steps:
            k = self._slot(key)
            while self.slot_key[k] >= 0:
                k = k + 1 & self.slots
            self.slot_key[k], self.slot_state[k] = key, state

    def _slot(self, key):
        return (key ^ key >> 7) * 0x9E3779B1 >> 12 & self.slots

    def _next(self, key: np.ndarray) -> np.ndarray:
        """The states that steps lead to; 0: there is none."""
        slot = self._slot(key)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_state[slot], 0)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.slots
            there = self.slot_key[slot[left]]
            good = there == key[left]
            out[left[good]] = self.slot_state[slot[left[good]]]
            left = left[(there >= 0) & ~good]
        return out

    def _lattices(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As `solved`, of many chunks of LONG characters at most, each of which is a piece: ids, how many of each chunk, scores and gaps.

        Edges of one length that end at one distance from the chunks' beginnings are taken together.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.letter[np.minimum(codes, len(self.letter) - 1)]
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(chunks)), sizes)
        at, until, begin = np.arange(len(codes)), ends[of], (ends - sizes)[of]
        width = len(self.letters) + 1
        starts, lengths, states = [], [], []
        state, alive = self._next(letter), at
        for length in count(1):
            good = self.state_id[state] >= 0
            starts.append(alive[good])
            states.append(state[good])
            lengths.append(np.full(len(starts[-1]), length))
            good = alive + length < until[alive]
            alive, state = alive[good], state[good]
            if not len(alive):
                break
            state = self._next(state * width + letter[alive + length])
            alive, state = alive[state > 0], state[state > 0]
        start, length, state = np.concatenate(starts), np.concatenate(lengths), np.concatenate(states)
        place = start - begin[start] + length
        most = int(length.max()) + 1
        key = place * most + (most - length)  # to each place the longest edge first
        order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")
        start, length, state = start[order], length[order], state[order]
        node = start + of[start]  # a chunk has a node more than characters
        then, score = node + length, self.state_score[state]
        first, second, back = np.full(len(codes) + len(chunks), -np.inf), np.full(len(codes) + len(chunks), -np.inf), np.zeros(len(codes) + len(chunks), np.int64)
        origin, last = ends - sizes + np.arange(len(chunks)), ends + np.arange(len(chunks))
        first[origin] = 0.0
        bounds = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order)).tolist()
        for a, b in pairwise(bounds):
            i, j, s = node[a:b], then[a:b], score[a:b]
            x, y, f = first[i] + s, second[i] + s, first[j]
            better = x > f
            second[j] = np.maximum(second[j], np.where(better, np.maximum(y, f), x))
            first[j] = np.where(better, x, f)
            back[j[better]] = np.flatnonzero(better) + a
        whose, now, found = np.arange(len(chunks)), last, []
        while len(whose):
            edge = back[now]
            found.append((whose, self.state_id[state[edge]]))
            now = node[edge]
            more = now != origin[whose]
            whose, now = whose[more], now[more]
        n = np.bincount(np.concatenate([w for w, _ in found]), minlength=len(chunks))
        stop = np.cumsum(n)
        ids = np.empty(int(stop[-1]), "<u4")
        for k, (w, own) in enumerate(found, 1):
            ids[stop[w] - k] = own
        return ids, n, first[last], first[last] - second[last]

    def _by_units(self, chunk: str) -> tuple[bytes, float, float]:
        own = [self.solved(u) for u in self.split(chunk)]
        return b"".join([x[0] for x in own]), sum([x[1] for x in own]), min([x[2] for x in own])

    def _solve(self, chunks: list[str]) -> None:
        """Puts chunks (white space and what follows) into the columns."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        odd = sizes > LONG
        odd[np.repeat(np.arange(len(chunks)), sizes)[~self.plain[np.minimum(codes, len(self.plain) - 1)]]] = True
        short = [c for c, x in zip(chunks, odd.tolist(), strict=True) if not x]
        rest = [c for c, x in zip(chunks, odd.tolist(), strict=True) if x]
        chunks = short + rest
        ids, n, best, gap = self._lattices(short) if short else (np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0), np.empty(0))
        if rest:
            more = [self._by_units(c) for c in rest]
            ids, n = np.append(ids, np.frombuffer(b"".join([x[0] for x in more]), "<u4")), np.append(n, [len(x[0]) // 4 for x in more])
            best, gap = np.append(best, [x[1] for x in more]), np.append(gap, [x[2] for x in more])
        # the library puts a space before what it encodes: the chunk's own first one, or one of its own, whose piece then goes
        plain = self.model.encode([c.removeprefix(SPACE).replace(SPACE, " ") for c in chunks], num_threads=1)
        space = [self.pieces[SPACE][0]]
        plain = [space if c == SPACE else own if c[0] == SPACE else own[1:] for c, own in zip(chunks, plain, strict=True)]
        said, m = np.fromiter(chain.from_iterable(plain), "<u4"), np.fromiter(map(len, plain), np.int64, len(plain))
        of = np.repeat(np.arange(len(chunks)), m)
        equal = n == m
        equal[equal] = np.bincount(np.repeat(np.arange(int(equal.sum())), m[equal]), said[equal[of]] != ids[np.repeat(equal, n)], int(equal.sum())) == 0
        score = np.where(equal, best, np.bincount(of, self.id_score[said], len(chunks)))
        for k in np.flatnonzero(np.isnan(score)).tolist():  # with bytes
            score[k] = self._scored(plain[k])
        texts = [c.replace(SPACE, " ").encode("utf-8", "surrogatepass") for c in chunks]
        spelled = list(map(self.text.__getitem__, said.tolist()))
        same = np.bincount(of, self.id_bytes[said], len(chunks)) == np.fromiter(map(len, texts), np.int64, len(texts))
        if not same.all() or b"".join(spelled) != b"".join(texts):
            cuts = [0, *np.cumsum(m).tolist()]
            same = np.array([b"".join(spelled[a:b]) == t for (a, b), t in zip(pairwise(cuts), texts, strict=True)])
        self.chunks.update(zip(chunks, range(self.gap.n, self.gap.n + len(chunks)), strict=True))
        for (own, ends, counts), new, size in ((self.best_ids, ids, n), (self.own_ids, said, m)):
            ends.add(own.n + np.cumsum(size)), counts.add(size), own.add(new)
        self.best_score.add(best), self.gap.add(gap), self.own_score.add(score), self.same.add(same)

    def _scored(self, ids: list[int]) -> float:
        """The score of a path: bytes' pieces count once for each character that they spell."""
        total, spelled = 0.0, b""
        for i in ids:
            if self.kinds[i]:
                total += self.scores[i]
            else:
                spelled += self.text[i]
        return total + self.unknown * len(spelled.decode("utf-8", "replace"))

    def _named(self, text: str) -> list[str]:
        whole = SPACE + text.replace(" ", SPACE)
        return _CHUNK.findall(whole) if self.cut else [whole]

    def _meet(self, names: set[str]) -> None:
        if len(self.chunks) + len(self.units) > self.limit:
            self._forget()
        new = list(names.difference(self.chunks))
        for k in range(0, len(new), MANY):
            self._solve(new[k : k + MANY])

    def _places(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.chunks.__getitem__, names), np.int64, len(names))

    def _chunks(self, text: str) -> tuple[list[str], np.ndarray]:
        names = self._named(text)
        self._meet(set(names))
        return names, self._places(names)

    @staticmethod
    def _merged(options: list[list], n: int) -> list[tuple[float, tuple]]:
        """The n cheapest choices of one option (cost, what) each from several lists that are sorted by cost."""
        least: list = [(0.0, ())]
        for own in options:
            least = heapq.nsmallest(n, ((c + d, (*choice, what)) for c, choice in least for d, what in own), key=lambda x: x[0])
        return least

    def _options(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best of a chunk: what they cost more than the best, and their packed ids."""
        found = self.options.get((text, n))
        if found is None:
            each = []
            for unit in self.split(text):
                paths = self.best(unit, n)
                each.append([(paths[0][0] - s, np.array(ids, "<u4").tobytes()) for s, ids in paths])
            found = self.options[text, n] = [(c, b"".join(choice)) for c, choice in self._merged(each, n)]
        return found

    def encode(self, text: str | None) -> tuple[bytes, float, float]:
        """Packed ids and score of the model's own segmentation, and by how much the lattice's best exceeds it."""
        if not text:
            return b"", 0.0, 0.0
        _, at = self._chunks(text)
        score = float(self.own_score.whole[at].sum())
        return _gathered(*self.own_ids, at)[0].tobytes(), score, max(0.0, float(self.best_score.whole[at].sum()) - score)

    def packed(self, text: str | None, n: int) -> list[tuple[float, bytes]]:
        """The n best paths of a whole text's lattice, best first: scores and packed ids.

        Only the n - 1 chunks whose second best costs least can differ from their best.
        """
        return self._best_of(*self._chunks(text), n) if text else [(0.0, b"")]

    def _best_of(self, names: list[str], at: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        costs = self.gap.whole[at]
        some = np.argsort(costs, kind="stable")[: n - 1] if len(costs) <= 64 else (low := np.argpartition(costs, n - 1)[: n - 1])[np.argsort(costs[low], kind="stable")]
        some = sorted(int(i) for i in some if costs[i] < np.inf)
        merged = self._merged([self._options(names[i], n) for i in some], n)
        total, out = float(self.best_score.whole[at].sum()), []
        ids, stop = _gathered(*self.best_ids, at)
        stop = np.append(0, stop)
        cuts = [0, *some, len(names)]
        whole = [ids[stop[a] : stop[b]].tobytes() for a, b in zip([0, *(i + 1 for i in some)], cuts[1:], strict=True)]
        for cost, choice in merged:
            out.append((total - cost, b"".join(chain.from_iterable(zip(whole, (*choice, b""), strict=True)))))
        return out

    def segmentations(self, text: str | None, n: int) -> tuple[list[tuple[float, bytes]], float]:
        """Scores and packed ids of the model's own segmentation and of the n - 1 best others, and the score of the lattice's best."""
        if not text:
            return [(0.0, b"")], 0.0
        return self._ranked(*self._chunks(text), n)[:2]

    def _ranked(self, names: list[str], at: np.ndarray, n: int) -> tuple[list[tuple[float, bytes]], float, bool]:
        """What `segmentations` gives, and whether each chunk decodes to itself."""
        first, found = _gathered(*self.own_ids, at)[0].tobytes(), self._best_of(names, at, n)
        return [(float(self.own_score.whole[at].sum()), first), *[x for x in found if x[1] != first][: n - 1]], found[0][0], bool(self.same.whole[at].all())

    def ranked(self, texts: list[str | None], n: int) -> Iterator[tuple[list[tuple[float, bytes]], float, bool]]:
        """Of each text what `segmentations` gives, and whether the model's own decodes to the text. The new chunks of some texts are solved together.

        Ids decode one by one, so what a text's chunks decode to follows one another; a literal U+2581 comes back as a space.
        """
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // TOGETHER)) + 1).tolist(), len(texts)]):
            names = [self._named(t) if t else [] for t in texts[a:b]]
            self._meet(every := set(chain.from_iterable(names)))
            places = dict(zip(every, map(self.chunks.__getitem__, every), strict=True))  # a small table is faster to look up than that of all chunks
            for text, own in zip(texts[a:b], names, strict=True):
                if not text:
                    yield [(0.0, b"")], 0.0, True
                    continue
                found, best, same = self._ranked(own, np.fromiter(map(places.__getitem__, own), np.int64, len(own)), n)
                yield found, best, SPACE not in text if same else self.decode(np.frombuffer(found[0][1], "<u4").tolist()) == text

    def nbest(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        return [(s, np.frombuffer(x, "<u4").tolist()) for s, x in self.packed(text, n)]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are bytes, control pieces say nothing, the space put before the text goes."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_KNOWN: dict[str, Segmenter] = {}


def segmenter(path: str, limit: int = 1_600_000) -> Segmenter:
    """The process's own Segmenter: a Python worker keeps it from task to task. limit: chunks, and units of odd ones, that it keeps (some 400 bytes each)."""
    if path not in _KNOWN:
        _KNOWN[path] = Segmenter(path)
    _KNOWN[path].limit = limit
    return _KNOWN[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (the model's own segmentation), score, and gap: by how much the lattice's best exceeds it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segmenter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                found = [known.encode(t) for t in some["text"].to_pylist()]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[0]) // 4 for x in found]), pa.int32()), pa.array(np.frombuffer(b"".join(x[0] for x in found), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some["doc_id"], ids, pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], ["doc_id", "ids", "score", "gap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, score double, gap double")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows doc_id, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segmenter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([known.decode(x or ()) for x in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def nbest(docs: DataFrame, model: str, n: int = _BEST) -> DataFrame:
    """doc_id, rank (from 1), score and ids of each text's segmentations: the model's own, then the n - 1 best others."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segmenter(model)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = [(s, np.frombuffer(x, "<u4").tolist()) for s, x in known.segmentations(text, n)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["doc_id", "rank", "score", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, rank int, score double, ids array<int>")


def digest(docs: DataFrame, model: str, n: int = _BEST, limit: int = 1_600_000) -> DataFrame:
    """Of each text: n_pieces, ids_crc32 (little-endian 32-bit ids) and score of the model's own segmentation, n_best (segmentations, of n at most) and
    last_score (that of the last), best_score (of the lattice's best), is_best (whether the model's own is that good) and round_trip."""
    fields = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "score": pa.float64(), "n_best": pa.int32(), "last_score": pa.float64(), "best_score": pa.float64(), "is_best": pa.bool_(), "round_trip": pa.bool_()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segmenter(model, limit)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # texts become Python objects a few at a time
                batch, out = whole.slice(at, 200), []
                for some, best, same in known.ranked(batch["text"].to_pylist(), n):
                    score, packed = some[0]
                    out.append((len(packed) // 4, zlib.crc32(packed), score, len(some), some[-1][0], best, score >= best, same))
                columns = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)]], ["doc_id", *fields])

    types = "n_pieces long, ids_crc32 long, score double, n_best int, last_score double, best_score double, is_best boolean, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, f"doc_id long, {types}")
