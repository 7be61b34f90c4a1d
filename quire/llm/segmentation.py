"""SentencePiece encoding and decoding: sampled segmentations without replacement.

A model's pieces span a lattice over a text; a path is a segmentation, and its probability
is the product of its pieces' probabilities over the sum of all paths.  Gumbel top-k emits
the k paths with the largest perturbed log-probabilities, which is a sample of k distinct
segmentations without replacement.  The search is an A-star search from the top: a set of
paths has a known total probability, so the largest perturbed value inside is a Gumbel
variable, truncated by the value of the set it was split off.  The agenda holds such sets;
the best one is popped, a path is drawn in it, and what is left of it is split by the first
word at which other paths leave the drawn one.

No piece crosses the start of a run of spaces, so the lattice falls into words (with their
leading spaces), and a worker keeps the lattices of the words it has met, up to a bound.
Draws come from a hash of the seed, the row's key, the sample, the word and the step, so a
row gets the same samples wherever it is processed.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import BYTE_CODE, U, mix, prefix_sums, slices, span_hash
from .shared import bound_batches

_SALT, _SAMPLE, _PLACE = U(0x8EBC6AF09C88C6E3), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Bytes of texts that are taken together.
WORDS_BYTES = 1 << 19
#: Positions whose pieces are looked up at once.
LOOKUP = 1 << 16
#: Edges of the lattices that a worker keeps, of 24 bytes each.
STORE_EDGES = 1_500_000
#: Slots of the hash table of pieces.
SLOTS = 1 << 20
#: Length, in log-probability, that an unknown byte is behind the rarest piece.
UNKNOWN = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model, with the space mark written as a space, and a hash table of their beginnings."""

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        special = np.array([model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        self.bytes_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.text = [b"" if special[i] else model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        if any(b" " in t.lstrip(b" ") for t in self.text):
            raise ValueError("a piece with a space behind other characters would cross words")
        for b, i in enumerate(self.bytes_id.tolist()):
            self.text[i] = bytes([b])
        score = np.array([model.get_score(i) for i in range(n)])
        own = np.flatnonzero(~special)
        if (score[own] == np.round(score[own])).all():  # merges have negative ranks for scores: take Zipf's law
            score[own] = -np.log(np.argsort(np.argsort(-score[own], kind="stable")) + 2.0)
        self.log = score - np.logaddexp.reduce(score[own])
        self.log[self.bytes_id] = self.log[own].min() - UNKNOWN
        self.short = int(600 / -self.log.min())  # bytes of words whose least path is above the least double
        self.length = np.array([len(t) for t in self.text])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.longest = int(self.length[own].max())
        seen = np.zeros(256, bool)
        seen[np.frombuffer(b"".join(self.text[i] for i in own), np.uint8)] = True
        self.alone = ~seen & (np.arange(256) < 128)  # bytes of characters that no piece has
        # Entries are the distinct beginnings of pieces: the piece that ends there, and whether a longer one goes on.
        count = self.length[own]
        begin = np.repeat(self.at[:-1][own], count)
        size = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        hashes, entry = np.unique(span_hash(prefix_sums(BYTE_CODE[self.flat]), begin, begin + size), return_inverse=True)
        self.entry_piece, self.goes_on = np.full(len(hashes), -1, np.int32), np.zeros(len(hashes), bool)
        whole = size == np.repeat(count, count)
        self.entry_piece[entry[whole]] = own
        self.goes_on[entry[~whole]] = True
        slot = (hashes & U(SLOTS - 1)).astype(np.int64)
        _, lead = np.unique(slot, return_index=True)
        self.key, self.entry = np.zeros(SLOTS, U), np.full(SLOTS, -1, np.int32)
        self.key[slot[lead]], self.entry[slot[lead]] = hashes[lead], lead
        late = np.setdiff1d(np.arange(len(hashes)), lead)  # the slot is another entry's; hashes ascend
        self.shared = np.zeros(SLOTS, bool)
        self.shared[slot[late]] = True
        self.late_key, self.late_entry = hashes[late], late.astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries with these hashes, -1 for none."""
        slot = (hashes & U(SLOTS - 1)).astype(np.int64)
        out = np.where(self.key[slot] == hashes, self.entry[slot], -1)
        open_ = np.flatnonzero(self.shared[slot] & (out < 0))
        if len(open_):
            at = np.minimum(np.searchsorted(self.late_key, hashes[open_]), len(self.late_key) - 1)
            out[open_] = np.where(self.late_key[at] == hashes[open_], self.late_entry[at], -1)
        return out


@functools.lru_cache(2)
def _pieces(proto: bytes) -> Pieces:
    return Pieces(proto)


def pieces_of(path: str) -> Pieces:
    return _pieces(Path(path).read_bytes())


@functools.lru_cache(1)
def _store(proto: bytes) -> WordStore:
    return WordStore(_pieces(proto))


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all i, counts[i] of them."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _sums_back(back: np.ndarray, weight: np.ndarray, last: np.ndarray, size: np.ndarray, edge: np.ndarray, degree: np.ndarray, to: np.ndarray, add: np.ufunc, times: np.ufunc) -> None:
    """Fills ``back`` from the words' last nodes to their first: the sum over edges of weight times what follows."""
    order = np.argsort(-size, kind="stable")
    reach = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
    for r, n in enumerate(reach.tolist(), 1):
        nodes = last[order[:n]] - r
        nodes = nodes[degree[nodes] > 0]
        if len(nodes):
            edges = _gather(edge[nodes], degree[nodes])
            back[nodes] = add.reduceat(times(weight[edges], back[to[edges]]), np.cumsum(degree[nodes]) - degree[nodes])


class Lattices:
    """The lattices of the distinct words in ``data``; a word of n bytes has n + 1 nodes.

    What a word's lattice holds doesn't depend on the other words, so lattices may be kept
    and joined in any way.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces):
        size = ends - starts
        text = data[_gather(starts, size)]
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int32)  # first nodes
        last = self.first + size
        n_nodes = int(size.sum() + len(size))
        lead = (text & 0xC0) != 0x80
        own = np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)[own]  # of the word, in the text
        sums = prefix_sums(BYTE_CODE[text])
        follow = np.append(np.flatnonzero(lead), len(text))
        char = np.cumsum(lead) if len(text) else np.zeros(0, np.int64)  # number of the next character
        char_end = np.minimum(follow[char], end)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cuts = np.unique(np.append(follow[np.searchsorted(follow, np.arange(0, len(text), LOOKUP))], [0, len(text)])) if len(text) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # no cut inside a character
            at = np.flatnonzero(lead[lo:hi]) + lo
            begin, ids, width, single = [], [], [], np.zeros(hi - lo, bool)
            for n in range(1, pieces.longest + 1):
                at = at[at + n <= end[at]]
                if not len(at):
                    break
                entry = pieces.find(span_hash(sums, at, at + n))
                at, entry = at[entry >= 0], entry[entry >= 0]
                piece = pieces.entry_piece[entry]
                hit = piece >= 0
                begin.append(at[hit])
                ids.append(piece[hit])
                width.append(np.full(hit.sum(), n))
                single[at[hit & (at + n == char_end[at])] - lo] = True
                at = at[pieces.goes_on[entry]]
            raw = np.arange(lo, hi)
            raw = raw[~single[np.maximum(follow[char[raw] - 1], lo) - lo]]  # of characters that may not be pieces
            begin, ids, width = np.concatenate([*begin, raw]), np.concatenate([*ids, pieces.bytes_id[text[raw]]]), np.concatenate([*width, np.ones(len(raw), np.int64)])
            order = np.argsort((begin - lo).astype(np.uint32), kind="stable")
            found.append((begin[order], ids[order], width[order]))
        begin, ids, width = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        begin, self.ids = begin.astype(np.int64), ids.astype(np.int32)
        node = begin + own[begin]
        self.to = (node + width).astype(np.int32)
        log = pieces.log[self.ids]
        degree = np.bincount(node, minlength=n_nodes)
        self.edge = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)  # first edges of the nodes; a slice has far fewer than 2**31
        # The log of the sum of all paths from a node to the word's end; sums of short words can't underflow.
        back, short = np.full(n_nodes, -np.inf), size <= pieces.short
        if short.any():
            plain = np.zeros(n_nodes)
            plain[last[short]] = 1
            _sums_back(plain, np.exp(log), last[short], size[short], self.edge, degree, self.to, np.add, np.multiply)
            with np.errstate(divide="ignore"):
                back = np.log(plain)
        if not short.all():
            back[last] = 0
            _sums_back(back, log, last[~short], size[~short], self.edge, degree, self.to, np.logaddexp, np.add)
        with np.errstate(invalid="ignore"):
            self.log = np.where(degree[node] == 1, 0.0, log + back[self.to] - back[node])
        # Sums of probabilities over the edges of each node, up to and with each edge.
        self.sums, rank = np.exp(self.log), np.arange(len(node)) - self.edge[node]
        for r in range(1, int(degree.max(initial=0))):
            at = np.flatnonzero(rank == r) if r == 1 else at[degree[node[at]] > r] + 1
            self.sums[at] += self.sums[at - 1]
        self.end = np.zeros(n_nodes, bool)
        self.end[last] = True

    def join(self, other: Lattices) -> None:
        """Adds the words of ``other`` behind one's own."""
        nodes, edges = np.int32(len(self.end)), np.int32(len(self.ids))
        self.first = np.concatenate([self.first, other.first + nodes])
        self.edge = np.concatenate([self.edge[:-1], other.edge + edges])
        self.to = np.concatenate([self.to, other.to + nodes])
        for name in ("ids", "log", "sums", "end"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))

    def keep(self, words: np.ndarray) -> None:
        """Keeps only some words, in ascending order."""
        begin = self.first[words].astype(np.int64)
        n_nodes = np.append(self.first, len(self.end))[words + 1] - begin
        nodes = _gather(begin, n_nodes)
        degree = (self.edge[nodes + 1] - self.edge[nodes]).astype(np.int64)
        edges = _gather(self.edge[nodes].astype(np.int64), degree)
        shift = (begin - (np.cumsum(n_nodes) - n_nodes))[np.repeat(np.repeat(np.arange(len(words)), n_nodes), degree)]
        self.to = (self.to[edges] - shift).astype(np.int32)
        self.first = (np.cumsum(n_nodes) - n_nodes).astype(np.int32)
        self.edge = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)
        self.end = self.end[nodes]
        for name in ("ids", "log", "sums"):
            setattr(self, name, getattr(self, name)[edges])

    def draw(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path for each word of the list: log-probabilities, numbers of pieces and all pieces in order."""
        log, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
        active, node, steps = np.arange(len(words)), self.first.take(words), []
        while True:
            going = np.flatnonzero(~self.end.take(node))
            if len(going) < len(node):
                active, node, keys = active.take(going), node.take(going), keys.take(going)
            if not len(active):
                break
            u = (mix(keys + np.array([len(steps)], U) * _SALT) >> U(11)).astype(np.float64) * 2.0**-53
            least, edge = self.edge.take(node), self.edge.take(node + 1) - 1
            target = u * self.sums.take(edge)
            far = np.flatnonzero((self.sums.take(edge - 1, mode="clip") > target) & (edge > least))
            while len(far):  # from the longest piece, which often has most of the probability
                edge[far] -= 1
                now = edge.take(far)
                far = far[(self.sums.take(now - 1, mode="clip") > target.take(far)) & (now > least.take(far))]
            log[active] += self.log.take(edge)
            count[active] += 1
            steps.append((active, self.ids.take(edge)))
            node = self.to.take(edge)
        at, out = np.cumsum(count) - count, np.zeros(count.sum(), np.int32)
        for step, (who, ids) in enumerate(steps):
            out[at[who] + step] = ids
        return log, count, out

    def draw_other(self, word: int, key: np.ndarray, taken: dict[tuple[int, ...], float]) -> tuple[float, list[int]]:
        """A path of one word that isn't among ``taken`` (with their log-probabilities): its log-probability and pieces."""
        node, log, out, live = int(self.first[word]), 0.0, [], dict(taken)
        draws = _uniform(key + np.arange(64, dtype=U) * _SALT).tolist()
        while not self.end[node]:
            lo, hi = int(self.edge[node]), int(self.edge[node + 1])
            weight = np.exp(self.log[lo:hi])
            for path, own in live.items():  # what the taken paths have of each edge
                weight[self.ids[lo:hi] == path[len(out)]] -= np.exp(own - log)
            weight = np.maximum(weight, 0)
            if not weight.any():  # only rounding has left anything
                weight = np.exp(self.log[lo:hi])
            sums = np.cumsum(weight)
            u = draws[len(out)] if len(out) < 64 else float(_uniform(key + np.array([len(out)], U) * _SALT)[0])
            edge = lo + min(int((sums <= u * sums[-1]).sum()), hi - lo - 1)
            log += float(self.log[edge])
            out.append(int(self.ids[edge]))
            node = int(self.to[edge])
            live = {p: v for p, v in live.items() if p[len(out) - 1] == out[-1] and len(p) > len(out)}
        return log, out


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((mix(keys) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(location: np.ndarray, bound: float | np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, truncated by ``bound``; minus infinity for empty sets."""
    gumbel = location - np.log(-np.log(_uniform(keys)))
    return bound - np.logaddexp(0, bound - gumbel)


def _rest_log(log: np.ndarray) -> np.ndarray:
    """log(1 - exp(log))."""
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(-np.expm1(np.minimum(log, 0)), 0))


class WordStore:
    """Lattices of words that a worker has met, so that frequent words are built once; of bounded size."""

    def __init__(self, pieces: Pieces):
        self.pieces, none = pieces, np.zeros(0, np.int64)
        self.lattices = Lattices(np.zeros(0, np.uint8), none, none, pieces)
        self.hashes, self.number, self.uses = np.zeros(0, U), none, none  # hashes ascend; uses by number

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the words in ``lattices``."""
        hashes, at, word = np.unique(span_hash(prefix_sums(BYTE_CODE[data]), starts, ends), return_index=True, return_inverse=True)
        if len(self.lattices.ids) > STORE_EDGES:  # what only one slice had makes room
            again = np.flatnonzero(self.uses > 1)
            self.lattices.keep(again)
            if len(self.lattices.ids) > STORE_EDGES // 2:
                again = again[:0]
                self.lattices.keep(again)
            place = np.full(len(self.uses), -1)
            place[again] = np.arange(len(again))
            kept = place[self.number] >= 0
            self.hashes, self.number, self.uses = self.hashes[kept], place[self.number[kept]], np.ones(len(again), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        number = np.empty(len(hashes), np.int64)
        number[known] = self.number[place[known]]
        fresh = np.flatnonzero(~known)
        number[fresh] = len(self.uses) + np.arange(len(fresh))
        self.lattices.join(Lattices(data, starts[at[fresh]], ends[at[fresh]], self.pieces))
        where = np.searchsorted(self.hashes, hashes[fresh])
        self.hashes, self.number = np.insert(self.hashes, where, hashes[fresh]), np.insert(self.number, where, number[fresh])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        self.uses[number] += 1
        return number[word]


class _Text:
    """The search in one text.  A sample: value, pieces, ends of the words in them, log-probabilities of the words.

    Sets on the agenda follow a sample up to a word and leave it there: their values are in
    a vector beside the sample, and ``taken`` has what the sets at a word have lost already.
    """

    def __init__(self, key: np.ndarray, value: float):
        self.key, self.value, self.samples, self.values, self.taken = key, value, [], [], []

    def keys(self, sample: int) -> np.ndarray:
        return self.key + np.array([sample], U) * _SAMPLE

    def best(self) -> tuple[float, int, int]:
        tops = [(float(v.max()), s, int(v.argmax())) for s, v in enumerate(self.values) if len(v)]
        return max(tops, default=(-np.inf, 0, 0))

    def path(self, sample: int, word: int) -> tuple[int, ...]:
        _, ids, ends, _, _ = self.samples[sample]
        return tuple(ids[ends[word - 1] if word else 0 : ends[word]].tolist())


def _add(drawn: list[tuple[_Text, float, np.ndarray, np.ndarray, np.ndarray, int]], sample: int) -> None:
    """Drawn samples, one a text; the sets that leave them at their word ``since`` or later go on the agendas."""
    if not drawn:
        return
    count = np.array([len(log) for *_, log, _ in drawn])
    befores = [np.concatenate([[0], np.cumsum(log)]) for *_, log, _ in drawn]  # text by text, as sums depend on their order
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    location = np.concatenate([b[:-1] for b in befores]) + _rest_log(np.concatenate([log for *_, log, _ in drawn]))
    keys = np.repeat(np.concatenate([text.keys(sample) for text, *_ in drawn]), count) + place.astype(U) * _PLACE
    sets = _truncated(location, np.repeat([value for _, value, *_ in drawn], count), keys ^ _SALT)
    sets[place < np.repeat([since for *_, since in drawn], count)] = -np.inf
    for (text, value, ids, ends, log, _), before, own in zip(drawn, befores, np.split(sets, np.cumsum(count)[:-1])):
        text.samples.append((value, ids, ends, log, before))
        text.values.append(own.copy())
        text.taken.append({})


def sample_slice(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces, k: int, store: WordStore | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k samples (pieces, log-probability, perturbed value, inclusion score), the largest value first."""
    store = store or WordStore(pieces)
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 32)  # the dummy prefix
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    space, alone = data == 32, pieces.alone[data]
    cut = space | alone
    cut[1:] &= ~(space[1:] & space[:-1])
    cut[1:] |= alone[:-1]
    cut[offsets[:-1][filled]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    first = np.searchsorted(starts, offsets)
    word = store.words(data, starts, ends)
    lattices = store.lattices
    values = -np.log(-np.log(_uniform(keys)))
    texts = [_Text(keys[i : i + 1], v) for i, v in enumerate(values.tolist())]

    def drawn(who: list[int], since: list[int], sample: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Fresh paths for the words from ``since`` on of the texts ``who``: log-probabilities, ends, pieces."""
        own = np.array(who, np.int64)
        lo = first[own] + np.array(since, np.int64)
        count = first[own + 1] - lo
        places = _gather(lo, count)
        row = np.repeat(own, count)
        key = mix(keys[row] + np.array([sample + 1], U) * _SALT) + (places - first[row]).astype(U) * U(0xD6E8FEB86659FD93)
        log, pieces_each, ids = lattices.draw(word[places], mix(key))
        ends, cuts = np.cumsum(pieces_each), np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            begin = int(ends[a - 1]) if a else 0
            yield log[a:b], ends[a:b] - begin, ids[begin : int(ends[b - 1]) if b > a else begin]

    everyone = list(range(len(keys)))
    _add([(text, text.value, ids, ends_, log, 0) for text, (log, ends_, ids) in zip(texts, drawn(everyone, [0] * len(everyone), 0))], 0)
    for sample in range(1, k):
        popped = [(i, *text.best()) for i, text in enumerate(texts) if len(text.samples) == sample]
        popped = [p for p in popped if p[1] > -np.inf]
        rest, new = drawn([i for i, *_ in popped], [w + 1 for *_, w in popped], sample), []
        for (i, value, parent, at_word), (log, ends_, ids) in zip(popped, rest):
            text = texts[i]
            _, old_ids, old_ends, old_log, before = text.samples[parent]
            taken = text.taken[parent].setdefault(at_word, {text.path(parent, at_word): float(old_log[at_word])})
            own_log, own_ids = lattices.draw_other(int(word[first[i] + at_word]), mix(text.keys(sample) + np.array([at_word], U) * _SALT), taken)
            taken[tuple(own_ids)] = own_log
            left = 1 - sum(math.exp(x) for x in taken.values())
            location = before[at_word] + (math.log(left) if left > 1e-12 else -np.inf)
            text.values[parent][at_word] = _truncated(np.array([location]), value, text.keys(sample) ^ np.array([at_word + 1], U) * _SALT)[0]
            start = int(old_ends[at_word - 1]) if at_word else 0
            now_ids = np.concatenate([old_ids[:start], np.array(own_ids, np.int32), ids])
            now_ends = np.concatenate([old_ends[:at_word], [start + len(own_ids)], start + len(own_ids) + ends_])
            new.append((text, value, now_ids, now_ends, np.concatenate([old_log[:at_word], [own_log], log]), at_word + 1))
        _add(new, sample)
    out = []
    for text in texts:
        bound = text.best()[0]
        out.append([(ids, float(before[-1]), value, 1.0 if bound == -np.inf else -math.expm1(-math.exp(min(700.0, before[-1] - bound)))) for value, ids, _, _, before in text.samples])
    return out


def decode_ids(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text that pieces stand for, without the dummy prefix."""
    text = pieces.flat[_gather(pieces.at[ids], pieces.length[ids])].tobytes()
    return text[1:] if text[:1] == b" " else text


SAMPLES = "id long, sample int, n_pieces int, log_probability double, perturbed double, inclusion double"


def _encode(batches: Iterator[pa.RecordBatch], proto: bytes, k: int, seed: int, digest: bool) -> Iterator[pa.RecordBatch]:
    pieces, store = _pieces(proto), _store(proto)
    last = ["ids_sha256", "round_trip"] if digest else ["ids"]
    names = [x.split()[0] for x in SAMPLES.split(", ")] + last
    for batch in batches:
        row_key = batch.column(1).to_numpy().view(np.uint64)
        for a, b, data, offsets in slices(batch.column(2), WORDS_BYTES):
            keys = mix(row_key[a:b] + U(seed) * _SALT)
            rows, each = [], []
            for i, found in enumerate(sample_slice(data, offsets, keys, pieces, k, store)):
                each.append(len(found))
                for n, (ids, log, value, inclusion) in enumerate(found):
                    end = (hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), decode_ids(ids, pieces) == data[offsets[i] : offsets[i + 1]].tobytes()) if digest else (ids,)
                    rows.append((n, len(ids), log, value, inclusion, *end))
            columns = list(zip(*rows))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), *([pa.string(), pa.bool_()] if digest else [pa.list_(pa.int32())])]
            own = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), each)))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(columns, kinds))], names)


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 0, model: str | None = None, digest: bool = False) -> DataFrame:
    """Up to k rows a document, one for each of its sampled segmentations.

    Columns: id, sample (0 for the largest perturbed value), n_pieces, log_probability,
    perturbed, inclusion (probability of being among samples with values above the next
    one's) and ids; with ``digest`` ids_sha256 (of little-endian 32-bit ids) and round_trip
    (whether the ids decode to the text) instead of ids.

    The row's key is a hash of its id and text, so repeated rows get equal samples.  Null
    and empty texts have one segmentation, without pieces; a text has fewer than k rows if
    it has fewer segmentations.  Characters that no piece has become bytes.  Null ids pass
    through; other columns are ignored; an empty table gives an empty result.  The model's
    own normalisation isn't applied, so ids stand for the text as it is; a model with a piece
    that has a space behind other characters is refused.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = SAMPLES + (", ids_sha256 string, round_trip boolean" if digest else ", ids array<int>")
    return base.mapInArrow(functools.partial(_encode, proto=Path(model or default_model()).read_bytes(), k=k, seed=seed, digest=digest), schema).withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[pa.RecordBatch]:
    pieces = _pieces(proto)
    for batch in batches:
        own = [None if x is None else decode_ids(np.array(x, np.int64), pieces).decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.string())], [*batch.schema.names[1:], "text"])


def decode_segmentations(samples: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """(id, text) of each row of pieces; null pieces give a null text, bytes that aren't UTF-8 a replacement character."""
    return samples.select(ids_col, id_col).mapInArrow(functools.partial(_decode, proto=Path(model or default_model()).read_bytes()), f"{id_col} long, text string")
