"""SentencePiece segmentations sampled without replacement, and decoding.

The lattice of a text holds every way to cut it into vocabulary pieces (a character that no piece covers is its bytes).
Piece weights follow from the vocabulary's ranks: log-weight -alpha * ln(rank + 2). The k segmentations are a Gumbel
top-k sample without replacement: a perturbed A-star search whose nodes are sets of segmentations that share a prefix.
A node's bound is the maximum of the Gumbel-perturbed log-probabilities below it, drawn from the node's exact mass and,
below a parent, truncated at the parent's. Popping the best node draws its maximum by following one path; what lies
beside that path gets truncated maxima of its own and stays in the queue: first a node for each word that is cut
otherwise, which is opened into its arcs when it is popped. So the j-th path is the j-th best perturbed segmentation, and
segmentations are distinct.

No piece crosses from one word to the next, so a text's lattice is the chain of its words' lattices. Masses (backward sums)
are made once per distinct word, for all words of a batch together, and paths of all words advance together.

Random numbers come from a counter-based generator keyed by seed and row key: results do not depend on partitioning.
A sample's inclusion score is 1 - exp(-exp(logp - kappa)), kappa the (k + 1)-th best perturbed value; with fewer than
k + 1 segmentations every one is included for certain. Null and empty texts have one empty segmentation. Texts are
segmented whole. Repeated rows give equal samples; segmentations whose perturbed values tie keep the order of their coming.
An empty table gives an empty result. Other columns are not looked at, whatever their names. A U+2581 in a text decodes to a blank, as in the library.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, text_of

BLANK = "▁"
NONE = np.zeros(0, np.int64)
SAMPLES, ALPHA, SEED = 2, 2.0, 20
#: Characters whose lattices are in memory at once.
PIECE_CHARS = 1 << 19
#: Words whose lattices are made at once, and arcs that are kept for later texts.
PART_WORDS, MOST_ARCS = 8192, 1_500_000
#: A word with its blanks before it; newlines are in no piece, so a text may also be cut around them.
UNIT = re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


class Pieces:
    """The vocabulary: pieces by text hash, their weights, and byte pieces."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(len(model)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        ordinary = sorted((i for i in range(len(model)) if i not in special), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(ordinary)}
        weights = np.array([-alpha * np.log(rank.get(i, len(rank)) + 2.0) for i in range(len(model))])
        self.weights = weights - np.log(np.exp(weights).sum())
        self.text = [model.id_to_piece(i) for i in range(len(model))]
        self.id = {self.text[i]: i for i in ordinary}
        self.longest = max(map(len, self.id))
        # every prefix of a piece by its hash; id -1 where only longer pieces begin so
        known: dict[int, int] = {}
        for piece, i in self.id.items():
            h = 0
            for c in piece:
                h = extend(h, ord(c))
                known.setdefault(h, -1)
            known[h] = i
        # open addressing, a key at the first free place from its home on; 0 is free
        self.mask = (1 << (8 * len(known)).bit_length()) - 1
        self.keys, self.ids = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        for h, i in known.items():
            at = h & self.mask
            while self.keys[at]:
                at = at + 1 & self.mask
            self.keys[at], self.ids[at] = h, i

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash whether a piece begins so, and the id of the piece that it is, or -1."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        here = self.keys[at]
        known = here == h
        open_ = np.flatnonzero(~known & (here != 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            here = self.keys[at[open_]]
            known[open_] = here == h[open_]
            open_ = open_[(here != 0) & ~known[open_]]
        return known, self.ids[at]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        back = {i: bytes([b]) for b, i in enumerate(self.byte)}
        text = b"".join(back[i] if i in back else self.text[i].encode() for i in ids).decode("utf-8", "replace")
        return text.replace(BLANK, " ")[1:]


MULTIPLIER = 0x9E3779B97F4A7C15


def extend(h: int, c: int) -> int:
    """Hash of a text longer by the character c."""
    h = (h ^ c) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 31)


def mixed(x: np.ndarray) -> np.ndarray:
    """Counter to well-mixed 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Counters to numbers strictly between 0 and 1."""
    return ((mixed(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Lattices:
    """Arcs and masses of many distinct words, flat. Node = character boundary; a word's last node has no arcs.

    A word's lattice does not depend on the others, so words are added PART_WORDS at a time (what is being made stays
    small), stay for later texts, and can be let go again.
    """

    ARCS = {"src": np.int32, "dst": np.int32, "piece": np.int64, "share": np.float64, "upto": np.float64}

    def __init__(self, words: list[str], pieces: Pieces):
        self.pieces, self.root, self.begin = pieces, np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.room = {name: np.empty(0, kind) for name, kind in self.ARCS.items()}
        self.show(0)
        self.add(words)

    def show(self, n: int) -> None:
        for name, array in self.room.items():
            setattr(self, name, array[:n])

    def add(self, words: list[str]) -> None:
        """Appends words; they are numbered in the order of their coming."""
        for i in range(0, len(words), PART_WORDS):
            part = WordLattices(words[i : i + PART_WORDS], self.pieces)
            nodes, arcs, new = len(self.begin) - 1, len(self.src), len(part.src)
            if arcs + new > len(self.room["src"]):
                for name, old in self.room.items():
                    self.room[name] = np.empty((arcs + new) * 5 // 4, old.dtype)
                    self.room[name][:arcs] = old[:arcs]
            for name, array in self.room.items():
                array[arcs : arcs + new] = getattr(part, name) + nodes if name in ("src", "dst") else getattr(part, name)
            self.root = np.concatenate((self.root, part.root + nodes))
            self.begin = np.concatenate((self.begin[:-1], part.begin + arcs))
            self.show(arcs + new)

    def keep(self, wanted: np.ndarray) -> None:
        """Lets go of the words that are not wanted; the others keep their order."""
        node = np.repeat(wanted, np.diff(self.root, append=len(self.begin) - 1))
        arc, number = node[self.src], np.cumsum(node) - 1
        count = np.diff(self.begin)[node]
        kept = {name: (number[array[arc]] if name in ("src", "dst") else array[arc]).astype(array.dtype) for name, array in ((name, getattr(self, name)) for name in self.ARCS)}
        self.root, self.begin, self.room = number[self.root[wanted]], np.concatenate(([0], np.cumsum(count))), kept
        self.show(len(kept["src"]))

    def walk(self, node: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node to its word's end. Returns the arcs, and the index into node of each, in path order."""
        node = node.copy()
        live = np.flatnonzero(self.begin[node] < self.begin[node + 1])
        arcs, of = [], []
        step = 0
        while len(live):
            here = node[live]
            low, high = self.begin[here], self.begin[here + 1]
            pick, u = low.copy(), uniform(salt[live] + np.uint64(step * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            open_ = np.flatnonzero(high - low > 1)
            while len(open_):
                open_ = open_[self.upto[pick[open_]] <= u[open_]]
                pick[open_] += 1
                open_ = open_[pick[open_] < high[open_] - 1]
            arcs.append(pick)
            of.append(live)
            node[live] = self.dst[pick]
            live = live[self.begin[node[live]] < self.begin[node[live] + 1]]
            step += 1
        if not arcs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        arcs, of = np.concatenate(arcs), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return arcs[order], of[order]


    def beside(self, arc: np.ndarray) -> np.ndarray:
        """Log of what the other arcs of its node have of the node's mass, added up from these arcs themselves."""
        low, high = self.begin[self.src[arc]], self.begin[self.src[arc] + 1]
        top, total = np.full(len(arc), -np.inf), np.zeros(len(arc))
        for step in (0, 1):
            for k in range(int((high - low).max()) if len(arc) else 0):
                at = np.minimum(low + k, high - 1)
                value = np.where((low + k < high) & (at != arc), self.share[at], -np.inf)
                if step:
                    total += np.exp(value - np.where(np.isneginf(top), 0.0, top))
                else:
                    top = np.maximum(top, value)
        with np.errstate(divide="ignore"):
            return np.log(total) + np.where(np.isneginf(top), 0.0, top)

    def other_cuts(self, cut: np.ndarray, arcs: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log of the mass of all other cuts of each word, given its cut's log-probability and arcs: what is left of one.

        For a cut with nearly all the mass that would be a difference of near equals; there it is added up, arc by arc, from
        the ways to leave the path.
        """
        with np.errstate(divide="ignore"):
            out = np.log(-np.expm1(np.minimum(cut, 0.0)))
        sure = cut > -1e-8
        at = np.flatnonzero(sure[of])
        if not len(at):
            return out
        arc, word = arcs[at], of[at]
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        n = np.diff(np.append(heads, len(arc)))
        inside = np.zeros(len(arc))
        for step in range(1, int(n.max())):
            here = heads[n > step] + step
            inside[here] = inside[here - 1] + self.share[arc[here - 1]]
        leave = inside + self.beside(arc)
        top = np.maximum.reduceat(leave, heads)
        top = np.where(np.isneginf(top), 0.0, top)
        with np.errstate(divide="ignore"):
            out[word[heads]] = top + np.log(np.add.reduceat(np.exp(leave - np.repeat(top, n)), heads))
        return out


class WordLattices:
    """The lattices of a part of the words."""

    def __init__(self, words: list[str], pieces: Pieces):
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(length)))[:-1]
        self.root = first + np.arange(len(words))  # one node more than characters in each word
        total, n_nodes = int(length.sum()), int(length.sum()) + len(words)
        # of each character: its node, and how many characters remain in its word
        word = np.repeat(np.arange(len(words)), length)
        node = np.arange(total) + word
        remain = np.repeat(first + length, length) - np.arange(total)
        found_at = [np.zeros(0, np.int64)]  # of each size: characters, ids and weights; characters without a piece first
        found_piece, found_weight, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], [1]
        h = np.zeros(total, np.uint64)
        live = np.arange(total)
        for n in range(1, pieces.longest + 1):
            live = live[remain[live] >= n]
            if not len(live):
                break
            step = (h[live] ^ code[live + n - 1]) * np.uint64(MULTIPLIER)
            step ^= step >> np.uint64(31)
            begins, found = pieces.find(step)
            live, found = live[begins], found[begins]
            h[live] = step[begins]
            whole = found >= 0
            found_at.append(live[whole])
            found_piece.append(found[whole].astype(np.int64))
            found_weight.append(pieces.weights[found_piece[-1]])
            sizes.append(n)
        covered = np.zeros(total, bool)
        if len(found_at) > 1:
            covered[found_at[1]] = True
        bare = np.flatnonzero(~covered)
        if len(bare):  # byte pieces: one for an ASCII character; else arc ids below zero name the character
            bytes_of = [chr(c).encode("utf-8", "surrogatepass") for c in code[bare].tolist()]
            found_at[0] = bare
            found_piece[0] = np.array([pieces.byte[b[0]] if len(b) == 1 else -1 - int.from_bytes(b, "big") for b in bytes_of], np.int64)
            found_weight[0] = np.array([sum(pieces.weights[pieces.byte[b]] for b in bs) for bs in bytes_of])
        # arcs by node and size: each size goes to the next free place of its nodes
        count = np.zeros(n_nodes, np.int64)
        for at in found_at:
            count[node[at]] += 1
        self.begin = np.concatenate(([0], np.cumsum(count)))
        n_arcs = int(self.begin[-1])
        self.src, self.dst, self.piece, weight = np.zeros(n_arcs, np.int64), np.zeros(n_arcs, np.int64), np.zeros(n_arcs, np.int64), np.zeros(n_arcs)
        free = self.begin[:-1].copy()
        for at, piece, value, n in zip(found_at, found_piece, found_weight, sizes):
            here = node[at]
            place = free[here]
            free[here] += 1
            self.src[place], self.dst[place], self.piece[place], weight[place] = here, here + n, piece, value
        del found_at, found_piece, found_weight, free, h, covered
        mass = np.zeros(n_nodes)
        share = np.empty(n_arcs)
        to_go = np.repeat(remain, count[node])
        by_remain = np.argsort(to_go.astype(np.uint16) if total and remain.max() < 1 << 16 else to_go, kind="stable")
        bounds = np.flatnonzero(np.diff(to_go[by_remain], prepend=0, append=np.iinfo(np.int64).max))
        for a, b in zip(bounds[:-1], bounds[1:]):
            arcs = by_remain[a:b]
            value = weight[arcs] + mass[self.dst[arcs]]
            heads = np.flatnonzero(np.diff(self.src[arcs], prepend=-1))
            top = np.maximum.reduceat(value, heads)
            n_of = np.diff(np.append(heads, len(arcs)))
            sums = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n_of)), heads))
            mass[self.src[arcs[heads]]] = sums
            share[arcs] = value - np.repeat(sums, n_of)
        self.share = share  # log of the arc's part of its node's mass
        # cumulative parts within a node, for drawing; added up node by node, so that no other word changes them
        self.upto = np.exp(share)
        place = np.arange(n_arcs) - self.begin[self.src]
        for k in range(1, int(place.max()) + 1 if n_arcs else 0):
            here = np.flatnonzero(place == k)
            self.upto[here] += self.upto[here - 1]


def truncated(log_mass: np.ndarray, limit: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Maxima of Gumbels with these log-masses, given that none passes limit."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, limit - np.log1p(-np.log(u) * np.exp(np.minimum(limit - log_mass, 700.0))))


class Search:
    """The queue of one text. Entries (-bound, order, kind, log-mass, word, arcs before, rest).

    kind 0, a prefix: the arcs before (a path and how many of its arcs, each shared with other entries, so that an entry's
    size does not depend on the text's), and rest the arc that leaves it. kind 1, a word: the words before are as on a known
    path and this word is cut otherwise; rest holds the word's arcs on the path.
    """

    def __init__(self, words: np.ndarray, key: int):
        self.words, self.salt, self.order, self.done = words, key, 0, []
        self.queue: list = []

    def fresh(self, n: int) -> np.ndarray:
        self.order += 1
        salt = mixed(np.array([(self.salt + self.order * MULTIPLIER) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        return uniform(salt + np.arange(n, dtype=np.uint64) * np.uint64(MULTIPLIER))

    def push(self, bound: float, kind: int, mass: float, word: int, before: tuple, rest) -> None:
        if bound > -np.inf:
            self.order += 1
            heapq.heappush(self.queue, (-bound, self.order, kind, mass, word, before, rest))

    def pop(self, lattices: Lattices, wanted: int):
        """The best prefix; words are opened on the way into the prefixes that leave the path within them.

        An entry stands for the best segmentation below it, so of one word's prefixes no more than wanted are queued.
        """
        while self.queue:
            bound, _, kind, mass, word, before, rest = heapq.heappop(self.queue)
            if kind == 0:
                if rest < 0:
                    return -bound, mass, word, NONE, int(lattices.root[self.words[0]]) if len(self.words) else -1
                (path, n), (inner, i) = before
                return -bound, mass, word, np.concatenate((path[:n], inner[:i], [rest])), int(lattices.dst[rest])
            low, high = lattices.begin[lattices.src[rest]], lattices.begin[lattices.src[rest] + 1]
            inside = mass + np.concatenate(([0.0], np.cumsum(lattices.share[rest])[:-1]))
            step = np.repeat(np.arange(len(rest)), high - low)
            arc = np.arange(len(step)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[step]
            beside = arc != rest[step]
            step, arc = step[beside], arc[beside]
            masses = inside[step] + lattices.share[arc]
            u = self.fresh(len(arc) + 1)
            part = np.cumsum(np.exp(masses - masses.max()))
            top = int(np.searchsorted(part, u[-1] * part[-1], "right"))
            bounds = truncated(masses, -bound, u[:-1])
            bounds[top] = -bound
            best = np.sort(np.argpartition(-bounds, wanted)[:wanted]) if len(bounds) > wanted else np.arange(len(bounds))
            for j in best.tolist():
                self.push(float(bounds[j]), 0, float(masses[j]), word, (before, (rest, int(step[j]))), int(arc[j]))
        return None


def sample_batch(texts: list[np.ndarray], keys: list[int], lattices: Lattices, k: int) -> list[list[tuple[float, float, np.ndarray]]]:
    """Of each text, given as its words' numbers: up to k (log-probability, inclusion score, arcs)."""
    searches = [Search(w, key) for w, key in zip(texts, keys)]
    for s in searches:
        u = s.fresh(1)[0]
        s.push(float(-np.log(-np.log(u))), 0, 0.0, 0, (), -1)
    for round_ in range(k + 1):
        if round_ == k:  # only the value is wanted: it is the bound of the best entry
            for s in searches:
                if len(s.done) == k and s.queue:
                    s.done.append((-s.queue[0][0], NONE))
            break
        now = [(s, x) for s in searches if len(s.done) == round_ and (x := s.pop(lattices, k + 1 - round_))]
        if not now:
            break
        count = np.array([len(s.words) - x[2] if x[4] >= 0 else 0 for s, x in now])
        ends = np.cumsum(count)
        first = ends - count
        node = lattices.root[np.concatenate([s.words[x[2] :] if c else NONE for (s, x), c in zip(now, count)]).astype(np.int64)]
        node[first[count > 0]] = [x[4] for (_, x), c in zip(now, count) if c]
        doc = np.repeat(np.arange(len(now)), count)
        salts = mixed(np.array([s.salt for s, _ in now], np.uint64) + np.uint64((round_ + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        salt = mixed(salts[doc] + (np.arange(len(node)) - first[doc]).astype(np.uint64) * np.uint64(MULTIPLIER))
        arcs, of = lattices.walk(node, salt)
        arc_end = np.searchsorted(of, ends)
        arc_start = np.concatenate(([0], arc_end[:-1]))
        # of each word: the log-probability of its cut, of what is before it, and of cutting it otherwise
        cut = np.bincount(of, lattices.share[arcs], len(node)) if len(node) else np.zeros(0)
        before = np.empty(len(node))
        for i, (_, x) in enumerate(now):
            own = cut[first[i] : ends[i]]
            before[first[i] : ends[i]] = np.cumsum(own) - own + x[1]
        other = before + lattices.other_cuts(cut, arcs, of)
        bound0 = np.array([x[0] for _, x in now])
        bounds = truncated(other, bound0[doc], uniform(salt + np.uint64(0xA0761D6478BD642F)))
        for i, (s, (bound, mass, word, prefix, _)) in enumerate(now):
            own = arcs[arc_start[i] : arc_end[i]]
            s.done.append((bound, np.concatenate((prefix, own))))
            if not count[i]:
                continue
            # no more than the segmentations still wanted can come from these words
            b, wanted = bounds[first[i] : ends[i]], k - round_
            best = np.argpartition(-b, wanted)[:wanted] if len(b) > wanted else np.arange(len(b))
            inside = np.searchsorted(of[arc_start[i] : arc_end[i]], first[i] + np.concatenate((best, best + 1)))
            for w, lo, hi in zip(best.tolist(), inside[: len(best)].tolist(), inside[len(best) :].tolist()):
                at = first[i] + w
                s.push(float(b[w]), 1, float(before[at]), word + w, (s.done[-1][1], len(prefix) + lo), own[lo:hi])
    out = []
    for s in searches:
        kappa = s.done[k][0] if len(s.done) > k else -np.inf
        rows = []
        for _, arcs in s.done[:k]:
            logp = float(lattices.share[arcs].sum()) if len(arcs) else 0.0
            rows.append((logp, float(-np.expm1(-np.exp(min(logp - kappa, 50.0)))) if np.isfinite(kappa) else 1.0, arcs))
        out.append(rows)
    return out


def units(text: str) -> list[str]:
    """The text's words as the model sees them: a blank before the text, blanks as U+2581. Joined they are that text.

    Where one blank stands between two words the text is split there, and a newline stays before what follows it.
    """
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or BLANK in text:
        return UNIT.findall(BLANK + text.replace(" ", BLANK))
    return [p if p[0] == "\n" else BLANK + p for p in parts]


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Sampler:
    """Samples texts; keeps the lattices of words that come again, up to MOST_ARCS arcs and those of the texts at hand."""

    def __init__(self, path: str, k: int, alpha: float, seed: int):
        self.pieces, self.k, self.seed = Pieces(path, alpha), k, seed
        self.number, self.uses, self.lattices = Numbers(), np.zeros(0, np.int64), Lattices([], self.pieces)

    def batch(self, keys: list[int | None], texts: list[str]) -> Iterator[list[tuple[float, float, np.ndarray]]]:
        """For each text its sampled (log-probability, inclusion score, ids); PIECE_CHARS of text at a time."""
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= PIECE_CHARS or i == len(texts) - 1:
                yield from self.piece(keys[start : i + 1], texts[start : i + 1])
                start, size = i + 1, 0

    def forget(self) -> None:
        """Lets go of rarer words until the lattices take half of their place."""
        arcs, least = np.add.reduceat(np.diff(self.lattices.begin), self.lattices.root), 2
        while int(arcs[wanted := self.uses >= least].sum()) > MOST_ARCS // 2:
            least *= 2
        self.lattices.keep(wanted)
        self.uses = self.uses[wanted]
        self.number = Numbers(zip((w for w, keep in zip(self.number, wanted.tolist()) if keep), range(len(self.uses))))

    def piece(self, keys: list[int | None], texts: list[str]) -> Iterator[list[tuple[float, float, np.ndarray]]]:
        if len(self.lattices.src) > MOST_ARCS:
            self.forget()
        before = len(self.number)
        coded = [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in map(units, texts)]
        self.lattices.add(list(itertools.islice(self.number, before, None)))
        uses = np.bincount(np.concatenate(coded), minlength=len(self.number)) if coded else np.zeros(0, np.int64)
        uses[:before] += self.uses
        self.uses = uses
        marks = [xxhash.xxh64_intdigest(repr(key).encode(), seed=self.seed) for key in keys]
        for rows in sample_batch(coded, marks, self.lattices, self.k):
            yield [(logp, score, self.ids(self.lattices.piece[arcs])) for logp, score, arcs in rows]

    def ids(self, piece: np.ndarray) -> np.ndarray:
        if (piece >= 0).all():
            return piece.astype(np.int32)
        out = []
        for p in piece.tolist():
            out += [p] if p >= 0 else [self.pieces.byte[b] for b in (-1 - p).to_bytes(4, "big").lstrip(b"\0")]
        return np.array(out, np.int32)


#: Ids of the segmentations that go out in one batch.
BATCH_IDS = 1 << 20


def sample_task(path: str, k: int, alpha: float, seed: int):
    def record(rows: list[tuple]) -> pa.RecordBatch:
        key, n, logp, score, ids = zip(*rows)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(logp, pa.float64()), pa.array(score, pa.float64()), lists], ["id", "sample", "log_prob", "inclusion", "ids"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, rows, size = Sampler(path, k, alpha, seed), [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, found in zip(keys, sampler.batch(keys, texts)):
                rows += [(key, j, p, s, ids) for j, (p, s, ids) in enumerate(found)]
                size += sum(len(x[2]) for x in found)
                if size >= BATCH_IDS:
                    yield record(rows)
                    rows, size = [], 0
        if rows:
            yield record(rows)

    return task


def segmentations(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows per document: id, sample, log_prob, inclusion, ids (pieces)."""
    small_batches(docs.sparkSession, 768)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(sample_task(path, k, alpha, seed), "id long, sample int, log_prob double, inclusion double, ids array<int>").withColumnRenamed("id", id_col)


def decode_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        tail = {i: bytes([b]) for b, i in enumerate(pieces.byte)}
        table = [tail.get(i) or p.replace(BLANK, " ").encode() for i, p in enumerate(pieces.text)]
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids or []))[1:].decode("utf-8", "replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return task


def decoded(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Rows with their ids replaced by the text they decode to; null ids decode to empty text."""
    small_batches(rows.sparkSession, 256)
    others = [c for c in rows.columns if c != ids_col]
    schema = rows.select(*others, F.lit("").alias("text")).schema
    return rows.select(*others, ids_col).mapInArrow(decode_task(path), schema)
