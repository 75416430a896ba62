"""Sampled SentencePiece segmentations: Gumbel top-k without replacement over the lattice, and exact decoding.

The lattice of a text has an edge for every vocabulary piece at every place; a character without a piece has one edge of
its byte pieces. A segmentation is a path, with probability in proportion to the product of its pieces' weights. The
model file orders its pieces by merge rank; a piece of rank r weighs `(10 + r) ** -alpha` (Zipf's law).

Sampling k paths without replacement is a search from the best on. A set of paths has a perturbed bound: its log mass
plus a Gumbel draw, at most the bound of the set it was split from. The set with the highest bound is opened: a path
drawn from it carries just that bound, and the others are split by the first edge in which they differ from it. The k
paths opened first are the sample; the bound of the set that would come next turns each path's probability into its
inclusion probability `1 - exp(-exp(log p - bound))`, given with its logarithm, as it is below the least double for a text
of some hundred words.

Spaces are taken as the pieces' word marks and one space is put in front, as the model does, so decoding gives back
every text exactly, word marks in the text included. Draws are hashes of the row key, the round and the place: the same
for a row wherever it runs; rows with equal keys and texts get equal samples. A null text gives one row with null `ids`;
an empty text one row without pieces; a text with fewer segmentations than k gives all it has. Other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import mix64, plain, restored, shielded, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Nothing that crosses the ends of these is a piece: a word with the spaces before it, a line feed or tab, spaces with no
#: word after them. Carriage returns end some pieces and so belong to words.
WORD = re.compile(r" *[^ \n\t]+|[\n\t]| +")
BASE, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 18
STRIDE = np.uint64((64 * 0x9E3779B97F4A7C15) % 2**64)


@dataclass
class Vocabulary:
    """Pieces by surface, with spaces for word marks. `nodes` are the hashes of all prefixes of pieces, in order."""

    surfaces: list[bytes]
    rank: np.ndarray
    nodes: np.ndarray
    piece: np.ndarray  # per node: id of the piece that ends there, or -1
    byte_ids: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        slots = np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS)
        self.slots = np.minimum(np.searchsorted(self.nodes, slots), len(self.nodes) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the first node not below each hash: by slot, then step by step over the few nodes of a slot."""
        at = self.slots[h >> np.uint64(64 - SLOT_BITS)]
        below = np.flatnonzero((self.nodes[at] < h) & (at < len(self.nodes) - 1))
        while len(below):
            at[below] += 1
            below = below[(self.nodes[at[below]] < h[below]) & (at[below] < len(self.nodes) - 1)]
        return at

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        surfaces, rank, byte_ids, known, longest = [], [], np.full(256, -1, dtype=np.int64), {}, 1
        for i in range(model.get_piece_size()):
            rank.append(float(np.clip(-model.get_score(i), 0, model.get_piece_size())))
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[1:-1], 16)
                byte_ids[byte] = i
                surfaces.append(bytes([byte]))
                rank[-1] = float(model.get_piece_size())
            elif model.is_control(i) or model.is_unknown(i):
                surfaces.append(b"")
            else:
                piece = model.id_to_piece(i).replace("▁", " ")
                surfaces.append(piece.encode())
                if not WORD.fullmatch(piece):
                    raise ValueError(f"piece {i} crosses the ends of words")
                longest = max(longest, len(piece))
                h = np.uint64(0)
                for at, c in enumerate(piece):
                    h = step_hash(h, np.uint64(ord(c)))
                    known.setdefault(int(h), -1)
                    if at == len(piece) - 1:
                        known[int(h)] = i
        nodes = np.array(sorted(known), dtype=np.uint64)
        return Vocabulary(surfaces, np.array(rank), nodes, np.array([known[int(h)] for h in nodes]), byte_ids, longest)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.surfaces.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def step_hash(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h + c + np.uint64(1)) * BASE ^ (h >> np.uint64(29))


@dataclass
class Lattice:
    """Edges of all distinct words, by start; `first[p]:first[p + 1]` are those from place p, longest first."""

    start: np.ndarray  # first place of each word
    stop: np.ndarray  # place after the last of each word
    first: np.ndarray
    end: np.ndarray
    ids: np.ndarray  # piece id, or -1 - code point
    logp: np.ndarray  # given the place
    other: np.ndarray  # log probability of the other edges from the place
    cum: np.ndarray  # probability cumulated over the edges from a place


def lattice(words: list[str], vocab: Vocabulary, alpha: float) -> Lattice:
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    stop = np.cumsum(size)
    start, n = stop - size, len(code)
    last = np.repeat(stop, size)
    at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
    weight = -alpha * np.log(10 + vocab.rank)
    levels = []
    for length in range(1, vocab.longest + 1):
        inside = at + length <= last[at]
        at, h = at[inside], h[inside]
        if not len(at):
            break
        h = step_hash(h, code[at + length - 1])
        node = vocab.find(h)
        live = vocab.nodes[node] == h
        piece = np.where(live, vocab.piece[node], -1)
        if length == 1:
            lost = np.flatnonzero(piece < 0)
            c = code[at[lost]].astype(np.int64)
            piece[lost] = np.where(c < 128, vocab.byte_ids[np.minimum(c, 127)], -1 - c)
            levels.append((at, length, piece))
        else:
            found = piece >= 0
            levels.append((at[found], length, piece[found]))
        at, h = at[live], h[live]
    count = np.zeros(n, dtype=np.int64)
    for where, _, _ in levels:
        count[where] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends, ids = np.repeat(np.arange(n), count), np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
    free = first[:-1].copy()
    for where, length, piece in reversed(levels):
        ends[free[where]], ids[free[where]] = where + length, piece
        free[where] += 1
    w = weight[np.maximum(ids, 0)]
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        c = -1 - ids[lost]
        w[lost] = (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) * weight[vocab.byte_ids[0]]
    p = _given_place(starts, ends, w, last, n)
    with np.errstate(divide="ignore"):
        logp = np.log(p)
        other = np.log(np.where(count[starts] > 1, np.maximum(1 - p, 0), 0))
    running = np.cumsum(p)
    cum = running - np.repeat(np.concatenate([[0], running])[first[:-1]], np.diff(first))
    cum[first[1:] - 1] = 2  # above every draw
    narrow = lambda x: x.astype(np.float32)
    return Lattice(start, stop, first, ends.astype(np.int32), ids.astype(np.int32), logp, narrow(other), narrow(cum))


class Lattices:
    """The lattice of all words met so far, grown word by word; begun anew when it holds `most` characters."""

    def __init__(self, vocab: Vocabulary, alpha: float, most: int = 750_000) -> None:
        self.vocab, self.alpha, self.most = vocab, alpha, most
        self.known: dict[str, int] = {}
        self.room: dict[str, np.ndarray] = {}
        self.used: dict[str, int] = {}

    def of(self, words: list[str]) -> tuple[Lattice, np.ndarray]:
        """A lattice with all of `words`, and the number of each word in it."""
        if self.used.get("first", 0) > self.most:
            self.known, self.used = {}, {}
        known = self.known
        new = list(set(words).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            more = vars(lattice(new, self.vocab, self.alpha))
            places, edges = max(self.used.get("first", 0) - 1, 0), self.used.get("ids", 0)
            for name, x in more.items():
                if name == "first":
                    self._add(name, x[1:] + edges if places else x)
                else:
                    self._add(name, x + np.array(places, dtype=x.dtype) if name in ("start", "stop", "end") else x)
        return Lattice(**{name: self.room[name][:n] for name, n in self.used.items()}), np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def _add(self, name: str, x: np.ndarray) -> None:
        n = self.used.get(name, 0)
        have = self.room.get(name)
        if have is None or len(have) < n + len(x):
            wider = np.empty(2 * (n + len(x)), dtype=x.dtype)
            if n:
                wider[:n] = have[:n]
            self.room[name] = wider
        self.room[name][n : n + len(x)] = x
        self.used[name] = n + len(x)


def _given_place(starts: np.ndarray, ends: np.ndarray, w: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Probability of each edge given its start: its share of the mass of all paths from there to the end of the word.

    Masses are added from the ends of the words backwards, by distance from the end. They are kept as numbers between
    0.5 and 1 with a power of two beside them, so a long word does not run out of range.
    """
    mass, power = np.ones(n + 1), np.zeros(n + 1, dtype=np.int64)
    far = last[starts] - starts
    order = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 65536 else far, kind="stable")
    bounds = np.searchsorted(far[order], np.arange(1, far.max(initial=0) + 2))
    share = np.exp(w)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if lo == hi:
            continue
        e = order[lo:hi]
        s, t = starts[e], ends[e]
        t = np.where(t < last[s], t, n)
        new = np.flatnonzero(np.diff(s, prepend=-1))
        top = np.maximum.reduceat(power[t], new)
        count = np.diff(np.append(new, len(s)))
        part = share[e] * np.ldexp(mass[t], np.maximum(power[t] - np.repeat(top, count), -1000).astype(np.int32))
        total = np.add.reduceat(part, new)
        share[e] = part / np.repeat(total, count)
        mass[s[new]], exponent = np.frexp(total)
        power[s[new]] = top + exponent
    return share


def uniform(seed: np.ndarray, turn: int, place: np.ndarray) -> np.ndarray:
    """Draws in (0, 1) by row seed, turn and place."""
    return unit(stream(seed, turn, place))


def stream(seed: np.ndarray, turn: int, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return place.astype(np.uint64) * STRIDE + (seed + np.uint64(turn) * BASE)


def unit(x: np.ndarray) -> np.ndarray:
    u = (mix64(x) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u /= 2.0**53
    return u


def walk(lat: Lattice, place: np.ndarray, stop: np.ndarray, seed: np.ndarray, turn: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges drawn from `place` to `stop`, for many words at once, in word order; how many each word has."""
    n = len(place)
    base = stream(seed, turn, key * 4096)
    count, steps = np.zeros(n, dtype=np.int64), []
    live = np.flatnonzero(place < stop)
    at = place[live]
    step = 0
    while len(live):
        u = unit(base[live] + np.uint64(step * int(STRIDE) % 2**64))
        edge = lat.first[at]
        over = np.flatnonzero(lat.cum[edge] <= u)
        while len(over):
            edge[over] += 1
            over = over[lat.cum[edge[over]] <= u[over]]
        steps.append((live, edge))
        count[live] += 1
        at = lat.end[edge]
        more = at < stop[live]
        live, at = live[more], at[more]
        step += 1
    offset = np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.int64)
    for step, (who, edge) in enumerate(steps):
        out[offset[who] + step] = edge
    return out, count


@dataclass
class Sample:
    edges: np.ndarray
    words: np.ndarray  # word number of each edge
    logp: float
    bound: float
    bounds: np.ndarray  # of the sets split off at each edge
    fixed: int  # edges shared with the path it was split from
    barred: frozenset[int]  # edges ruled out at place `fixed`


def _rest(lat: Lattice, edge: int, barred: frozenset[int]) -> np.ndarray:
    """Edges from the same place as `edge`, without the ones ruled out."""
    place = int(np.searchsorted(lat.first, edge, side="right")) - 1
    options = np.arange(lat.first[place], lat.first[place + 1])
    return options[[int(e) not in barred for e in options]]


def _split(lat: Lattice, s: Sample, seed: np.ndarray, turn: int) -> None:
    """Bounds of the sets of paths that first leave the sample at each of its free edges."""
    p = lat.logp[s.edges]
    mass = lat.other[s.edges].astype(np.float64)
    if s.barred and s.fixed < len(p):
        left = _rest(lat, int(s.edges[s.fixed]), s.barred | {int(s.edges[s.fixed])})
        with np.errstate(divide="ignore"):
            mass[s.fixed] = np.log(np.exp(lat.logp[left]).sum())
    mass += np.cumsum(p) - p
    # Draws and their logs need no more than single precision; the masses keep theirs.
    noise = -np.log(uniform(seed, turn, np.arange(len(p))).astype(np.float32))
    with np.errstate(over="ignore"):
        s.bounds = mass - np.log(np.exp((mass - s.bound).astype(np.float32)) + noise)
    s.bounds[: s.fixed] = -np.inf


def sample_all(texts: list[str], seeds: np.ndarray, lattices: Lattices, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its sampled paths, best bound first: piece ids, log probability, inclusion probability."""
    return [[(ids, logp, float(np.exp(inc))) for ids, logp, inc in samples] for samples in sample_logs(texts, seeds, lattices, k)]


def log_inclusion(distance: float) -> float:
    """`log(1 - exp(-exp(distance)))`, also where the inner exponential is too small for a double."""
    if distance < -30:
        return distance
    with np.errstate(over="ignore"):
        return float(np.log(-np.expm1(-np.exp(distance))))


def sample_logs(texts: list[str], seeds: np.ndarray, lattices: Lattices, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """As `sample_all`, with the logarithm of the inclusion probability."""
    cut = [WORD.findall(" " + t) if t else [] for t in texts]
    sizes = np.array([len(c) for c in cut])
    flat = [w for c in cut for w in c]
    if not flat:
        return [[(np.empty(0, dtype=np.int32), 0.0, 0.0)] for _ in texts]
    lat, types = lattices.of(flat)
    vocab = lattices.vocab
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    number = np.arange(len(flat)) - (ends - sizes)[doc]
    place, stop = lat.start[types], lat.stop[types]
    edges, count = walk(lat, place, stop, seeds[doc], 0, number)
    word = np.repeat(number, count)
    bounds = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], ends])]
    drawn: list[list[Sample]] = []
    for i in range(len(texts)):
        e = edges[bounds[i] : bounds[i + 1]]
        own = np.array([seeds[i]], dtype=np.uint64)
        root = float(-np.log(-np.log(uniform(own, 1, np.zeros(1))[0])))
        s = Sample(e, word[bounds[i] : bounds[i + 1]], float(lat.logp[e].sum()), root, np.empty(0), 0, frozenset())
        _split(lat, s, own, 2)
        drawn.append([s])
    for turn in range(1, k):
        _open_next(lat, drawn, seeds, turn, ends, sizes, place, stop, turn == k - 1)
    out = []
    for i, samples in enumerate(drawn):
        if not sizes[i]:
            out.append([(np.empty(0, dtype=np.int32), 0.0, 0.0)])
            continue
        cutoff = max(s.bounds.max(initial=-np.inf) for s in samples)
        out.append([(_ids(lat, s.edges, vocab), s.logp, log_inclusion(float(s.logp - cutoff))) for s in samples])
    return out


def _open_next(lat: Lattice, drawn: list[list[Sample]], seeds: np.ndarray, turn: int, ends: np.ndarray, sizes: np.ndarray, place: np.ndarray, stop: np.ndarray, last: bool) -> None:
    """Open the set with the highest bound of every text that has one, and draw a path from it.

    The sets split off the last path are never opened; the highest of their bounds is drawn at once from their mass.
    """
    todo = []
    for i, samples in enumerate(drawn):
        best = max(samples, key=lambda s: s.bounds.max(initial=-np.inf))
        bound = best.bounds.max(initial=-np.inf)
        if np.isfinite(bound):
            todo.append((i, best, int(best.bounds.argmax()), float(bound)))
    if not todo:
        return
    starts, stops, who, keys, heads = [], [], [], [], []
    for i, s, j, _ in todo:
        barred = (s.barred if j == s.fixed else frozenset()) | {int(s.edges[j])}
        options = _rest(lat, int(s.edges[j]), barred)
        p = np.cumsum(np.exp(lat.logp[options]))
        u = uniform(seeds[i : i + 1], 4 * turn + 1, np.full(1, j))
        edge = int(options[min(int(np.searchsorted(p, u[0] * p[-1])), len(options) - 1)])
        w = int(s.words[j])
        base = int(ends[i] - sizes[i])
        after = place[base + w : ends[i]].copy()
        after[0] = lat.end[edge]
        starts.append(after)
        stops.append(stop[base + w : ends[i]])
        who.append(np.full(len(after), seeds[i]))
        keys.append(np.arange(w, sizes[i]))
        heads.append((edge, barred, float(lat.logp[s.edges[:j]].sum() + np.log(p[-1]))))
    drawn_edges, count = walk(lat, np.concatenate(starts), np.concatenate(stops), np.concatenate(who), 4 * turn + 2, np.concatenate(keys))
    tail_words = np.repeat(np.concatenate(keys), count)
    cuts = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum([len(x) for x in starts])])]
    for n, ((i, s, j, bound), (edge, barred, mass)) in enumerate(zip(todo, heads, strict=True)):
        s.bounds[j] = -np.inf
        new = np.concatenate([s.edges[:j], [edge], drawn_edges[cuts[n] : cuts[n + 1]]])
        logp = float(lat.logp[new].sum())
        if last:
            others = -np.expm1(logp - mass)
            left = mass + np.log(others) if others > 1e-12 else -np.inf
            noise = -np.log(uniform(seeds[i : i + 1], 4 * turn + 3, np.zeros(1)))
            drawn[i].append(Sample(new, new, logp, bound, left - np.log(np.exp(left - bound) + noise), j, barred))
            continue
        words = np.concatenate([s.words[: j + 1], tail_words[cuts[n] : cuts[n + 1]]])
        sample = Sample(new, words, logp, bound, np.empty(0), j, barred)
        _split(lat, sample, seeds[i : i + 1], 4 * turn + 3)
        drawn[i].append(sample)


def _ids(lat: Lattice, edges: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    ids = lat.ids[edges]
    if (ids >= 0).all():
        return ids.astype(np.int32)
    parts, at = [], 0
    for lost in np.flatnonzero(ids < 0).tolist():
        parts.append(ids[at:lost])
        parts.append(vocab.byte_ids[list(chr(-1 - int(ids[lost])).encode("utf-8", "surrogatepass"))])
        at = lost + 1
    return np.concatenate([*parts, ids[at:]]).astype(np.int32)


@shielded("key", "text")
def encode(docs: DataFrame, k: int = 2, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """`docs` without `text`, one row per sampled segmentation: `rank`, `n_pieces`, `log_prob`, `inclusion`, `log_inclusion`, `ids`, `exact`.

    `exact` says whether decoding the ids gives the text back; it is null for a null text. The vocabulary is read on the driver and broadcast; its size is that of the model file.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = ("rank", "n_pieces", "log_prob", "inclusion", "log_inclusion", "ids", "exact")
    kept = [c for c in docs.columns if c != text and c not in names]
    before = docs.select(*kept).schema
    rows = plain(docs.select(*kept, F.col(text).alias("_text")))
    rows = rows.withColumn("_seed", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    schema = T.StructType([rows.schema[c] for c in kept]).add("rank", T.IntegerType()).add("n_pieces", T.LongType())
    schema = schema.add("log_prob", T.DoubleType()).add("inclusion", T.DoubleType()).add("log_inclusion", T.DoubleType()).add("ids", T.ArrayType(T.IntegerType())).add("exact", T.BooleanType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = Lattices(vocab.value, alpha)
        for frame in frames:
            for part in text_chunks(frame, "_text", 250_000):
                texts = [t if isinstance(t, str) else "" for t in part["_text"]]
                samples = sample_logs(texts, part["_seed"].to_numpy().astype(np.uint64), lattices, k)
                counts = [len(s) for s in samples]
                out = part.drop(columns=["_text", "_seed"]).loc[np.repeat(np.arange(len(part)), counts)].reset_index(drop=True)
                empty = part["_text"].isna().repeat(counts).to_numpy()
                flat = [x for s in samples for x in s]
                ids = [None if e else x[0] for x, e in zip(flat, empty, strict=True)]
                texts_of = [t for t, c in zip(texts, counts, strict=True) for _ in range(c)]
                yield out.assign(
                    rank=[r for c in counts for r in range(1, c + 1)],
                    n_pieces=[len(x[0]) for x in flat],
                    log_prob=[x[1] for x in flat],
                    inclusion=np.exp([x[2] for x in flat]),
                    log_inclusion=[x[2] for x in flat],
                    ids=pd.Series(ids, dtype=object),
                    exact=pd.Series([None if x is None else vocab.value.decode(x) == t for x, t in zip(ids, texts_of, strict=True)], dtype=object),
                )

    return restored(rows.mapInPandas(run, schema), before)


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """`rows` with the text that `ids` stand for; null ids give a null text."""
    vocab = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf(T.StringType())
    def decoded(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else vocab.value.decode(x) for x in column], dtype=object)

    return rows.withColumn(text, decoded(ids))
