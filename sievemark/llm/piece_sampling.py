"""SentencePiece encoding and decoding by Gumbel top-k without replacement.

The lattice of a text has an edge for each vocabulary piece that matches; no piece crosses the start
of a run of spaces, so it is the product of the lattices of its pre-tokens, which are built once for
each distinct pre-token of a batch (all starts walk a trie of the pieces in step, backward sums layer by layer).
A path's log-probability is the sum of its pieces' log-probabilities, normalised over the lattice.

Perturbed A* search: the set of all paths has a Gumbel value; a popped set is split into disjoint
sets, of which one, chosen in proportion to mass, inherits the value and the others draw values
truncated below it. Sets are "the completions of a prefix other than a known path" and "the other
pieces at a place of a path"; a set that is to yield its best path descends in proportion to mass.
Paths come out by falling perturbed value, distinct, as k draws without replacement. The value of the
best set left after them is the threshold; a path's inclusion score is the chance that its value lies
above it. All numbers are hashes of (seed, row key, place), so a row gives the same samples anywhere.

Characters without a piece fall back to their bytes. A BPE model's scores are merge ranks, not
log-probabilities: its pieces get Zipfian ones, -log(rank + 2). Those of a unigram model are used.

Defined cases: null and empty texts have one sample without pieces, inclusion 1; a text with fewer
than k segmentations gives all it has; a literal space symbol is a space, as in the library; repeated
rows give equal samples; a null key seeds like 0; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

SPACE = "▁"
#: Ends a pre-token where many stand one after another; no code point.
CUT = 0x110000
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1024
#: Columns of the table of trie steps: ASCII, the space symbol, and a column that leads nowhere.
SPACE_COLUMN, NO_COLUMN = 128, 129


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.of_ascii = np.array([self.bytes.get(b, 0) for b in range(128)], np.int32)
        #: bytes that are no character alone, and what the other pieces say
        self.high = {i for i, b in self.byte_of.items() if b > 127}
        self.told = [chr(self.byte_of[i]) if i in self.byte_of else p for i, p in enumerate(self.pieces)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        scores = np.array([model.get_score(i) for i in plain])
        ranked = scores.size == 0 or scores.min() < -1000
        self.scores = np.full(n, -1e9)
        self.scores[plain] = -np.log(np.arange(len(plain)) + 2.0) if ranked else scores
        self.byte_score = float(self.scores[plain].min()) - 2.0 if plain else -10.0
        #: what each piece says, in bytes
        self.said = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)], pa.binary())
        # trie of the pieces: states that go on come first; a table of their steps for frequent characters, sorted (state, character) keys for the others
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in plain:
            state = 0
            for c in self.pieces[i]:
                state = steps.setdefault((state, ord(c)), len(steps) + 1)
            ends[state] = i
        going = sorted({state for state, _ in steps} | {0})
        place = {state: k for k, state in enumerate(going)}
        for state in range(len(steps) + 1):
            place.setdefault(state, len(place))
        self.going = len(going)
        self.steps = np.full(self.going * (NO_COLUMN + 1), -1, np.int32)
        rare = {}
        for (state, c), to in steps.items():
            if c < 128 or c == ord(SPACE):
                self.steps[place[state] * (NO_COLUMN + 1) + (c if c < 128 else SPACE_COLUMN)] = place[to]
            else:
                rare[place[state] << 21 | c] = place[to]
        self.keys = np.array(sorted(rare), np.int64)
        self.next = np.array([rare[k] for k in sorted(rare)], np.int32)
        self.piece_of = np.full(len(place), -1, np.int32)
        for state, i in ends.items():
            self.piece_of[place[state]] = i

    def matches(self, codes: np.ndarray):
        """(start, piece) of the pieces of 1, 2, ... characters found anywhere; all starts walk the trie in step."""
        columns = np.where(codes < 128, codes, NO_COLUMN).astype(np.int32)
        columns[codes == ord(SPACE)] = SPACE_COLUMN
        others = (columns == NO_COLUMN) & (codes != CUT)
        some = bool(len(self.keys)) and bool(others.any())
        at, state, depth = np.flatnonzero(codes != CUT).astype(np.int32), None, 0
        while len(at):
            here = at + depth
            step = columns[here] if state is None else state * (NO_COLUMN + 1) + columns[here]
            now = self.steps[step]
            if some and len(odd := np.flatnonzero(others[here])):
                key = (state[odd].astype(np.int64) << 21 if state is not None else 0) | codes[here[odd]]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                now[odd] = np.where(self.keys[found] == key, self.next[found], -1)
            ok = now >= 0
            at, state, depth = at[ok], now[ok], depth + 1
            piece = self.piece_of[state]
            hit = piece >= 0
            yield depth, at[hit], piece[hit]
            on = state < self.going
            at, state = at[on], state[on]

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [0]

    def decode(self, ids) -> str:
        """The text of piece ids, without the space that every text starts with."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.told.__getitem__, ids))
        else:
            out = bytearray()
            for i in ids:
                out += bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode()
            text = out.decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


    def says(self, ids: pa.ListArray, texts: pa.Array) -> pa.Array:
        """Whether each list of ids decodes to its text, in which a space symbol is a space."""
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.said.take(ids.flatten())), b"")
        plain = pc.replace_substring(texts, SPACE, " ").cast(pa.binary())
        led = pc.binary_join_element_wise(pa.scalar(b" "), plain, pa.scalar(b""))
        return pc.equal(joined, pc.if_else(pc.equal(pc.binary_length(plain), 0), plain, led))


class Lattices:
    """Lattices of distinct pre-tokens, as one graph over the characters of their concatenation.

    Edges stand in the order of their nodes, those of a node together, longest piece first.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary, alpha: float):
        sizes = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        codes = np.full(int(self.end[-1]) + 1, CUT, np.int64)
        inside = np.ones(len(codes), bool)
        inside[self.end] = False
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.is_end = np.append(~inside, False)
        self.count = np.zeros(len(codes) + 1, np.int32)
        found, bare = [], inside
        for depth, start, piece in vocabulary.matches(codes):
            if depth == 1:
                bare = inside.copy()
                bare[start] = False
            self.count[start] += 1
            found.append((depth, start, piece, vocabulary.scores[piece]))
        bare = np.flatnonzero(bare).astype(np.int32)
        if len(bare):
            width = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
            self.count[bare] += 1
            found.insert(0, (1, bare, (-1 - codes[bare]).astype(np.int32), vocabulary.byte_score * width))
        # nodes by their distance to the end of the word, so that sums go from the ends
        left = (np.repeat(self.end, sizes + 1) - np.arange(len(codes)))[inside]
        nodes = np.flatnonzero(inside)[np.argsort(left.astype(np.uint16 if left.max() < 1 << 16 else np.int64), kind="stable")].astype(np.int32)
        each = self.count[nodes]
        bounds = np.concatenate([[0], np.cumsum(each)])
        self.first = np.zeros(len(codes) + 1, np.int32)
        self.first[nodes] = bounds[:-1]
        self.source = np.repeat(nodes, each)
        self.after, self.piece, score = np.empty(len(self.source), np.int32), np.empty(len(self.source), np.int32), np.empty(len(self.source))
        free = self.first + self.count - 1
        for depth, start, piece, own in found:
            at = free[start]
            free[start] -= 1
            self.after[at], self.piece[at], score[at] = start + depth, piece, own * alpha
        beta = np.zeros(len(codes) + 1)
        layers = np.concatenate([[0], np.cumsum(np.bincount(left)[1:])])
        for a, b in zip(layers[:-1], layers[1:], strict=True):
            lo, hi = bounds[a], bounds[b]
            value, groups = score[lo:hi] + beta[self.after[lo:hi]], bounds[a:b] - lo
            top = np.maximum.reduceat(value, groups)
            beta[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, each[a:b])), groups))
        #: log of the chance of an edge given its node, and the sums of the chances up to it
        self.log_q = score + beta[self.after] - beta[self.source]
        self.below = np.exp(self.log_q)
        open_nodes = nodes
        for k in range(1, int(each.max())):
            open_nodes = open_nodes[self.count[open_nodes] > k]
            at = self.first[open_nodes] + k
            self.below[at] += self.below[at - 1]
        self.below[bounds[1:] - 1] = np.inf

    def drawn(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, in proportion to its chance."""
        edge = self.first[node]
        wrong = np.flatnonzero(u >= self.below[edge])
        while len(wrong):
            edge[wrong] += 1
            wrong = wrong[u[wrong] >= self.below[edge[wrong]]]
        return edge


def _uniform(seed: np.ndarray, place: np.ndarray, step: np.ndarray, path: int) -> np.ndarray:
    """One number for each place, step and path of a row."""
    at = place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + step.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    h = mix((seed ^ at) + np.uint64((path + 1) * 0x27D4EB2F165667C5 & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class _Numbers:
    """One row's uniform numbers for the search."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h = self.state
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        return (((h ^ (h >> 31)) >> 11) + 0.5) / (1 << 53)


def truncated(mean: float, bound: float, u: float) -> float:
    """A Gumbel value of this mean, below the bound."""
    return mean - math.log(math.exp(min(mean - bound, 700.0)) - math.log(u))


def _log_less(a: float, b: float) -> float:
    """log(exp(a) - exp(b)); a set without mass is -inf."""
    d = b - a
    return a + math.log1p(-math.exp(d)) if d < -1e-12 else -math.inf


class Search:
    """The search of one row. paths: (edges, log-probabilities of the prefixes, perturbed value)."""

    def __init__(self, lattices: Lattices, numbers: _Numbers):
        self.lattices, self.numbers = lattices, numbers
        self.heap: list = []
        self.paths: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.ties = 0

    def _push(self, value: float, mass: float, what: tuple) -> None:
        if mass > -math.inf:
            self.ties += 1
            heapq.heappush(self.heap, (-value, self.ties, mass, what))

    def found(self, edges: np.ndarray, at: int, value: float) -> None:
        """A path whose first at edges belong to a set that is split already."""
        logs = np.concatenate([[0.0], np.cumsum(self.lattices.log_q[edges])])
        self.paths.append((edges, logs, value))
        rest = _log_less(logs[at], logs[-1])
        if rest > -math.inf:
            self._push(truncated(rest, value, self.numbers()), rest, ("path", len(self.paths) - 1, at))

    def next_branch(self) -> tuple[int, int, int, float] | None:
        """Pop and split sets until one is a single piece at a place of a path: (path, place, edge, value)."""
        while self.heap:
            value, _, mass, what = heapq.heappop(self.heap)
            value = -value
            if what[0] == "path":
                _, which, at = what
                edges, logs, _ = self.paths[which]
                other = _log_less(logs[at], logs[at + 1])
                rest = _log_less(logs[at + 1], logs[-1])
                sides = (other, ("side", which, at, (int(edges[at]),))), (rest, ("path", which, at + 1))
                top = max(other, rest)
                if top == -math.inf:
                    continue
                a, b = math.exp(other - top), math.exp(rest - top)
                chosen = 0 if self.numbers() * (a + b) < a else 1
                self._push(value, sides[chosen][0], sides[chosen][1])
                mean, what = sides[1 - chosen]
                if mean > -math.inf:
                    self._push(truncated(mean, value, self.numbers()), mean, what)
            else:
                _, which, at, taken = what
                edges, logs, _ = self.paths[which]
                node_first = int(edges[at])
                first = self._first_of(node_first)
                free = [e for e in range(first, first + self._count_of(node_first)) if e not in taken]
                q = np.exp(self.lattices.log_q[free])
                total = float(q.sum()) if free else 0.0
                if total <= 0:
                    continue
                k = min(int(np.searchsorted(np.cumsum(q), self.numbers() * total, side="right")), len(free) - 1)
                left = total - float(q[k])
                if len(free) > 1 and left > 0:
                    mean = float(logs[at]) + math.log(left)
                    self._push(truncated(mean, value, self.numbers()), mean, ("side", which, at, (*taken, free[k])))
                return which, at, free[k], value
        return None

    def _first_of(self, edge: int) -> int:
        return int(self.lattices.first[self.lattices.source[edge]])

    def _count_of(self, edge: int) -> int:
        return int(self.lattices.count[self.lattices.source[edge]])

    def threshold(self) -> float:
        return -self.heap[0][0] if self.heap else -math.inf


def _complete(lattices: Lattices, node: np.ndarray, end: np.ndarray, seed: np.ndarray, place: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its end, one after another, and how many each has."""
    steps, count, active = [], np.zeros(len(node), np.int64), np.flatnonzero(node < end)
    node = node.copy()
    while len(active):
        edge = lattices.drawn(node[active], _uniform(seed[active], place[active], count[active], path))
        steps.append((active, edge))
        node[active] = lattices.after[edge]
        count[active] += 1
        active = active[node[active] < end[active]]
    offset = np.cumsum(count) - count
    edges = np.zeros(int(count.sum()), np.int64)
    for k, (who, edge) in enumerate(steps):
        edges[offset[who] + k] = edge
    return edges, count


def _pretokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, those of all texts by number, and the first of each text. A pre-token is a run of spaces and what follows it."""
    column = pa.array(texts, pa.large_string())
    if pc.any(pc.match_substring(column, SPACE)).as_py():
        column = pc.replace_substring(column, SPACE, " ")
    parts = pc.split_pattern(column, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    word, values = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    # a text begins with a space that isn't written; of spaces in a row, all but the last leave an empty part
    distinct = [SPACE + v for v in values]
    blank = values.index("") if "" in values else -1
    gaps = np.flatnonzero(word == blank)
    keep = np.ones(len(word), bool)
    keep[offsets[:-1][np.diff(offsets) == 1][[texts[d] == "" for d in np.flatnonzero(np.diff(offsets) == 1)]]] = False
    gaps = gaps[keep[gaps]]
    if len(gaps):
        index: dict[str, int] = {}
        ends = offsets[np.searchsorted(offsets, gaps, "right")]
        at = 0
        while at < len(gaps):
            last = at
            while last + 1 < len(gaps) and gaps[last + 1] == gaps[last] + 1 and ends[last + 1] == ends[at]:
                last += 1
            after, n = int(gaps[last]) + 1, last - at + 1
            keep[gaps[at : last + 1]] = False
            if after < ends[at]:
                run = SPACE * n + distinct[word[after]]
            else:
                after, run = int(gaps[last]), SPACE * n
                keep[after] = True
            word[after] = index.setdefault(run, len(distinct) + len(index))
            at = last + 1
        distinct += index
    if keep.all():
        return distinct, word, offsets
    sums = np.concatenate([[0], np.cumsum(keep)])
    word = word[keep]
    used = np.zeros(len(distinct), bool)
    used[word] = True
    number = np.cumsum(used) - 1
    return [v for v, u in zip(distinct, used.tolist(), strict=True) if u], number[word], sums[offsets]


def sampled_batch(texts: list[str], seeds: np.ndarray, k: int, vocabulary: Vocabulary, alpha: float) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: (ids, log-probability, perturbed value, inclusion score)."""
    distinct, word, first = _pretokens(texts)
    lattices = Lattices(distinct, vocabulary, alpha) if distinct else None
    full = [d for d, text in enumerate(texts) if text]
    if full:
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        edges, count = _complete(lattices, lattices.start[word], lattices.end[word], seeds[doc], np.arange(len(word)) - first[doc], 0)
        bound = np.concatenate([[0], np.cumsum(count)])
    searches = {}
    for d in full:
        searches[d] = Search(lattices, _Numbers(int(seeds[d])))
        searches[d].found(edges[bound[first[d]] : bound[first[d + 1]]], 0, -math.log(-math.log(searches[d].numbers())))
    for path in range(1, k):
        # one branch of each search, completed together
        branches, node, last, seed, place = [], [], [], [], []
        for d, search in searches.items():
            if len(search.paths) == path and (branch := search.next_branch()):
                which, at, edge, _ = branch
                done = _words_done(lattices, search.paths[which][0][:at])
                rest = word[first[d] + done : first[d + 1]]
                start = lattices.start[rest]
                start[0] = lattices.after[edge]
                branches.append((d, branch))
                node.append(start)
                last.append(lattices.end[rest])
                seed.append(np.full(len(rest), seeds[d]))
                place.append(np.arange(done, done + len(rest)))
        if not branches:
            break
        edges, count = _complete(lattices, np.concatenate(node), np.concatenate(last), np.concatenate(seed), np.concatenate(place), path)
        bound = np.concatenate([[0], np.cumsum(count)])
        at_word = 0
        for (d, (which, at, edge, value)), own in zip(branches, node, strict=True):
            rest = edges[bound[at_word] : bound[at_word + len(own)]]
            at_word += len(own)
            known = searches[d].paths[which][0]
            searches[d].found(np.concatenate([known[:at], [edge], rest]), at + 1, value)
    out = []
    for d, text in enumerate(texts):
        if not text:
            out.append([(np.zeros(0, np.int32), 0.0, math.inf, 1.0)])
            continue
        limit = searches[d].threshold()
        own = []
        for path, logs, value in searches[d].paths:
            inclusion = 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(logs[-1] - limit, 700.0)))
            own.append((_ids(lattices.piece[path], vocabulary), float(logs[-1]), value, inclusion))
        out.append(own)
    return out


def _words_done(lattices: Lattices, edges: np.ndarray) -> int:
    """Pre-tokens that a prefix has finished."""
    return int(lattices.is_end[lattices.after[edges]].sum()) if len(edges) else 0


def _ids(pieces: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Piece ids; an edge without a piece becomes the bytes of its character."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces.astype(np.int32)
    if vocabulary.bytes and pieces.min() >= -128:  # one byte for each
        out = pieces.astype(np.int32)
        out[bare] = vocabulary.of_ascii[-1 - out[bare]]
        return out
    kinds, which = np.unique(pieces[bare], return_inverse=True)
    codes = [vocabulary.fallback(chr(-1 - p)) for p in kinds.tolist()]
    sizes = np.ones(len(pieces), np.int64)
    sizes[bare] = np.array([len(c) for c in codes])[which]
    out = np.repeat(pieces, sizes).astype(np.int32)
    at = (np.cumsum(sizes) - sizes)[bare]
    for k, code in enumerate(codes):
        for shift, i in enumerate(code):
            out[at[which == k] + shift] = i
    return out


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(model_file: str) -> Vocabulary:
    return _vocabularies.get(model_file) or _vocabularies.setdefault(model_file, Vocabulary(model_file))


def sampled(docs: DataFrame, model_file: str, k: int = 2, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sample, ids, log_prob, perturbed, inclusion, round_trip) for each of up to k samples of every row; no shuffle."""

    def run(batches):
        vocabulary = _vocabulary(model_file)
        for batch in batches:
            at = 0
            sizes = batch.column(2).to_numpy()
            while at < batch.num_rows:
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + BATCH_ROWS]), BATCH_BYTES, "right")))
                part = batch.slice(at, end - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = sampled_batch(texts, mix(part.column(3).to_numpy(zero_copy_only=False).view(np.uint64), 9), k, vocabulary, alpha)
                rows = [(i, s, *x) for i, own in enumerate(found) for s, x in enumerate(own, 1)]
                who, sample, ids, logs, value, inclusion = zip(*rows, strict=True)
                flat, bounds = pa.array(np.concatenate(ids)), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
                trip = vocabulary.says(lists, pa.array(texts, pa.string()).take(pa.array(who)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(sample, pa.int32()), lists, pa.array(logs), pa.array(value), pa.array(inclusion), trip], ["id", "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])
                at = end

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col), F.lit(0))).alias("seed"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = sampled(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids", "log_prob", "perturbed", "inclusion", "round_trip")
