"""Sampled SentencePiece segmentation: forward filtering and backward sampling over the piece lattice, and its decoding.

A text is cut before each space and around line ends into segments, which no piece of the vocabulary crosses. A segment's
lattice has an arc for each piece that matches; a character
without a piece of its own is spelled by byte pieces. Forward filtering sums the weights of all paths to each position;
backward sampling then draws the arcs from the end with exactly the probability of the whole segmentation. Segments are
independent given the text, so a text's segmentation is drawn from the law over its lattice. Sums are scaled down every RESCALE
positions, so a segment may have any length; memory grows with the longest one (a run of text without a space).

The draws come from counters keyed by the row's key and the segment's place in the row: the same row is always segmented
alike, whatever its batch, task or neighbours. No normalisation is applied, so decoding gives back the exact text.

The vocabulary file has ranks (byte-pair merges), not probabilities; a piece of rank r weighs (r + ZIPF) ** -SHARPNESS.

Defined results: null and empty texts have no pieces and count as lossless; they decode to an empty text. Repeated rows
are segmented alike. A null key is a key of its own. An empty table gives an empty table. `encode` keeps other columns, but
replaces any that are named n_pieces, pieces or lossless.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import configure, free_names

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF, SHARPNESS, SEED = 10.0, 0.6, 5
RESCALE = 64
#: Segments whose lattices a worker keeps, and the most arcs they may have together.
KEPT, KEPT_ARCS = 300_000, 6_000_000
SPACE = "▁"
#: Stands for a literal U+2581, which must not match the space mark of a piece.
LITERAL = ""
_SEGMENTS = re.compile(r"\n| ?[^ \n]+| ")


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return tx.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1))


@dataclass(frozen=True)
class Vocabulary:
    """texts: what each piece stands for, in bytes; spell: byte -> id; and a table of the pieces' hashes, ids and weights."""

    texts: tuple[bytes, ...]
    spell: tuple[int, ...]
    longest: int
    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    filled: np.ndarray
    #: Which hashes may be those of a piece's beginning.
    begun: np.ndarray

    def may_go_on(self, hashes: np.ndarray) -> np.ndarray:
        return self.begun[(hashes & np.uint64(len(self.begun) - 1)).astype(np.int64)]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are pieces', and the pieces' places in the table."""
        maybe = np.flatnonzero(self.filled[(hashes & np.uint64(len(self.filled) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[maybe]
        return maybe[hit], place[hit]


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, spell, words, beginnings = [], [0] * 256, [], set()
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte = int(piece[1:-1], 16)
            spell[byte] = k
            texts.append(bytes([byte]))
        elif model.is_control(k) or model.is_unknown(k) or LITERAL in piece:
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE, " ").encode())
            hashed = np.zeros(1, np.uint64)
            for c in piece:
                hashed = _extend(hashed, np.array([ord(c)], np.uint64))
                beginnings.add(int(hashed[0]))
            # The factor by length is the same for all paths to a position; it keeps the sums in the range of floats.
            words.append((int(hashed[0]), k, math.exp(SHARPNESS * (4.0 * len(piece) - math.log(ZIPF - model.get_score(k)))), len(piece)))
    words.sort()
    hashes = np.array([w[0] for w in words], np.uint64)
    filled, begun = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
    for table, have in ((filled, hashes), (begun, np.array(sorted(beginnings), np.uint64))):
        table[(have & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return Vocabulary(tuple(texts), tuple(spell), max(w[3] for w in words), hashes, np.array([w[1] for w in words], np.int32), np.array([w[2] for w in words]), filled, begun)


@dataclass
class Lattices:
    """Compiled lattices, as arrays over nodes and their arcs. An arc has the node it comes from (-1: the segment's start)."""

    vocabulary: Vocabulary
    known: dict[str, int] = field(default_factory=dict)
    nodes: int = 0
    arcs: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, np.int32))
    upto: np.ndarray = field(default_factory=lambda: np.zeros(1 << 17))
    source: np.ndarray = field(default_factory=lambda: np.zeros(1 << 17, np.int32))
    piece: np.ndarray = field(default_factory=lambda: np.zeros(1 << 17, np.int32))

    def add(self, segments: list[str]) -> None:
        """Compile segments that are not known yet, all at once.

        Positions 0 to n of each segment are nodes; so are the places between the bytes of a spelled character.
        """
        vocabulary = self.vocabulary
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        start = np.cumsum(size) - size
        match = np.where(codes == ord(SPACE), ord(LITERAL), codes)
        head = start[match[start] == 32]
        match[head] = ord(SPACE)
        n, number = len(codes), np.repeat(np.arange(len(segments)), size)
        end, node = np.repeat(start + size, size), np.arange(n) + number  # the node before each character; the next is one more
        at, hashes = np.arange(n), np.zeros(n, np.uint64)
        from_, to, piece, weight = [], [], [], []
        spelled = np.ones(n, bool)
        for length in range(1, vocabulary.longest + 1):
            keep = at + length <= end[at]
            at, hashes = at[keep], _extend(hashes[keep], match[at[keep] + length - 1])
            alive = vocabulary.may_go_on(hashes)
            at, hashes = at[alive], hashes[alive]
            if not len(at):
                break
            found, k = vocabulary.look_up(hashes)
            if length == 1:
                spelled[at[found]] = False
            from_.append(node[at[found]])
            to.append(node[at[found]] + length)
            piece.append(vocabulary.ids[k])
            weight.append(vocabulary.weights[k])
        # Characters without a piece: a chain of byte pieces, each inner node with one arc.
        chain_from, chain_to, chain_piece, nodes = [], [], [], n + len(segments)
        last_from, last_to, last_piece = [], [], []
        for k in np.flatnonzero(spelled).tolist():
            here = int(node[k])
            spelling = chr(int(codes[k])).encode(errors="surrogateescape")
            for byte in spelling[:-1]:
                chain_from.append(here)
                chain_to.append(nodes)
                chain_piece.append(vocabulary.spell[byte])
                here, nodes = nodes, nodes + 1
            last_from.append(here)
            last_to.append(int(node[k]) + 1)
            last_piece.append(vocabulary.spell[spelling[-1]])
        # Longer pieces first: they are likelier, and backward sampling tries a node's arcs in this order.
        before = np.concatenate([node[spelled], *from_[::-1]])  # the position the arc's path comes from
        from_, to = np.concatenate([np.array(last_from, np.int64), *from_[::-1]]), np.concatenate([np.array(last_to, np.int64), *to[::-1]])
        piece, weight = np.concatenate([np.array(last_piece, np.int32), *piece[::-1]]), np.concatenate([np.ones(len(last_from)), *weight[::-1]])
        order = np.argsort(to, kind="stable")
        before, from_, to, piece, weight = before[order], from_[order], to[order], piece[order], weight[order]
        # Forward filtering, position by position in all segments at once.
        depth = np.zeros(n + len(segments), np.int16 if size.max() < 1 << 15 else np.int64)
        depth[node + 1] = np.arange(n) - start[number] + 1
        by_depth = np.argsort(depth[to], kind="stable")
        source, target, mass = before[by_depth], to[by_depth], weight[by_depth]
        forward = np.zeros(n + len(segments))
        forward[start + np.arange(len(segments))] = 1.0
        steps = np.searchsorted(depth[target], np.arange(1, int(size.max()) + 2, dtype=np.int64))
        shares, done = np.empty(len(to)), 0
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(to) else np.zeros(0, np.int64)  # each node's arcs stand together
        groups = np.searchsorted(heads, steps).tolist()
        for at, (a, b) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True), 1):
            if a < b:
                own = heads[groups[at - 1] : groups[at]]
                forward[target[own]] = np.add.reduceat(forward[source[a:b]] * mass[a:b], own - a)
            if at % RESCALE == 0 or b == len(to):
                shares[done:b] = forward[source[done:b]] * mass[done:b] / forward[target[done:b]]
                done = b
            if at % RESCALE == 0:  # all that later arcs come from, by one factor in each segment
                on = np.flatnonzero(size > at)
                near = (start[on] + on)[:, None] + np.arange(max(0, at - vocabulary.longest), at + 1)
                forward[near] /= forward[near].max(axis=1, keepdims=True)
        chance = np.empty(len(to))
        chance[by_depth] = shares
        first_node = np.zeros(nodes, bool)
        first_node[start + np.arange(len(segments))] = True
        # The nodes inside spelled characters come after all others, in order.
        from_ = np.concatenate([from_, np.array(chain_from, np.int64)])
        to, piece = np.concatenate([to, np.array(chain_to, np.int64)]), np.concatenate([piece, np.array(chain_piece, np.int32)])
        chance = np.concatenate([chance, np.ones(len(chain_from))])
        opens = np.append(True, to[1:] != to[:-1])
        closes = np.append(opens[1:], True)
        total = np.cumsum(chance)
        upto = total - np.repeat((total - chance)[opens], np.diff(np.append(np.flatnonzero(opens), len(to))))
        upto[closes] = 2.0  # rounding never leads past a node's last arc
        first = np.zeros(nodes, np.int64)
        first[to[opens]] = np.flatnonzero(opens) + self.arcs
        self.first = _put(self.first, self.nodes, first)
        self.upto, self.piece = _put(self.upto, self.arcs, upto), _put(self.piece, self.arcs, piece)
        self.source = _put(self.source, self.arcs, np.where(first_node[from_], -1, from_ + self.nodes))
        self.known.update(zip(segments, (start + size + np.arange(len(segments)) + self.nodes).tolist(), strict=True))
        self.nodes, self.arcs = self.nodes + nodes, self.arcs + len(to)

    def clear(self) -> None:
        self.known.clear()
        self.nodes = self.arcs = 0


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    if at + len(values) > len(array):
        array = np.concatenate([array, np.zeros(max(len(array), at + len(values) - len(array)), array.dtype)])
    array[at : at + len(values)] = values
    return array


def sample(texts: list[str], seeds: np.ndarray, lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and the offsets of the texts in them."""
    if len(lattices.known) > KEPT or lattices.arcs > KEPT_ARCS:
        lattices.clear()
    by_text = [_SEGMENTS.findall(t) for t in texts]
    flat = [s for own in by_text for s in own]
    known = lattices.known
    new = [s for s in set(flat) if s not in known]
    if new:
        lattices.add(new)
    counts = np.array([len(own) for own in by_text], np.int64)
    starts = np.cumsum(counts) - counts
    state = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    place = np.arange(len(flat)) - np.repeat(starts, counts)
    key = tx.mix(np.repeat(seeds, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    active, drawn = np.arange(len(flat)), []
    steps = np.zeros(len(flat), np.int64)
    step = 0
    while len(active):
        u = (tx.mix(key[active] + np.uint64((step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        arc = lattices.first[state]
        behind = np.flatnonzero(u >= lattices.upto[arc])
        while len(behind):
            arc[behind] += 1
            behind = behind[u[behind] >= lattices.upto[arc[behind]]]
        drawn.append((active, lattices.piece[arc]))
        steps[active] = step + 1
        state = lattices.source[arc]
        more = state >= 0
        active, state = active[more], state[more]
        step += 1
    ends = np.cumsum(steps)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for step, (own, pieces) in enumerate(drawn):
        out[ends[own] - 1 - step] = pieces
    offsets = np.zeros(len(texts) + 1, np.int64)
    per = np.concatenate([[0], ends])
    offsets[1:] = per[starts + counts]
    return out, offsets


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.pool = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
        self.size = np.array([len(t) for t in vocabulary.texts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and the rows' offsets."""
        size = self.size[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        data = self.pool[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])]
        return data, ends[offsets]


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def encode(documents: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The documents without their text, with n_pieces, pieces (ids) and lossless (the pieces decode to the exact text)."""
    spark = documents.sparkSession
    configure(spark)
    rest = [c for c in documents.columns if c not in (text_col, "n_pieces", "pieces", "lossless")]
    schema = documents.select(*rest).schema.add("n_pieces", "long").add("pieces", T.ArrayType(T.IntegerType())).add("lossless", "boolean")
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    shared = spark.sparkContext.broadcast(vocabulary)  # the vocabulary's size is fixed
    text, row_key = free_names(documents, "text_", "key_")

    def run(batches):
        lattices, decode = _worker(shared.value)
        for batch in batches:
            for part, data, at in tx.chunks(batch, text):
                texts = [t.decode(errors="surrogateescape") for t in tx.text_list(data, at)]
                ids, offsets = sample(texts, tx.column(part, row_key).to_numpy().view(np.uint64), lattices)
                back, ends = decode(ids, offsets)
                same = np.array_equal(ends, at) and tx.per_row(back != data, at) == 0
                yield pa.RecordBatch.from_arrays([*(tx.column(part, c) for c in rest), pa.array(np.diff(offsets)), _lists(ids, offsets), pa.array(np.broadcast_to(same, len(part)).astype(bool))], schema.names)

    return documents.select(*rest, F.col(text_col).alias(text), key.alias(row_key)).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text") -> DataFrame:
    """The rows with their text again."""
    configure(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = tx.column(batch, "pieces")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            data, ends = decoder(lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in tx.text_list(data, ends)], pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)


_workers: dict[int, tuple[Lattices, Decoder]] = {}


def _worker(vocabulary: Vocabulary) -> tuple[Lattices, Decoder]:
    """A worker process keeps its lattices from task to task."""
    key = xxhash.xxh3_64_intdigest(b"\0".join(vocabulary.texts))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Lattices(vocabulary), Decoder(vocabulary)
    return _workers[key]


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(documents, load())
