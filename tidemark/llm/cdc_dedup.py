"""Removal of repeated passages by content-defined chunking.

A gear rolling hash over the bytes cuts each text into variable chunks. A cut falls where a word starts, if the hash of
the WINDOW bytes before it has CUT_BITS zero bits, and at any code point with no space in the UNSPACED bytes before it, if
the hash has UNSPACED_BITS zero bits (text of scripts without spaces, long runs); but not where another such place lies
within MIN_CHUNK bytes before it. These cuts depend on nearby bytes alone, so an insertion shifts no later one. A stretch
without a cut for MAX_CHUNK bytes (a run of one character, say) is cut into pieces counted from its start.
Chunks are deduplicated by 96 bits of their digest, seeded by their length: the first occurrence, by id, text hash and
position, stays (of 1e12 different chunks, two share a digest in less than 1 of 100,000 corpora). Later occurrences are
removed where a run of neighbouring repeated chunks reaches MIN_RUN bytes; a shorter run is taken for chance and left alone.

Digest counts and first occurrences are pre-aggregated, and the digests that occur again are stored; rows of a digest that
many share get the first occurrence from a bounded broadcast list, so that no task gathers them.

Defined results: null and empty texts have no chunks and pass unchanged. Repeated rows (same id and text) count as one
document and are cut alike. Null ids sort first. An empty table gives an empty table. `remove_repeats` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import attach, configure, free_names, materialize

WINDOW, CUT_BITS, MIN_CHUNK, MAX_CHUNK = 16, 2, 16, 256
#: Bytes without a space after which cuts need no word start, and the zero bits they need: there are more places for them.
UNSPACED, UNSPACED_BITS = 32, 3
#: Bytes of neighbouring repeated chunks from which they are a passage.
MIN_RUN = 100
SEED = 42
#: Bits of a chunk's size beside its start; no chunk has as many as 2 ** PLACE bytes.
PLACE = 16
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of GEAR of the last 16 bytes, each shifted by its distance, modulo 2**16, by doubling."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        more = h.copy()
        more[width:] += h[:-width] << np.uint16(width)
        h = more
    return h


def _unspaced(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The starts of code points with UNSPACED bytes and more before them, and none of those a space."""
    edge = np.concatenate([[-1], np.flatnonzero(space), [len(data)]])
    long = np.flatnonzero(np.diff(edge) > UNSPACED + 1)
    first, size = edge[long] + 1 + UNSPACED, edge[long + 1] - edge[long] - 1 - UNSPACED
    places = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    return places[(data[places] & 0xC0) != 0x80]


def cut_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts and ends; the chunks of a row cover it."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = tx.SPACES[data]
    word = np.flatnonzero(~space[1:] & space[:-1]) + 1
    # The top bits depend on all WINDOW bytes; those of the row before are hidden by the minimum at a row's start.
    h, inner = gear(data), _unspaced(data, space)
    inner = inner[inner - at[tx.rows_of(inner, at)] >= UNSPACED]
    hot = word[(h[word - 1] >> np.uint16(16 - CUT_BITS)) == 0]
    hot = np.union1d(hot, inner[(h[inner - 1] >> np.uint16(16 - UNSPACED_BITS)) == 0])
    hot = hot[hot - at[tx.rows_of(hot, at)] >= MIN_CHUNK]
    if len(hot):
        hot = hot[np.append(True, np.diff(hot) >= MIN_CHUNK)]
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], hot]))
    end = np.append(begin[1:], n)
    pieces = (end - begin + MAX_CHUNK - 1) // MAX_CHUNK
    if (pieces > 1).any():
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = np.repeat(begin, pieces) + number * MAX_CHUNK
        for _ in range(3):  # not inside a code point
            cut = np.where((data[cut] & 0xC0) == 0x80, cut - 1, cut)
        begin = cut
        end = np.append(begin[1:], n)
    return begin, end


def _source(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))


def chunk_table(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, th, place, digest, check): a row for each chunk; th is the text's XXH64, place is start << PLACE | size in bytes."""
    configure(documents.sparkSession)
    docs = _source(documents, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                begin, end = cut_points(data, at)
                row = tx.rows_of(begin, at)
                whole, hashing = data.tobytes(), xxhash.xxh3_128_digest
                digest = np.frombuffer(b"".join([hashing(whole[a:b], b - a) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                th = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tx.text_list(data, at)], np.uint64).view(np.int64)
                ids = tx.column(part, "i").take(pa.array(row))
                place = (begin - at[row]) << PLACE | (end - begin)
                columns = [ids, pa.array(th[row]), pa.array(place), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(digest[:, 1].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["i", "th", "place", "digest", "check"])

    return docs.mapInArrow(run, f"i {docs.schema['i'].dataType.simpleString()}, th long, place long, digest long, check int")


def repeated_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, th, spans): for each document the sorted (start, size) in bytes of chunks that occur earlier in the corpus."""
    chunks = chunk_table(documents, id_col=id_col, text_col=text_col)
    own = F.struct("i", "th", "place")
    first = chunks.groupBy("digest", "check").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.count("*").alias("n"))
    again = materialize(first.where("not (first <=> last)").select("digest", "check", "first", "n"), "chunks")
    later = attach(chunks, again, ["digest", "check"], "n", "place").where("not (struct(i, th, place) <=> first)")
    span = F.struct(F.shiftright("place", PLACE).cast("int").alias("start"), F.col("place").bitwiseAND((1 << PLACE) - 1).cast("int").alias("size"))
    return later.groupBy("i", "th").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def passages(spans: list[tuple[int, int]], least: int = MIN_RUN) -> list[tuple[int, int]]:
    """Runs of neighbouring spans of at least `least` bytes, as (start, end)."""
    out: list[list[int]] = []
    for start, size in spans:
        if out and out[-1][1] == start:
            out[-1][1] = start + size
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out if b - a >= least]


def _joined(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    spans = repeated_spans(documents, id_col=id_col, text_col=text_col)
    name, i, th = free_names(documents, "spans", "i", "th")
    own = spans.select(F.col("i").alias(i), F.col("th").alias(th), F.col("spans").alias(name))
    return documents.join(own, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(th)), "left").drop(i, th), name


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later occurrences of repeated passages cut out; documents with no word left by this are dropped.

    A column n_chars, if there is one, is brought up to date.
    """
    configure(documents.sparkSession)
    both, name = _joined(documents, id_col, text_col)
    schema, k = documents.schema, documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            spans, texts = tx.column(batch, name).to_pylist(), tx.column(batch, text_col)
            out, keep = texts.to_pylist(), []
            for j, own in enumerate(spans):
                cut = passages([(s["start"], s["size"]) for s in own]) if own else []
                if cut:
                    out[j] = cut_out(out[j].encode(), cut).decode()
                keep.append(not cut or bool(out[j].strip(" \t\n\r\v\f")))
            yield pa.RecordBatch.from_arrays([pa.array(out, texts.type) if j == k else tx.column(batch, c) for j, c in enumerate(schema.names)], schema.names).filter(pa.array(keep, pa.bool_()))

    cleaned = both.mapInArrow(run, schema)
    if "n_chars" in documents.columns and isinstance(schema["n_chars"].dataType, T.LongType):
        cleaned = cleaned.withColumn("n_chars", F.length(text_col).cast("long"))
    return cleaned


def cut_out(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in cut:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: bytes, repeated passages as (start, end) in bytes, the bytes they hold, and the text that stays."""
    configure(documents.sparkSession)
    both, name = _joined(documents.select(id_col, text_col), id_col, text_col)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in tx.column(batch, text_col).to_pylist()]
            cuts = [passages([(s["start"], s["size"]) for s in own]) if own else [] for own in tx.column(batch, name).to_pylist()]
            kept = [cut_out(t, c).decode() for t, c in zip(texts, cuts, strict=True)]
            lists = pa.array([[{"start": a, "end": b} for a, b in c] for c in cuts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([tx.column(batch, id_col), pa.array(list(map(len, texts)), pa.int64()), lists, pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64()), pa.array(kept, pa.string())], ["i", "n_bytes", "repeats", "repeated_bytes", "kept_text"])

    return both.mapInArrow(run, f"i {kind}, n_bytes long, repeats array<struct<start:int,end:int>>, repeated_bytes long, kept_text string").withColumnRenamed("i", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
