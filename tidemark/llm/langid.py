"""Language identification by compression with per-language zstandard raw-content dictionaries.

A text (letters only, A-Z lower-cased) is encoded whole with each language's dictionary; the language whose dictionary
gives the fewest bytes wins. Where the two best differ by at most MARGIN bytes the text is encoded again with several
disjoint smaller dictionaries of each language and their sums decide; a margin that stays narrow marks the answer as
rejected.

Every language with a labelled text is learned. Dictionaries are filled from a bounded sample: at most SAMPLE_TEXTS distinct
texts of each language, chosen by a hash of the text, and of each a slice that starts at a place the hash chooses; slices share
SAMPLE_CHARS code points equally. All dictionaries together have at most MODEL_BYTES bytes: beyond 900 languages each gets less.
Predictions encode whole texts.

Defined results: a null text, or one without a letter, is `und` with score 0 and not rejected. Repeated rows get equal
results. Ties go to the language with more training rows, then to the smaller code. With no usable label every text is
`und` and rejected. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import configure

SAMPLE_TEXTS, SAMPLE_CHARS = 200, 400_000
DICTIONARY_BYTES, SMALL_BYTES, SMALL_COUNT = 32 << 10, 6 << 10, 6
MODEL_BYTES = 64 << 20
LEVEL, SMALL_LEVEL, MARGIN = 5, 9, 3
UNKNOWN = "und"
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    """By language, most frequent first: code, dictionary, small dictionaries."""

    languages: tuple[tuple[str, bytes, tuple[bytes, ...]], ...]


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(_LETTERS).split())


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.where("t <> ''").withColumn("h", F.xxhash64("t"))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.desc("n"), "l").collect()  # a row for each language
    if not counts:
        return Model(())
    # A threshold on the hash leaves about four times the wanted distinct texts of each language; copies fold before they are ranked.
    wanted = {r.l: (min(1.0, 4.0 * SAMPLE_TEXTS / max(1, r.d)), SAMPLE_CHARS // min(SAMPLE_TEXTS, max(1, r.d))) for r in counts}
    about = F.create_map(*[F.lit(x) for l, (share, chars) in wanted.items() for x in (l, F.struct(F.lit(share).alias("share"), F.lit(chars).alias("chars")))])[F.col("l")]
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(about["share"], F.lit(0.0)) * (1 << 30))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1).cast("long"), F.length("t") - about["chars"] + 1)).cast("int") + 1
    some = some.groupBy("l", "h").agg(F.min(F.substring("t", start, about["chars"])).alias("t"))
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("k") <= SAMPLE_TEXTS)
    texts: dict[str, list[str]] = {r.l: [] for r in counts}
    for r in ranked.orderBy("l", "k").collect():  # at most SAMPLE_TEXTS slices and about SAMPLE_CHARS code points of each language
        texts[r.l].append(r.t)
    room = min(1.0, MODEL_BYTES / ((DICTIONARY_BYTES + SMALL_COUNT * SMALL_BYTES) * len(counts)))
    large, little = int(DICTIONARY_BYTES * room), int(SMALL_BYTES * room)
    out = []
    for r in counts:
        per = max(200, (large + SMALL_COUNT * little) // max(1, len(texts[r.l])))
        whole = b" ".join(normal(t.encode())[: 4 * per] for t in texts[r.l])
        small = [whole[k : k + little] for k in range(0, SMALL_COUNT * little, little)]
        out.append((r.l, whole[:large], tuple(x for x in small if len(x) >= 64) or (whole[:large],)))
    return Model(tuple(out))


class Classifier:
    def __init__(self, model: Model) -> None:
        self.codes = [code for code, _, _ in model.languages]
        self.main = [_compressor(d, LEVEL) for _, d, _ in model.languages]
        self.small = [[_compressor(d, SMALL_LEVEL) for d in small] for _, _, small in model.languages]

    def __call__(self, text: bytes) -> tuple[str, float, bool, int]:
        """Language, score, rejected, margin in bytes."""
        known = normal(text)
        if not known or not (known.isascii() or any(map(str.isalpha, known.decode(errors="replace")))):
            return UNKNOWN, 0.0, False, 0
        if not self.codes:
            return UNKNOWN, 0.0, True, 0
        sizes = [len(c.compress(known)) for c in self.main]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = min((s for k, s in enumerate(sizes) if k != best), default=sizes[best] + 99) - sizes[best]
        narrow = False
        if margin <= MARGIN:
            close = [k for k, s in enumerate(sizes) if s <= sizes[best] + MARGIN]
            sums = {k: sum(len(c.compress(known)) for c in self.small[k]) / len(self.small[k]) + sizes[k] for k in close}
            best = min(close, key=sums.__getitem__)
            narrow = min((s for k, s in sums.items() if k != best), default=1e9) - sums[best] < 1
        share = 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes)
        return self.codes[best], min(1.0, share), narrow, margin


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=raw, level=level, write_content_size=False, write_checksum=False)


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, margin_bytes) for each document."""
    configure(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        classify = Classifier(model)
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                lang, score, rejected, margin = zip(*map(classify, tx.text_list(data, at)), strict=True)
                yield pa.RecordBatch.from_arrays([tx.column(part, "i"), pa.array(lang), pa.array(score), pa.array(rejected), pa.array(margin, pa.int64())], ["i", "lang_pred", "score", "rejected", "margin_bytes"])

    out = docs.mapInArrow(run, f"i {docs.schema['i'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, margin_bytes long")
    return out.withColumnRenamed("i", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = train(documents.where(fold != 2))
    return identify(documents, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "margin_bytes")
