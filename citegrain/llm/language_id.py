"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with texts of
that language. A text is reduced to its lower-cased words (letters alone tell a
language; marks and digits compress alike under any dictionary), compressed
under every dictionary, window by window over its whole length, and the
language with the smallest total wins. If the runner-up is nearly as small, the
decision is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .worker import take_over

UNDETERMINED = "und"
#: Bytes compressed at a time. The text in front of a byte helps to compress
#: it whatever its language; short windows leave more to the dictionaries.
WINDOW_BYTES = 4096
#: Matches of four bytes count, as the parts of words that tell a language are short.
MIN_MATCH, SEARCH_LOG, WINDOW_LOG = 4, 3, 18
_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def words_of(text: str) -> bytes:
    return _REST.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageConfig:
    """Bounds of what is learned, and when a decision is rejected.

    sample_rows: labelled rows at most, for each language, that fill its
    dictionary, those with the smallest hash of doc_id; the rest of the table
    is only counted. dictionary_bytes: of each dictionary, to which a text
    gives a tenth at most, from its middle. languages: learned and compared at
    a time; every one that is named is learned, in groups of so many, so that
    neither the driver nor a worker holds more than a group's rows or
    compressors. min_margin: bytes by which the winner must be smaller;
    min_share: the same as a share of the winner.
    """

    sample_rows: int = 96
    dictionary_bytes: int = 24 << 10
    languages: int = 64
    min_margin: int = 1
    min_share: float = 0.001


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learn_dictionaries(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling frequency, from rows with non-null lang, text and doc_id that aren't held out; none if there is no such row."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("doc_id") >= F.lit(-(2**63)))).where(~held_out(F.col("doc_id")))
    counts = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    found = []
    for at in range(0, len(counts), config.languages):
        found += _learn_group(train, counts[at : at + config.languages], config)
    return found


def _learn_group(train: DataFrame, counts: list, config: LanguageConfig) -> list[tuple[str, bytes]]:
    scale = 1 << 40
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(scale))
    share = {r.lang: min(scale, math.ceil(scale * 1.5 * (config.sample_rows + 10) / r["count"])) for r in counts}
    below = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(x)) for lang, x in share.items()], F.lit(0))
    most = config.dictionary_bytes // 10
    # A text gives its middle alone, so only that leaves the executors: a row is bounded, and with it what is collected.
    middle = F.expr(f"substring(text, int(greatest(1, (length(text) - {2 * most}) / 2 + 1)), {2 * most})")
    rows = train.where(place < below).select("lang", place.alias("place"), middle.alias("text")).collect()
    found = []
    for lang in share:
        texts = [words_of(r.text) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.place, r.text))[: config.sample_rows]]
        parts, room = [], config.dictionary_bytes
        for t in texts:
            start = max(0, (len(t) - most) // 2)
            part = t[start : start + min(most, room)]
            parts.append(part)
            room -= len(part)
            if room <= 0:
                break
        found.append((lang, b"".join(reversed(parts))))
    return found


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], at_once: int = LanguageConfig.languages):
        self.dictionaries, self.at_once = dictionaries, at_once
        self.languages = [lang for lang, _ in dictionaries]
        self.starts = range(0, len(dictionaries), at_once)
        self.held, self.compressors = None, []

    def hold(self, start: int) -> None:
        """Makes the compressors of a group; the group before is let go."""
        import zstandard as z

        if self.held == start:
            return
        self.held, self.compressors = start, []
        how = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY, min_match=MIN_MATCH, search_log=SEARCH_LOG, window_log=WINDOW_LOG, hash_log=WINDOW_LOG - 1, chain_log=WINDOW_LOG - 1, write_content_size=0, write_checksum=0, write_dict_id=0)
        for _, content in self.dictionaries[start : start + self.at_once]:
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compressors.append(z.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def sizes(self, text: str) -> list[int]:
        """Of a text under the compressors of the group that is held."""
        raw = words_of(text)
        windows = [raw[at : at + WINDOW_BYTES] for at in range(0, len(raw), WINDOW_BYTES)]
        return [sum(len(compress(w)) for w in windows) for compress in self.compressors]

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """Language, score, size under its dictionary, margin to the runner-up in bytes of each text."""
        told = [i for i, t in enumerate(texts) if t is not None and self.languages and _LETTER.search(t)]
        sizes: dict[int, list[int]] = {i: [] for i in told}
        for start in self.starts:
            self.hold(start)
            for i in told:
                sizes[i] += self.sizes(texts[i])
        return [self.decide(sizes[i]) if i in sizes else (UNDETERMINED, 0.0, 0, 0) for i in range(len(texts))]

    def decide(self, sizes: list[int]) -> tuple[str, float, int, int]:
        best = min(range(len(sizes)), key=sizes.__getitem__)  # ties: the more frequent language
        others = sizes[:best] + sizes[best + 1 :]
        margin = min(others) - sizes[best] if others else sizes[best]
        score = 1 / (1 + sum(math.exp(-min(50.0, 0.5 * (s - sizes[best]))) for s in others))
        return self.languages[best], score, sizes[best], margin


def predict_languages(docs: DataFrame, dictionaries: list[tuple[str, bytes]], config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Adds lang_pred, score and accepted to the rows, whatever their columns.

    Null text, no letter, or nothing learned: `und`, score 0, not accepted.
    Clashing columns lang_pred, score, accepted are replaced. Rows keep their
    number and order, repeated ones and those without doc_id too; there is no
    shuffle. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs.drop("lang_pred", "score", "accepted")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        c = Classifier(dictionaries, config.languages)
        for batch in batches:
            found = c.classify(batch.column(at).to_pylist())
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] != UNDETERMINED and f[3] >= max(config.min_margin, config.min_share * f[2]) for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    schema = T.StructType(list(kept.schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("accepted", "boolean")):
        schema = schema.add(name, kind)
    return kept.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; lang, source and doc_id don't reach the classifier.

    Null doc_id: told, not held out. Rows repeated with one doc_id: each told.
    Empty table: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn_dictionaries(docs)
    found = predict_languages(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; the columns stay as they are.

    If no row names a language there is nothing to tell languages by, and so
    nothing to reject: all rows stay. Empty table: no rows.
    """
    learned = learn_dictionaries(docs)
    if not learned:
        return docs
    # Rows travel as one column, so that theirs may have any names.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict_languages(held, learned).where("accepted").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
