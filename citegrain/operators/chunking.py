"""Regions of units packed into passages of at most 350 words, region by region.

A region is packed from front to back. Where it goes on in another passage,
that one begins with what the reader needs again: the headings that repeat, or
else about fifty words of the passage before, from the start of a sentence. A
unit longer than a passage is split at a sentence's end where one fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.words import canonical
from ..runtime import ship
from .corpus import assign_passage_ids

WORD_CAP, OVERLAP_WORDS = 350, 50
TOKEN_WINDOW, TOKEN_MARGIN = 512, 32
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Unit:
    text: str
    page_start: int | None = None
    page_end: int | None = None
    atomic: bool = False
    repeats: bool = False  # a heading that goes before every passage its rows are split over
    degraded: bool = False
    has_figures: bool = False
    unbacked: bool = False
    split: bool = False  # part of an atomic unit

    def cut(self, room: int) -> tuple["Unit", "Unit"]:
        """About the first ``room`` words, whole sentences if one fits, and the rest."""
        room = max(room, 1)
        at = 0
        for n in map(words, _SENTENCES.split(self.text)):
            if at + n > room:
                break
            at += n
        at, all_words = at or room, self.text.split()
        mark = self.split or self.atomic
        return replace(self, text=" ".join(all_words[:at]), split=mark), replace(self, text=" ".join(all_words[at:]), split=mark)

    def tail(self) -> str:
        """The last fifty words or so, from the start of a sentence; of one longer sentence its end."""
        kept, n = [], 0
        for s in reversed(_SENTENCES.split(self.text)):
            if kept and n + words(s) > OVERLAP_WORDS:
                break
            kept.append(s)
            n += words(s)
            if n >= OVERLAP_WORDS:
                break
        text = " ".join(reversed(kept))
        return " ".join(text.split()[-OVERLAP_WORDS:]) if n > OVERLAP_WORDS else text


@dataclass
class Passage:
    """own: units of this passage's own; lead: repeated headings; overlap: words of the passage before."""

    lead: list[Unit] = field(default_factory=list)
    overlap: str = ""
    own: list[Unit] = field(default_factory=list)

    @property
    def carried(self) -> int:
        return sum(words(u.text) for u in self.lead) + words(self.overlap)

    @property
    def size(self) -> int:
        return self.carried + sum(words(u.text) for u in self.own)

    @property
    def text(self) -> str:
        return "\n".join([*(u.text for u in self.lead), *([self.overlap] if self.overlap else []), *(u.text for u in self.own)])

    def row(self) -> dict:
        """Pages are those of its own units; flags those of all that it holds."""
        pages = [p for u in self.own for p in (u.page_start, u.page_end) if p]
        every = self.lead + self.own
        flags = {f: any(getattr(u, f) for u in every) for f in ("degraded", "has_figures", "unbacked")}
        return {"text": self.text, "page_start": min(pages, default=None), "page_end": max(pages, default=None), "carried": self.carried, "partial_unit": any(u.split for u in self.own), **flags}


def _next_passage(last: Unit, headings: list[Unit], coming: Unit) -> Passage:
    """How the region goes on: with its headings, unless a heading comes anyway or they'd leave no room; else with overlap."""
    if headings and not coming.repeats and sum(words(u.text) for u in headings) < WORD_CAP:
        return Passage(lead=list(headings))
    return Passage(overlap="" if last.atomic else last.tail())


def pack(units: list[Unit]) -> Iterator[Passage]:
    """Passages of one region, in order."""
    todo = [u for u in reversed(units) if u.text.split()]
    now, headings, in_headings = Passage(), [], False
    while todo:
        unit = todo.pop()
        if now.size + words(unit.text) > WORD_CAP:
            if not now.own:  # nothing but what was carried, and the unit still doesn't fit
                unit, rest = unit.cut(WORD_CAP - now.size)
                todo.append(rest)
            else:
                todo.append(unit)
                yield now
                now = _next_passage(now.own[-1], headings, unit)
                continue
            over = True
        else:
            over = False
        if unit.repeats:
            headings = [*headings, unit] if in_headings else [unit]
        in_headings = unit.repeats
        now.own.append(unit)
        if over:
            yield now
            now = _next_passage(unit, headings, todo[-1])
    if now.own:
        yield now


UNIT_FIELDS = ("text", "page_start", "page_end", "atomic", "repeats", "degraded", "has_figures", "unbacked")
PACKED = "source_id string, region int, part int, text string, page_start int, page_end int, carried int, partial_unit boolean, degraded boolean, has_figures boolean, unbacked boolean"


def pack_regions(units: DataFrame) -> DataFrame:
    """Packed passages of each (source_id, region); units have a position and the fields of Unit.

    Regions are dealt out by hash and lie sorted in their task, which goes
    through them one after the other: a group is one region's units, a section,
    never a source.
    """
    ship(units.sparkSession)
    present = [c for c in UNIT_FIELDS if c in units.columns]
    schema = to_arrow_schema(StructType.fromDDL(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passages(key: tuple, held: list[Unit]) -> list[dict]:
            return [{"source_id": key[0], "region": key[1], "part": i, **p.row()} for i, p in enumerate(pack(held))]

        now, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = row["source_id"], row["region"]
                if key != now:
                    out += passages(now, held) if now else []
                    now, held = key, []
                if row["text"] is not None:
                    held.append(Unit(**{k: row[k] for k in present if row[k] is not None}))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist(passages(now, held), schema=schema)

    dealt = units.repartition("source_id", "region").sortWithinPartitions("source_id", "region", "position")
    return dealt.select("source_id", F.col("region").cast("int").alias("region"), *present).mapInArrow(run, PACKED)


def chunk_sources(units: DataFrame, regions: DataFrame, sources: DataFrame) -> DataFrame:
    """Passages with ids and headers. regions(source_id, region, section_number, section_title, section_path, entry_location), sources(source_id, display_name)."""
    packed = pack_regions(units).withColumn("position", F.struct("region", "part"))
    named = assign_passage_ids(packed, canonical(F.col("text")))
    joined = named.join(regions, ["source_id", "region"]).join(sources.select("source_id", "display_name"), "source_id")
    header = T.citation_header(F.col("display_name"), F.col("section_number"), F.col("section_path"), F.col("section_title"), F.col("page_start").isNotNull())
    return joined.withColumn("header", header).drop("position")


def check_pages(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Passages whose pages lie outside their source's; pageless sources aren't checked. A caller fails on any row."""
    joined = passages.join(sources.where("page_count IS NOT NULL").select("source_id", "page_count"), "source_id")
    out = lambda c: F.coalesce((F.col(c) < 1) | (F.col(c) > F.col("page_count")), F.lit(False))
    return joined.where(out("page_start") | out("page_end"))


def token_budget(passages: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(passage_id, tokens, state): `over` fills the encoder's window, `near` comes within a margin of it."""
    state = F.when(F.col(tokens) >= TOKEN_WINDOW, "over").when(F.col(tokens) >= TOKEN_WINDOW - TOKEN_MARGIN, "near")
    return passages.withColumn("state", state).where("state IS NOT NULL").select("passage_id", tokens, "state")
