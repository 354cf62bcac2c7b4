"""Answers as text: a line grammar read into blocks and fields.

Line 1 names the outcome, line 2 is the direct answer, line 3 a rule of three
hyphens; the body's blocks are told by how their first line begins. A stream
whose first line names no outcome is all body, and no field is taken from it.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .conversation import CONTENT_OUTCOMES

MARKER = re.compile(r"\[\[p:([^\]\s]+)\]\]")
SUGGESTIONS = 3
_GAPS = re.compile(r"\s{2,}")

#: How a line begins, in the order of the tests; the group after the opening is its text.
_BLOCKS = (
    ("heading", re.compile(r"## (.*)")),
    ("step", re.compile(r"(\d+)\.\s+(.*)")),
    ("bullet", re.compile(r"- (.*)")),
    ("caveat", re.compile(r"!caveat (.*)")),
    ("conflict", re.compile(r"!conflict (.*)")),
)
#: Fields that an answer with a valid first line carries among its lines.
_FIELDS = (
    ("uncovered", re.compile(r"~uncovered (.*)")),
    ("narrow", re.compile(r"\?narrow (.*)")),
    ("cause", re.compile(r"\?cause (.*)")),
    ("device", re.compile(r"@device (.*)")),
    ("suggest", re.compile(r"!suggest (.*)")),
)
_SPARK_BLOCK = "struct<pos:int,type:string,number:int,text:string,markers:array<string>,readings:array<string>>"
ANSWER = (
    f"line_one string, parsed boolean, framing string, direct_answer string, blocks array<{_SPARK_BLOCK}>, uncovered array<string>, "
    "narrow_question string, narrow_candidates array<string>, causes array<struct<rank:int,statement:string,check:string,cites:array<string>>>, "
    "device string, suggestions array<string>"
)


def markers_in(text: str) -> list[str]:
    return MARKER.findall(text)


def bare(text: str) -> str:
    return _GAPS.sub(" ", MARKER.sub("", text)).strip()


@dataclass
class Answer:
    line_one: str | None = None
    parsed: bool = False
    framing: str = "unparsed"
    direct_answer: str | None = None
    blocks: list[dict] = field(default_factory=list)
    uncovered: list[str] = field(default_factory=list)
    narrow_question: str | None = None
    narrow_candidates: list[str] = field(default_factory=list)
    causes: list[dict] = field(default_factory=list)
    device: str | None = None
    suggestions: list[str] = field(default_factory=list)


def _told(line: str, table) -> tuple[str, re.Match] | tuple[None, None]:
    for name, pattern in table:
        if m := pattern.fullmatch(line):
            return name, m
    return None, None


#: How the lines begin that continue what is open; a cause takes one, the others any number.
_CONTINUES = {"conflict": "- ", "narrow": "* ", "cause": "check: ", "caveat": "  "}


class Reader:
    """Reads an answer as it comes: ``feed`` takes text or bytes and gives the blocks that it closed, ``close`` the rest.

    Readings continue a conflict, indented lines a caveat, starred lines a
    narrowing question, a check line a cause. Paragraphs run on over plain
    lines. A blank line ends whatever is open. Any stream gives an answer;
    nothing raises, and bytes that aren't UTF-8 are replaced.
    """

    def __init__(self):
        self.answer = Answer()
        self._decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        self._rest, self._lines = "", 0
        self._kind, self._held = "", []
        self._whole, self._asked = True, False

    def feed(self, data: str | bytes) -> list[dict]:
        before = len(self.answer.blocks)
        *whole, self._rest = (self._rest + (self._decode(data) if isinstance(data, bytes) else data)).split("\n")
        for line in whole:
            self._line(line.rstrip("\r"))
        return self.answer.blocks[before:]

    def close(self) -> list[dict]:
        before = len(self.answer.blocks)
        self._rest += self._decode(b"", True)
        if self._rest:
            self._line(self._rest.rstrip("\r"))
            self._rest = ""
        self._end()
        if self._lines:
            self.answer.framing = "parsed" if self.answer.parsed and self._whole else "unparsed"
        return self.answer.blocks[before:]

    def _line(self, line: str) -> None:
        """The first three lines have places of their own, if the first names an outcome; the rest is body."""
        a, n = self.answer, self._lines
        self._lines += 1
        if n == 0:
            a.line_one = line.strip()
            a.parsed = a.line_one in CONTENT_OUTCOMES
        if a.parsed and n == 1:
            a.direct_answer = line.strip() or None
        elif not a.parsed or (n > 1 and not (n == 2 and line.strip() == "---")):
            self._body(line)

    def _body(self, line: str) -> None:
        if not line.strip():
            self._end()
            return
        goes_on = _CONTINUES.get(self._kind)
        if goes_on and line.startswith(goes_on):
            self._held.append(line)
            if self._kind == "cause":  # a cause has one check
                self._end()
            return
        name = _told(line, _BLOCKS + _FIELDS if self.answer.parsed else _BLOCKS)[0] or "paragraph"
        # A caveat, a cause or a question stays open over plain lines, which are a paragraph of their own.
        if name == self._kind == "paragraph":
            self._held.append(line)
            return
        self._end()
        self._kind, self._held = name, [line]

    def _block(self, kind: str, text: str, number: int | None = None, readings: list[str] | None = None) -> None:
        found = markers_in(text) + [m for r in readings or [] for m in markers_in(r)]
        self.answer.blocks.append({"pos": len(self.answer.blocks), "type": kind, "number": number, "text": text, "markers": found, "readings": readings or []})

    def _end(self) -> None:
        """What is open becomes a block or a field."""
        a, kind, held = self.answer, self._kind, self._held
        self._kind, self._held = "", []
        if not held:
            return
        if kind == "paragraph":
            self._block(kind, " ".join(x.strip() for x in held))
            return
        first, rest = held[0], held[1:]
        m = _told(first, _BLOCKS + _FIELDS)[1]
        value = m.groups()[-1]
        if kind == "step":
            self._block(kind, value.strip(), int(m[1]))
        elif kind == "caveat":
            self._block(kind, " ".join([value.strip(), *(x.strip() for x in rest)]))
        elif kind == "conflict":
            self._block(kind, value.strip(), readings=[x[2:] for x in rest])
            self._whole = self._whole and len(rest) == 2
        elif kind in ("heading", "bullet"):
            self._block(kind, value.strip())
        elif kind == "uncovered":
            a.uncovered.append(value.strip())
        elif kind == "narrow":
            if not self._asked:
                a.narrow_question, a.narrow_candidates, self._asked = value.strip(), [x[2:].strip() for x in rest], True
            else:  # a second question is dropped, and its starred lines are prose
                for x in rest:
                    self._block("paragraph", x.strip())
        elif kind == "cause":
            check = rest[0].removeprefix("check: ") if rest else ""
            a.causes.append({"rank": len(a.causes) + 1, "statement": bare(value), "check": bare(check), "cites": markers_in(value) + markers_in(check)})
        elif kind == "device":
            a.device = a.device or value.strip()
        elif kind == "suggest":
            if value.strip() not in a.suggestions:
                a.suggestions.append(value.strip())


def read_answer(stream: str | bytes | None) -> Answer:
    """A whole stream at once."""
    r = Reader()
    r.feed(stream or "")
    r.close()
    return r.answer


def parse_answers(transcripts: DataFrame, key: str = "turn_id", text: str = "stream") -> DataFrame:
    """(key, fields of Answer) of each transcript, in Arrow batches. A null stream is an empty one."""
    ship(transcripts.sparkSession)
    kind = dict(transcripts.dtypes)[key]
    schema = f"{key} {kind}, {ANSWER}"
    names = [f.name for f in transcripts.sparkSession.createDataFrame([], schema).schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(transcripts.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [read_answer(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([getattr(a, n) for a in answers], arrow.field(n).type) for n in names[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return transcripts.select(key, text).mapInArrow(run, schema)


def outcome_of(answer: DataFrame, covered: Column) -> Column:
    """A valid first line's outcome, else what coverage says."""
    return F.when(F.col("parsed"), F.col("line_one")).when(covered, "answered").otherwise("refused-not-covered")


def narrowing_of(question: Column, candidates: Column) -> Column:
    """Null without a question or candidates."""
    return F.when(question.isNotNull() & (F.size(candidates) > 0), F.struct(question.alias("question"), candidates.alias("candidates")))


def client_blocks(text: str) -> list[tuple[str, str]]:
    """(type, text) as the browser client reads a body: soft line ends stay, one space after a step's number, and an unknown `!word` loses its wrapper."""
    out: list[tuple[str, str]] = []
    open_paragraph = False
    for line in text.split("\n"):
        if not line.strip():
            open_paragraph = False
            continue
        m = re.fullmatch(r"(?:(?P<h>## )|(?P<s>\d+\. )|(?P<b>- )|(?P<c>!caveat )|(?P<x>!conflict )|(?P<u>![a-z-]+ ))(?P<t>.*)", line)
        kind = next((n for k, n in (("h", "heading"), ("s", "step"), ("b", "bullet"), ("c", "caveat"), ("x", "conflict")) if m and m[k]), None)
        if kind:
            out.append((kind, m["t"]))
            open_paragraph = False
            continue
        plain = m["t"] if m else line
        if open_paragraph:
            out[-1] = ("paragraph", f"{out[-1][1]}\n{plain}")
        else:
            out.append(("paragraph", plain))
            open_paragraph = True
    return out
