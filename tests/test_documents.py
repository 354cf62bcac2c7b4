"""Chunks, page geometry, entries, framing and conversations."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrain.functions import text as T
from citegrain.operators import chunking as K
from citegrain.operators import conversation, corpus, entries, framing, geometry, layout
from citegrain.sources import index_store, simple_yaml, snapshots, stores
from citegrain.streaming import conversation as streaming
from citegrain.streaming.views import ViewWatcher

# Chunks ---------------------------------------------------------------------

sentence = st.integers(1, 40).map(lambda n: " ".join(f"w{i}" for i in range(n)) + ".")
unit = st.builds(lambda xs, atomic, repeats: K.Unit(" ".join(xs), 1, 2, atomic, repeats), st.lists(sentence, min_size=0, max_size=14), st.booleans(), st.sampled_from([False, False, False, True]))


@settings(max_examples=150, deadline=None)
@given(st.lists(unit, max_size=14))
def test_packing_loses_nothing(units):
    """Without the carried words the passages are the region, in order; none is over the cap."""
    passages = list(K.pack(units))
    back = [w for p in passages for w in p.text.split()[p.carried :]]
    assert back == [w for u in units for w in u.text.split()]
    assert all(len(p.text.split()) <= K.WORD_CAP and p.own for p in passages)


def test_packing_repeats_headings_or_overlaps():
    head = K.Unit("A | B", atomic=True, repeats=True)
    rows = [K.Unit(" ".join(["cell"] * 100), atomic=True) for _ in range(5)]
    first, second = K.pack([head, *rows])
    assert second.text.startswith("A | B\n") and second.carried == 3 and not second.overlap
    prose = [K.Unit(" ".join(f"s{i}w{j}" for j in range(24)) + " end.") for i in range(20)]
    first, second = K.pack(prose)
    assert second.overlap and second.overlap.endswith("end.") and 25 <= second.carried <= 50
    assert [p.carried for p in K.pack([K.Unit("x. " * 400, atomic=True)])][1:] == [0] and all(u.split for p in K.pack([K.Unit("x. " * 400, atomic=True)]) for u in p.own)


def test_chunk_sources(spark):
    units = spark.createDataFrame([("s", 0, 0, "same text", 1, 1), ("s", 1, 0, "same  text", 2, 2), ("t", 0, 0, "same text", None, None)], "source_id string, region int, position int, text string, page_start int, page_end int")
    regions = spark.createDataFrame([("s", 0, "1", "T", ["P"], None), ("s", 1, None, "U", [], None), ("t", 0, None, "V", [], "f:1")], "source_id string, region int, section_number string, section_title string, section_path array<string>, entry_location string")
    sources = spark.createDataFrame([("s", "S", 2), ("t", "T", None)], "source_id string, display_name string, page_count int")
    got = {(r.source_id, r.region): r for r in K.chunk_sources(units, regions, sources).collect()}
    a, b = got["s", 0].passage_id, got["s", 1].passage_id
    assert b == f"{a}.2" and a.startswith("s#") and len(a) == 18
    assert got["s", 0].header == "S — §1 P › T" and got["t", 0].header == "T — V"
    assert K.check_pages(K.chunk_sources(units, regions, sources), sources).count() == 0
    assert K.check_pages(K.chunk_sources(units, regions, sources), sources.withColumn("page_count", F.lit(1))).count() == 1


# Geometry ------------------------------------------------------------------------


class Line:
    def __init__(self, text, x, y, font="F", size=9.0, block=0, w=None, h=8.0):
        self.text, self.x0, self.y0, self.x1, self.y1, self.font, self.size, self.block = text, x, y, x + (w or 5 * len(text)), y + h, font, size, block


line = Line


class Page:
    def __init__(self, lines, number=1):
        self.lines, self.number = lines, number


page = Page


def document(*pages):
    rows = [(i, x.text, (x.x0, x.y0, x.x1, x.y1), x.font, x.size, x.block, False, True, False) for i, p in enumerate(pages) for x in p.lines]
    return geometry.Document.of(rows, [(p.number, 600.0, False) for p in pages])


def parts(lines):
    d = document(page(lines))
    return d, geometry.segments(d, np.arange(len(d.text)), 600.0)


def test_table_with_panels_and_ragged_rows():
    rows = [("Trigger", "Note", "Trigger", "Note"), ("", "Number", "", "Number"), ("Kick", "36", "Ride", "51"), ("Snare", "38", "Crash 1", "49"), ("Rim", "37", "Crash 2", "57"), ("Tom", "48", "", "")]
    _, (table,) = parts([line(t, 50 + 130 * c, 100 + 15 * r) for r, row in enumerate(rows) for c, t in enumerate(row) if t])
    assert table.heading == ["Trigger", "Note Number", "Trigger", "Note Number"] and table.starts == [0, 2]
    assert [t for t, _ in table.body] == ["Kick | 36 ‖ Ride | 51", "Snare | 38 ‖ Crash 1 | 49", "Rim | 37 ‖ Crash 2 | 57", "Tom | 48"]


def test_tables_among_prose():
    """Two short cells join a table that has three rows of three; a long cell or a single line ends it."""
    cells = lambda y, *ts: [line(t, 50 + 130 * c, y) for c, t in enumerate(ts)]
    lines = [*cells(100, "Before it, in words that go on"), *cells(115, "a", "b"), *cells(130, "a", "b", "1"), *cells(145, "c", "d", "2"), *cells(160, "e", "f", "3"), *cells(175, "g", "h"), *cells(190, "one line"), *cells(205, "x", "y", "4"), *cells(220, "x", "y", "5"), *cells(235, "x", "one two three four five six seven", "6")]
    d, (before, table, after) = parts(lines)
    assert table.heading == ["a", "b", ""] and [t for t, _ in table.body] == ["a | b | 1", "c | d | 2", "e | f | 3", "g | h"]
    assert [d.text[i] for r in before for i in r] == ["Before it, in words that go on"] and sum(map(len, after)) == 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 50), max_size=30), st.floats(0, 9))
def test_clusters(values, tolerance):
    """A new cluster begins with the first value further than the tolerance from the first of the one before."""
    values, want, first = sorted(values), [], None
    for v in values:
        if first is None or v > first + tolerance:
            first = v
            want.append(want[-1] + 1 if want else 0)
        else:
            want.append(want[-1])
    assert geometry.clusters(np.array(values), tolerance).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 700), st.sampled_from(["1. a", "2. b", "3", "word", "two words", "x " * 9])), max_size=30))
def test_every_line_is_in_one_unit(marks):
    d = document(page([line(t, float(x), float(y), block=y // 100) for x, y, t in marks]))
    units = geometry.page_units(d, 0, np.arange(len(d.text)))
    loose = lambda text: sorted(text.replace("|", " ").replace("‖", " ").split())
    assert loose("\n".join(u.text for u in units)) == loose("\n".join(d.text))


def test_columns_of_prose():
    lines = [line(f"left{i} aa bb cc dd ee ff", 50, 100 + 12 * i) for i in range(12)] + [line(f"right{i} aa bb cc dd ee ff gg", 330, 100 + 12 * i) for i in range(12)]
    d, (prose,) = parts(lines)
    assert [d.text[r[0]].split()[0] for r in prose] == [f"left{i}" for i in range(12)] + [f"right{i}" for i in range(12)]


def test_procedure_over_a_page_break():
    d = document(page([line("1. do this", 50, 700), line("2. then that", 50, 715)], 1), page([line("3. and last", 50, 100), line("Prose after it.", 30, 130, block=1)], 2))
    units = geometry.joined(geometry.page_units(d, 0, np.array([0, 1])) + geometry.page_units(d, 1, np.array([2, 3])))
    assert [(u.text, u.atomic, u.page_end) for u in units] == [("1. do this\n2. then that\n3. and last", True, 2), ("Prose after it.", False, 2)]


def test_breaks():
    """Steps count on or begin anew; wrapped rows stay with their step unless they lie left of its text."""
    assert geometry.breaks([1, None, 2, 4, None, None], [50, 62, 50, 50, 20, 20], [60, 62, 60, 60, 20, 20], [0, 0, 0, 0, 1, 2]) == [0, 3, 4, 5]
    assert geometry.breaks([], [], [], []) == []


def test_outline_anchors_and_regions():
    body = lambda n: [line(f"plain text of page {n} line {i} going on", 50, 200 + 12 * i) for i in range(6)]
    d = document(page([line("Cover", 50, 50, size=30.0), *body(1)], 1), page([line("1.1 First thing", 50, 100, size=14.0), *body(2), line("1.2 Second thing", 50, 400, size=14.0), line("tail", 50, 420)], 2), page(body(3), 3))
    regions = geometry.assemble(d, [(1, "1 Part", 2), (2, "1.1 First thing", 2), (2, "1.2 Second thing", 2), (2, "1.3 Missing", 3)], geometry.Style(9.0, 37.0))
    assert [(r.number, r.title, r.path, r.anchor) for r in regions] == [
        (None, "Cover", (), "Front matter"), ("1", "Part", (), "page-only"), ("1.1", "First thing", ("Part",), "title"), ("1.2", "Second thing", ("Part",), "title"), ("1.3", "Missing", ("Part",), "page-only"),
    ]


def test_parents():
    got = geometry.with_parents([(1, None, "a", 1), (2, None, "b", 1), (3, None, "c", 1), (4, None, "d", 1), (2, None, "e", 1)])
    assert [e.path for e in got] == [(), ("a",), ("a", "b"), ("b", "c"), ("a",)]


def snapshot(pages, toc=(), count=None):
    block = lambda ls: {"bbox": [0.0, 0.0, 600.0, 800.0], "lines": [{"bbox": [x.x0, x.y0, x.x1, x.y1], "spans": [{"text": x.text, "bbox": [x.x0, x.y0, x.x1, x.y1], "font": x.font, "size": x.size, "flags": 0}]} for x in ls]}
    return {"schema": "citegrain.pdf.extraction/1", "page_count": count or len(pages), "toc": [list(map(str, t)) for t in toc], "pages": [{"number": p.number, "width": 600.0, "height": 800.0, "images": [[0.0, 0.0, 300.0, 200.0]] if p.number == 1 else [], "blocks": [block(p.lines)]} for p in pages]}


def test_snapshots_and_layout(spark, tmp_path):
    heads = [page([line("My Guide", 50, 20), line(str(n), 300, 780), line(f"Text number {n} with words in it and more of them", 50, 300), line(f"Head {n}", 50, 200, "B", 14.0)], n) for n in range(1, 7)]
    (tmp_path / "a.json").write_text(json.dumps(snapshot(heads)))
    (tmp_path / "b.json").write_text(json.dumps(snapshot([page([line("ðx", 10, 300, "QZPXMI+Wingdings3"), line("é?", 10, 330, "Symbol"), line("é", 10, 350, "Arial")])])))
    docs = snapshots.read_snapshots(spark, str(tmp_path / "*.json"))
    lines = layout.mark_furniture(layout.lines_of(docs))
    marked = {(r.page, r.text) for r in lines.where("furniture AND doc = 'a'").collect()}
    assert marked == {(n, t) for n in range(1, 7) for t in ("My Guide", str(n))}
    audit = {r.doc: r for r in layout.glyph_audit(lines).collect()}
    assert (audit["b"].spans_repaired, audit["b"].spans_degraded, audit["b"].unreadable) == (1, 1, True) and not audit["a"].unreadable
    assert {(r.doc, r.font, r["count"]) for r in layout.heading_style(lines).collect()} == {("a", "B", 6)}
    assert {(r.doc, r.low) for r in layout.low_text(lines).collect()} == {("a", True), ("b", True)}
    assert {(r.doc, r.page) for r in layout.has_figures(docs).where("has_figures").collect()} == {("a", 1), ("b", 1)}
    units = geometry.assemble_documents(docs, lines).collect()
    titles = [u.section_title for u in units]
    assert {"Head 1", "Head 6"} <= set(titles) and not any("My Guide" in u.text for u in units)
    snapshots.write_snapshots(docs, str(tmp_path / "out"))
    again = snapshots.read_snapshots(spark, str(tmp_path / "a.json"))
    assert again.select("page_count").first().page_count == 6
    (tmp_path / "c.json").write_text(json.dumps({**snapshot(heads), "schema": "other/9"}))
    with pytest.raises(Exception, match="not a snapshot"):
        snapshots.read_snapshots(spark, str(tmp_path / "c.json")).collect()


def test_language_inheritance(spark):
    rows = [("d", 1, 0, 3, None, None), ("d", 1, 1, 20, "en", 0.9), ("d", 1, 2, 3, None, None), ("d", 2, 0, 20, "fr", 0.9), ("d", 2, 1, 20, "en", 0.3), ("d", 3, 0, 2, None, None), ("e", 1, 0, 2, None, None)]
    df = spark.createDataFrame(rows, "doc string, page int, block int, words int, lang string, confidence double")
    got = {(r.doc, r.page, r.block): r.english for r in layout.select_english(df).collect()}
    assert got == {("d", 1, 0): True, ("d", 1, 1): True, ("d", 1, 2): True, ("d", 2, 0): False, ("d", 2, 1): False, ("d", 3, 0): False, ("e", 1, 0): True}
    pages = {(r.doc, r.page): (r.included, r.partial) for r in layout.language_audit(layout.select_english(df)).collect()}
    assert pages == {("d", 1): (True, False), ("d", 2): (False, False), ("d", 3): (False, False), ("e", 1): (True, False)}


# Entries --------------------------------------------------------------------------

ENTRY = b"""---\ndevices: [a/live@12, a/key]\nextra: 1\n---\n# No sound\nalso: silent; nothing\nWork down.\n## The Switch is off\n**Check:** the lamp\nis dark\nwhy: it happens\nfix: a/live \xc2\xa71.2 "The Switch"\n## Gone\ncheck: it is gone\nundocumented: b/c\n## Otherwise\nask\n"""


def test_entry():
    e = entries.read_entry(ENTRY)
    assert e["reason"] is None and e["symptom"] == "No sound" and e["line"] == 5 and e["phrasings"] == ["silent", "nothing"]
    assert e["devices"] == [{"id": "a/live", "revision": "12"}, {"id": "a/key", "revision": None}]
    assert e["causes"][0]["check"] == "the lamp is dark" and e["causes"][0]["notes"] == "why: it happens" and e["causes"][0]["fixes"] == [{"source_id": "a/live", "number": "1.2", "title": "The Switch", "line": 12}]
    assert e["causes"][1]["undocumented"] == "b/c" and e["closing"] == "Otherwise\nask"
    assert e["flags"] == ["unknown-frontmatter-key:extra", "closing-statement-inferred:"]
    assert entries.render(e) == "No sound\nalso: silent; nothing\nWork down.\n\nThe Switch is off\ncheck: the lamp is dark\nwhy: it happens\n\nGone\ncheck: it is gone\n\nOtherwise\nask"


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda b: b[4:], "frontmatter-missing"), (lambda b: b.replace(b"---\n#", b"#"), "frontmatter-malformed"), (lambda b: b.replace(b"devices: [a/live@12, a/key]", b"x: 1"), "no-devices"),
        (lambda b: b.replace(b"[a/live@12, a/key]", b"a/live"), "devices-not-a-list"), (lambda b: b.replace(b"# No sound", b"# No sound\n# Two"), "no-symptom"), (lambda b: b.replace(b"**Check:** the lamp", b"x"), "cause-missing-check"),
        (lambda b: b.replace(b"undocumented: b/c", b"undocumented: b/c\nfix: a/b \xc2\xa71"), "cause-fix-and-undocumented"), (lambda b: b.replace(b"undocumented: b/c\n", b"fix: nowhere\n"), "cause-missing-fix"),
        (lambda b: b + b"## More\ncheck: x\nfix: a \xc2\xa71\n" * 7, "too-many-causes"), (lambda b: b.split(b"## Gone")[0], "too-few-causes"),
    ],
)
def test_entry_rejections(change, reason):
    assert entries.read_entry(change(ENTRY))["reason"] == reason


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200) | st.lists(st.sampled_from(["---", "devices: [a/b]", "# s", "## c", "check: x", "fix: a §1", "text", "", "also: y", "- check: z"]), max_size=20).map(lambda xs: "\n".join(xs).encode()))
def test_entry_is_total(data):
    e = entries.read_entry(data)
    assert (e["reason"] is None) == ("causes" in e)


def test_entries_table(spark):
    files = spark.createDataFrame([("a.md", bytearray(ENTRY)), ("b.md", bytearray(b"nothing")), ("c.md", None)], "source_file string, content binary")
    parsed = entries.parse_entries(files)
    assert {r.source_file: r.reason for r in parsed.collect()} == {"a.md": None, "b.md": "frontmatter-missing", "c.md": "frontmatter-missing"}
    good = parsed.where("reason IS NULL")
    units = entries.entry_units(parsed, spark.createDataFrame([("a.md", 2)], "source_file string, rank int")).orderBy("position").collect()
    assert [(u.atomic, u.repeats, u.unbacked) for u in units] == [(False, True, False), (True, False, False), (True, False, True), (True, False, False)]
    devices = spark.createDataFrame([("a/live", "Live", "12 Standard"), ("b/c", "C", None)], "device_id string, display_name string, revision string")
    found = {(r.finding, r.device) for r in entries.scope_findings(good, devices, spark.createDataFrame([("a/live",)], "device_id string")).collect()}
    assert found == {("revision-mismatch", "a/live"), ("unknown-device", "a/key")}
    terms = entries.cause_terms(good, devices)
    assert {(r.rank, r.term) for r in terms.collect()} == {(1, "Switch")}
    miss = entries.term_misses(terms, spark.createDataFrame([("a.md", 1, "about other things")], "source_file string, rank int, text string"))
    assert [r.term for r in miss.collect()] == ["Switch"]
    assert [r.device_id for r in entries.uncovered_devices(devices, good).collect()] == ["b/c"]
    assert entries.orphaned_entries(good, devices).count() == 0 and entries.orphaned_entries(good, devices.where("device_id = 'b/c'")).count() == 1 and entries.orphaned_entries(good, devices.where("false")).count() == 0
    side = entries.sidecar(good, spark.createDataFrame([("a.md", "p1"), ("a.md", "p2")], "source_file string, passage_id string"))
    assert side.count() == 2 and side.select("entry_key").distinct().count() == 1


def test_close_sections(spark):
    passages = spark.createDataFrame([("s", "1", "The Live Mixer", 1, "p1"), ("s", None, "Monitoring", 2, "p2")], "source_id string, section_number string, section_title string, row_id int, passage_id string")
    pointers = spark.createDataFrame([(1, "s", None, "The Live Mixr"), (2, "s", "11", None), (3, "s", None, "Monit")], "pid int, source_id string, number string, title string")
    got = {r.pid: r for r in entries.resolve_pointers(pointers, entries.sections_of(passages)).collect()}
    assert got[1].reason == "no-such-section" and got[1].candidates == ["The Live Mixer"] and got[2].candidates == ["§1"] and got[3].passage_ids == ["p2"]


# Framing ------------------------------------------------------------------------


def test_framing():
    a = framing.read_answer("ranked-causes\nLook at [[p:x#1]].\n---\n?cause The lamp [[p:a]]\ncheck: is it dark\n?cause Other\n\n!conflict they differ\n- one [[p:b]]\n- two\n?narrow Which?\n* a\n* b\n@device Foo\n~uncovered that\n!suggest s\nprose\nmore\n")
    assert a.parsed and a.framing == "parsed" and a.direct_answer == "Look at [[p:x#1]]."
    assert a.causes == [{"rank": 1, "statement": "The lamp", "check": "is it dark", "cites": ["a"]}, {"rank": 2, "statement": "Other", "check": "", "cites": []}]
    assert [(b["type"], b["text"]) for b in a.blocks] == [("conflict", "they differ"), ("paragraph", "prose more")] and a.blocks[0]["markers"] == ["b"]
    assert (a.narrow_question, a.narrow_candidates, a.device, a.uncovered, a.suggestions) == ("Which?", ["a", "b"], "Foo", ["that"], ["s"])
    assert framing.read_answer("answered\nx\n---\n!conflict c\n- only one\n").framing == "unparsed"
    u = framing.read_answer("Hello. There\n@device x\n- b")
    assert not u.parsed and u.device is None and [b["type"] for b in u.blocks] == ["paragraph", "bullet"]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120) | st.text(max_size=120) | st.lists(st.sampled_from(["answered", "x", "---", "", "- r", "!conflict c", "?cause z", "check: q", "* s", "?narrow n", "!caveat v", "  w", "1. s", "## h"]), max_size=14).map("\n".join))
def test_framing_is_total(stream):
    a = framing.read_answer(stream)
    assert [b["pos"] for b in a.blocks] == list(range(len(a.blocks))) and (a.framing == "unparsed" or a.parsed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["answered", "x", "---", "", "- r", "!conflict c", "?cause z", "check: q", "* s", "?narrow n", "!caveat v", "  w", "1. s", "## h", "é[[p:a]]", "y\r"]), max_size=14).map("\n".join), st.lists(st.integers(1, 9), max_size=60))
def test_framing_in_pieces(stream, sizes):
    """However a stream is cut, bytes of one character apart as well, the answer and its blocks are the same."""
    data, at, blocks, reader = stream.encode(), 0, [], framing.Reader()
    for n in [*sizes, len(data)]:
        blocks += reader.feed(data[at : at + n])
        at += n
    blocks += reader.close()
    assert reader.answer == framing.read_answer(data) and blocks == reader.answer.blocks


def test_client_blocks():
    assert framing.client_blocks("## H\n1. a\n2.  b\n!odd c\nd\n\ne") == [("heading", "H"), ("step", "a"), ("step", " b"), ("paragraph", "c\nd"), ("paragraph", "e")]


# Conversations ---------------------------------------------------------------------

TURNS = [("a", i, f"q{i}", o, f"r{i}") for i, o in enumerate(["answered", "needs-narrowing", "timeout", "needs-narrowing", "ranked-causes", "answered", "answered", "answered", "cancelled", "answered", "answered"])] + [("b", 0, "x", "needs-narrowing", "y"), ("b", 1, "z", "answered", "w")]


def test_replay_equals_windows(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn long, question string, outcome string, answer string")
    left = {(r.conv_id, r.turn): (r.retrieval_query, r.narrowing_count, r.history) for r in streaming.replay(df).collect()}
    counted = {(r.conv_id, r.turn): (r.retrieval_query, r.narrowing_count) for r in conversation.narrowing_state(df).collect()}
    said = {(r.conv_id, r.turn): "\n".join(r.history) for r in conversation.history(df).collect()}
    assert left == {k: (*counted[k], said[k]) for k in counted}


def test_stream_equals_replay(spark, tmp_path):
    schema = "conv_id string, turn long, question string, outcome string, answer string"
    for i, part in enumerate((TURNS[:4], TURNS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = streaming.stream_conversations(source).writeStream.format("memory").queryName("convs").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("convs").collect()))
    want = sorted(map(tuple, streaming.replay(spark.createDataFrame(TURNS, schema)).collect()))
    assert got == want


# The index on storage ------------------------------------------------------------------


def test_index_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    passages = spark.createDataFrame([("s", "s#1", 0, "h", "on off"), ("s", "s#2", 1, "h", "mid-side"), ("t", "t#1", 0, "h", "on")], "source_id string, passage_id string, position int, header string, text string")
    meta = spark.createDataFrame([("s", "manuals", "vendor-manual", "f1", 1, "m", 4, True, 2), ("t", "manuals", "vendor-manual", "f2", 1, "m", 4, True, 1)], "source_id string, store string, kind string, fingerprint string, ingestion_version int, model string, dim int, normalised boolean, chunk_count int")
    assert index_store.read_manifest(spark, root) is None and index_store.collect_views(spark, root) == []
    index_store.write_shards(spark, root, passages, meta)
    first = index_store.commit_view(spark, root, built_at="t0")
    watcher = ViewWatcher(spark, root)
    assert watcher.check() and not watcher.check()
    assert [(r.row_id, r.passage_id) for r in watcher.view["passages"].orderBy("row_id").collect()] == [(0, "s#1"), (1, "s#2"), (2, "t#1")]
    assert first["sources"][1]["row_start"] == 2
    # One source is replaced, another removed.
    index_store.write_shards(spark, root, passages.where("source_id = 's'").limit(1), meta.where("source_id = 's'").withColumn("chunk_count", F.lit(1)))
    index_store.remove_sources(spark, root, ["t"])
    second = index_store.commit_view(spark, root, built_at="t0")
    assert second["view_dir"] != first["view_dir"] and watcher.check() and watcher.view["passages"].count() == 1
    assert index_store.collect_views(spark, root) == [first["view_dir"].split("/")[1]]
    again = index_store.commit_view(spark, root, built_at="t0")
    assert again["corpus_revision"] == second["corpus_revision"] and again["view_dir"] != second["view_dir"]
    index_store.write_text(spark, f"{root}/manifest.json", json.dumps({**again, "index_version": 9}))
    assert not watcher.check() and "index version" in watcher.fault and watcher.view["passages"].count() == 1
    assert index_store.read_audit(spark, root, "a/b") is None
    index_store.write_audit(spark, root, "a/b", {"x": 1})
    assert index_store.read_audit(spark, root, "a/b") == {"x": 1, "rejection": None}


def test_stores(spark, tmp_path):
    root = tmp_path / "m"
    assert stores.scan_manuals(spark, str(root)) == (False, None)
    root.mkdir()
    for n in ("a_b_guide_v1_en.pdf", "a_b_guide_v2_en.pdf", "c_d_guide_v1_en.pdf", "Bad.PDF", "README.md"):
        (root / n).write_bytes(n.encode())
    ok, found = stores.scan_manuals(spark, str(root))
    got = {r.name: (r.reason, r.fingerprint and r.fingerprint[:7]) for r in found.collect()}
    assert ok and got == {"a_b_guide_v1_en.pdf": ("source-id-collision", None), "a_b_guide_v2_en.pdf": ("source-id-collision", None), "c_d_guide_v1_en.pdf": (None, "sha256:"), "Bad.PDF": ("filename-invalid", None)}
    store = tmp_path / "t"
    (store / "sub" / ".h").mkdir(parents=True)
    (store / "sub" / "e.md").write_bytes(ENTRY)
    (store / "sub" / ".h" / "f.md").write_bytes(ENTRY)
    (store / "x.txt").write_text("x")
    ok, files, skipped = stores.scan_entries(spark, str(store))
    assert [r.source_file for r in files.collect()] == ["sub/e.md"] and [r.path for r in skipped.collect()] == ["x.txt"]
    assert stores.entries_fingerprint(files).count() == 1
    (tmp_path / "rig.yaml").write_text("devices:\n  - id: a/b\n    display_name: B\n    revision: 12\nsource_applicability:\n  a/b:\n    device: a/b\n    status: confirmed\n")
    if simple_yaml.yaml is not None:
        devices, declared = stores.load_inventory(spark, str(tmp_path / "rig.yaml"))
        assert devices.first().revision == "12" and declared.first().status == "confirmed"
    assert stores.load_inventory(spark, str(tmp_path / "none.yaml"))[0].count() == 0
    ledger, missing = stores.read_ledger(spark, str(tmp_path / "ledger"))
    assert missing and ledger.count() == 0
    rows = spark.createDataFrame([("k2", "t", ["p"], ["e"]), ("k1", "t", ["q"], [])], stores.LEDGER)
    stores.write_ledger(rows, str(tmp_path / "ledger"))
    back, missing = stores.read_ledger(spark, str(tmp_path / "ledger"))
    assert not missing and sorted(r.pointer for r in back.collect()) == ["k1", "k2"] and (tmp_path / "ledger").read_text().startswith('{"pointer": "k1"')
    (tmp_path / "broken").write_text("{}\n")
    with pytest.raises(stores.Malformed, match="line 1"):
        stores.read_ledger(spark, str(tmp_path / "broken"))


def test_plain_yaml_subset(monkeypatch):
    monkeypatch.setattr(simple_yaml, "yaml", None)
    assert simple_yaml.load("devices: [a/b@1, c/d]\nx: 'y'\nn: 3") == {"devices": ["a/b@1", "c/d"], "x": "y", "n": 3}
    assert simple_yaml.load("devices:\n  - a/b\n  - c") == {"devices": ["a/b", "c"]}
    with pytest.raises(simple_yaml.Unreadable):
        simple_yaml.load("][")


def test_reports(spark):
    assert entries.counts_line(1, 0, 2) == "1 entry ingested, 0 rejected, 2 flagged"
    assert corpus.view_name("r", "t") != corpus.view_name("r", "t", 1) and len(corpus.view_name("r", "t")) == 16
    assert spark.range(1).select(T.placeholder_filename(F.lit("a/b")).alias("x")).first().x == "a_b_<doctype>_v<version>_<lang>.pdf"
