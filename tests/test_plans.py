"""A whole run over small stores, run again, and turns replayed over what it committed."""

import json

import pytest
from pyspark.sql import functions as F

from citegrain.functions.words import function_word_detector
from citegrain.operators import outcomes, vectors
from citegrain.plans import ingest, turns
from citegrain.sources import index_store, simple_yaml

ENTRY = """---
devices: [acme/synth]
---
# No sound
## The Output Switch is off
check: the lamp is dark
fix: acme/synth "Output Switch"
## The Filter is closed
check: the cutoff is low
fix: acme/synth "Filter Section"
"""


def snapshot(topic):
    def line(text, y, size=9.0, font="F"):
        box = [50.0, y, 50.0 + 5 * len(text), y + 8]
        return {"bbox": box, "spans": [{"text": text, "bbox": box, "font": font, "size": size, "flags": 0}]}

    pages = []
    for n, head in enumerate(("Output Switch", "Filter Section"), 1):
        body = [line(f"The {head} of the {topic} sets level {i} for the whole unit and more words here.", 100.0 + 12 * i) for i in range(5)]
        block = {"bbox": [0.0, 0.0, 600.0, 800.0], "lines": [line(head, 60.0, 14.0, "B"), *body]}
        pages.append({"number": n, "width": 600.0, "height": 800.0, "images": [], "blocks": [block]})
    return json.dumps({"schema": "citegrain.pdf.extraction/1", "page_count": 2, "toc": [["1", "Output Switch", "1"], ["1", "Filter Section", "2"]], "pages": pages})


@pytest.mark.skipif(simple_yaml.yaml is None, reason="nested YAML needs its library")
def test_run_and_replay(spark, tmp_path):
    manuals, store = tmp_path / "manuals", tmp_path / "triage"
    manuals.mkdir(), store.mkdir()
    (manuals / "acme_synth_guide_v1_en.pdf.json").write_text(snapshot("synth"))
    (manuals / "acme_mixer_guide_v1_en.pdf.json").write_text(snapshot("mixer"))
    (manuals / "wrong name.pdf.json").write_text(snapshot("x"))
    (store / "no-sound.md").write_text(ENTRY)
    (store / "bad.md").write_text("nothing")
    (tmp_path / "rig.yaml").write_text("devices:\n  - id: acme/synth\n    display_name: Synth\n  - id: acme/drum\n    display_name: Drum\nsource_applicability:\n  acme/synth:\n    device: acme/synth\n    status: confirmed\n")
    root = str(tmp_path / "index")

    def run(at):
        return ingest.ingest(spark, root, str(manuals), str(store), str(tmp_path / "rig.yaml"), vectors.hash_encoder(16), 16, built_at=at)

    one = run("t1")
    assert one.exit_code == 0 and one.ingested == ["acme/mixer", "acme/synth", "authored/triage"]
    assert one.rejected == {"wrong name.pdf": "filename-invalid"} and one.entries == "1 entry ingested, 1 rejected, 0 flagged"
    assert [d["device_id"] for d in one.gaps["owned_but_undocumented"]] == ["acme/drum"]
    assert ingest.validate(spark, root)[0] == 0
    code, lines = ingest.validate(spark, root, str(store), str(tmp_path / "rig.yaml"))
    assert code == 1 and lines[3] == "1 entry ingested, 1 rejected, 0 flagged" and "bad.md — frontmatter-missing" in lines[4]
    code, lines = ingest.run_coverage(spark, root, str(store), str(tmp_path / "rig.yaml"))
    assert code == 0 and "uncovered: 1" in lines and "  acme/drum" in lines and any("2 causes, resolved" in x for x in lines)
    assert index_store.read_audit(spark, root, "acme/synth")["page_count"] == 2 and index_store.read_audit(spark, root, "acme/synth")["rejection"] is None
    ledger = (store / ".pointer-ledger.jsonl").read_text()
    assert ledger.count("\n") == 2
    two = run("t2")
    assert two.reused == ["acme/mixer", "acme/synth"] and two.manifest["corpus_revision"] == one.manifest["corpus_revision"]
    assert (store / ".pointer-ledger.jsonl").read_text() == ledger
    (manuals / "acme_mixer_guide_v1_en.pdf.json").unlink()
    three = run("t3")
    assert three.removed == ["acme/mixer"] and three.manifest["corpus_revision"] != two.manifest["corpus_revision"]
    assert ingest.inventory_lines(spark, root).count() == 2

    view = index_store.load_view(spark, root, three.manifest)
    passage = view["passages"].where("source_id = 'acme/synth'").orderBy("position").first()
    q = spark.createDataFrame([(1, "output switch level", [float(x) for x in passage.vector], ["acme/synth", "authored/triage"], ["acme/synth"], None), (2, "nothing alike", [0.0] * 16, ["acme/synth"], ["acme/synth"], None)], "qid int, text string, vector array<double>, sources array<string>, scope array<string>, excluded string")
    gate = F.struct(F.lit(5).alias("passage_count"), F.array().cast("array<string>").alias("unknown_source_ids"), F.lit(1).alias("selected_count"), F.lit("local").alias("provider_kind"), *[F.lit(False).alias(c) for c in ("requires_key", "credential_stored", "requires_ack", "acknowledged")])
    flight = F.struct(F.lit(False).alias("cancelled"), F.lit(True).alias("streamed"), F.lit(None).cast("string").alias("failure"), F.lit(None).cast("double").alias("retry_after"), F.lit("p").alias("provider"), F.lit(None).cast("string").alias("detail"))
    gates = q.select("qid", gate.alias("gate"), flight.alias("flight"))
    stream = f"answered\nSet it [[p:{passage.passage_id}]].\n---\n1. Turn Output Switch on [[p:{passage.passage_id}]] [[p:made-up]]\n2. Set 5 dB\n"
    transcripts = spark.createDataFrame([(1, stream), (2, None)], "qid int, stream string")
    got = turns.replay(view, q, gates, transcripts)
    found = {r.qid: r for r in got["turns"].collect()}
    assert (found[1].outcome, found[1].view, found[2].outcome) == ("answered", "answer", "refused-not-covered")
    assert [(r.qid, r.number, r.passage_id) for r in got["citations"].collect()] == [(1, 1, passage.passage_id)]
    assert {r.qid: r.stripped for r in got["stripped"].collect()} == {1: 1} and [r.qid for r in got["ungrounded"].collect()] == [1]
    log = turns.events(got).where("qid = 1").orderBy("seq").collect()
    assert [r.name for r in log] == ["outcome", "direct_answer", "body_delta", "body_delta", "citation", "contributing_sources", "ungrounded", "framing", "done"]
    assert [r.seq for r in log] == list(range(len(log)))
    cite = json.loads(log[4].payload)
    assert cite["display_name"] == "Acme Synth" and cite["section_title"] and cite["page"] in (1, 2) and cite["kind"] == "vendor-manual"
    assert outcomes.VIEWS["answered"] == "answer"


def page(*blocks):
    """A page of blocks, each a list of (text, y, font)."""
    box = lambda t, y: [50.0, y, 50.0 + 5 * len(t), y + 8]
    line = lambda t, y, font: {"bbox": box(t, y), "spans": [{"text": t, "bbox": box(t, y), "font": font, "size": 9.0, "flags": 0}]}
    return [{"bbox": [0.0, 0.0, 600.0, 800.0], "lines": [line(*x) for x in b]} for b in blocks]


def document(*pages, toc=()):
    return json.dumps({"schema": "citegrain.pdf.extraction/1", "page_count": len(pages), "toc": [list(map(str, t)) for t in toc], "pages": [{"number": n, "width": 600.0, "height": 800.0, "images": [], "blocks": p} for n, p in enumerate(pages, 1)]})


ENGLISH = "The filter of the unit is set with this knob and it is not for the other part"
GERMAN = "Der Filter und die Taste sind nicht auf der Seite und das ist mit dem Knopf zu sehen"


@pytest.mark.skipif(simple_yaml.yaml is None, reason="nested YAML needs its library")
def test_run_in_detail(spark, tmp_path):
    """Repaired glyphs and chosen languages reach the passages; bad sources fail alone; another encoder embeds anew; terms are checked."""
    manuals, store = tmp_path / "manuals", tmp_path / "triage"
    manuals.mkdir(), store.mkdir()
    arrow = page([("Press ð to go on with the next of the steps that are here", 100.0, "QZPXMI+Wingdings3")], [(ENGLISH, 130.0, "F")])
    (manuals / "acme_arrow_guide_v1_en.pdf.json").write_text(document(arrow))
    (manuals / "acme_many_guide_v1_multi.pdf.json").write_text(document(page([(ENGLISH, 100.0, "F")], [(GERMAN, 200.0, "F")]), page([(GERMAN, 100.0, "F")])))
    (manuals / "acme_odd_guide_v1_en.pdf.json").write_text(document(page([("éééé ôôôô éééé", 100.0, "Symbol")])))
    (manuals / "acme_broken_guide_v1_en.pdf.json").write_text(json.dumps({"schema": "other/9"}))
    (store / "entry.md").write_text("---\ndevices: [acme/arrow]\n---\n# Stuck\n## The Chaos Knob is off\ncheck: look\nfix: acme/arrow \"Front matter\"\n## Gone\ncheck: look\nundocumented: acme/gone\n")
    (store / "notes.txt").write_text("not an entry")
    rig = tmp_path / "rig.yaml"
    rig.write_text("devices:\n  - id: acme/arrow\n    display_name: Arrow\n  - id: acme/gone\n    display_name: Gone\n")
    root = str(tmp_path / "index")
    calls = tmp_path / "calls"

    def encoder(name):
        inner = vectors.hash_encoder(8)

        def encode(texts):
            with open(calls, "a") as f:
                f.write(f"{name} {len(texts)}\n")
            return inner(texts)

        encode.name = name
        return encode

    run = lambda name: ingest.ingest(spark, root, str(manuals), str(store), str(rig), encoder(name), 8, built_at="t", detector=function_word_detector())
    one = run("first")
    assert one.ingested == ["acme/arrow", "acme/many", "authored/triage"] and one.skipped == ["notes.txt"]
    assert one.rejected == {"acme/odd": "unreadable-text"} and list(one.failures) == ["acme/broken"] and "not a snapshot" in one.failures["acme/broken"] and one.exit_code == 1
    texts = {s: " ".join(r.text for r in rs) for s in ("acme/arrow", "acme/many") for rs in [index_store.read_shards(spark, root).where(f"source_id = '{s}'").collect()]}
    assert "Press ▲ to go on" in texts["acme/arrow"] and "Der Filter" not in texts["acme/many"] and ENGLISH in texts["acme/many"]
    assert one.audits["acme/many"]["foreign_pages"] == [2] and one.audits["acme/many"]["partial_pages"] == [1] and one.audits["acme/arrow"]["spans_repaired"] == 1
    assert index_store.read_audit(spark, root, "acme/odd")["rejection"] == {"reason": "unreadable-text"}
    assert one.entries == "1 entry ingested, 0 rejected, 1 flagged"
    assert [x.strip() for x in one.entry_lines if "term-not" in x] == ["entry.md — term-not-in-passage — cause 1 — Chaos Knob"]
    code, lines = ingest.validate(spark, root, str(store), str(rig))
    assert code == 1 and any("term-not-in-passage" in x for x in lines)
    code, lines = ingest.run_coverage(spark, root, str(store), str(rig))
    assert code == 0 and "unbacked: 1" in lines and "drifted: none" in lines
    two = run("first")
    assert two.reused == ["acme/arrow", "acme/many"] and two.manifest["embedding"]["model"] == "first"
    assert {x.split()[0] for x in calls.read_text().splitlines()} == {"first"}
    three = run("second")
    assert three.reused == [] and three.manifest["embedding"]["model"] == "second"
    assert ingest.validate(spark, str(tmp_path / "none"))[0] == 1 and ingest.run_coverage(spark, str(tmp_path / "none"), str(store), str(rig))[0] == 1


def test_encoder_shape_and_reuse(spark):
    df = spark.createDataFrame([("a", "h", "x"), ("b", "h", "y")], "passage_id string, header string, text string")
    first = vectors.encode_missing(df, None, vectors.hash_encoder(8), 8)
    rows = {r.passage_id: r.vector for r in first.collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in rows.values())

    def refuses(texts):
        raise AssertionError("nothing is left to encode")

    again = vectors.encode_missing(df, spark.createDataFrame(list(rows.items()), "passage_id string, vector array<float>"), refuses, 8)
    assert {r.passage_id: r.vector for r in again.collect()} == rows
    with pytest.raises(Exception, match="the encoder gave"):
        vectors.encode_texts(df, "text", vectors.hash_encoder(4), 8).collect()
    assert {r.tokens for r in vectors.token_counts(df, "text", len).collect()} == {1}
