"""Text rules against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrain.functions import text as T
from citegrain.functions import words


def one(spark, build, *values, kind="string"):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {kind}" for i in range(len(values))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def tokens(text):
    out = []
    for m in re.finditer(r"[a-z0-9]+(?:[-/._]+[a-z0-9]+)*", text.casefold()):
        parts = re.split(r"[-/._]+", m.group())
        whole = re.sub(r"([-/._])[-/._]*", r"\1", m.group())
        out += [whole, *parts] if len(parts) > 1 else [whole]
    return out


def test_terms(spark):
    texts = ["Dry/Wet", "bge-small-en-v1.5", "mid--side a.-b", "Straße ON/off 12.1.", "", "...", "x_y-z/1.0 _a_ -b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(T.terms(F.col("t")).alias("x")).collect()] == [tokens(t) for t in texts]
    assert one(spark, T.terms, None) == []


@pytest.mark.parametrize(
    "name, good",
    [
        ("acme_synth-12_manual_v12.1_en.pdf", True), ("a_b_c_v1_multi.pdf", True), ("a_b_c_v1_en.PDF", False), ("a_b_c_1_en.pdf", False),
        ("a--b_c_d_v1_en.pdf", False), ("A_b_c_v1_en.pdf", False), ("a_b_c_v1._en.pdf", False), ("a_b_c_v1_eng.pdf", False), ("x/a_b_c_v1_en.pdf", False), ("a_b_c_v1_en.pdf\n", False),
    ],
)
def test_filename(spark, name, good):
    found = one(spark, T.filename_identity, name)
    assert (found is not None) == good
    if good:
        assert one(spark, lambda c: T.identity_filename(T.filename_identity(c)), name) == name


def test_display_name(spark):
    assert one(spark, lambda c: T.identity_display_name(T.filename_identity(c)), "acme_mixer-solo-4g_guide_v1_en.pdf") == "Acme Mixer Solo 4G"


@pytest.mark.parametrize(
    "text, want",
    [
        ('a/b §18.1 "The Mixer"', ("a/b", "18.1", "The Mixer")), ("a/b §18", ("a/b", "18", None)), ("a/b “Curly”", ("a/b", None, "Curly")), ("a/b", None), ('a/b "  "', None), ("", None), ("a b c", None),
    ],
)
def test_pointer(spark, text, want):
    found = one(spark, T.pointer, text)
    assert (tuple(found) if found else None) == want


def test_title_key(spark):
    assert one(spark, T.title_key, "18.1  The Live   Mixer. ") == "the live mixer"
    assert one(spark, T.symptom_key, " 0 dB is\tnever  reached ") == "0 db is never reached"
    assert one(spark, T.furniture_key, "Page 12 of 240") == "page # of #"
    assert one(spark, T.font_family, "QZPXMI+Wingdings 3") == "wingdings3"


@pytest.mark.parametrize(
    "term, text, found",
    [
        ("Track Activator", "the Track\nActivator is off", True), ("Off", "switched off", False), ("0 dB", "10 dB", False), ("0 dB", "at 0dB now", True), ("44.1 kHz", "44.1 KHZ", True),
        ("Saturator's", "the Saturator’s Drive", True), ("-12 dB", "x -12 dB y", True), ("I/O (A)", "the I/O (A) port", True),
    ],
)
def test_contains(spark, term, text, found):
    assert one(spark, T.contains_term, term, text) == found


def test_markers(spark):
    text = "See [[p:a#1]] and  [[p:b#2]], then [[p:a#1]]. [[p:bad id]]"
    assert one(spark, T.markers, text) == ["a#1", "b#2", "a#1"]
    got = one(spark, lambda c: T.keep_known_markers(c, F.array(F.lit("a#1"))), text)
    assert tuple(got) == ("See [[p:a#1]] and , then [[p:a#1]]. [[p:bad id]]", 1)


def test_header(spark):
    h = lambda paged, number: one(spark, lambda n: T.citation_header(F.lit("Live"), n, F.array(F.lit("A"), F.lit("B")), F.lit("C"), F.lit(paged)), number)
    assert h(True, "1.2") == "Live — §1.2 A › B › C" and h(True, None) == "Live — A › B › C" and h(False, None) == "Live — C"


def test_runs_and_numbers():
    assert [r for _, r in words.capital_runs("The Track Activator is off. Click MIDI  Map, then Off")] == ["The Track Activator", "Click MIDI  Map", "Off"]
    assert [r for _, r in words.capital_runs("The Track Activator is off", frozenset())] == ["Track Activator"]
    assert [n for _, n in words.numbers("at -12  dB, 44.1 kHz, v1.5 and 50%")] == ["-12 dB", "44.1 kHz", "50%"]
    assert words.looks_factual("press Save > Export") and words.looks_factual("set 3 dB") and not words.looks_factual("2.") and not words.looks_factual("just words")


def test_claim_terms():
    got = words.claim_terms("The Track Activator is off", "Device reads 0 dB", "x\nThe Track Activator is off\ncheck: Device reads 0 dB", ["acme/synth-12"], ["Live"])
    assert got == ["Track Activator", "0 dB"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_canonical_is_stable(text):
    once = words.canonical_text(text)
    assert words.canonical_text(once) == once and "  " not in once


def test_seams(spark):
    """State that is late, broken or not there leaves a turn without; a script answers what it knows."""
    from pyspark.sql import functions as F

    from citegrain.sources import seams

    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    rows = spark.createDataFrame([(1, "tempo", "120", 20.0), (2, "tempo", "90", 140.0), (9, "tempo", "1", 1.0)], "qid long, key string, value string, latency_ms double")
    rows = rows.withColumns({"observed_at": F.current_timestamp(), "now": F.current_timestamp(), "origin": F.lit("live"), "origin_kind": F.lit("session")})
    assert [(r.qid, r.value) for r in seams.acquired_state(seams.StateTable(rows), q).collect()] == [(1, "120")]
    assert seams.acquired_state(None, q).count() == 0 and seams.acquired_state(seams.StateTable(rows.drop("latency_ms")), q).count() == 0
    script = spark.createDataFrame([(2, "answered\nyes")], "qid long, stream string")
    assert {r.qid: r.stream for r in seams.ScriptedProvider(script).answer(q.withColumn("prompt", F.lit("?"))).collect()} == {1: None, 2: "answered\nyes", 3: None}


def test_delta_keeps_white_space(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  [[p:x]] b [[p:y]]\n", ["x"])], "t string, known array<string>")
    r = df.select(T.clean_delta(F.col("t"), F.col("known")).alias("d"), T.keep_known_markers(F.col("t"), F.col("known")).alias("k")).first()
    assert r.d == " a  [[p:x]] b \n" and r.k.text == "a [[p:x]] b" and r.k.stripped == 1
