"""Language ID, exact and near dedup, tokens, packing, mixing: against plain Python, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citegrain.llm import components as cc
from citegrain.llm import bounded, exact_dedup, language_id, mixing, near_dedup, packing, token_codes, tokens
from citegrain.runtime import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENCODERS: dict = {}
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1),
    (2, "The  quick brown\tfox jumps over the lazy dog again and again.", "en", "a", 1),
    (2, "The  quick brown\tfox jumps over the lazy dog again and again.", "en", "a", 1),
    (3, None, "en", "a", 1),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "b", 3),
    (6, "x", "de", "b", 1),
    (7, LONG, "en", "c", 1),
    (8, LONG + " tail", "en", "c", 1),
    (None, "no id here, and a text of its own", "fr", "c", 1),
    (9, "123 456 ... !!!", "fr", None, 1),
    (10, "it's. THE END., a.. b... c,. É. é, …. <|ENDOFTEXT|> <|endoftext|>. x<|endoftext|>y क़ İstanbul. don't \x1c \x85a　b é É. ×. x÷, »., (c). 5. ĳ. \U0001f600.", "fr", "d", 1),
]
CLASHING = ("digest", "rep", "score", "_id", "_digest", "shard", "epochs", "_block", "accepted", "keep_id", "row", "id", "_gone", "_row", "kept", "component")


def unharmed(df):
    """Clashing columns have kept their values."""
    return all(str(r[c]) == str(r["doc_id"]) for r in map(lambda r: r.asDict(), df.collect()) for c in CLASHING)


@pytest.fixture(scope="module")
def odd(spark):
    # Columns that clash with names used inside.
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def real(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Language ------------------------------------------------------------------


def test_language_accuracy(spark, sf):
    found = {r.doc_id: r for r in language_id.op1_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    assert all(found[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if found[d.doc_id].held_out]
    assert sum(found[d.doc_id].lang_pred == d.lang for d in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_odd(odd, empty):
    learned = language_id.learn_dictionaries(odd)
    assert [lang for lang, _ in learned][0] == "en"
    out = rows(language_id.predict_languages(odd, learned))
    assert len(out) == len(ODD)
    by = {(r["doc_id"], r["text"]): r for r in out}
    for r in out:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    assert by[(7, LONG)]["lang_pred"] == "en"
    assert language_id.learn_dictionaries(empty) == [] and rows(language_id.predict_languages(empty, learned)) == []
    assert {r["lang_pred"] for r in rows(language_id.predict_languages(odd, []))} == {"und"}


def test_language_learns_every_language(spark):
    """More languages than are handled at a time: the rarest is told as well."""
    word = lambda n, i: "".join(chr(0x4E00 + 40 * n + (7 * i + j) % 40) for j in range(4))
    data = [(100 * n + i, " ".join(word(n, i + m) for m in range(60)), f"l{n:02}", "s", 0) for n in range(70) for i in range(20 if n < 69 else 12)]
    df = spark.createDataFrame(data, SCHEMA)
    learned = language_id.learn_dictionaries(df)
    assert {lang for lang, _ in learned} == {f"l{n:02}" for n in range(70)} and learned[-1][0] == "l69"
    out = rows(language_id.predict_languages(df, learned))
    assert len(out) == len(data) and all(r["lang_pred"] == r["lang"] for r in out)
    few = language_id.LanguageConfig(languages=3)
    some = df.where("doc_id % 100 < 2")
    assert language_id.learn_dictionaries(df, few) == learned
    told = lambda c: sorted((r["doc_id"], r["lang_pred"], r["score"], r["accepted"]) for r in rows(language_id.predict_languages(some, learned, c)))
    assert told(few) == told(language_id.LanguageConfig())


def plain_sizes(text, contents):
    """Compressed size of a text under each dictionary, in plain Python: windows of 4096 bytes of its lower-cased words."""
    import zstandard as z

    raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")
    out = []
    for content in contents:
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        how = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY, min_match=4, search_log=3, window_log=18, hash_log=17, chain_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)
        out.append(sum(len(z.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096)))
    return out


def test_language_against_plain_python(spark, sf):
    """Every prediction of the query is that of the smallest size, over the whole text, and each dictionary is what its rows say."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language_id.learn_dictionaries(docs)
    place = {r.doc_id: r.p for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {1 << 40}) AS p").collect()}
    all_rows, most = docs.collect(), (24 << 10) // 10
    names = [lang for lang, _ in learned]
    assert set(names) == {r.lang for r in all_rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    for lang, content in learned:
        rows_of = sorted((place[r.doc_id], r.text) for r in all_rows if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)[:96]
        parts, room = [], 24 << 10
        for _, t in rows_of:
            t = t[max(0, (len(t) - 2 * most) // 2) :][: 2 * most]
            w = re.sub(r"[\W\d_]+", " ", t.lower()).encode()
            parts.append(w[max(0, (len(w) - most) // 2) :][: min(most, room)])
            room -= len(parts[-1])
            if room <= 0:
                break
        assert content == b"".join(reversed(parts))
    found = {r.doc_id: r for r in language_id.op1_language_id(spark, sf).collect()}
    for r in all_rows:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert found[r.doc_id].lang_pred == "und"
            continue
        sizes = plain_sizes(r.text, [c for _, c in learned])
        assert found[r.doc_id].lang_pred == names[sizes.index(min(sizes))]


def test_language_without_labels(spark, odd, empty, sf):
    nameless = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.learn_dictionaries(nameless) == []
    assert language_id.stage_language(spark, nameless, sf).count() == len(ODD)
    assert rows(language_id.stage_language(spark, empty, sf)) == []


def test_language_stage_keeps_columns(spark, odd, sf):
    out = language_id.stage_language(spark, odd, sf)
    assert out.columns == odd.columns and unharmed(out)


# Exact ----------------------------------------------------------------------


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(spark, odd, empty):
    ws = Workspace(spark, "t")
    out = rows(exact_dedup.dedup_batch(ws, odd, exact_dedup.DigestIndex(spark, ws.path("i"), 4)))
    groups = defaultdict(list)
    for d, t, *_ in ODD:
        groups[norm(t)].append(d)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, (r.values() for r in out)), key=key) == sorted(want, key=key)
    ws = Workspace(spark, "t")
    assert rows(exact_dedup.dedup_batch(ws, empty, exact_dedup.DigestIndex(spark, ws.path("i"), 4))) == []


def test_exact_dedup_index_persists(spark):
    ws = Workspace(spark, "t")
    index = exact_dedup.DigestIndex(spark, ws.path("i"), 4)
    first = spark.createDataFrame([(5, "a b", None, None, 1), (6, "c", None, None, 1)], SCHEMA)
    second = spark.createDataFrame([(1, "a  b", None, None, 1), (2, "d", None, None, 1)], SCHEMA)
    exact_dedup.dedup_batch(Workspace(spark, "t"), first, index, "one").collect()
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_batch(Workspace(spark, "t"), second, index, "two").collect()}
    assert out == {1: (5, False), 2: (2, True)}
    exact_dedup.dedup_batch(Workspace(spark, "t"), second, index, "two")  # again: nothing is added twice
    assert index.read().count() == 3
    again = exact_dedup.DigestIndex(spark, ws.path("i"))  # opened by its path alone
    assert again.manifest()["buckets"] == 4 and again.read().count() == 3


def test_exact_dedup_index_is_read_as_it_lies(spark):
    """No shuffle and no sort on the index's side of the anti-join."""
    ws = Workspace(spark, "t")
    index = exact_dedup.DigestIndex(spark, ws.path("i"), 4)
    ids = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("keep_id"))
    index.append(ids(0, 900), "one")
    index.append(ids(800, 1000), "two")
    assert len(index.runs()) == 2 and index.read().count() == 1000
    plan = index.unknown(ids(990, 1010))._jdf.queryExecution().executedPlan().toString()
    for scan in plan.split("FileScan")[1:]:
        assert "Bucketed: true" in scan
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert index.unknown(ids(990, 1010)).count() == 10


def test_exact_dedup_index_merges_runs(spark):
    """Many batches leave few runs, and each digest once, with the id of its first batch."""
    ws = Workspace(spark, "t")
    index = exact_dedup.DigestIndex(spark, ws.path("i"), 2)
    for b in range(6):
        index.append(spark.range(10 * b, 10 * b + 15).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), (F.col("id") + 1000 * b).alias("keep_id")), f"b{b}")
    assert len(index.manifest()["runs"]) <= 3 and len(index.manifest()["batches"]) == 6
    held = {r.digest: r.keep_id for r in index.read().collect()}
    assert len(held) == index.read().count() == 65
    assert held[hashlib.sha256(b"12").hexdigest()] == 12 and held[hashlib.sha256(b"16").hexdigest()] == 1016


@pytest.mark.parametrize("stage", [exact_dedup.stage_exact_dedup, near_dedup.stage_near_dedup])
def test_stages_with_more_to_drop_than_is_broadcast(spark, odd, sf, monkeypatch, stage):
    few = sorted(str(r.asDict()) for r in stage(spark, odd, sf).collect())
    monkeypatch.setattr(bounded, "BROADCAST_ROWS", 0)
    assert sorted(str(r.asDict()) for r in stage(spark, odd, sf).collect()) == few


def test_exact_stage(spark, odd, sf):
    out = exact_dedup.stage_exact_dedup(spark, odd, sf)
    assert out.columns == odd.columns and unharmed(out)
    texts = sorted(norm(r.text) for r in out.collect())
    assert texts == sorted({norm(t) for _, t, *_ in ODD})


# Near -------------------------------------------------------------------------


def components(texts):
    sets = {}
    for d, t in texts:
        w = (t or "").encode("utf-8", "replace").lower().split()
        sets.setdefault(d, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, sets


def check_near(spark, df, texts):
    want, sets = components([(d, t) for d, t in texts if d is not None])
    out = rows(near_dedup.near_duplicates(Workspace(spark, "t"), df))
    assert len(out) == len(texts)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_near_dedup_odd(spark, odd, empty):
    check_near(spark, odd, [(d, t) for d, t, *_ in ODD])
    assert rows(near_dedup.near_duplicates(Workspace(spark, "t"), empty)) == []


def test_near_dedup_real(spark, sf):
    docs = real(spark, sf)
    check_near(spark, spark.read.parquet(f"{sf}/documents.parquet"), list(docs.items()))


def test_near_dedup_chains_and_families(spark):
    """Copies of copies, a base that isn't the smallest id, and families just below the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts, n = [], 0
    for family in range(4):
        words = [f"f{family}{w}" for w in base]
        for _ in range(25):
            copy = list(words)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 6))):
                copy[k] = f"x{rng.integers(10**6)}"
            texts.append((1000 - n, " ".join(copy)))
            n += 1
        for _ in range(10):  # a chain: each differs a little from the one before
            words = list(words)
            words[int(rng.integers(len(words)))] = f"y{rng.integers(10**6)}"
            texts.append((1000 - n, " ".join(words)))
            n += 1
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in texts], SCHEMA)
    check_near(spark, df, texts)


def test_near_dedup_blocks(spark, monkeypatch):
    """The same over many blocks a cluster, by shingles and by rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 600)
    test_near_dedup_chains_and_families(spark)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1 << 18)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    test_near_dedup_chains_and_families(spark)


@pytest.mark.parametrize("few", [300_000, 0])
def test_connected_components(spark, monkeypatch, few):
    """In one task and in rounds: chains, stars, rings, self loops and repeated edges."""
    monkeypatch.setattr(cc, "FEW_EDGES", few)
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)] + [(400 + i, 400 + (i + 1) % 9) for i in range(9)]
    edges += [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 200, (120, 2))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in cc.connected_components(Workspace(spark, "t"), df, "c").collect()}
    want = {x: x for e in edges for x in e}
    while True:
        new = dict(want)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == want:
            break
        want = new
    assert got == want
    assert cc.connected_components(Workspace(spark, "t"), df.where("false"), "c").count() == 0


def test_near_dedup_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(cc, "FEW_EDGES", 0)
    test_near_dedup_chains_and_families(spark)


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = pool[:225], pool[75:]
        agree = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
        errors.append(agree - 150 / 300)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_near_stage(spark, odd, sf):
    out = near_dedup.stage_near_dedup(spark, odd, sf)
    assert unharmed(out)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} >= {1, 3, 4, 5, 6, 7, 9, 10, None}
    assert 8 not in {r.doc_id for r in out.collect()}


# Tokens -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer())


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_word_encoder(spark, sf, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    t, e = Tokenizer.from_file(path), tokens.WordEncoder(tokens.read_definition(path), cache_words=50)
    texts = [x for _, x, *_ in ODD] + list(real(spark, sf).values())
    for _ in range(2):  # again with a cache that was turned over
        for at in range(0, len(texts), 40):
            for text, ids in zip(texts[at : at + 40], e.encode(texts[at : at + 40])):
                assert ids.tobytes() == whole(t, text).tobytes()


MARKED = ["\u0130.", "\u0130\u015f.", "W\u030a", "T\u0308 x", "A\u030a.", "I\u0307,", "\u1e9e.", "\u00d7.", "\u00df. \u017f, \u0149.", "\u0958.", "\u212a.", "\uac00\u11a8.", "x\u0301. y"]


def same_ids(tokenizer, encoder, texts):
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tobytes() == whole(tokenizer, text).tobytes(), ascii(text)


def test_word_encoder_of_every_folded_letter(tokenizer):
    """All characters that may stand in a folded text, in front of, behind and between what is folded."""
    e = tokens.WordEncoder(tokens.read_definition(tokens.default_tokenizer()))
    same_ids(tokenizer, e, MARKED)
    for c in map(chr, range(0x00C0, 0x0180)):
        same_ids(tokenizer, e, [f"{c}.", f"A{c}, {c}B. {c}9.", f"{c}'S. {c}'ll, ({c})."])


@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("Aa .,'9\u0130\u0307\u030aWT\u00e9\u00dc<|")), max_size=12), max_size=8))
@settings(max_examples=400, deadline=None)
def test_word_encoder_over_unicode(texts):
    path = tokens.default_tokenizer()
    if path not in ENCODERS:
        ENCODERS[path] = Tokenizer.from_file(path), tokens.WordEncoder(tokens.read_definition(path))
    same_ids(*ENCODERS[path], texts)


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, "<u4"), np.array([0]), rng.integers(0, 256, 700), rng.integers(0, 60_000, 5000), rng.integers(0, 2**32, 3000, dtype=np.uint64)):
        ids = ids.astype("<u4")
        ends = np.array([len(ids) // 3, len(ids)])
        image = token_codes.pack(ids, [7, None], ends, 11)
        s = token_codes.Segment.of(image)
        assert s.length == len(image) and s.before == 11
        assert (s.ids() == ids).all() and s.doc_ids == [7, None] and s.ends.tolist() == ends.tolist()
        for i in rng.integers(0, max(1, len(ids)), 50 if len(ids) else 0):
            read = []
            one = token_codes.Segment(lambda at, n: read.append(n) or image[at : at + n])
            read.clear()
            assert one[int(i)] == ids[i]
            assert sum(read) <= 69 * 4  # a chunk, a block and a rank a level, however long the image
        with pytest.raises(IndexError):
            s[len(ids)]


def test_token_codes(spark, odd, empty, tokenizer):
    store = token_codes.TokenStore.write(odd, Workspace(spark, "t").path("s"), tokens.default_tokenizer(), 3, 1000)
    got, start, every = rows(store.documents()), 0, []
    for (d, t, *_), r in zip(sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), sorted(got, key=lambda r: (r["start"]))):
        ids = np.append(whole(tokenizer, t), np.uint32(1)).astype("<u4")
        assert r == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)
        every += ids.tolist()
    assert len(got) == len(ODD)
    # Any id by its position, from another handle on the same folder.
    again = token_codes.TokenStore(spark, store.path)
    assert again.directory().count() > 3 and sum(r.n_ids for r in again.directory().collect()) == len(every)
    asked = [0, len(every) - 1, 5, 5, *np.random.default_rng(0).integers(0, len(every), 20).tolist()]
    assert again.ids_at(asked) == [every[i] for i in asked]
    with pytest.raises(IndexError):
        again.ids_at([len(every)])
    nothing = token_codes.TokenStore.write(empty, Workspace(spark, "t").path("s"), tokens.default_tokenizer())
    assert rows(nothing.documents()) == [] and rows(nothing.directory()) == []


def test_token_codes_split_files(spark, sf, tokenizer, monkeypatch):
    """Many segments and files of a task: the same documents, in order of their ids."""
    monkeypatch.setattr(token_codes, "FILE_SEGMENTS", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store = token_codes.TokenStore.write(docs, Workspace(spark, "t").path("s"), tokens.default_tokenizer(), 2, 5000)
    got = sorted(rows(store.documents()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r.doc_id for r in docs.collect())
    assert store.directory().select("path").distinct().count() > 4
    for r, (d, t) in zip(got, sorted(real(spark, sf).items())):
        ids = np.append(whole(tokenizer, t), np.uint32(1)).astype("<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


# Packing --------------------------------------------------------------------------


def check_pieces(pieces, texts, tokenizer):
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append(np.append(whole(tokenizer, t), np.uint32(1)).astype("<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        assert sum(p["length"] for p in ps) == sum(map(len, ids[d]))
        for p in ps:
            assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in ids[d])
    lengths = []
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048
        lengths.append(at)
    return lengths


def test_packing_odd(spark, odd, empty, tokenizer):
    lengths = check_pieces(rows(packing.pack_documents(odd, partitions=2)), [(d, t) for d, t, *_ in ODD], tokenizer)
    assert lengths
    assert rows(packing.pack_documents(empty)) == []


def test_packing_real(spark, sf, tokenizer):
    docs = real(spark, sf)
    chunked = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), chunk_ids=20_000)
    check_pieces(rows(chunked), list(docs.items()), tokenizer)
    lengths = check_pieces(rows(packing.op10_packing(spark, sf)), list(docs.items()), tokenizer)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.02 * sum(lengths)


def test_plan_is_optimal():
    """Against all plans, on small inputs."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 9))]).tolist()
        penalty = [0, *rng.integers(0, 6, 9).tolist()]
        best = {0: 0}
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 12 - (pos[j] - pos[i]) + penalty[j] for i in range(j) if pos[j] - pos[i] <= 12)
        cuts = packing.plan_windows(pos, penalty, 12)
        cost, last = 0, 0
        for c in cuts:
            assert c - last <= 12
            cost += 12 - (c - last) + penalty[pos.index(c)]
            last = c
        assert last == pos[-1] and cost == best[len(pos) - 1]
        best_open = min(best[i] for i in range(len(pos)) if pos[-1] - pos[i] <= 12)
        cost, last = 0, 0
        for c in packing.plan_windows(pos, penalty, 12, open_end=True):
            cost += 12 - (c - last) + penalty[pos.index(c)]
            last = c
        assert pos[-1] - last <= 12 and cost == best_open


# Mixing -----------------------------------------------------------------------------


def test_bisection():
    c = mixing.MixConfig(target_entropy=0.9, repetition_limit=100.0)
    words = [1000, 10, 10, 10]
    a = mixing.bisect_exponent(words, c)
    assert 0 < a < 1 and mixing.entropy_share(words, a) == pytest.approx(0.9, abs=1e-6)
    tight = mixing.MixConfig(target_entropy=0.9, repetition_limit=1.5)
    b = mixing.bisect_exponent(words, tight)
    assert b > a and mixing.repetition(words, b, tight) == pytest.approx(1.5, rel=1e-6)


def test_mixing_meets_its_budgets(spark):
    data = [(i, "w " * (3 + i % 7), None, "big" if i % 10 else "small", 0) for i in range(2000)]
    df = spark.createDataFrame(data, SCHEMA)
    config = mixing.MixConfig(target_entropy=1.0, repetition_limit=3.5)
    out = rows(mixing.mix(Workspace(spark, "t"), df, config))
    p = mixing.plan_mix(Workspace(spark, "t"), df, config)
    for s in rows(p.sources):
        n = sum(r["n_words"] for r in out if r["source"] == s["_source"])
        assert s["_budget"] - 9 <= n <= s["_budget"]
    times = defaultdict(int)
    for r in out:
        times[r["doc_id"], r["source"]] += 1
    assert set(d for d, _ in times) == set(range(2000))
    assert {n for (_, s), n in times.items() if s == "big"} == {1}
    for source in ("big", "small"):  # a stream without gaps, epoch after epoch, block after block
        stream = sorted((r["ordinal"], r["epoch"], r["block"]) for r in out if r["source"] == source)
        assert [o for o, *_ in stream] == list(range(len(stream)))
        runs = [k for i, (_, *k) in enumerate(stream) if not i or stream[i - 1][1:] != tuple(k)]
        assert len(runs) == len(set(map(tuple, runs))) and [e for e, _ in runs] == sorted(e for e, _ in runs)
    assert {n for (_, s), n in times.items() if s == "small"} <= {3, 4}


def test_default_budget_never_falls_short():
    c, rng, short = mixing.MixConfig(), np.random.default_rng(1), 0
    for _ in range(2000):
        words = [int(x) for x in rng.integers(10**12, 10**13, 5)]
        p = mixing.weights_at(words, 0.3)
        b = mixing.budget_of(words, p, c)
        short += any(math.floor(b * x + 1e-6) < w for x, w in zip(p, words))
        assert all(mixing.words_to_emit(b, x, w, c) >= w for x, w in zip(p, words))
    assert short > 0


def test_mixing_of_many_sources(spark, odd, sf):
    """More sources than the driver takes: the same rows from a table of totals."""
    df = spark.createDataFrame([(i, "w " * (i % 9), None, f"s{i % 40 if i % 3 else 0}", 0) for i in range(900)], SCHEMA)
    many = mixing.MixConfig(max_sources=3)
    got = lambda d, c: sorted(map(str, rows(mixing.mix(Workspace(spark, "t"), d, c))))
    assert got(df, many) == got(df, mixing.MixConfig()) != []
    none = mixing.MixConfig(max_sources=0)
    assert got(odd, none) == got(odd, mixing.MixConfig())
    assert got(df.withColumn("text", F.lit("")), none) == got(df.withColumn("text", F.lit("")), mixing.MixConfig())


def test_mixing_odd(spark, odd, empty, sf):
    out = rows(mixing.mix(Workspace(spark, "t"), odd))
    assert {r["doc_id"] for r in out} == {d for d, *_ in ODD}
    assert rows(mixing.mix(Workspace(spark, "t"), empty)) == []
    staged = mixing.stage_mixing(spark, odd, sf)
    assert staged.columns == odd.columns and unharmed(staged)
    count = lambda rs: sorted((str(r["doc_id"]), str(r["source"])) for r in rs)
    assert count(rows(staged)) == count(out)
    assert rows(mixing.stage_mixing(spark, empty, sf)) == []
