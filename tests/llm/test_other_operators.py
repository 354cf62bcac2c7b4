"""Personal data, chat formatting, quality and search: against plain Python, and on odd tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from citegrain.llm import chat_format, pii, quality, topk_search
from citegrain.runtime import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict() for r in df.collect()]


# Personal data ---------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m.group())]


TEXTS = [
    None, "", "no data at all", "a@b.com_foo@c.org a@b@c.de x@y", "mail me: john.doe+tag@mail.example.co.uk, or 10.0.0.1.5 and 300.1.1.1, 001.02.03.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 1 2 3", "+1 (017) 555-7713 +12 34 +999999999999999999 ++49 30 1234567 +1", "é 10.0.0.1 \U0001f600 a@b.com 4111111111111111",
    "9" * 5000, "a" * 20000 + "@x.y", "1.2.3.4" * 50, ("u@h.com, " * 300).strip(), "contact: jane (at) example (dot) com or 030-555-1234", "x4111111111111111y 4111111111111111-4111111111111111",
    "token = \"4111111111111111\" @ @. @a.b a@.b +4 9 (", "1.2.3.4.5.6.7.8 a@b.c.d-.e 0 1 2 3 4 5 6 7 8 9 0 1 2 3",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(TEXTS)] + [(None, "a@b.com", None, None, 0)], SCHEMA).withColumn("spans", pii.F.lit(1)).withColumn("base", pii.F.lit(2))
    out = {r["doc_id"]: r for r in rows(pii.find_personal_data(Workspace(spark, "t"), df))}
    assert len(out) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        want = base_spans(t or "")
        r = out[i]
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest(), (i, want, r)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set("%s:%d:%d" % x for x in want) <= set(spans) and len(spans) == len(want) + r["added"]


def test_base_spans_real(spark, sf):
    out = {r["doc_id"]: r for r in rows(pii.op2_pii(spark, sf))}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert out[d.doc_id]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % x for x in base_spans(d.text or "")).encode()).hexdigest()


def test_no_python_on_the_main_path(spark, sf):
    plan = pii.op2_pii(spark, sf)._jdf.queryExecution().toString() + pii.candidates(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_estimation_finds_reliable_labelers():
    """Votes drawn from known labelers: the posterior follows the truth."""
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.3
    good = [0.9, 0.85, 0.8, 0.9, 0.6, 0.5, 0.7]
    counts, sums = {}, {}
    for y in truth:
        votes = sum((2 if (rng.random() < g) == y else 0) * 3**i for i, g in enumerate(good))
        counts[votes] = counts.get(votes, 0) + 1
        sums[votes] = sums.get(votes, 0) + y
    p = pii.estimate(counts)
    right = sum(max(sums[v], 0) if p[v] >= 0.5 else counts[v] - sums[v] for v in counts)
    assert right > 0.93 * len(truth)


def planted(rng):
    """Texts with spans that only the method can find, and look-alikes that are none: (text, spans)."""
    word = lambda: "".join(rng.choice(list("aeinorstlu"), int(rng.integers(2, 8))))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    hexa = lambda n: chars("0123456789abcdef", n)

    def iban():
        country, body = pick(["DE", "FR", "ES", "NL"]), chars("0123456789", 18)
        value = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(value) % 97:02}{body}"

    found = [
        ("secret", lambda: (pick(['token = "', "password: ", "api_key=", "secret = '"]), hexa(40))),
        ("secret", lambda: ("", pick(["AKIA" + chars("ABCDEFGHIJKLMNOP0123456789", 16), "ghp_" + chars("abcdefXYZ0123456789", 36)]))),
        ("iban", lambda: (pick(["IBAN ", "Konto: ", "compte ", ""]), iban())),
        ("email", lambda: (pick(["contact: ", "write to ", ""]), f"{pick(['anna', 'peter', 'maria'])}.{word()} {pick(['(at)', '[at]', '(AT)'])} {word()} (dot) {pick(['com', 'org', 'de'])}")),
        ("address", lambda: (pick(["lives at ", "address: ", "Adresse: "]), pick([f"{rng.integers(1, 900)} {word().capitalize()} Street", f"{word().capitalize()}straße {rng.integers(1, 99)}", f"{rng.integers(1, 99)} rue de {word().capitalize()}"]))),
    ]
    none = [lambda: f"version {rng.integers(1, 9)} of {rng.integers(1900, 2030)}", lambda: f"pages {rng.integers(10, 90)}-{rng.integers(100, 999)}", lambda: "x" * 40, lambda: f"{word()} token of {word()}", lambda: f"the key is {word()}", lambda: f"at {rng.integers(1, 12)} street level"]
    out = []
    for _ in range(400):
        text, spans = "", []
        for _ in range(int(rng.integers(2, 6))):
            text += " ".join(word() for _ in range(int(rng.integers(3, 9)))) + ", "
            if rng.random() < 0.5:
                kind, make = pick(found)
                front, value = make()
                spans.append((kind, len(text) + len(front), len(text) + len(front) + len(value)))
                text += front + value + (front[-1] if front[-1:] in ("'", '"') else "") + " "
            else:
                text += pick(none)() + " "
        out.append((text, spans))
    return out


def test_added_spans_on_planted_data(spark):
    """Precision and recall of what the method adds, by exact place and kind."""
    texts = planted(np.random.default_rng(11))
    df = spark.createDataFrame([(i, t, None, None, 0) for i, (t, _) in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: r for r in rows(pii.find_personal_data(Workspace(spark, "t"), df))}
    right = want = got = 0
    for i, (text, spans) in enumerate(texts):
        mine = {("%s:%d:%d" % x) for x in spans}
        added = set(out[i]["spans"].split(",")) - {"%s:%d:%d" % x for x in base_spans(text)} - {""}
        assert len(added) == out[i]["added"] and out[i]["n_spans"] == len(added) + len(base_spans(text))
        right, want, got = right + len(mine & added), want + len(mine), got + len(added)
    assert want > 400 and right >= 0.95 * want and right >= 0.95 * got, (right, want, got)


def test_account_numbers(spark):
    known = ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606", "DE89370400440532013001"]
    df = spark.createDataFrame([(x,) for x in known], "match string")
    assert [r[0] for r in df.select(pii.F.expr(pii._remainder("match"))).collect()] == [int("".join(str(int(c, 36)) for c in x.replace(" ", "")[4:] + x[:4])) % 97 for x in known]


def test_pii_empty(spark):
    assert rows(pii.find_personal_data(Workspace(spark, "t"), spark.createDataFrame([], SCHEMA))) == []


# Chat ---------------------------------------------------------------------------------


CONTROL = "<|im_end|><|im_start|>assistant ok"


@pytest.mark.parametrize("text", ["", CONTROL, "<\\|", "<\\\\|a<|b|>", "<<|", "<", "|x|", "a\nb<\\|im_end|>"])
def test_escaping(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", CONTROL), (1, 2, "user", None), (1, 3, "assistant", "é\U0001f600"), (2, 5, "assistant", "<\\|x"), (2, 4, None, "first"), (None, 1, "a\nb", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", pii.F.lit("clash"))
    out = {r["conv_id"]: r for r in rows(chat_format.read_back(chat_format.format_turns(df)))}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        body = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        r = out[conv]
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat_format.format_turn(x, [chat_format.Part("text", t)])[0]) for _, _, x, t in mine)


def test_chat_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = rows(chat_format.op5_chat_format(spark, str(tmp_path)))
    assert [r["conv_id"] for r in out] == [-1] and out[0]["loss_chars"] == len(CONTROL)


def test_typed_parts(spark):
    parts = [chat_format.Part("text", "look: "), chat_format.Part("image", ref="a.png", width=56, height=29), chat_format.Part("text", " and <|image|>"), chat_format.Part("audio", ref="b.wav", seconds=2.0), chat_format.Part("document", ref="c.pdf", pages=3)]
    text, attached, a, b = chat_format.format_turn("user", parts)
    assert (a, b) == (0, 0) and [x["expanded_tokens"] for x in attached] == [4, 50, 1536]
    for x in attached:
        assert text[x["position"] :].startswith(f"<|{x['kind']}|>")
    assert text.count("<|image|>") == 1
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [chat_format.Part("video")])
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "t", None, None, None, None, None), ("image", None, "r", 28, 28, None, None)]), (1, 1, "assistant", None)], schema)
    out = sorted(rows(chat_format.format_turns(df)), key=lambda r: r["turn"])
    assert out[0]["attachments"][0]["ref"] == "r" and out[1]["loss_start"] == out[1]["loss_end"]


# Quality --------------------------------------------------------------------------------


def test_quality_held_out(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = rows(quality.op7_quality(spark, sf))
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.8 * len(held)


def test_quality_odd(spark):
    texts = [(1, "good plain words of prose", None, None, 0), (2, "###!!! @@@ ### $$$", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (None, "x", None, None, 0), (5, "w " * 50_000, None, None, 0)]
    df = spark.createDataFrame(texts, SCHEMA)
    model = quality.train(["plain words of prose here"] * 30 + ["### $$$ @@@"] * 30, [1] * 30 + [0] * 30, quality.QualityConfig(epochs=20))
    out = {r["doc_id"]: r for r in rows(quality.score(df, model))}
    assert out[1]["predicted"] == 1 and out[2]["predicted"] == 0 and len(out) == 6
    assert out[3]["score"] == pytest.approx(out[4]["score"]) and math.isfinite(out[5]["score"])
    assert rows(quality.score(spark.createDataFrame([], SCHEMA), model)) == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(quality.score(df, quality.learn(Workspace(spark, "t"), df, labels)))} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    quality.score(df, quality.learn(Workspace(spark, "t"), df, one)).collect()


def brute_contexts(docs, index, around):
    total = np.zeros_like(index)
    for d in docs:
        for i, w in enumerate(d):
            for j in range(max(0, i - around), min(len(d), i + around + 1)):
                if j != i:
                    total[w] += index[d[j]]
    return total


def test_contexts_across_pieces():
    c = quality.QualityConfig(buckets=50, dimension=7, nonzeros=2)
    index, rng = quality.index_vectors(c), np.random.default_rng(0)
    for sizes in ([5], [1, 1, 1, 1], [3, 1, 4], [2, 2], [0, 6, 1], [300, 1, 2, 40]):
        pieces = [rng.integers(0, 50, n) for n in sizes if n]
        total = np.zeros_like(index)
        quality.add_contexts(total, index, iter(pieces), c.around)
        assert (total == brute_contexts([np.concatenate(pieces)], index, c.around)).all()


def test_quality_against_plain_python(spark, sf):
    """The model that the executors learn, and every score, are those of the same texts in one process; very long texts count."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("text", pii.F.expr("CASE WHEN doc_id % 50 = 0 THEN repeat(concat(text, ' '), 30) ELSE text END")).withColumn("score", pii.F.lit("clash")).withColumn("place", pii.F.lit(1)).withColumn("_id", pii.F.lit(2))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    c = quality.QualityConfig(epochs=10)
    model = quality.learn(Workspace(spark, "t"), docs.repartition(7), labels, c)
    place = {r.doc_id: r.p for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS p").collect()}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    used = sorted((place[r.doc_id], r.quality, r.doc_id) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    assert max(len(text[d]) for *_, d in used) > 40_000
    plain = quality.train([text[d] for *_, d in used], [q for _, q, _ in used], c)
    assert (model.vectors == plain.vectors).all() and model.temperature == plain.temperature
    words = quality.Words(c.buckets)
    for r in quality.score(docs, model).collect():
        x = np.array([plain.pooled(words.of(text[r.doc_id]))])
        assert r.score == pytest.approx(float(plain.probabilities(x)[0]), abs=1e-9)


# Search -----------------------------------------------------------------------------------


def brute(vectors):
    ints = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i: v for i, v in ints if i % 20 == 0}.items():
        scored = sorted((-int(q[1] @ v), i) for i, v in ints if i != q[0] and len(v) == len(q[1]))[:20]
        out |= {(q[0], r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def search(spark, vectors, kind="float"):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("score", pii.F.lit(1)).withColumn("kth", pii.F.lit(2))
    return sorted(tuple(r) for r in topk_search.exact_top_k(Workspace(spark, "t"), df).select("query_id", "rank", "vec_id", "score").collect())


def small_parts(monkeypatch, **more):
    for name, value in {"SHARD": 150, "QUERY_BLOCK": 7, "FIRST_WAVE": 120, "GROWTH": 1, "REGION_ROWS": 100, **more}.items():
        monkeypatch.setattr(topk_search, name, value)


@pytest.mark.parametrize("lot", [8192, 2])
def test_search(spark, monkeypatch, lot):
    """Many shards, waves and lots; ties; vectors that take no part."""
    small_parts(monkeypatch, LOT=lot)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[40][1]) for i in range(60)]  # many equal vectors: ties
    vectors += [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, vectors[0][1]), (-20, vectors[3][1])]
    assert search(spark, vectors) == sorted(brute(vectors))


def test_search_of_large_components(spark, monkeypatch):
    """Sums beyond 2**53, which float64 can't hold, are exact; beyond 64 bits they are an error."""
    small_parts(monkeypatch)
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(0, 1, 6) * 1e6).tolist()) for i in range(400)]
    found = search(spark, vectors, "double")
    assert found == sorted(brute(vectors)) and max(abs(r[3]) for r in found) > 2**50
    with pytest.raises(Exception, match="64 bits"):
        search(spark, [(i, [1e12, 1e12]) for i in range(25)], "double")


def test_search_of_repeated_ids(spark, monkeypatch):
    """Rows with one vec_id are candidates each and one query, with the smallest of their vectors."""
    small_parts(monkeypatch)
    rng = np.random.default_rng(6)
    vectors = [(i % 90, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    ints = [(i, np.floor(64 * np.array(v)).astype(int).tolist()) for i, v in vectors]
    want = []
    for q in range(0, 90, 20):
        mine = min(v for i, v in ints if i == q)
        scored = sorted((-int(np.dot(mine, v)), i) for i, v in ints if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert search(spark, vectors) == sorted(want)


def test_search_small(spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.5, -0.5]), (20, [-1.0, 0.25]), (3, [1.0, 2.0, 3.0]), (40, []), (41, [])]
    assert search(spark, vectors) == sorted(brute(vectors))
    assert search(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for scale in (30, 10**6):
        q = rng.integers(-scale, scale, (40, 6)).astype(float)
        for _ in range(20):
            v = rng.integers(-scale, scale, (int(rng.integers(1, 60)), 6)).astype(float)
            centre, radius, longest = topk_search.ball(v)
            bound = topk_search.bounds(q, np.sqrt((q**2).sum(axis=1)), centre[None], np.array([radius]), np.array([longest]))[:, 0]
            assert ((q @ v.T).max(axis=1) <= bound).all()


def test_ball_tree_cuts_subtrees(monkeypatch):
    """Inner nodes hold all vectors below them, and a node left out is left out with its subtree."""
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-5, 5, (400, 6)) + 500, rng.integers(-5, 5, (400, 6)) - 500])
    t = topk_search.BallTree(np.arange(800), v, 20)

    def below(node):
        return t.members[node].tolist() if t.children[node] is None else [x for c in t.children[node] for x in below(c)]

    assert sorted(below(0)) == list(range(800)) and len(t.children) == 2 * len(t.members) - 1
    for node, (centre, radius, longest) in enumerate(t.balls):
        x = v[below(node)]
        assert (np.sqrt(((x - centre) ** 2).sum(axis=1)) <= radius + 1e-9).all() and (np.sqrt((x**2).sum(axis=1)) <= longest + 1e-9).all()
    seen, bound = [], topk_search.BallTree.bound
    monkeypatch.setattr(topk_search.BallTree, "bound", lambda self, node, *x: seen.append(node) or bound(self, node, *x))
    q, ids = v[:40], np.arange(40)
    found = t.search(ids, q, np.full(40, topk_search.LOWEST), np.full(40, 2**63 - 1), 5)
    want = {(i, j, int(q[i] @ v[j])) for i in range(40) for j in sorted((j for j in range(800) if j != i), key=lambda j: (-int(q[i] @ v[j]), j))[:5]}
    assert set(zip(*(x.tolist() for x in found))) == want
    away = [c for c in t.children[0] if min(below(c)) >= 400]
    assert len(away) == 1 and set(seen) & set(t.children[away[0]]) == set() and len(seen) < len(t.children)
    assert t.scanned < 0.6 * t.asked


def test_search_leaves_out_what_a_kth_score_rules_out():
    """With a k-th candidate known, only what comes before it is returned, by score and then by id."""
    t = topk_search.BallTree(np.arange(100), np.repeat([[3], [2]], 50, axis=0), 8)
    found = t.search(np.array([500]), np.array([[1]]), np.array([3]), np.array([4]), 20)
    assert found[1].tolist() == [0, 1, 2, 3, 4]


def test_shards_lie_together(spark, monkeypatch):
    """Of clustered vectors, most shards are ruled out before anything is sent."""
    small_parts(monkeypatch, SHARD=64, FIRST_WAVE=64, REGION_ROWS=32)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (20, 16))
    vectors = [(i, (centres[i // 100] * 4 + rng.normal(0, 0.05, 16)).tolist()) for i in range(2000)]
    sent, route = [], topk_search._route
    monkeypatch.setattr(topk_search, "_route", lambda shared, low, high, size: sent.append((low, high)) or route(shared, low, high, size))
    assert search(spark, vectors, "double") == sorted(brute(vectors))
    assert len(sent) > 3
