"""Temperature mixing of sources, in DataFrame operations alone.

The weight of a source is its share of the words to the power of an exponent,
normalised. The exponent is found by bisection, so that the weights' entropy
reaches a target without any source being repeated more often than a limit. The
weights become words to emit for each source: some whole epochs, then part of
one more, taken in a seeded permutation of the source's blocks. A source of n
rows has about sqrt(n) blocks, so neither a source's list of blocks nor a block
is ever large, whatever a source's share of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import Workspace

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of blocks up to this many rows (about 40 bytes each) is broadcast.
BROADCAST_BLOCKS = 200_000
SOURCES = "_source string, _weight double, _exponent double, _budget long, _full long, _rest long, _blocks long"


@dataclass(frozen=True)
class MixConfig:
    """target_entropy: as a share of that of equal weights. repetition_limit: of any source; it goes before the entropy.

    budget_words: to emit in all; by default as many as let every document be
    emitted once at least. max_sources: handled on the driver and broadcast; the
    totals of more stay in a table, which each step of the bisection reads.
    """

    target_entropy: float = 0.999
    repetition_limit: float = 1.5
    budget_words: int | None = None
    steps: int = 40
    seed: int = 17
    max_sources: int = 100_000


def weights_at(words: list[int], exponent: float) -> list[float]:
    total = sum(words)
    raw = [(w / total) ** exponent for w in words]
    return [x / sum(raw) for x in raw]


def entropy_share(words: list[int], exponent: float) -> float:
    if len(words) < 2:
        return 1.0
    return -sum(p * math.log(p) for p in weights_at(words, exponent)) / math.log(len(words))


def budget_of(words: list[int], weights: list[float], config: MixConfig) -> float:
    return config.budget_words if config.budget_words is not None else max(w / p for w, p in zip(words, weights))


def repetition(words: list[int], exponent: float, config: MixConfig) -> float:
    p = weights_at(words, exponent)
    b = budget_of(words, p, config)
    return max(b * x / w for w, x in zip(words, p))


def _boundary(holds_low, steps: int) -> float:
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds_low(middle) else (low, middle)
    return low


def bisect_exponent(words: list[int], config: MixConfig) -> float:
    """The largest exponent in [0, 1] that reaches the entropy, raised to the smallest that keeps the limit."""
    flat = _boundary(lambda a: entropy_share(words, a) >= config.target_entropy, config.steps)
    safe = _boundary(lambda a: repetition(words, a, config) > config.repetition_limit, config.steps)
    return max(flat, safe)


def words_to_emit(budget: float, weight: float, words: int, config: MixConfig) -> int:
    """Of a source; under the default budget never less than it has, however the product was rounded."""
    mine = math.floor(budget * weight + 1e-6)
    return mine if config.budget_words is not None else max(words, mine)


def _few_sources(spark: SparkSession, totals: list, config: MixConfig) -> DataFrame:
    some = [r for r in totals if r.words]
    words = [r.words for r in some]
    exponent = bisect_exponent(words, config) if words else 1.0
    weight = dict(zip([r.source for r in some], weights_at(words, exponent))) if words else {}
    budget = budget_of(words, list(weight.values()), config) if words else 0
    rows = []
    for r in totals:
        w = weight.get(r.source, 0.0)
        mine = words_to_emit(budget, w, r.words, config)
        full, rest = divmod(mine, r.words) if r.words else (1, 0)  # a source without words is passed on once
        rows.append((r.source, w, exponent, mine, full, rest, math.ceil(math.sqrt(r.rows))))
    return spark.createDataFrame(rows, SOURCES)


def _many_sources(totals: DataFrame, config: MixConfig) -> DataFrame:
    """The same from a table of totals: a step of the bisection is one row of sums."""
    some = totals.where("words > 0")
    everything = some.agg(F.sum("words")).first()[0]
    raw = lambda a: F.pow(F.col("words") / F.lit(float(everything or 1)), F.lit(a))

    def sums(a: float):
        x = raw(a)
        return some.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("z"), F.sum(x * F.ln(x)).alias("s"), F.max(F.col("words") / x).alias("most"), F.max(x / F.col("words")).alias("least")).first()

    def budget_at(r) -> float:
        return config.budget_words if config.budget_words is not None else r.most * r.z

    def even(a: float) -> bool:
        r = sums(a)
        return (1.0 if r.n < 2 else (math.log(r.z) - r.s / r.z) / math.log(r.n)) >= config.target_entropy

    def repeats(a: float) -> bool:
        r = sums(a)
        return budget_at(r) * r.least / r.z > config.repetition_limit

    exponent = max(_boundary(even, config.steps), _boundary(repeats, config.steps)) if everything else 1.0
    z, budget = (0.0, 0.0) if not everything else ((r := sums(exponent)).z, float(budget_at(r)))
    worded = F.col("words") > 0
    weight = F.when(worded, raw(exponent) / F.lit(z)).otherwise(0.0)
    mine = F.floor(F.lit(budget) * F.col("_weight") + 1e-6)
    if config.budget_words is None:
        mine = F.greatest(mine, F.col("words"))
    known = totals.withColumn("_weight", weight).withColumn("_budget", mine)
    full = F.when(worded, F.expr("_budget div words")).otherwise(1)
    rest = F.when(worded, F.expr("_budget % words")).otherwise(0)
    return known.select(F.col("source").alias("_source"), "_weight", F.lit(exponent).alias("_exponent"), "_budget", full.cast("long").alias("_full"), rest.cast("long").alias("_rest"), F.ceil(F.sqrt("rows")).alias("_blocks"))


def place(seed: int, *what: Column) -> Column:
    """A number below 2**60 from a seed and values, the same in any engine with SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(w.cast("string"), F.lit("")) for w in what])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


@dataclass
class Plan:
    words: DataFrame  # doc_id, source, n_words, block, epochs: whole copies of the row
    extra: DataFrame  # doc_id, source, block, epoch: rows of the last block, which is taken in part
    sources: DataFrame  # source, weight, exponent, budget and so on
    few: bool  # the sources may be broadcast
    blocks: DataFrame  # source, block, rows, full: whole epochs of the source
    small: bool  # the blocks may be broadcast


def _with_block(df: DataFrame, sources: DataFrame, few: bool, config: MixConfig) -> DataFrame:
    joined = df.join(F.broadcast(sources) if few else sources, F.coalesce(F.col("source"), F.lit("")) == F.col("_source"))
    return joined.withColumn("_block", F.pmod(place(config.seed, F.col("doc_id")), F.col("_blocks")))


def plan_mix(ws: Workspace, docs: DataFrame, config: MixConfig = MixConfig()) -> Plan:
    spark = docs.sparkSession
    counted = ws.put("words", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words")))
    sums = counted.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_words").alias("words"))
    totals = sums.orderBy("source").limit(config.max_sources + 1).collect()
    few = len(totals) <= config.max_sources
    sources = _few_sources(spark, totals, config) if few else ws.put("sources", _many_sources(ws.put("totals", sums), config))
    dealt = _with_block(counted, sources, few, config)
    key = place(config.seed, F.col("_source"), F.col("_full"), F.col("_block"))
    sizes = dealt.groupBy("_source", "_full", "_rest", "_block").agg(F.sum("n_words").alias("size"), F.count(F.lit(1)).alias("rows"))
    upto = F.sum("size").over(Window.partitionBy("_source").orderBy(key, "_block"))
    blocks = ws.put("blocks", sizes.withColumn("_before", upto - F.col("size")).select("_source", "_full", "_block", (F.col("_rest") - F.col("_before")).alias("_room"), "size", "rows"))
    taken = F.col("_room") >= F.col("size")
    whole = blocks.select("_source", "_block", (F.col("_full") + taken.cast("long")).alias("epochs"))
    small = (sources.agg(F.sum("_blocks")).first()[0] or 0) <= BROADCAST_BLOCKS
    emitted = dealt.join(F.broadcast(whole) if small else whole, ["_source", "_block"])
    cut = blocks.where(~taken & (F.col("_room") > 0)).select("_source", "_block", "_room")
    within = F.sum("n_words").over(Window.partitionBy("_source", "_block").orderBy(place(config.seed + 1, F.col("doc_id"), F.col("_full")), "doc_id"))
    part = dealt.join(F.broadcast(cut) if few else cut, ["_source", "_block"]).withColumn("_upto", within).where("_upto <= _room")
    return Plan(emitted.select("doc_id", "source", "n_words", "_block", "epochs"), part.select("doc_id", "source", "n_words", "_block", F.col("_full").alias("epoch")), sources, few, blocks.select("_source", "_block", "rows", F.col("_full").alias("full")), small)


def mix(ws: Workspace, docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row for each emission of a document: doc_id, source, n_words, epoch (from 0), block, ordinal.

    ordinal (from 0, gapless) is the emission's place in its source's stream:
    epoch by epoch, in each the blocks in a permutation of its own, in a block
    the rows in one. Null text: no words. Null source: as ''. Null doc_id: as
    any other. Rows repeated with one doc_id are emitted alike. A source
    without any word: each row once. Empty table: no rows. Other columns take
    no part.
    """
    p = plan_mix(ws, docs, config)
    often = p.words.where("epochs > 0").select("doc_id", "source", "n_words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"), "_block")
    out = often.unionByName(p.extra).withColumn("_source", F.coalesce("source", F.lit("")))
    # Blocks number about the square root of the rows, and so do a block's rows: neither window is large.
    each = p.blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    order = Window.partitionBy("_source", "epoch").orderBy(place(config.seed, F.col("_source"), F.col("epoch"), F.col("_block")), "_block")
    before = each.select("_source", "epoch", "_block", (F.sum("rows").over(order) - F.col("rows")).alias("_first"))
    total = p.blocks.groupBy("_source").agg(F.sum("rows").alias("_rows"))
    placed = out.join(F.broadcast(before) if p.small and p.few else before, ["_source", "epoch", "_block"]).join(F.broadcast(total) if p.few else total, "_source")
    nth = F.row_number().over(Window.partitionBy("_source", "epoch", "_block").orderBy(place(config.seed + 1, F.col("doc_id"), F.col("epoch")), "doc_id"))
    return placed.select("doc_id", "source", "n_words", "epoch", F.col("_block").alias("block"), (F.col("epoch") * F.col("_rows") + F.col("_first") + nth - 1).alias("ordinal"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(Workspace(spark, "mixing"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as they are emitted; the columns stay as they are.

    Texts aren't shuffled: a row finds its copies by its block, and the few
    rows of blocks taken in part by doc_id.
    """
    config = MixConfig()
    ws = Workspace(spark, "mixing")
    p = plan_mix(ws, docs, config)
    copies = p.words.groupBy("source", "_block").agg(F.max("epochs").alias("epochs"))
    extra = ws.put("extra", p.extra.select(F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("_src"), F.lit(1).alias("_more")).distinct())
    blocks = ws.put("copies", copies.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("_block").alias("_b"), F.col("epochs").alias("_epochs")).groupBy("_s", "_b").agg(F.max("_epochs").alias("_epochs")))
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    dealt = _with_block(held, p.sources, p.few, config)
    few = blocks.count() <= BROADCAST_BLOCKS
    out = dealt.join(F.broadcast(blocks) if few else blocks, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    out = out.join(F.broadcast(extra) if few else extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_source") == F.col("_src")), "left")
    n = F.col("_epochs") + F.coalesce("_more", F.lit(0))
    out = out.where(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def oracle_op6(config: MixConfig = MixConfig()) -> str:
    """DuckDB SQL: the bisections as one CTE for each step."""
    h = lambda seed, *what: f"CAST('0x' || substr(sha256('{seed}' || {' || '.join(f"':' || coalesce(CAST({w} AS VARCHAR), '')" for w in what)}), 1, 15) AS BIGINT)"
    ctes = [
        r"d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words FROM documents)",
        "t AS (SELECT s, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words FROM d GROUP BY s)",
        "u AS (SELECT s, words, CAST(words AS DOUBLE) / (SELECT sum(words) FROM t) AS share FROM t WHERE words > 0)",
    ]
    weights = "SELECT s, words, pow(share, m) / sum(pow(share, m)) OVER () AS p FROM u, x"
    entropy = f"(WITH x AS (SELECT m FROM {{0}}), w AS ({weights}) SELECT CASE WHEN count(*) < 2 THEN 1 ELSE -sum(p * ln(p)) / ln(count(*)) END >= {config.target_entropy} FROM w)"
    repeats = f"(WITH x AS (SELECT m FROM {{0}}), w AS ({weights}) SELECT max(words / p) * max(p / words) > {config.repetition_limit} FROM w)"
    for name, test in (("e", entropy), ("r", repeats)):
        ctes.append(f"{name}0 AS (SELECT CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0.5 AS DOUBLE) AS m)")
        for k in range(config.steps):
            at = f"{name}{k}"
            ctes.append(f"{name}{k + 1} AS (SELECT lo, hi, (lo + hi) / 2 AS m FROM (SELECT CASE WHEN ok THEN m ELSE lo END AS lo, CASE WHEN ok THEN hi ELSE m END AS hi FROM (SELECT lo, hi, m, {test.format(at)} AS ok FROM {at})))")
    ctes += [
        f"x AS (SELECT greatest((SELECT lo FROM e{config.steps}), (SELECT lo FROM r{config.steps})) AS m)",
        f"w AS ({weights})",
        "b AS (SELECT t.s, t.words, CAST(ceil(sqrt(t.n)) AS BIGINT) AS blocks, CAST(floor((SELECT max(words / p) FROM w) * coalesce(w.p, 0) + 1e-6) AS BIGINT) AS budget FROM t LEFT JOIN w ON t.s = w.s)",
        "f AS (SELECT s, blocks, CASE WHEN words > 0 THEN budget // words ELSE 1 END AS full_, CASE WHEN words > 0 THEN budget % words ELSE 0 END AS rest FROM b)",
        f"g AS (SELECT d.*, f.full_, f.rest, {h(config.seed, 'doc_id')} % blocks AS block FROM d JOIN f ON d.s = f.s)",
        "z AS (SELECT s, full_, rest, block, sum(n_words) AS size, count(*) AS n FROM g GROUP BY ALL)",
        f"y AS (SELECT s, full_, block, size, rest - (sum(size) OVER (PARTITION BY s ORDER BY {h(config.seed, 's', 'full_', 'block')}, block) - size) AS room FROM z)",
        "k AS (SELECT g.*, y.room, y.size FROM g JOIN y ON g.s = y.s AND g.block = y.block)",
        "o AS (SELECT s, full_, block, n, unnest(range(full_ + 1)) AS epoch FROM z)",
        f"q AS (SELECT s, epoch, block, sum(n) OVER (PARTITION BY s, epoch ORDER BY {h(config.seed, 's', 'epoch', 'block')}, block) - n AS first FROM o)",
        "a AS (SELECT doc_id, source, s, n_words, unnest(range(full_ + CASE WHEN room >= size THEN 1 ELSE 0 END)) AS epoch, block FROM k)",
        f"c AS (SELECT doc_id, source, s, n_words, full_ AS epoch, block, room, sum(n_words) OVER (PARTITION BY s, block ORDER BY {h(config.seed + 1, 'doc_id', 'full_')}, doc_id) AS upto FROM k WHERE room < size AND room > 0)",
    ]
    ctes += [
        "u2 AS (SELECT doc_id, source, s, n_words, epoch, block FROM a UNION ALL SELECT doc_id, source, s, n_words, epoch, block FROM c WHERE upto <= room)",
        f"v2 AS (SELECT *, row_number() OVER (PARTITION BY s, epoch, block ORDER BY {h(config.seed + 1, 'doc_id', 'epoch')}, doc_id) - 1 AS nth FROM u2)",
    ]
    last = "SELECT v2.doc_id, v2.source, v2.n_words, v2.epoch, v2.block, CAST(v2.epoch * t.n + q.first + v2.nth AS BIGINT) AS ordinal FROM v2 JOIN q ON q.s = v2.s AND q.epoch = v2.epoch AND q.block = v2.block JOIN t ON t.s = v2.s"
    return "WITH " + ",\n".join(ctes) + "\n" + last
