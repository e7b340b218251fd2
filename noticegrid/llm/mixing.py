"""Mixing sources to target weights by temperature; DataFrame operations alone.

A source with a share p of the tokens gets the weight p**exponent / sum. Exponent 1 leaves the
shares as they are, 0 makes them equal. The exponent is bisected on a grid of 1/1024, then every
source's weight is realised as whole passes and one part of a pass over a fixed permutation of its
documents, block after block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.session import materialise

STEPS = 1024
SECTIONS = 32  # one search step looks at 33 exponents, as five halvings would
BLOCK_DOCS = 1_000
MAX_REPEATS = 2.0


def source_key() -> Column:
    """A source's name as a key without nulls; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def token_count() -> Column:
    """Words of the whole text; a null text has none."""
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def place(seed: int) -> Column:
    """A document's place in the permutation, 60 bits; a null id has the place of an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def measures(totals: DataFrame, ks: list[int]) -> DataFrame:
    """``k, entropy, repeats`` for exponents k / STEPS.

    Entropy of the weights is a share of the largest possible one; repeats are the passes of the
    smallest source for one pass of the largest. Sources without tokens do not count. ``totals`` has
    ``tokens, most, least, n`` for each source; every exponent is one aggregated row.
    """
    exponent = F.col("k") / F.lit(float(STEPS))
    share = F.col("tokens") / F.col("most")
    weighed = (
        totals.filter("tokens > 0").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
        .select("k", F.pow(share, exponent).alias("w"), (exponent * F.log(share)).alias("l"), "n", (F.col("most") / F.col("least")).alias("ratio"))
    )
    sums = weighed.groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("l")).alias("s"), F.max("n").alias("n"), F.max("ratio").alias("ratio"))
    entropy = F.when(F.col("n") > 1, (F.log("z") - F.col("s") / F.col("z")) / F.log("n")).otherwise(F.lit(1.0))
    return sums.select("k", entropy.alias("entropy"), F.pow("ratio", F.lit(1.0) - exponent).alias("repeats"))


def bisect(totals: DataFrame, test: Column, rising: bool) -> int:
    """The grid exponent at the edge of a monotone ``test``: the least that passes if it begins to
    hold with rising exponents, else the largest. Without one that passes, the end nearest to it."""
    low, high = 0, STEPS
    while True:
        step = max(1, (high - low) // SECTIONS)
        ks = sorted({*range(low, high + 1, step), high})
        passed = {r.k for r in measures(totals, ks).filter(test).select("k").collect()}  # 34 rows at most
        if rising:
            edge = next((i for i, k in enumerate(ks) if k in passed), len(ks) - 1)
            low, high = ks[max(0, edge - 1)], ks[edge]
            if step == 1:
                return high
        else:
            edge = next((i for i in range(len(ks) - 1, -1, -1) if ks[i] in passed), 0)
            low, high = ks[edge], ks[min(len(ks) - 1, edge + 1)]
            if step == 1:
                return low


def source_plan(rows: DataFrame, *, entropy: float | None, max_repeats: float, budget: int | None) -> DataFrame:
    """``key, tokens, docs, k, whole, part`` of each source: whole passes and the tokens of the last one.

    The exponent is the least whose smallest source repeats ``max_repeats`` times at most while the
    largest is passed once. With ``entropy`` (a share of the largest possible) it is the largest
    that meets that target, unless the limit on repeats asks for a larger one. ``budget`` is the
    number of tokens to give out; without it, it is what one pass of the largest source implies.
    """
    by_source = materialise(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    held = by_source.filter("tokens > 0").agg(F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count(F.lit(1)).alias("n")).first()
    totals = by_source.withColumns({c: F.lit(held[c]).cast("bigint") for c in ("most", "least", "n")})
    k = STEPS
    if held.n:
        k = bisect(totals, F.col("repeats") <= max_repeats, True)
        if entropy is not None:
            k = max(k, bisect(totals, F.col("entropy") >= entropy, False))
    passes = F.pow(F.col("most") / F.col("tokens"), F.lit(1.0 - k / STEPS))
    given = F.floor(F.col("tokens") * passes + F.lit(1e-6)).cast("bigint")
    plan = totals.withColumn("k", F.lit(k)).withColumn("given", F.when(F.col("tokens") > 0, given).otherwise(F.lit(0).cast("bigint")))
    if budget is not None:
        total = plan.agg(F.sum("given").alias("t")).first().t or 1
        most = F.floor(F.col("tokens") * F.lit(max_repeats)).cast("bigint")
        plan = plan.withColumn("given", F.least(F.floor(F.col("given") * F.lit(budget / total)).cast("bigint"), most))
    empty = F.col("tokens") == 0
    return plan.select(
        "key", "tokens", "docs", "k", "given",
        F.when(empty, 1).otherwise(F.expr("given div tokens")).cast("bigint").alias("whole"),
        F.when(empty, 0).otherwise(F.expr("given % tokens")).cast("bigint").alias("part"),
    )


def placed_rows(rows: DataFrame, plan: DataFrame, block_docs: int) -> DataFrame:
    """``rows`` with their source's plan, block and ``before``, the tokens of the source ahead of them.

    Blocks are even ranges of the permutation, so a source of any size is summed by block, and only
    one row a block meets in one window.
    """
    count = F.ceil(F.col("docs") / block_docs).cast("bigint")
    block = F.shiftright(F.shiftright("place", 28) * count, 32)  # the first 32 of 60 bits
    blocked = rows.join(plan, "key").withColumn("block", block)
    sums = blocked.groupBy("key", "block").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "block", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "block").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts, ["key", "block"]).withColumn("before", F.col("start") + F.col("inside"))
    )


def narrow(docs: DataFrame, seed: int) -> DataFrame:
    doc = F.col("doc_id").cast("bigint")
    return docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), source_key().alias("key"), token_count().alias("n_tokens"), place(seed).alias("place"))


def mix(
    docs: DataFrame, *, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: int | None = None,
    seed: int = 0, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row per copy of a document: ``doc_id, source, n_tokens, exponent, pass, block, mix_order``.

    ``mix_order`` in [0, 1) is the copy's place in its source's stream; read in that order, sources
    alternate by their weights. Without a budget every document has at least one copy. The last,
    partial pass takes the leading documents of the permutation as far as their tokens fit. A null
    source is a source of its own; documents without tokens cost nothing and have as many copies as
    whole passes; a source of such documents alone has one pass. Repeated rows and ids are rows of
    their own; an empty table gives none.
    """
    rows = materialise(narrow(docs, seed))
    plan = materialise(source_plan(rows, entropy=entropy, max_repeats=max_repeats, budget=budget))
    last = (F.col("n_tokens") > 0) & (F.col("before") + F.col("n_tokens") <= F.col("part"))
    copies = (F.col("whole") + F.when(last, 1).otherwise(0)).cast("int")
    placed = placed_rows(rows, plan, block_docs).withColumn("copies", copies).filter("copies > 0")
    order = (F.col("pass") * F.col("tokens") + F.col("before")).cast("double") / F.greatest(F.col("given"), F.lit(1)).cast("double")
    return placed.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("copies") - 1).cast("bigint")))).select(
        "doc_id", "source", "n_tokens", (F.col("k") / F.lit(float(STEPS))).alias("exponent"), "pass", "block", order.alias("mix_order")
    )


def mixed_rows(
    docs: DataFrame, *, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: int | None = None,
    seed: int = 0, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` has it.

    The documents of a partial pass lead the permutation, so a source's cut is the last place taken.
    Texts meet one row a source; they are not sorted or gathered by it.
    """
    rows = materialise(narrow(docs, seed))
    plan = materialise(source_plan(rows, entropy=entropy, max_repeats=max_repeats, budget=budget))
    fits = (F.col("before") + F.col("n_tokens") <= F.col("part")) & (F.col("n_tokens") > 0)
    at = F.struct(F.col("place"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("n_tokens"))
    cuts = placed_rows(rows, plan, block_docs).groupBy("key").agg(F.max("whole").alias("whole"), F.max(F.when(fits, at)).alias("cut"))
    cuts = materialise(cuts.select(F.col("key").alias("_key"), "whole", "cut"))
    own = F.struct(place(seed).alias("place"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"), token_count().alias("n_tokens"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), source_key().alias("_key"), own.alias("_at"))
    more = F.coalesce((F.col("_at") <= F.col("cut")) & (F.col("_at.n_tokens") > 0), F.lit(False))
    copies = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")
    repeated = keyed.join(cuts, "_key").withColumn("_copies", copies).filter("_copies > 0")
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
