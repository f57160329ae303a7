"""Mixing sources to target weights, budgeted down a domain - language - source tree.

A token budget is split at every node by its children's integer weights. A child that has fewer tokens
than its share (its text times ``max_epochs``) is filled up, and what it lacks goes to its siblings in
proportion to their weights; only what a whole family lacks has been taken from the ancestors' split
above, because a node never gets more than its descendants can give. All shares are exact integers.

Each leaf then takes whole epochs of its documents, and of one more epoch, in an order seeded by the
epoch's number, the prefix of tokens that is left of its budget; the document at the end may be cut.
The prefix is found in two steps, ranges of the order first, as many as the leaf's rows ask for, so that
a leaf with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stored, table

TREE = ("domain", "lang", "source")
NO_VALUE = "(none)"
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
SEED = 17
MAX_EPOCHS = 4
#: Columns that a mixture carries for a while; no table has these names.
MIX, NAME = "__mix_of_row", ["__mix_name_1", "__mix_name_2"]
#: Rows of a leaf that one task sorts, about.
SORTED_ROWS = 4096
#: Parts in which the rows of a leaf are dealt where they meet its budget.
DEALS = 16


def default_domain() -> Column:
    """Domain of a source: its trailing number's fifth (src0-src4: d0, ...); sources without one are ``other``."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.expr("cast(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as bigint) div 5 as string)")))


def default_weights() -> dict[str, Column]:
    """Integer weight of a child among its siblings, for each level."""
    lang = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], kv[1]), list(LANG_WEIGHTS.items())[1:], F.when(F.col("lang") == "en", LANG_WEIGHTS["en"])).otherwise(5)
    return {"domain": F.lit(1), "lang": lang, "source": F.lit(1)}


def measured(docs: DataFrame, domain: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, spread, keep...): tokens are runs of bytes other than ASCII white space.

    ``spread`` places rows without doc_id in the order of an epoch: a hash of their text.
    """
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (domain if domain is not None else default_domain()).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_VALUE)).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit(NO_VALUE)).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).alias("spread"), *keep,
    )


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Budget of each child: columns parents..., name, weight, cap, pool (the parent's budget).

    Children are filled in order of cap / weight. While a child's proportional part of what is left
    is its cap or more it is saturated; the others split the rest by weight, and the units that
    rounding down leaves go one each to the first of them by name.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), name)
    rising, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    d = children.withColumn("left", big("pool") - F.coalesce(F.sum("cap").over(rising), F.lit(0)).cast("decimal(19,0)")).withColumn("heavy", F.sum("weight").over(rest))
    d = d.withColumn("full", F.col("cap").cast("decimal(19,0)") * big("heavy") <= F.col("left") * big("weight"))
    family = Window.partitionBy(*parents)
    d = d.withColumn("pool_left", F.col("pool") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))).withColumn("weight_left", F.sum(F.when(~F.col("full"), F.col("weight"))).over(family))
    d = d.withColumn("base", F.expr("case when full then cap else cast(cast(pool_left as decimal(19,0)) * cast(weight as decimal(19,0)) div cast(weight_left as decimal(19,0)) as bigint) end"))
    d = d.withColumn("odd", F.when(F.col("weight_left") > 0, F.col("pool_left") - F.sum(F.when(~F.col("full"), F.col("base"))).over(family)).otherwise(0))
    place = F.row_number().over(Window.partitionBy(*parents).orderBy(F.col("full"), name))
    return d.withColumn("budget", F.col("base") + F.when(~F.col("full") & (place <= F.col("odd")), 1).otherwise(0)).select(*parents, name, "cap", "budget")


def leaf_budgets(tokens: DataFrame, budget: Column, weights: dict[str, Column] | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, available, n_rows, budget) of every leaf; budget is a Column over ``total``."""
    weights = weights or default_weights()
    leaves = stored(tokens.sparkSession, tokens.groupBy(*TREE).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_rows")).where("available > 0").withColumn("root", F.lit(0)), "leaves")
    total = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    pool = total.select(F.least(budget.cast("long"), F.col("total") * max_epochs)).first()[0]
    level = None
    parents = ["root"]
    for name in TREE:
        caps = leaves.groupBy(*parents, name).agg((F.sum("available") * max_epochs).alias("cap")).withColumn("weight", weights[name].cast("long"))
        pooled = caps.withColumn("pool", F.lit(pool).cast("long")) if level is None else caps.join(level, parents)
        level = shared_out(pooled, parents, name).select(*parents, name, F.col("budget").alias("pool"))
        parents = [*parents, name]
    return leaves.join(level, parents).select(*TREE, "available", "n_rows", F.col("pool").alias("budget"))


def selected(tokens: DataFrame, leaves: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``tokens`` with whole_epochs, part_tokens (of the last epoch) and taken (all tokens).

    Rows of one place in the order (equal doc_ids, or none and equal texts) follow by size and ``keep``.
    """
    digits = F.expr(f"cast(greatest(0, ceil(log(16, n_rows / {SORTED_ROWS}))) as int)")
    own = leaves.select(*TREE, F.expr("budget div available").alias("whole_epochs"), F.expr("budget % available").alias("part"), digits.alias("digits"))
    # leaves are a small table that is mostly broadcast; where it isn't, rows meet them by leaf and deal, not leaf by leaf
    own = stored(tokens.sparkSession, own, "budgets").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    deal = F.pmod(F.xxhash64("doc_id", "spread", "n_tokens"), F.lit(DEALS)).cast("int")
    d = tokens.withColumn("deal", deal).join(own, [*TREE, "deal"], "left").na.fill(0, ["whole_epochs", "part", "digits"])
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.col("spread").cast("string")))
    d = d.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole_epochs").cast("string"), name).cast("binary")))
    d = d.withColumn("range", F.expr("substring(place, 1, digits)"))
    ranges = d.groupBy(*TREE, "range").agg(F.sum("n_tokens").alias("tokens"))
    before = ranges.withColumn("before", F.sum("tokens").over(Window.partitionBy(*TREE).orderBy("range")) - F.col("tokens")).drop("tokens")
    own = Window.partitionBy(*TREE, "range").orderBy("place", "doc_id", "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [*TREE, "range"]).withColumn("at", F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens"))
    d = d.withColumn("part_tokens", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_tokens"), F.col("part") - F.col("at"))))
    return d.select("doc_id", *TREE, "n_tokens", "whole_epochs", "part_tokens", (F.col("whole_epochs") * F.col("n_tokens") + F.col("part_tokens")).alias("taken"), *keep)


def half() -> Column:
    return F.expr("total div 2")


def mixed(spark: SparkSession, docs: DataFrame, budget: Column | None = None, weights: dict[str, Column] | None = None, domain: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """What each row of ``docs`` (doc_id, text, lang, source, ...) gives to the mixture. [DataFrame functions only]

    Null languages and sources are leaves of their own; null or blank texts have no tokens and give
    none; rows without doc_id take part; repeated rows count each; an empty table gives no rows.
    """
    tokens = stored(spark, measured(docs, domain, keep), "tokens-of")
    return selected(tokens, leaf_budgets(tokens, budget if budget is not None else half(), weights, max_epochs), seed, keep)


def _prefix(texts: pd.Series, n: pd.Series) -> pd.Series:
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(text: str, k: int) -> str:
        for i, m in enumerate(word.finditer(text), 1):
            if i == k:
                return text[: m.end()]
        return text

    return pd.Series([cut(t, k) for t, k in zip(texts, n, strict=True)], dtype="object")


def mixture(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` once for each epoch, the last one's end cut after its tokens.

    Every row takes part, without doc_id or with a repeated one too: rows are named by two hashes of all
    their columns, and equal rows, which are interchangeable, share what they all are given. Only the cut
    text of each leaf passes through Python. An empty table gives no rows.
    """
    names = docs.columns
    named = docs.select(*names, *(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in names)).alias(n) for k, n in enumerate(NAME)))
    take = mixed(spark, named, keep=tuple(NAME), **options).where("taken > 0").select(*NAME, F.struct("n_tokens", "whole_epochs", "part_tokens").alias(MIX))
    d = named.dropDuplicates(NAME).join(take, NAME).drop(*NAME)
    times = F.expr(f"array_repeat(0, cast({MIX}.whole_epochs + if({MIX}.part_tokens = {MIX}.n_tokens, 1, 0) as int))")
    whole = d.select(*names, F.explode(times).alias(MIX)).drop(MIX)
    prefix = F.pandas_udf(_prefix, "string")
    cut = d.where(f"{MIX}.part_tokens > 0 and {MIX}.part_tokens < {MIX}.n_tokens").withColumn("text", prefix("text", f"{MIX}.part_tokens"))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return whole.unionByName(cut.select(*names))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; half of all tokens, default weights, at most four epochs."""
    return mixed(spark, table(spark, sf_dir, "documents"))


def _level(parents: str, name: str, weight: str, above: str) -> str:
    on = " AND ".join(f"c.{p} = a.{p}" for p in parents.split(", "))
    return f"""
c_{name} AS (SELECT {parents}, {name}, sum(available) * {MAX_EPOCHS} AS cap, {weight} AS weight FROM leaves GROUP BY ALL),
j_{name} AS (SELECT c.*, a.pool FROM c_{name} c JOIN {above} a ON {on}),
l_{name} AS (SELECT *, pool - coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (PARTITION BY {parents} ORDER BY cap::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM j_{name}),
f_{name} AS (SELECT *, cap * heavy <= rest * weight AS is_full FROM l_{name}),
g_{name} AS (SELECT *, pool - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {parents}), 0) AS pool_left, sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parents}) AS weight_left FROM f_{name}),
h_{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE pool_left * weight // weight_left END AS base FROM g_{name}),
i_{name} AS (SELECT *, pool_left - coalesce(sum(base) FILTER (NOT is_full) OVER (PARTITION BY {parents}), 0) AS odd, row_number() OVER (PARTITION BY {parents} ORDER BY is_full, {name}) AS place FROM h_{name}),
b_{name} AS (SELECT {parents}, {name}, base + CASE WHEN NOT is_full AND place <= odd THEN 1 ELSE 0 END AS pool FROM i_{name}),"""


ORACLE = (
    r"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'other' ELSE 'd' || (regexp_extract(source, '([0-9]{1,9})$', 1)::BIGINT // 5)::VARCHAR END AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::HUGEINT AS available FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
top AS (SELECT 0 AS root, least(sum(available) // 2, sum(available) * """
    + str(MAX_EPOCHS)
    + ") AS pool FROM leaves),"
    + _level("root", "domain", "1", "top")
    + _level("root, domain", "lang", "CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 5 END", "b_domain")
    + _level("root, domain, lang", "source", "1", "b_lang")
    + f"""
d AS (SELECT t.*, coalesce(b.pool // l.available, 0) AS whole_epochs, coalesce(b.pool % l.available, 0) AS part
  FROM t LEFT JOIN leaves l USING (domain, lang, source) LEFT JOIN b_source b ON b.domain = t.domain AND b.lang = t.lang AND b.source = t.source),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || whole_epochs::VARCHAR || '|' || doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS pos FROM d),
p AS (SELECT *, greatest(0, least(n_tokens, part - pos))::BIGINT AS part_tokens FROM o)
SELECT doc_id, domain, lang, source, n_tokens, whole_epochs::BIGINT AS whole_epochs, part_tokens, (whole_epochs * n_tokens + part_tokens)::BIGINT AS taken FROM p
"""
)
