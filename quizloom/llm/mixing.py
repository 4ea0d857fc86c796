"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Leaves of the tree are (domain, language, source). Bottom-up, a node can give what its leaves hold,
times the epochs allowed. Top-down, a node's budget is split among its children by weight; children
that can't take their share are filled, and what they leave goes to their siblings. Since a node
never gets more than its subtree can give, a shortage reaches the ancestors only when no sibling
is left. Splits are in whole tokens and sum to the budget exactly.

A leaf with T tokens and an allotment of e * T + r tokens gives e whole epochs, and of the next one
the first r tokens in the seeded order of that epoch: md5 of seed, epoch and id (of a row without an id,
of its text's md5). Where a leaf's
prefix ends is found without sorting the leaf: rows fall into buckets by the hash's first digits,
bucket sums are accumulated per leaf, and only inside a bucket are rows ordered.

Nulls in domain, language or source are the empty string; a null text has no tokens. Repeated rows count as often as they occur. An empty table gives an
empty result. Weights are whole numbers; children without one have weight 1; weight 0 gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm.common import WORD, materialise

#: Rows of a leaf that a bucket is to hold; a bucket is a group of one task.
BUCKET_ROWS = 4096


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_budget(nodes: DataFrame, parent: list[str], name: str, budget: Column) -> DataFrame:
    """nodes (name, weight, room) with share: each parent's budget over its children, none beyond its room.

    In order of room over weight, a child is full if its part of what is left is more than its room.
    The first that isn't sets the rate for all after it.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("room") / F.col("weight")).asc(), F.col(name).asc())
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns(
        {
            "budget": budget,
            "filled": F.coalesce(F.sum("room").over(past), F.lit(0)),
            "weights": F.sum("weight").over(after),
            "ahead": F.coalesce(F.sum("weight").over(past), F.lit(0)),
        }
    )
    big = lambda c: F.col(c).cast("decimal(19,0)")
    full = big("room") * big("weights") <= F.greatest(big("budget") - big("filled"), F.lit(0)) * big("weight")
    nodes = nodes.withColumn("full", full)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumns(
        {
            "at": F.min(F.when(~F.col("full"), F.col("ahead"))).over(whole),
            "left": F.max(F.when(~F.col("full"), F.greatest(F.col("budget") - F.col("filled"), F.lit(0)))).over(whole),
            "open": F.max(F.when(~F.col("full"), F.col("weights"))).over(whole),
        }
    )
    cut = lambda w: F.expr(f"cast((cast(left as decimal(19,0)) * cast({w} as decimal(19,0))) div cast(open as decimal(19,0)) as bigint)")
    part = cut("(ahead - at + weight)") - cut("(ahead - at)")
    nodes = nodes.withColumn("share", F.when(F.col("full") | F.col("at").isNull() | (F.col("ahead") < F.col("at")), F.col("room")).otherwise(part))
    return nodes.drop("filled", "weights", "ahead", "full", "at", "left", "open", "budget")


def weight_of(weights: dict[str, int], key: Column) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), F.lit(1)).cast("long")


def leaf_budgets(leaves: DataFrame, budget: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (domain, language, source, total) with allotment, in tokens."""
    leaves = leaves.withColumns({"room": F.col("total") * epochs, "weight": weight_of(weights.get("source", {}), F.col("source"))})
    leaves = leaves.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(0))
    some = lambda nodes: nodes.where("weight > 0 and room > 0")
    leaves = some(leaves)
    languages = leaves.groupBy("domain", "language").agg(F.sum("room").alias("room")).withColumn("weight", weight_of(weights.get("language", {}), F.col("language")))
    languages = some(languages)
    domains = languages.groupBy("domain").agg(F.sum("room").alias("room")).withColumn("weight", weight_of(weights.get("domain", {}), F.col("domain")))
    domains = some(domains).withColumn("all", F.lit(0))
    domains = split_budget(domains, ["all"], "domain", F.least(F.lit(budget).cast("long"), F.sum("room").over(Window.partitionBy("all"))))
    languages = split_budget(languages.join(domains.select("domain", F.col("share").alias("given")), "domain"), ["domain"], "language", F.col("given"))
    leaves = leaves.join(languages.select("domain", "language", F.col("share").alias("given")), ["domain", "language"])
    leaves = split_budget(leaves, ["domain", "language"], "source", F.col("given"))
    return leaves.select("domain", "language", "source", "total", F.col("share").alias("allotment"))


def leaf_columns(domain: Column, lang_col: str, source_col: str) -> dict[str, Column]:
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return {"domain": plain(domain), "language": plain(F.col(lang_col)), "source": plain(F.col(source_col))}


def order_of(seed: str, passes: Column, id_: Column, text: Column) -> Column:
    """A row's place in the epoch after its passes."""
    nameless = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), passes.cast("string"), F.coalesce(id_.cast("long").cast("string"), nameless)).cast("binary"))


def taken(docs: DataFrame, domain: Column, budget_share: float, epochs: int, weights: dict[str, dict[str, int]], seed: str = "0", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs, as they are, of which the mix takes a part at least; of equal rows all, if one.

    In a leaf these are all rows, or those with words up to a last one in the epoch's order. So a row per
    leaf is joined, and no text passes an exchange.
    """
    leaf, inner = leaf_columns(domain, lang_col, source_col), F.xxhash64(text_col)
    chosen = mixed(docs.withColumn("__row", inner), domain, budget_share, epochs, weights, seed, id_col, text_col, lang_col, source_col, row_col="__row")
    place = F.struct("order", F.col(id_col).cast("long").alias("id"), F.col("__row").alias("row"))
    last = chosen.groupBy(*leaf).agg(F.max("passes").alias("__passes"), F.max(F.when(F.col("prefix_tokens") > 0, place)).alias("__last"))
    last = materialise(last, "last").withColumnsRenamed({c: f"__{c}" for c in leaf})
    own = docs.withColumns({f"__own_{c}": of for c, of in leaf.items()})
    both = own.join(last, [F.col(f"__own_{c}") == F.col(f"__{c}") for c in leaf])
    order = order_of(seed, F.col("__passes"), F.col(id_col), F.col(text_col))
    place = F.struct(order.alias("order"), F.col(id_col).cast("long").alias("id"), inner.alias("row"))
    words = F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    return both.where((F.col("__passes") > 0) | (words & (place <= F.col("__last")))).select(*docs.columns)


def mixed(docs: DataFrame, domain: Column, budget_share: float, epochs: int, weights: dict[str, dict[str, int]], seed: str = "0", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """A row per row of docs that is chosen: id, domain, language, source, n_tokens, passes (whole
    epochs) and prefix_tokens (tokens taken in the epoch after those).

    The budget is budget_share of all tokens. row_col, a key of the rows, orders rows of equal ids; it and order are kept.
    """
    key = [row_col] if row_col else []
    # The text that orders a row without an id; only its digest is kept.
    nameless = F.when(F.col(id_col).cast("long").isNull(), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    own = leaf_columns(domain, lang_col, source_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *(c.alias(n) for n, c in own.items()), tokens(F.col(text_col)).alias("n_tokens"), nameless.alias("nameless"), *key)
    rows = materialise(rows, "tokens")
    leaf = ["domain", "language", "source"]
    leaves = materialise(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n")), "leaves")
    budget = int((leaves.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]) * budget_share)
    given = leaf_budgets(leaves.drop("n"), budget, epochs, weights).join(leaves.select(*leaf, "n"), leaf)
    given = given.withColumns({"passes": F.expr("allotment div total"), "rest": F.expr("allotment % total"), "buckets": F.expr(f"1 + n div {BUCKET_ROWS}")})
    given = materialise(given.where("allotment > 0").select(*leaf, "passes", "rest", "buckets"), "given")
    rows = rows.join(given, leaf).withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), F.col("passes").cast("string"), F.coalesce(F.col("id").cast("string"), "nameless")).cast("binary")))
    # The first 28 bits of the order, cut into as many equal ranges as the leaf has buckets.
    rows = rows.withColumn("bucket", F.expr("(cast(conv(substring(order, 1, 7), 16, 10) as bigint) * buckets) div 268435456"))
    sums = rows.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("here"))
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select(*leaf, "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base")), "buckets")
    inside = Window.partitionBy(*leaf, "bucket").orderBy("order", "id", *key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*leaf, "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    taken = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    rows = rows.withColumn("prefix_tokens", taken).where("passes > 0 or prefix_tokens > 0")
    return rows.select(F.col("id").alias(id_col), *leaf, "n_tokens", "passes", "prefix_tokens", *key, *(["order"] if key else []))
