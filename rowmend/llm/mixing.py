"""Mixing sources to target weights: budgets down a tree, then a prefix of a seeded epoch per leaf."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmend.llm import tables

BUCKET_ROWS = 4_096
# Fixed value: the number of values of the first eight hex digits of a hash.
HEX8 = 4_294_967_296


@dataclass(frozen=True)
class Level:
    """One level of the tree: its name, the node of a row, and the node's weight among its siblings."""

    name: str
    node: Column
    weight: Column


def word_count(column: str) -> Column:
    """Words between white space; null and blank texts have none."""
    trimmed = F.regexp_replace(tables.text_or_empty(column), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``budget``: the parent's ``total`` over its children by ``weight``, none above ``cap``.

    Children that would get more than they have are full; what they leave goes to their
    siblings by weight. In order of cap / weight the full ones come first, so sums over
    that order find the level of the others at once. A parent with less supply than
    budget gives all it has; ``cap`` of a node is its whole subtree, so such a shortage has
    gone to the parent's siblings already. Nodes without weight get nothing.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy("ratio", "node")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    live = nodes.filter("weight > 0").withColumn("ratio", F.col("cap") / F.col("weight"))
    marked = live.withColumn("full", F.col("ratio") <= (F.col("total") - before) / weight_from)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    share = F.greatest(F.lit(0.0), (F.col("total") - used) / open_weight * F.col("weight"))
    return marked.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)))


def leaf_budgets(leaves: DataFrame, levels: list[Level], total: float) -> DataFrame:
    """``(level names, budget)``; ``leaves`` has the level names and ``cap``, tokens times epochs.

    The tables have a row per node, not per document. Each level is a window over the
    children of one node.
    """
    spark = leaves.sparkSession
    names = [level.name for level in levels]
    parents = spark.range(1).select(F.lit(float(total)).alias("total"))
    for depth in range(len(levels)):
        path = names[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{names[depth]}").alias("weight"))
        joined = nodes.join(parents, names[:depth]) if depth else nodes.crossJoin(F.broadcast(parents))
        parents = fill(joined.withColumn("node", F.col(names[depth])), names[:depth]).select(
            *path, F.col("budget").alias("total")
        )
    return parents.withColumnRenamed("total", "budget")


def mixture(
    docs: DataFrame, levels: list[Level], share: float, max_epochs: int, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
) -> DataFrame:
    """What to take of every row: ``(id, level names, n_tokens, epochs, in_prefix, copies)``.

    The budget is ``share`` of all tokens (words). Leaves give whole epochs while their budget
    lasts and then the prefix of one more epoch, in an order seeded by ``seed``, the
    epoch's number and the id: rows whose words before them in that order are below what
    is left. Texts are taken whole. Rows of a leaf with equal ids have one place in the
    order. Null texts have no words; null nodes are the node ``none``; a null id is ``none``.

    A leaf with a third of all rows is cut into buckets of the order of about
    ``BUCKET_ROWS`` rows; sums per bucket give the words before each bucket, and only
    inside a bucket rows are sorted.
    """
    names = [level.name for level in levels]
    extra = [row_col] if row_col else []
    rows = tables.written(
        docs.select(
            F.col(id_col).alias("id"), *extra, word_count(text_col).alias("n_tokens"),
            *[F.coalesce(level.node.cast("string"), F.lit("none")).alias(level.name) for level in levels],
        ),
        "mixing-rows",
    )
    leaves = rows.groupBy(*names).agg(
        F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    weighted = tables.written(
        leaves.select(
            "*", (F.col("tokens") * max_epochs).alias("cap"),
            *[level.weight.cast("double").alias(f"w_{level.name}") for level in levels],
        ),
        "mixing-leaves",
    )
    supply = weighted.agg(F.sum("tokens")).first()[0] or 0.0
    budgets = tables.written(leaf_budgets(weighted, levels, float(int(supply * share))), "mixing-budgets")
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("bigint")
    plan = weighted.join(budgets, names, "left").select(
        *names, "tokens", "rows", F.coalesce("budget", F.lit(0.0)).alias("budget")
    ).withColumn("epochs", epochs).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = plan.withColumn("buckets", F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)))
    spot = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epochs"), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    bucket = F.floor(F.conv(F.substring("spot", 1, 8), 16, 10).cast("double") * F.col("buckets") / F.lit(float(HEX8)))
    # Written, so that a leaf's rows do not stay together after the join.
    placed = tables.written(rows.join(plan, names).withColumn("spot", spot).withColumn("bucket", bucket), "mixing-placed")
    sums = placed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    earlier = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*names, "bucket", F.coalesce(F.sum("bucket_tokens").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*names, "bucket")
    upto = F.sum("n_tokens").over(inside.orderBy("spot").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("n_tokens").over(Window.partitionBy(*names, "bucket", "spot"))
    found = placed.join(starts, [*names, "bucket"]).withColumn("start", F.col("before") + upto - same)
    chosen = found.withColumn("in_prefix", (F.col("start") < F.col("left")) & (F.col("n_tokens") > 0))
    return chosen.select(
        "id", *extra, *names, "n_tokens", "epochs", "in_prefix",
        (F.col("epochs") + F.col("in_prefix").cast("bigint")).alias("copies"),
    )


def take(docs: DataFrame, levels: list[Level], share: float, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a mixture of at most one epoch leaves out, all columns as they were."""
    numbered = tables.numbered(docs, "mixing-docs")
    flat = numbered.select("whole.*", "row") if "row" not in docs.columns else numbered.select(
        *[F.col(f"whole.`{c}`").alias(f"{c}__" if c == "row" else c) for c in docs.columns], "row"
    )
    dropped = mixture(flat, levels, share, 1, seed, id_col, text_col, row_col="row").filter("copies <= 0").select("row")
    return tables.without(numbered, tables.written(dropped, "mixing-dropped"))


# The production tree over ``documents`` and its weights.
DOMAIN_WEIGHTS = {"d0": 3, "d1": 2, "d2": 2}
LANG_WEIGHTS = {"en": 6, "fr": 2, "de": 2, "es": 2}


def _weights(column: str, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in table.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out


def corpus_levels() -> list[Level]:
    """Domain (from the number of the source), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]+)$", 1).try_cast("bigint")
    return [
        Level("domain", F.concat(F.lit("d"), F.pmod(number, F.lit(3)).cast("string")), _weights("domain", DOMAIN_WEIGHTS)),
        Level("lang", F.col("lang"), _weights("lang", LANG_WEIGHTS)),
        Level("source", F.col("source"), F.lit(1)),
    ]
