"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. At each node its children share
the node's budget by weight; a child that has less than its share (all its leaves' tokens times
`max_epochs`) gives the shortage to its siblings, by their weights, and only what a whole family
can't take stays with its parent's siblings. In closed form: children in the order of capacity over
weight are saturated as long as their capacity is at most their share of what the earlier ones
leave. A leaf takes whole epochs, and of the last one a prefix of its documents in the order of
md5(seed:epoch:doc_id), as long as the tokens before a document are less than the rest of its budget.

Prefixes are found without sorting a source: tokens are summed by the leading digits of the digest,
only the group where the budget ends is looked at in detail, and the selection itself is a filter
on the digest. Tokens are estimated as a quarter of the text's bytes, rounded up.

Defined results: null or empty texts have no tokens and are never selected; a null language or
source is the leaf `unknown`; nodes without a weight have weight 1, those of weight 0 get nothing;
documents with the same digest (repeated rows) share one fate; a null id is digested as `null`; a
budget beyond all capacities takes all; an empty table gives no rows; other columns are kept, whatever
their names; ids may have any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.naming import fresh
from tidewater.operators.lineage import keep

LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[tuple[str, ...], float] = {
    ("web",): 0.4, ("news",): 0.3, ("books",): 0.2, ("code",): 0.1,
    **{(d, g): w for d in ("web", "news", "books", "code") for g, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))},
}
SEED, MAX_EPOCHS, BUDGET_SHARE, DIGITS = 17, 4, 1.0, 3
#: What the driver holds is a row a leaf; with more than these it raises rather than fill up.
MOST_LEAVES = 1 << 20


def domain_of_source() -> Column:
    """web, news, books or code, by the number at the end of the source's name."""
    number = F.coalesce(F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in ("web", "news", "books", "code")]), number % 4 + 1)


def _digest(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent.., name, capacity, weight, budget of the parent) with `given`, the budget of each node."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    nodes = nodes.where("weight > 0").withColumn("full", F.col("capacity") * F.sum("weight").over(onward) <= F.col("weight") * left)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return nodes.withColumn("given", F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * rest / open_weight))


def leaf_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `given`: tokens to draw from each, epochs counted.

    The budget is `budget_share` times all tokens.
    """
    spark = leaves.sparkSession
    leaves = leaves.where("tokens > 0")
    total = leaves.agg((F.sum("tokens") * F.lit(float(budget_share))).alias("budget"))
    given = leaves.withColumn("capacity", F.col("tokens") * max_epochs).crossJoin(F.broadcast(total))  # one row
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        rows = [(*k, float(w)) for k, w in weights.items() if len(k) == depth + 1]
        nodes = given.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("budget"))
        if rows:
            nodes = nodes.join(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in path) + ", weight double"), path, "left")
        else:
            nodes = nodes.withColumn("weight", F.lit(None).cast("double"))
        nodes = _share(nodes.withColumn("weight", F.coalesce("weight", F.lit(1.0))), path[:-1], name)
        given = given.drop("budget").join(nodes.select(*path, F.col("given").alias("budget")), path)
    return given.select(*LEVELS, "tokens", F.col("budget").alias("given"))


def _leafed(docs: DataFrame, names: dict[str, str], domain: Column | None) -> DataFrame:
    unknown = F.lit("unknown")
    return docs.withColumns({
        names["domain"]: F.coalesce(domain if domain is not None else domain_of_source(), unknown),
        names["lang"]: F.coalesce("lang", unknown),
        names["source"]: F.coalesce("source", unknown),
        names["tokens"]: F.coalesce(F.floor((F.octet_length("text") + 3) / 4), F.lit(0)).cast("long"),
    })


def select_epochs(docs: DataFrame, names: dict[str, str], domain: Column | None = None, weights: dict[tuple[str, ...], float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs, a row for every epoch a document is drawn in, with the columns that `names` calls domain, lang, source, tokens and epoch."""
    spark = docs.sparkSession
    keys = list(LEVELS)
    slim = _leafed(docs.select("doc_id", "text", "lang", "source"), {k: k if k not in ("lang", "source") else f"leaf_{k}" for k in (*LEVELS, "tokens")}, domain)
    slim = slim.select("doc_id", "domain", F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), "tokens").where("tokens > 0")
    leaves = keep(slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
    if (found := leaves.count()) > MOST_LEAVES:
        raise ValueError(f"{found} leaves are too many to budget at once; the most are {MOST_LEAVES}")
    budgets = leaf_budgets(leaves, weights, budget_share, max_epochs)
    whole = F.least(F.floor((F.col("given") + 1e-6) / F.col("tokens")), F.lit(max_epochs))
    budgets = budgets.select(*keys, whole.cast("int").alias("whole"), (F.floor(F.col("given") + 1e-6) - whole * F.col("tokens")).cast("long").alias("rest"))
    # the leaves are few; as a local table their size is known, and the planner broadcasts them only while it is small
    budgets = spark.createDataFrame(budgets.toArrow())
    last = slim.join(budgets, keys).where("rest > 0").select(*keys, "rest", "tokens", _digest(F.col("whole"), seed).alias("digest"))
    grouped = last.groupBy(*keys, "rest", F.substring("digest", 1, DIGITS).alias("lead")).agg(F.sum("tokens").alias("tokens"))
    leaf = Window.partitionBy(*keys)
    running = F.sum("tokens").over(leaf.orderBy("lead").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = grouped.select(*keys, "rest", "lead", (running - F.col("tokens")).alias("before"), running.alias("after")).where("before < rest and after >= rest")
    ends = spark.createDataFrame(ends.toArrow())
    inside = last.select(*keys, "tokens", "digest", F.substring("digest", 1, DIGITS).alias("lead")).join(ends, [*keys, "lead"])
    inside = inside.groupBy(*keys, "rest", "before", "digest").agg(F.sum("tokens").alias("tokens"))
    so_far = F.col("before") + F.sum("tokens").over(leaf.orderBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    cutoff = inside.select(*keys, "digest", "rest", so_far.alias("so_far")).where("so_far < rest").groupBy(*keys).agg(F.max("digest").alias("cutoff"))
    *own, whole_, cutoff_, n_ = fresh([*docs.columns, *names.values()], *[f"leaf_{k}" for k in keys], "leaf_whole", "leaf_cutoff", "leaf_n")
    plan = budgets.join(cutoff, keys, "left").select(*[F.col(k).alias(c) for k, c in zip(keys, own, strict=True)], F.col("whole").alias(whole_), F.col("cutoff").alias(cutoff_))
    plan = spark.createDataFrame(plan.toArrow())
    marked = _leafed(docs, names, domain).where(F.col(names["tokens"]) > 0)
    met = marked.join(plan, [F.col(names[k]) == F.col(c) for k, c in zip(keys, own, strict=True)])
    more = F.coalesce(_digest(F.col(whole_), seed) <= F.col(cutoff_), F.lit(False)).cast("int")
    drawn = met.withColumn(n_, F.col(whole_) + more).where(F.col(n_) > 0).withColumn(names["epoch"], F.explode(F.sequence(F.lit(0), F.col(n_) - 1)))
    return drawn.drop(n_, whole_, cutoff_, *own)


def mix(docs: DataFrame, domain: Column | None = None, weights: dict[tuple[str, ...], float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch) of every document drawn, once for each epoch from 0."""
    names = {"domain": "domain", "lang": "leaf_lang", "source": "leaf_source", "tokens": "tokens", "epoch": "epoch"}
    drawn = select_epochs(docs.select("doc_id", "text", "lang", "source"), names, domain, weights, budget_share, max_epochs, seed)
    return drawn.select("doc_id", "domain", F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), "tokens", "epoch")


def mixed(docs: DataFrame, domain: Column | None = None, weights: dict[tuple[str, ...], float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs to train on, as often as they are drawn; the columns are those of docs."""
    wanted = (*LEVELS, "tokens", "epoch")
    names = dict(zip(wanted, fresh(docs.columns, *[f"mix_{k}" for k in wanted]), strict=True))
    drawn = select_epochs(docs, names, domain, weights, budget_share, max_epochs, seed)
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql(seed: int = SEED, max_epochs: int = MAX_EPOCHS, share: float = BUDGET_SHARE) -> str:
    def values(depth: int) -> str:
        rows = [(k, w) for k, w in WEIGHTS.items() if len(k) == depth]
        return ", ".join("(" + ", ".join(f"'{x}'" for x in k) + f", CAST({w} AS DOUBLE))" for k, w in rows)

    def level(depth: int, above: str) -> str:
        path = list(LEVELS[:depth])
        name, parent = path[-1], path[:-1]
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        joined = " AND ".join(f"n.{c} = w.{c}" for c in path)
        weight = f"LEFT JOIN (VALUES {values(depth)}) AS w({', '.join(path)}, weight) ON {joined}" if values(depth) else ""
        budget = f"(SELECT budget FROM {above} b WHERE {' AND '.join(f'b.{c} = n.{c}' for c in parent)})" if parent else f"(SELECT budget FROM {above})"
        return f"""
n{depth} AS (SELECT {', '.join('n.' + c for c in path)}, capacity, {'coalesce(weight, 1.0)' if weight else '1.0::DOUBLE'} AS weight, {budget} AS budget
  FROM (SELECT {', '.join(path)}, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS capacity FROM leaves GROUP BY ALL) n {weight}),
f{depth} AS (SELECT *, capacity * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM n{depth} WHERE weight > 0 WINDOW o AS ({part} ORDER BY capacity / weight, {name})),
g{depth} AS (SELECT {', '.join(path)}, CASE WHEN is_full THEN CAST(capacity AS DOUBLE)
    ELSE weight * (budget - coalesce(sum(capacity) FILTER (is_full) OVER ({part}), 0)) / sum(weight) FILTER (NOT is_full) OVER ({part}) END AS budget FROM f{depth})"""

    return f"""
WITH d AS (
  SELECT doc_id, coalesce(['web', 'news', 'books', 'code'][coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4 + 1], 'unknown') AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens
  FROM documents WHERE strlen(text) > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
g0 AS (SELECT sum(tokens) * CAST({share} AS DOUBLE) AS budget FROM leaves),
{level(1, 'g0')},{level(2, 'g1')},{level(3, 'g2')},
plan AS (SELECT domain, lang, source, whole, CAST(floor(budget + 1e-6) AS BIGINT) - whole * tokens AS rest FROM (
  SELECT g.*, tokens, least(CAST(floor((budget + 1e-6) / tokens) AS BIGINT), {max_epochs}) AS whole FROM g3 g JOIN leaves USING (domain, lang, source))),
hashed AS (SELECT d.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM d JOIN plan USING (domain, lang, source)),
sums AS (SELECT domain, lang, source, digest, sum(tokens) AS t FROM hashed GROUP BY ALL),
before AS (SELECT *, sum(t) OVER (PARTITION BY domain, lang, source ORDER BY digest) - t AS b FROM sums),
drawn AS (SELECT h.*, whole + CASE WHEN b < rest THEN 1 ELSE 0 END AS epochs FROM hashed h JOIN before USING (domain, lang, source, digest))
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, epochs)) AS INTEGER) AS epoch FROM drawn
"""


SQL = _sql()
