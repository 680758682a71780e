"""Mixing sources to target weights by hierarchical budgeting.

A token budget is passed down a tree domain - language - source.  Below each
node it is split by the children's weights; a child that cannot use its share
(its tokens times the allowed epochs are fewer) takes all it has, and the
shortage goes to its siblings, again by weight, until the node's budget is
used.  As a node never gets more than its children hold together, a shortage
reaches the node's own siblings only when its children are exhausted.

Each leaf then fills its share with whole epochs of its documents and a prefix
of one more epoch: the documents in the order of md5(seed:epoch:doc_id), as
long as their tokens fit.  The order is cut by key ranges: token sums per
``4096`` key ranges of a leaf find the range that holds the cut, and only that
range is ordered row by row, so no leaf is sorted in one task.

What the prefixes leave unused is handed on, to siblings before ancestors: below each language the rest of its
budget pays for the leaves' next documents, the smallest first; each language then offers the smallest one left to its
domain, whose rest pays likewise, and each domain to the root.  So a node's unused tokens are always fewer than
the smallest document left that its children offer.

Tokens are runs of characters other than space and \\t-\\r.  Defined results:
a null text has no tokens; the prefix ends before
the first document, in key order, that does not fit, or with it if rest handed on pays for it, so a leaf falls
short of its budget or exceeds it by less than that document's tokens (all rows of
its id); a leaf without tokens has no budget, and none of its
documents is taken; null domain, language, source or id count as empty
text; rows with the same leaf and id are taken or left together; an empty
table gives an empty result; other columns are left alone (clashing working
names carry an underscore).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadworthy.llm.common import written

LEAF = ("domain", "lang", "source")
#: Most leaves sent to every task (about 10 MB); beyond, a leaf's documents are dealt into SALTS parts to meet them.
BROADCAST_LEAVES, SALTS = 50_000, 32


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """Domain of a source: the tens of its trailing number, halved (``src7`` in d1), else ``other``."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.floor(number.cast("int") / 5).cast("string"))).otherwise("other")


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    return F.coalesce(F.try_element_at(named, name), F.lit(1.0))


def _share(children: DataFrame, parent: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """Split each parent's budget over its children by weight, none above its cap."""
    key = [F.col(c) for c in parent]
    order = Window.partitionBy(*key).orderBy(F.col(cap) / F.col(weight), *[F.col(c) for c in LEAF if c in children.columns])
    used = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = (F.col(budget) - used) / left
    tried = children.withColumn("_rate", rate).withColumn("_full", F.col(cap) <= F.col("_rate") * F.col(weight))
    open_rate = F.max(F.when(~F.col("_full"), F.col("_rate"))).over(Window.partitionBy(*key))
    share = F.when(F.col("_full"), F.col(cap)).otherwise(F.floor(open_rate * F.col(weight)).cast("long"))
    return tried.withColumn(out, share).drop("_rate", "_full")


def budgets(leaves: DataFrame, ratio: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``budget``, ``epochs`` (whole ones) and ``rest`` (tokens of the prefix),
    and the budgets of the nodes above them (``lang_budget``, ``domain_budget``, ``total_budget``).

    The tree's budget is ``ratio`` of all tokens, at most ``max_epochs`` of them.
    """
    leaves = leaves.withColumn("_cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("_cap").alias("_cap"))
    domains = langs.groupBy("domain").agg(F.sum("_cap").alias("_cap"))
    total = leaves.agg(F.least(F.floor(F.sum("tokens") * F.lit(float(ratio))), F.sum("_cap")).cast("long")).scalar()
    weigh = lambda df, level: df.withColumn("_weight", _weight(F.col(level), weights.get(level, {})))
    domains = _share(weigh(domains.withColumn("_total", total), "domain"), [], "_total", "_cap", "_weight", "_domain_budget")
    langs = _share(weigh(langs.join(domains.select("domain", "_domain_budget", "_total"), "domain"), "lang"),
                   ["domain"], "_domain_budget", "_cap", "_weight", "_lang_budget")
    leaves = _share(weigh(leaves.join(langs.select("domain", "lang", "_lang_budget", "_domain_budget", "_total"), ["domain", "lang"]), "source"),
                    ["domain", "lang"], "_lang_budget", "_cap", "_weight", "budget")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    return leaves.withColumn("epochs", whole).select(
        *LEAF, "tokens", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"),
        F.col("_lang_budget").alias("lang_budget"), F.col("_domain_budget").alias("domain_budget"), F.col("_total").alias("total_budget"))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _meet(rows: DataFrame, leaves: DataFrame, leaf: list[str]) -> DataFrame:
    """Rows joined to their leaf (``leaves`` is a written table, so counting it is cheap)."""
    if leaves.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaves), leaf)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    leaves = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(leaves, [*leaf, "_salt"]).drop("_salt")


def cuts(tokens: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """(leaf, cut, used, next_key, next_tokens): the last order key that the leaf's prefix takes, the prefix's tokens, and
    the first key that does not fit with its tokens; leaves without a prefix are left out."""
    keyed = (
        _meet(tokens, shares.where(F.col("rest") > 0).select(*LEAF, "epochs", "rest"), list(LEAF))
        .select(*LEAF, "rest", "n_tokens", order_key(F.col("doc_id"), F.col("epochs"), seed).alias("_key"))
        .withColumn("_range", F.substring("_key", 1, 3))
    )
    sums = keyed.groupBy(*LEAF, "rest", "_range").agg(F.sum("n_tokens").alias("_sum"))
    in_order = Window.partitionBy(*LEAF).orderBy("_range")
    ends = sums.withColumn("_end", F.sum("_sum").over(in_order)).where(F.col("_end") > F.col("rest"))
    first = ends.groupBy(*LEAF).agg(F.min(F.struct("_range", (F.col("_end") - F.col("_sum")).alias("_start"))).alias("_cut"))
    first = first.select(*LEAF, F.col("_cut._range").alias("_range"), F.col("_cut._start").alias("_start"))
    by_key = Window.partitionBy(*LEAF, "_range").orderBy("_key")
    last = (
        keyed.join(first, [*LEAF, "_range"])
        .groupBy(*LEAF, "_range", "_start", "rest", "_key").agg(F.sum("n_tokens").alias("_sum"))
        .withColumn("_end", F.col("_start") + F.sum("_sum").over(by_key))
        .withColumn("_fits", F.col("_end") <= F.col("rest"))
        .groupBy(*LEAF, "_range", "_start").agg(
            F.max(F.when(F.col("_fits"), F.col("_key"))).alias("_last"), F.max(F.when(F.col("_fits"), F.col("_end"))).alias("_used"),
            F.min(F.when(~F.col("_fits"), F.col("_key"))).alias("next_key"), F.min(F.when(~F.col("_fits"), F.col("_end"))).alias("_next"))
        .withColumn("used", F.coalesce("_used", "_start"))
    )
    return last.select(*LEAF, F.coalesce("_last", "_range").alias("cut"), "used", "next_key", (F.col("_next") - F.col("used")).alias("next_tokens"))


def _pay(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Children (``taken``, ``offer``) with ``paid``: whether the parent's rest reaches their offer, the smallest first."""
    node = Window.partitionBy(*[F.col(c) for c in parent])
    order = node.orderBy(F.col("offer").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.col(budget) - F.sum("taken").over(node)
    return children.withColumn("paid", F.col("offer").isNotNull() & (F.sum("offer.n").over(order) <= rest))


def hand_on(leaves: DataFrame) -> DataFrame:
    """(leaf): leaves whose next document is paid for by what is left unused, first below their language, then their domain, then the root.

    Above the leaves a node has one offer, the smallest of its children's that was not paid, so a task orders a node's children.
    """
    offer = F.struct(F.col("next_tokens").alias("n"), *LEAF)
    rows = leaves.withColumn("taken", F.col("epochs") * F.col("tokens") + F.coalesce("used", F.lit(0))).withColumn(
        "offer", F.when(F.col("next_key").isNotNull(), offer))
    levels = []
    for parent, budget, above in ((["domain", "lang"], "lang_budget", ["domain_budget", "total_budget"]),
                                  (["domain"], "domain_budget", ["total_budget"]), ([], "total_budget", [])):
        rows = _pay(rows, parent, budget)
        levels.append(rows.where("paid").select("offer.*"))
        if parent:
            rows = rows.groupBy(*parent).agg(
                F.sum(F.col("taken") + F.when(F.col("paid"), F.col("offer.n")).otherwise(0)).alias("taken"),
                F.min(F.when(~F.col("paid"), F.col("offer"))).alias("offer"), *[F.max(c).alias(c) for c in above])
    return levels[0].unionByName(levels[1]).unionByName(levels[2]).select(*LEAF)


def plan(docs: DataFrame, ratio: float, max_epochs: int, seed: int,
         weights: Mapping[str, Mapping[str, float]] | None = None, domain: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents' leaf, id and tokens; leaves with budget, epochs, rest and cut, which counts what was handed on).

    ``docs`` needs doc_id, text, lang and source; ``weights`` maps a level's
    name to its nodes' weights (1 where not named); ``domain`` derives a
    document's domain.
    """
    for level, named in (weights or {}).items():
        if level not in LEAF or any(not w > 0 for w in named.values()):
            raise ValueError("weights are positive and given by domain, lang or source")
    if ratio < 0 or max_epochs < 1:
        raise ValueError("ratio must not be negative; at least one epoch")
    leaf = {"domain": source_domain(F.col("source")) if domain is None else domain, "lang": F.col("lang"), "source": F.col("source")}
    tokens = written(
        docs.select("doc_id", *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in leaf.items()],
                    token_count(F.col("text")).alias("n_tokens")), "mix-tokens")
    leaves = tokens.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    shares = written(budgets(leaves, ratio, max_epochs, weights or {}), "mix-shares")
    cut = written(shares.join(cuts(tokens, shares, seed), list(LEAF), "left"), "mix-cuts")
    paid = hand_on(cut).withColumn("_paid", F.lit(True))
    leaves = cut.join(paid, list(LEAF), "left").withColumn("cut", F.when(F.col("_paid"), F.col("next_key")).otherwise(F.col("cut")))
    return tokens, written(leaves.drop("_paid"), "mix-leaves")


def copies(df: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Rows with leaf and doc_id joined to their leaf: how often each is taken (``copies``), none if never."""
    prefix = (order_key(F.col("doc_id"), F.col("epochs"), seed) <= F.col("cut")).cast("int")
    taken = _meet(df, leaves.select(*LEAF, "epochs", "cut"), list(LEAF)).withColumn(
        "copies", F.col("epochs") + F.coalesce(prefix, F.lit(0)))
    return taken.where("copies > 0").drop("epochs", "cut")


def mix(docs: DataFrame, ratio: float, max_epochs: int = 1, seed: int = 7,
        weights: Mapping[str, Mapping[str, float]] | None = None, domain: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs``, all their columns, each as often as it was taken."""
    _, leaves = plan(docs, ratio, max_epochs, seed, weights, domain)
    leaves = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEAF], "epochs", "cut")
    names = docs.columns
    leaf = {"_domain": source_domain(F.col("source")) if domain is None else domain, "_lang": F.col("lang"), "_source": F.col("source")}
    keyed = docs.withColumns({k: F.coalesce(c.cast("string"), F.lit("")) for k, c in leaf.items()})
    # The epochs and cut of a row's leaf; working names carry an underscore.
    leaves = leaves.withColumnsRenamed({"epochs": "_epochs", "cut": "_cut"})
    prefix = (order_key(F.col("doc_id"), F.col("_epochs"), seed) <= F.col("_cut")).cast("int")
    taken = _meet(keyed, leaves, list(leaf)).withColumn("_copies", F.col("_epochs") + F.coalesce(prefix, F.lit(0)))
    if max_epochs == 1:
        return taken.where("_copies > 0").select(*names)
    return taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)
