"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree of domain, language and source. At each node it is split among
the children by weight; a child that can't use its share (all its epochs hold fewer tokens) takes
what it can, and the rest goes to its siblings by their weights. Only what a whole family can't use has
stayed with the family's own siblings, one level up, as a node never gets more than its subtree can use:
what lies below a weight of 0 doesn't count. Tokens that rounding leaves over go one by one to the
children with the largest remainders.
A leaf reads its documents in epochs, each in its own seeded order, and takes them until its
budget is reached: whole epochs, then a prefix of one more.

Budgets are windows over the nodes of the tree. Prefixes come from sums over the leading hex digits
of the order key, twice 256 of them, so that only documents in the one slice where the budget ends
are ever sorted: a leaf with a third of all rows is no large group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import durable, release

LEVELS = ("domain", "lang", "source")
#: Production parameters. Weights are whole numbers; what isn't named weighs 1.
DOMAINS = ("web", "books", "reference")
WEIGHTS = {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
#: Share of all tokens that the mix has, how often a document may be read, seed of the orders.
SHARE_PERCENT, MAX_EPOCHS, SEED = 60, 2, 17
#: Name of a node whose level is null.
NONE = "(none)"


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\t-\r]+")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: the number at its end, modulo the number of domains; without one, the first."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % len(DOMAINS)
    return F.get(F.array(*map(F.lit, DOMAINS)), n)


def _weight(level: str, weights: dict) -> Column:
    """Weight of the node of this level; ValueError unless all are whole numbers from 0 on."""
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        if w != int(w) or w < 0:
            raise ValueError(f"weight of {level} {name} must be a whole number, 0 or more: {w}")
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(19,0)")


def split_budget(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each child from ``total`` (its parent's), ``capacity`` and ``weight``, all decimals.

    In the order of capacity for weight, the children that are filled come first; the k-th is filled if what
    is left after those before it gives it at least its capacity. The others share the rest, rounded down;
    the tokens left over, fewer than these children, go to the largest remainders, then by name.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    before = family.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    x = children.where("weight > 0").withColumns({"_c": whole(F.coalesce(F.sum("capacity").over(before), zero)), "_w": whole(F.coalesce(F.sum("weight").over(before), zero)), "_all": whole(F.sum("weight").over(family))})
    x = x.withColumn("_full", F.col("capacity") * (F.col("_all") - F.col("_w")) <= F.col("weight") * (F.col("total") - F.col("_c")))
    filled = lambda c: whole(F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(family), zero))
    x = x.withColumns({"_fc": filled("capacity"), "_fw": filled("weight")})
    x = x.withColumns({"_part": F.expr("cast(case when not _full then (weight * (total - _fc)) div nullif(_all - _fw, 0) end as decimal(38,0))"), "_rest": F.expr("case when not _full then (weight * (total - _fc)) % nullif(_all - _fw, 0) end")})
    turn = family.orderBy(F.col("_rest").desc_nulls_last(), name)
    over = F.col("total") - F.col("_fc") - whole(F.coalesce(F.sum("_part").over(family), zero))
    x = x.withColumns({"_over": over, "_turn": F.row_number().over(turn)})
    part = whole(F.col("_part") + (F.col("_turn") <= F.col("_over")).cast("int"))
    return x.withColumn("budget", F.when(F.col("_full"), whole(F.col("capacity"))).otherwise(part)).drop("_c", "_w", "_all", "_full", "_fc", "_fw", "_part", "_rest", "_over", "_turn", "total")


def budgets(leaves: DataFrame, total: Column, weights: dict) -> DataFrame:
    """Leaf budgets from ``tokens`` of each leaf; ``capacity`` is what all its epochs hold.

    A leaf with a weight of 0 at any level adds nothing to what the nodes above it can use.
    """
    used = reduce(lambda a, b: a & b, ((_weight(level, weights) > 0) for level in LEVELS))
    usable = leaves.withColumn("capacity", F.when(used, F.col("capacity")).otherwise(0))
    node = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        here = usable.groupBy(*path).agg(F.sum("capacity").cast("decimal(19,0)").alias("capacity")).withColumn("weight", _weight(level, weights))
        here = here.withColumn("total", total) if node is None else here.join(node.select(*path[:-1], F.col("budget").alias("total")), path[:-1])
        above, node = node, durable(split_budget(here, path[:-1], level))
        release(above)
    return leaves.join(node.select(*LEVELS, F.col("budget").cast("long").alias("budget")), list(LEVELS))


def _boundary(rows: DataFrame, leaf: list[str], slice_: str, rest: str) -> DataFrame:
    """For each leaf the slice in which the running sum passes ``rest``, and the sum before it."""
    w = Window.partitionBy(*leaf).orderBy(slice_)
    sums = rows.groupBy(*leaf, slice_, rest).agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(w))
    over = sums.where(F.col("upto") > F.col(rest)).groupBy(*leaf).agg(F.min(F.struct(F.col(slice_).alias("at"), (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
    return over.select(*leaf, F.col("b.at").alias("_at"), F.col("b.before").alias("_before"))


def mix(
    docs: DataFrame,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    weights: dict | None = None,
    share_percent: int = SHARE_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``id_col``, ``domain``, ``lang``, ``source``, ``n_tokens``, ``copies`` of each document in the mix.

    The budget is ``share_percent`` of all tokens (words), rounded down. ``copies`` is how many epochs the
    document is read in; documents that aren't read are left out. Null languages and sources are the
    node ``(none)``. Null and empty texts have no tokens and are read with the prefix in which their
    turn comes. Rows of one leaf with equal ids have one turn and are read together or not at all, and so
    have null ids. Nodes with weight 0 get nothing. An empty table gives an empty result; other
    columns are ignored.
    """
    domain = domain_of(F.col(source_col)) if domain is None else domain
    leaf = list(LEVELS)
    named = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), F.coalesce(lang_col, F.lit(NONE)).alias("lang"), F.coalesce(source_col, F.lit(NONE)).alias("source"), count_words(F.col(text_col)).alias("tokens"))
    rows = durable(named.withColumn("domain", F.coalesce("domain", F.lit(NONE))))
    leaves = durable(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * max_epochs))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * share_percent // 100
    plan = budgets(leaves, F.lit(total).cast("decimal(38,0)"), WEIGHTS if weights is None else weights)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)))
    plan = durable(plan.select(*leaf, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest")))

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    x = rows.join(plan, leaf).withColumn("key", key).withColumns({"s1": F.substring("key", 1, 2), "s2": F.substring("key", 3, 2)})
    x = durable(x)
    b1 = durable(_boundary(x, leaf, "s1", "rest"))
    # Leaves whose budget is never passed have no boundary: all of their documents are read.
    x = x.join(b1, leaf, "left").withColumn("left", F.col("rest") - F.coalesce("_before", F.lit(0)))
    edge = x.where(F.col("s1") == F.col("_at")).drop("_at", "_before")
    sure = x.select("id", *leaf, "tokens", "epochs", (F.col("_at").isNull() | (F.col("s1") < F.col("_at"))).cast("long").alias("more")).where(x["_at"].isNull() | (x["s1"] != x["_at"]))
    b2 = durable(_boundary(edge, leaf, "s2", "left"))
    y = edge.join(b2, leaf, "left").withColumn("left", F.col("left") - F.coalesce("_before", F.lit(0)))
    last = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inner = y.where(F.col("s2") == F.col("_at")).select("id", *leaf, "tokens", "epochs", (F.sum("tokens").over(last) <= F.col("left")).cast("long").alias("more"))
    outer = y.where(F.col("_at").isNull() | (F.col("s2") != F.col("_at"))).select("id", *leaf, "tokens", "epochs", (F.col("_at").isNull() | (F.col("s2") < F.col("_at"))).cast("long").alias("more"))
    out = sure.unionByName(inner).unionByName(outer).withColumn("copies", (F.col("epochs") + F.col("more")).cast("long"))
    return out.where("copies > 0").select(F.col("id").alias(id_col), *leaf, F.col("tokens").alias("n_tokens"), "copies")


def take_mix(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is read; all columns."""
    lang, source = parameters.get("lang_col", "lang"), parameters.get("source_col", "source")
    picked = mix(docs, id_col=id_col, **parameters).select(F.col(id_col).alias("_id"), F.col("lang").alias("_l"), F.col("source").alias("_s"), "copies").groupBy("_id", "_l", "_s").agg(F.max("copies").alias("_copies"))
    # Under other names, so that no column of the documents is taken for one of the mix.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    x = docs.toDF(*own.values())
    same = x[own[id_col]].eqNullSafe(picked["_id"]) & (F.coalesce(own[lang], F.lit(NONE)) == picked["_l"]) & (F.coalesce(own[source], F.lit(NONE)) == picked["_s"])
    return x.join(picked, same).select(*own.values(), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_n")).drop("_n").toDF(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _level_sql(out: str, path: list[str], parent: str, weight: str) -> str:
    """One level of the tree: the same rule as ``split_budget``."""
    name, up = path[-1], ", ".join(path[:-1])
    by = f"partition by {up}" if up else ""
    total = f"(select total from {parent})" if not up else "total"
    source = f"select {', '.join(path)}, sum(capacity)::hugeint as capacity, {weight}::hugeint as weight from leaves group by {', '.join(path)}"
    if up:
        source = f"select c.*, p.budget as total from ({source}) c join {parent} p using ({up})"
    return (
        f"{out}_a as (select *, {total} as t, coalesce(sum(capacity) over b, 0) as c, coalesce(sum(weight) over b, 0) as w, sum(weight) over ({by}) as wa from ({source}) "
        f"window b as ({by} order by capacity / weight, {name} rows between unbounded preceding and 1 preceding)), "
        f"{out}_b as (select *, capacity * (wa - w) <= weight * (t - c) as f from {out}_a), "
        f"{out}_c as (select *, coalesce(sum(capacity) filter (f) over ({by}), 0) as fc, coalesce(sum(weight) filter (f) over ({by}), 0) as fw from {out}_b), "
        f"{out}_d as (select *, case when not f then (weight * (t - fc)) // nullif(wa - fw, 0) end as part, case when not f then (weight * (t - fc)) % nullif(wa - fw, 0) end as rem from {out}_c), "
        f"{out}_e as (select *, t - fc - coalesce(sum(part) over ({by}), 0) as ov, row_number() over ({by} order by rem desc nulls last, {name}) as turn from {out}_d), "
        f"{out} as (select {', '.join(path)}, case when f then capacity else part + (turn <= ov)::int end::hugeint as budget from {out}_e)"
    )


def _weight_sql(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[level].items()) + " else 1 end" if level in WEIGHTS else "1"


OP3_SQL = (
    "with named as (select doc_id, list_extract(['web', 'books', 'reference'], (coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int), 0) % 3 + 1)::bigint) as domain, "
    f"coalesce(lang, '{NONE}') as lang, coalesce(source, '{NONE}') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as tokens from documents), "
    f"leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, sum(tokens)::bigint * {MAX_EPOCHS} as capacity from named group by all), "
    f"root as (select coalesce(sum(tokens), 0)::hugeint * {SHARE_PERCENT} // 100 as total from leaves), "
    + ", ".join(_level_sql(f"l{i}", list(LEVELS[: i + 1]), "root" if i == 0 else f"l{i - 1}", _weight_sql(level)) for i, level in enumerate(LEVELS))
    + ", plan as (select domain, lang, source, coalesce(l2.budget // nullif(tokens, 0), 0) as epochs, l2.budget - coalesce(l2.budget // nullif(tokens, 0), 0) * tokens as rest from leaves join l2 using (domain, lang, source)), "
    f"turn as (select n.*, epochs, rest, md5('{SEED}|' || epochs || '|' || coalesce(doc_id::varchar, '')) as key from named n join plan using (domain, lang, source)), "
    "summed as (select *, sum(tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) <= rest as more from turn) "
    "select doc_id, domain, lang, source, tokens::bigint as n_tokens, (epochs + more::int)::bigint as copies from summed where epochs + more::int > 0"
)
