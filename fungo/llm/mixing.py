"""Mixing sources to target weights through a tree of domain, language and source.

Budgets go down the tree. At each node the budget is shared by weight; a child
that holds less than its share gives what it lacks to its siblings, and only
what no sibling can take is missing above. As a node's capacity is that of its
whole subtree, one pass from the root settles every shortage. A leaf then takes
whole epochs of its documents and a prefix, counted in tokens, of the next
epoch's seeded order.

DataFrame functions only. A leaf's order is found by a prefix sum over 4096
hash buckets; only the one bucket in which a leaf's budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

LEVELS = ("domain", "lang", "source")
#: Target weights; a name without one counts as 1.
DOMAIN_WEIGHTS = {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
BUCKET_DIGITS = 3


def default_domain(source: Column) -> Column:
    """Sources fall into four domains by the number at the end of their name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("dom"), number.try_cast("int") % 4))


def count_tokens(text: Column) -> Column:
    """Blanks and one more; none for a null or empty text."""
    return F.coalesce(F.when(text == "", 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parent: list[str], name: str, budget: str = "budget") -> DataFrame:
    """``nodes`` (parent columns, name, cap, weight, budget of the parent) with each node's own ``share``.

    Siblings in ascending order of cap / weight: as long as the water level
    covers them they are filled, and the level over the rest is the greatest of
    the levels that leaving out a filled prefix gives.
    """
    order = [F.asc_nulls_last(F.col("cap") / F.nullif(F.col("weight"), F.lit(0.0))), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*order)
    filled = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide((F.col(budget) - filled).cast("double"), open_weight)
    leveled = nodes.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    return leveled.withColumn("share", F.least(F.col("cap"), F.floor(F.greatest(F.coalesce("level", F.lit(0.0)), F.lit(0.0)) * F.col("weight")).cast("long"))).drop("level")


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``leaves`` (levels, tokens) with ``share``: tokens to draw from each."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    root = leaves.agg(F.floor(F.sum("tokens") * budget_share).cast("long").alias("budget"))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("domain"), weights.get("domain", {})))
    # one row for the whole corpus
    top = water_fill(top.join(F.broadcast(root)), [], "domain").select("domain", F.col("share").alias("budget"))
    middle = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("lang"), weights.get("lang", {})))
    middle = water_fill(middle.join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = leaves.withColumn("weight", _weight(F.col("source"), weights.get("source", {})))
    return water_fill(low.join(middle, ["domain", "lang"]), ["domain", "lang"], "source")


def with_copies(docs: DataFrame, budget_share: float = 1.0, max_epochs: int = 2, seed: int = 7, weights: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """Two struct columns: ``row``, the row of ``docs``, and ``mix``: domain, lang, source, tokens, copies (0 for documents that are not drawn).

    The budget is ``budget_share`` of all tokens. Null languages and sources are
    nodes named "none"; texts without tokens are drawn with every epoch their
    leaf gets; rows that repeat are drawn each; among rows with equal order the
    shorter comes first. An empty table gives no row.
    """
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    # the row goes into one column, so that none of its names meets one of ours
    tagged = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(domain if domain is not None else default_domain(F.col(source_col)), F.lit("none")).alias("__domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("none")).alias("__lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("none")).alias("__source"),
        count_tokens(F.col(text_col)).alias("__tokens"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
    )
    slim = stage(tagged.select(*(F.col(f"__{c}").alias(c) for c in LEVELS), F.col("__tokens").alias("tokens"), F.col("__id").alias("id")), "mix_tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, budget_share, max_epochs, weights).select(
        *LEVELS, F.least(F.lit(max_epochs), F.coalesce(F.try_divide(F.col("share"), F.col("tokens")).cast("long"), F.lit(0))).cast("int").alias("whole"), "share", F.col("tokens").alias("leaf_tokens")
    )
    plan = stage(plan.withColumn("rest", F.col("share") - F.col("whole") * F.col("leaf_tokens")).drop("share", "leaf_tokens"), "mix_plan")

    def key(whole: str, doc: str) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(whole).cast("string"), F.col(doc)))

    bucket = F.substring(key("whole", "id"), 1, BUCKET_DIGITS)
    sums = slim.join(plan, list(LEVELS)).groupBy(*LEVELS, "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before + tokens > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", "before"), F.col("bucket")).alias("edge"))
    plan = stage(plan.join(edge, list(LEVELS), "left").select(*(F.col(c).alias(f"__p_{c}") for c in LEVELS), F.col("whole").alias("__whole"), F.col("rest").alias("__rest"), F.col("edge.bucket").alias("__edge"), F.col("edge.before").alias("__before")), "mix_edges")

    same = [F.col(f"__{c}") == F.col(f"__p_{c}") for c in LEVELS]
    placed = tagged.join(plan, same).withColumn("__key", key("__whole", "__id")).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    on_edge = F.coalesce(F.col("__bucket") == F.col("__edge"), F.lit(False))
    sure = placed.where(~on_edge).withColumn("__in", F.coalesce(F.col("__bucket") < F.col("__edge"), F.lit(True)))
    running = F.sum("__tokens").over(Window.partitionBy("__domain", "__lang", "__source").orderBy("__key", "__id", "__tokens").rowsBetween(Window.unboundedPreceding, 0))
    close = placed.where(on_edge).withColumn("__in", F.col("__before") + running <= F.col("__rest"))
    copies = F.least(F.lit(max_epochs), F.col("__whole") + F.col("__in").cast("int"))
    mix = F.struct(*(F.col(f"__{c}").alias(c) for c in LEVELS), F.col("__tokens").alias("tokens"), copies.alias("copies"))
    return sure.unionByName(close).select("row", mix.alias("mix"))


def mixture(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each row of ``docs`` that is drawn: doc_id, domain, lang, source, tokens, copies."""
    return with_copies(docs, id_col=id_col, **how).where("mix.copies > 0").select(F.col("row")[id_col].alias("doc_id"), "mix.*")


def draw(docs: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, each as often as it is drawn; columns stay as they are."""
    mixed = with_copies(docs, **how).where("mix.copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("copy")).select("row.*")


#: DuckDB SQL of ``mixture`` with its defaults.
ORACLE = """
with t as (select doc_id, coalesce('dom' || cast(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as int) % 4 as varchar), 'none') as domain,
  coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
  cast(coalesce(case when text = '' then 0 else length(text) - length(replace(text, ' ', '')) + 1 end, 0) as bigint) as tokens, coalesce(cast(doc_id as varchar), '') as id from documents),
 leaf as (select domain, lang, source, cast(sum(tokens) as bigint) as tokens, cast(sum(tokens) * 2 as bigint) as cap from t group by all),
 d0 as (select domain, sum(cap) as cap, case domain when 'dom0' then 4.0::double when 'dom1' then 3 when 'dom2' then 2 else 1 end as weight, (select cast(floor(sum(tokens) * 1.0) as bigint) from leaf) as budget from leaf group by domain),
 d1 as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, domain rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by cap / weight, domain rows between current row and unbounded following) as level from d0),
 d as (select domain, least(cap, floor(greatest(max(level) over (), 0) * weight)) as budget from d1),
 l0 as (select leaf.domain, lang, sum(cap) as cap, case lang when 'en' then 4.0::double when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end as weight, any_value(budget) as budget from leaf join d on leaf.domain = d.domain group by leaf.domain, lang),
 l1 as (select *, (budget - coalesce(sum(cap) over (partition by domain order by cap / weight, lang rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (partition by domain order by cap / weight, lang rows between current row and unbounded following) as level from l0),
 l as (select domain, lang, least(cap, floor(greatest(max(level) over (partition by domain), 0) * weight)) as budget from l1),
 s0 as (select leaf.*, 1.0::double as weight, l.budget from leaf join l on leaf.domain = l.domain and leaf.lang = l.lang),
 s1 as (select *, (budget - coalesce(sum(cap) over (partition by domain, lang order by cap / weight, source rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (partition by domain, lang order by cap / weight, source rows between current row and unbounded following) as level from s0),
 s as (select domain, lang, source, tokens as leaf_tokens, cast(least(cap, floor(greatest(max(level) over (partition by domain, lang), 0) * weight)) as bigint) as share from s1),
 p as (select *, cast(least(2, case when leaf_tokens = 0 then 0 else share // leaf_tokens end) as int) as whole from s),
 k as (select t.*, whole, share - whole * leaf_tokens as rest, md5('7:' || whole || ':' || id) as key from t join p on t.domain = p.domain and t.lang = p.lang and t.source = p.source),
 r as (select *, sum(tokens) over (partition by domain, lang, source order by key, id, tokens rows between unbounded preceding and current row) as running from k),
 c as (select doc_id, domain, lang, source, tokens, cast(least(2, whole + case when running <= rest then 1 else 0 end) as int) as copies from r)
select * from c where copies > 0"""
