"""Set containment: which sets hold all elements of which others, and method sets by embedding.

Sets of equal elements are one class (told by count and two sums of hashes, 128 bits). A
class's supersets are sought among the sets that hold its rarest element, then its second
rarest; the rest is counted. Elements that many sets have (``Close``, ``String``) are thus
only followed for sets that have nothing rarer, and those are dealt over several keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.storage import remove, shuffles_released, stored

#: Pairs of one element that a join key holds, or so.
KEY_PAIRS = 1 << 20


def classes(sets: DataFrame) -> DataFrame:
    """set_id, class_id (the least id of the sets with equal elements) of ``sets`` (set_id, element, without repeats)."""
    signed = sets.groupBy("set_id").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("element").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "element")).alias("s2")
    )
    least = signed.groupBy("n", "s1", "s2").agg(F.min("set_id").alias("class_id"))
    return signed.join(least, ["n", "s1", "s2"]).select("set_id", "class_id")


def contained(small: DataFrame, large: DataFrame, expand: bool = True) -> DataFrame:
    """small_id, large_id of each set of ``small`` and each of ``large`` (both set_id, element) that holds all its elements.

    Repeats count once, nulls never; a set without elements isn't in the table and so in no pair. With ``expand`` false, the
    pairs are those of class representatives (see :func:`classes`).
    """
    with shuffles_released(small.sparkSession):
        return _contained(small, large, expand)


def _contained(small: DataFrame, large: DataFrame, expand: bool) -> DataFrame:
    """Tables go as soon as nothing reads them; candidates are shuffled as (small, large, second) alone, once."""
    spark, held = small.sparkSession, []
    a, b = (stored(df.select("set_id", "element").dropna().distinct(), "sets", held) for df in (small, large))
    a_class, b_class = (stored(classes(x), "set-classes", held) for x in (a, b))
    kept = lambda x, c: x.join(c.where("set_id = class_id").select("set_id"), "set_id", "left_semi")
    b_rows = stored(kept(b, b_class), "sets", held)
    remove(spark, [held.pop(1)])  # b: its representatives are all that is read from here on
    a_rows = kept(a, a_class)

    often = b_rows.groupBy("element").agg(F.count("*").alias("often"))
    rated = a_rows.join(often, "element", "left")
    key = F.struct("often", "element")
    # the two rarest, by two minima; a set with an element that no large set has is in none
    first = rated.groupBy("set_id").agg(F.count("*").alias("n"), F.count("often").alias("known"), F.min(key).alias("first")).where("n = known").drop("known")
    first = stored(first, "set-rarest", held)
    second = rated.join(first.where("n > 1"), "set_id").where(key > F.col("first")).groupBy("set_id").agg(F.min(key)["element"].alias("second"))
    keyed = stored(first.join(second, "set_id", "left").select("set_id", "n", F.col("first.element").alias("element"), F.col("first.often").alias("often"), "second"), "set-keys", held)

    loads = stored(keyed.groupBy("element").agg(F.ceil(F.sum("often") / KEY_PAIRS).cast("int").alias("splits")), "set-loads", held)
    left = keyed.join(loads, "element").withColumn("split", F.pmod(F.xxhash64("set_id"), F.col("splits")).cast("int"))
    right = b_rows.join(loads, "element").select("element", F.col("set_id").alias("large_id"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    found = lambda which: left.where(which).join(right, ["element", "split"]).select(F.col("set_id").alias("small_id"), "large_id", "second")

    member = b_rows.select(F.col("set_id").alias("large_id"), F.col("element").alias("second"))
    single = found("n = 1").select("small_id", "large_id")
    both = stored(found("n > 1").join(member, ["large_id", "second"], "left_semi").select("small_id", "large_id"), "set-candidates", held)
    counted = both.join(keyed.select(F.col("set_id").alias("small_id"), "n", "element", "second"), "small_id")
    double = counted.where("n = 2").select("small_id", "large_id")
    more = counted.where("n > 2").join(a_rows.select(F.col("set_id").alias("small_id"), F.col("element").alias("other")), "small_id").where("other <> element AND other <> second")
    more = more.join(member.withColumnRenamed("second", "other"), ["large_id", "other"], "left_semi").groupBy("small_id", "large_id", "n").agg(F.count("*").alias("held"))
    pairs = single.unionByName(double).unionByName(more.where("held = n - 2").select("small_id", "large_id"))
    if expand:
        members = lambda c, name: c.select(F.col("class_id").alias(name), F.col("set_id").alias(f"{name}_all"))
        pairs = pairs.join(members(a_class, "small_id"), "small_id").join(members(b_class, "large_id"), "large_id").select(F.col("small_id_all").alias("small_id"), F.col("large_id_all").alias("large_id"))
    out = stored(pairs, "contained")
    remove(spark, held)
    return out


def embedded(own: DataFrame, embeds: DataFrame) -> DataFrame:
    """owner, name of the members (owner, name) that owners have themselves or by what they embed (owner, part), at any depth.

    A fix-point: each round follows the newly reached parts one step; cycles end as nothing new is reached.
    """
    spark, held = own.sparkSession, []
    step = stored(embeds.select("owner", "part").dropna().distinct().where("owner <> part"), "embeds", held)
    reached = frontier = step
    while not frontier.isEmpty():
        further = frontier.join(step.select(F.col("owner").alias("part"), F.col("part").alias("next")), "part").select("owner", F.col("next").alias("part")).where("owner <> part")
        frontier = stored(further.distinct().join(reached, ["owner", "part"], "left_anti"), "embeds", held)
        reached = reached.unionByName(frontier)
    named = own.select("owner", "name")
    more = reached.join(named.select(F.col("owner").alias("part"), "name"), "part").select("owner", "name")
    out = stored(named.unionByName(more).distinct(), "method-sets")
    remove(spark, held)
    return out
