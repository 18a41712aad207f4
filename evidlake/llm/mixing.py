"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm.common import WORD, boxed, written

# Documents that one node of the reduction tree settles among themselves, at most about.
FAN_IN = 128


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target words of each source: ``share`` of all words, dealt by weight; none above ``cap`` times its own.

    Takes one row per source (source, source_size). Sources get the weights in turn, by code point, null last.
    What a capped source can't take is dealt to the others by weight until none is above its cap. With the sources
    in the order of cap / weight, those capped are a prefix: the first whose cap is above the level that is
    left for it and all after it sets the level of them all. If all are capped, all have their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select(
        "source", "source_size",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ).alias("weight"),
        (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())).alias("total"),
        (F.lit(float(cap)) * F.col("source_size")).alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
        F.row_number().over(by_ratio).alias("nr"),
    )
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("nr", "level")))
    return levels.withColumn("level", level.over(Window.partitionBy())["level"]).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"),
    )


def draw(seed: int, *of: Column) -> Column:
    """A number from 0 to below 1 that depends on its arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def settle(items: Column, seed: int) -> Column:
    """One node of the tree: pairs the residual with each next item and moves words between the two.

    An item has doc (struct), size and mass, its fractional words. Either way the pair keeps its words, and
    the odds keep each item's expected words; one of the two ends with none or all of its words and is done, the
    other goes on as the residual. Gives done, an array of (doc, taken), and the residual.
    """
    kind = "struct<doc:struct<doc_id:bigint,source:string>,size:bigint,mass:double>"
    done = "array<struct<doc:struct<doc_id:bigint,source:string>,taken:boolean>>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(done).alias("done"))

    def end(item: Column, taken: bool) -> Column:
        return F.struct(item.doc.alias("doc"), F.lit(taken).alias("taken"))

    def left(item: Column, mass: Column) -> Column:
        return F.struct(item.doc.alias("doc"), item.size.alias("size"), mass.alias("mass"))

    def step(state: Column, x: Column) -> Column:
        r = state.rest
        give = F.least(r.size - r.mass, x.mass)  # what can go from the item to the residual
        take = F.least(r.mass, x.size - x.mass)  # and from the residual to the item
        up = draw(seed, r.doc, x.doc) * (give + take) < take
        # Which of the two is done, and with what: the one whose bound the move has met.
        r_done = F.when(up, give == r.size - r.mass).otherwise(take == r.mass)
        keep = F.when(up & r_done, left(x, x.mass - give)).when(up, left(r, r.mass + give))
        keep = keep.when(r_done, left(x, x.mass + take)).otherwise(left(r, r.mass - take))
        gone = F.when(up & r_done, end(r, True)).when(up, end(x, False)).when(r_done, end(r, False)).otherwise(end(x, True))
        return F.when(r.isNull(), F.struct(x.alias("rest"), state.done.alias("done"))).otherwise(
            F.struct(keep.alias("rest"), F.array_append(state.done, gone).alias("done"))
        )

    return F.aggregate(items, start, step)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Each document of a source is due target / source_size copies. The whole copies are sure; the fraction is
    rounded by pivotal pairing, in words: documents of a source are dealt to nodes of about ``fan_in``, which settle
    all but one of their documents; the residuals of all nodes are dealt to fewer nodes, and so on up to one
    residual per source, which is taken by chance. A source therefore misses its target by less than the size of one
    document, and small documents come last in each node so that this one tends to be small. No task holds more
    than the documents of some nodes, whatever a source's share.

    size is the number of words (null text: 0), taken is copies * size. Rows with the same doc_id and source,
    nulls included, count as one document, with their sizes added. Sources that are all empty have target 0 and take
    nothing. No documents: no rows. Reruns agree, as all draws depend on the documents alone.
    """
    sized = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = written(sized.groupBy("doc_id", "source").agg(F.sum("size").alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = targets(per_source.select("source", "source_size"), weights, share, cap)
    aims = aims.join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    aims = written(aims.withColumnRenamed("source", "s"), "mix-targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    all_docs = sized.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("whole", F.floor(due)).withColumn(
        "mass", (due - F.col("whole")) * F.col("size")
    )
    items = all_docs.where("mass > 0").select(
        "source", F.struct("doc_id", "source").alias("doc"), "size", "mass",
        F.ceil(F.col("n") / fan_in).alias("nodes"),
    )
    most = aims.agg(F.max("n")).first()[0] or 0
    depth = max(1, math.ceil(math.log(max(most, 2), fan_in)))
    done = []
    for level in range(depth):
        node = F.pmod(F.xxhash64(F.lit(seed + level), "doc"), "nodes") if level < depth - 1 else F.lit(0)
        order = F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("key"), "doc", "size", "mass"))),
            lambda x: F.struct(x.doc.alias("doc"), x.size.alias("size"), x.mass.alias("mass")),
        )
        held = items.groupBy("source", node.alias("node"), "nodes").agg(order.alias("items")).select(
            "source", "nodes", settle(F.col("items"), seed + level).alias("state")
        )
        held = written(held, f"mix-level-{level}")
        done.append(held.select(F.explode("state.done").alias("x")).select("x.doc", "x.taken"))
        items = held.select(
            "source", "state.rest.doc", "state.rest.size", "state.rest.mass",
            F.ceil(F.col("nodes") / fan_in).alias("nodes"),
        )
    # One residual a source is left.
    done.append(items.select("doc", (draw(seed, F.col("doc")) * F.col("size") < F.col("mass")).alias("taken")))
    taken = done[0]
    for more in done[1:]:
        taken = taken.unionByName(more)
    taken = taken.where("taken").select(F.col("doc.doc_id").alias("d"), F.col("doc.source").alias("s"), F.lit(1).alias("extra"))
    out = all_docs.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")), "left")
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, with their columns: each row as many times as the mix takes it."""
    copies = mix(docs, **how).where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), "copies")
    keyed = boxed(docs, docs["doc_id"].cast("long").alias("doc"), docs["source"].cast("string").alias("source"))
    found = keyed.join(copies, F.col("doc").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
