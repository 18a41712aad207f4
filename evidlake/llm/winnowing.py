"""Document fingerprints by winnowing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.functions.running import previous
from evidlake.llm.common import texts, written

# Units are words, cut every eight characters, so that texts without blanks have many units too.
UNIT = r"([^\x20\x09-\x0D]{1,8})"
GRAM, WINDOW = 3, 4
# A selected gram is one long: 38 bits of hash above 25 bits of position, counted down so that of equal hashes the
# rightmost is the smallest number.
PLACES = 25
# Documents ids that are ordered together, and such ranges whose order is found together.
RANGE = 1000


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(1))


def gram_keys(own: Column, k: int = GRAM) -> Column:
    """One number for each k-gram of units, from the chained hashes of its units. Fewer units: one gram of them all."""
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(own, i + j) for j in range(k)]), 64 - 38)
    last = F.greatest(F.size(own) - k, F.lit(0))
    keys = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.shiftleft(hashed(i), PLACES) + (F.lit((1 << PLACES) - 1) - i)
    )
    return F.when(F.size(own) > 0, keys).otherwise(F.array().cast("array<bigint>"))


def winnow(keys: Column, w: int = WINDOW) -> Column:
    """The smallest key of every window of w grams, each once, in the order of positions. Fewer grams: one window."""
    windows = F.slice(keys, 1, F.greatest(F.size(keys) - w + 1, F.least(F.size(keys), F.lit(1))))
    least = F.transform(windows, lambda x, i: F.least(x, *[F.get(keys, i + j) for j in range(1, w)]))
    return F.array_distinct(least)


def with_selected(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the selected grams of a text column. Each step is a column of its own, so none is computed twice."""
    keep = [c for c in df.columns if c != name]
    stepped = df.select(*keep, units(F.col(text)).alias("__units"))
    stepped = stepped.select(*keep, gram_keys(F.col("__units")).alias("__keys"))
    return stepped.select(*keep, winnow(F.col("__keys")).alias(name))


def selection(selected: Column) -> Column:
    """Selected grams as structs of hash and position (of the gram's first unit, from 0)."""
    return F.transform(
        selected,
        lambda x: F.struct(
            F.shiftright(x, PLACES).alias("hash"),
            (F.lit((1 << PLACES) - 1) - x.bitwiseAND((1 << PLACES) - 1)).cast("int").alias("position"),
        ),
    )


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, PLACES)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes of two sets; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint: hash and position of the grams that winnowing selects in the whole text (null: empty).

    Texts that share a run of at least GRAM + WINDOW - 1 units share a selected gram. Of equal hashes in a window
    the rightmost counts. A text has up to 2^25 units. Empty or blank texts have an empty fingerprint; rows with
    the same doc_id or a null one are treated each on its own. No rows: no rows.
    """
    return with_selected(texts(docs), "text", "s").select("doc_id", selection(F.col("s")).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, selected (grams), next_text and next_selected: those of the following document.

    The order is that of doc_id (null first), then text; after the last comes the first, for a single document itself.
    Ids are cut into ranges: a window orders each of them, and its last document gets the first of the following range.
    Texts are shuffled once, by range.
    """
    found = texts(docs).withColumn("range", F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(-(1 << 62))))
    ranges = written(
        docs.select(F.coalesce(F.floor(docs["doc_id"].cast("long") / RANGE), F.lit(-(1 << 62))).alias("range")).distinct(), "ranges"
    )
    last = ranges.agg(F.max("range")).first()[0]
    before = previous(
        ranges.withColumn("__level", F.floor(F.col("range") / RANGE)), [], [("__level", True)], ["range"],
        {"before": F.col("range")},
    ).select(F.col("range").alias("r"), F.coalesce("before", F.lit(last)).alias("before"))
    before = written(before, "ranges-before")
    dealt = found.repartition("range").sortWithinPartitions("range", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    heads = dealt.withColumn("n", F.row_number().over(order)).where("n = 1").join(before, F.col("range") == F.col("r")).select(
        F.col("before").alias("at"), F.col("text").alias("head_text")
    )
    heads = with_selected(heads, "head_text", "head_selected")
    rows = with_selected(dealt, "text", "selected").select(
        "*", F.lead("text").over(order).alias("lead_text"), F.lead("selected").over(order).alias("lead_selected")
    )
    joined = rows.join(heads, (F.col("range") == F.col("at")) & F.col("lead_text").isNull(), "left")
    return joined.select(
        "doc_id", "text", "selected", F.coalesce("lead_text", "head_text").alias("next_text"),
        F.coalesce("lead_selected", "head_selected").alias("next_selected"),
    )


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """Each document beside its edited text, whose last 1/share of code points is replaced by the next one's first.

    Gives doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (digests of the selected grams with
    their positions: equal texts have equal ones), near_edited, near_next, and the selected grams.
    """
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    found = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "selected", "next_selected",
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"),
    )
    found = with_selected(found, "edited", "edited_selected").select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "selected", "edited_selected",
        hashes(F.col("selected")).alias("a"), hashes(F.col("edited_selected")).alias("b"), hashes(F.col("next_selected")).alias("c"),
    )
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", digest("selected").alias("fingerprint"),
        digest("edited_selected").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
