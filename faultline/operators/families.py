"""Incidents of different signatures that say nearly the same, within chains of overlapping times.

Each incident's wording is a set of words. Equal wordings of a chain are one node, so a storm of alike
incidents is one row before any join. Two nodes meet only where they share one of their rarest words: of a set of
``s`` words that has to share ``r`` with another, any ``s - r + 1`` hold a shared one, and the rarest are taken
(prefix filter). So the search is exact, and a word that every wording holds brings nobody together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import message_template, top_frame
from faultline.session import stored

CHAIN = ("service", "group_start")


def wording(error_type: Column, stack_trace: Column, endpoint: Column, message: Column) -> Column:
    """Text whose words are compared: error type, innermost frame, endpoint and message template."""
    return F.concat_ws(" ", error_type, top_frame(stack_trace), endpoint, message_template(message))


def words_of(text: Column) -> Column:
    """Distinct words of ``text`` in order; none for NULL and blank text."""
    words = F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda word: word != "")))


def _with_rare_words(nodes: DataFrame, percent: int) -> DataFrame:
    """Nodes with ``rare``: the words of which one is shared with every node similar enough, rarest first."""
    each = nodes.select(*CHAIN, "words", F.explode("words").alias("word"))
    counts = each.groupBy(*CHAIN, "word").agg(F.count(F.lit(1)).alias("holders"))
    ordered = (
        each.join(counts, [*CHAIN, "word"])
        .groupBy(*CHAIN, "words").agg(F.sort_array(F.collect_list(F.struct("holders", "word"))).alias("by_rarity"))
    )
    size = F.size("words")
    needed = F.ceil(size * percent / F.lit(100.0)).cast("int")
    return ordered.select(*CHAIN, "words", F.slice("by_rarity.word", F.lit(1), size - needed + 1).alias("rare"))


def _links(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of a chain with ``100 * shared >= percent * union``, in both directions."""
    probes = stored(_with_rare_words(nodes, percent), "wordings").withColumn("word", F.explode("rare"))
    left = probes.select(*CHAIN, "word", "words", "rare")
    right = probes.select(*CHAIN, "word", F.col("words").alias("other"), F.col("rare").alias("other_rare"))
    sizes_fit = (F.size("words") * 100 >= F.size("other") * percent) & (F.size("other") * 100 >= F.size("words") * percent)
    # a pair that shares several rare words is judged at the first of them only
    met_first = F.array_intersect("rare", "other_rare")[0] == F.col("word")
    shared = F.size(F.array_intersect("words", "other"))
    alike = shared * 100 >= (F.size("words") + F.size("other") - shared) * percent
    met = left.join(right, [*CHAIN, "word"]).filter((F.col("words") < F.col("other")) & sizes_fit & met_first & alike)
    return met.select(*CHAIN, F.explode(F.array(
        F.struct(F.col("words"), F.col("other")), F.struct(F.col("other").alias("words"), F.col("words").alias("other")),
    )).alias("link")).select(*CHAIN, "link.words", "link.other")


def incident_families(incidents: DataFrame, percent: int = 80) -> DataFrame:
    """Each incident with the number of similar incidents in its chain and the earliest of them.

    ``incidents``: ``incident_id, service, group_start, first_seen, wording`` (chains by ``anomalies.incident_groups``).
    Similar are incidents of a chain whose words have a Jaccard similarity of ``percent`` in 100 or more.
    ``head_id`` is the similar incident seen first (ties by id), the incident itself included; one without
    words is similar to none. Other columns are left out.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be in 1..100, not {percent}")
    rows = stored(incidents.select("incident_id", *CHAIN, "first_seen", words_of(F.col("wording")).alias("words")), "wordings-of")
    seen = F.struct("first_seen", "incident_id")
    nodes = rows.filter(F.size("words") > 0).groupBy(*CHAIN, "words").agg(
        F.count(F.lit(1)).alias("incidents"), F.min(seen).alias("head"))
    nodes = stored(nodes, "wording-nodes")
    others = nodes.select(*CHAIN, F.col("words").alias("other"), "incidents", "head")
    near = _links(nodes, percent).join(others, [*CHAIN, "other"]).select(*CHAIN, "words", "incidents", "head")
    judged = nodes.select(*CHAIN, "words", "incidents", "head").unionByName(near).groupBy(*CHAIN, "words").agg(
        (F.sum("incidents") - 1).alias("similar_incidents"), F.min("head").alias("head"))
    return rows.join(judged, [*CHAIN, "words"], "left").select(
        "incident_id", *CHAIN, F.coalesce("similar_incidents", F.lit(0)).cast("bigint").alias("similar_incidents"),
        F.coalesce("head.incident_id", "incident_id").alias("head_id"))
