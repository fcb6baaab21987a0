"""Path similarity over a hypernym graph.

A graph is a table (synset, hypernym), a row per edge.  Names end in part of speech and number, as in bank.n.01.
The distance of two synsets is the least number of steps up from one and then down to the other: their paths meet in
a common ancestor, so two synsets that only share a hyponym aren't joined.  Verbs have no common top; where a
target is a verb, all verbs meet in a root above them, one step beyond each synset's farthest ancestor.
The similarity is 1 / (1 + distance).

Nothing but counts comes to the driver.  Every round is a join of the states reached last with the
edges, written to the shared folder; there are as many rounds as the longest of the shortest paths has edges.  A state is
visited once, so a cycle, which is a defect of a graph, ends too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import durable, scratch


def _reach(start: DataFrame, moves: DataFrame, keep) -> DataFrame:
    """(start, node, down, steps): the least number of moves from each start to each state that it reaches.

    start: (start, node, down); moves: (node, down, to, then), from one state to another.
    """
    key = ["start", "node", "down"]
    last = keep(durable(start.select(*key).distinct().withColumn("steps", F.lit(0).cast("long"))))
    seen, steps = last, 0
    while not last.isEmpty():
        steps += 1
        reached = last.join(moves, ["node", "down"]).select("start", F.col("to").alias("node"), F.col("then").alias("down")).distinct()
        last = keep(durable(reached.join(seen.select(*key), key, "left_anti").withColumn("steps", F.lit(steps).cast("long"))))
        seen = seen.unionByName(last)
    return seen


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("synset", "hypernym").where("synset IS NOT NULL AND hypernym IS NOT NULL").distinct()


def distances(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, synset, distance), long, for every synset of the graph that a target's paths reach, itself included (0).

    targets: (target).  Null names are left out, repeated rows count once, a target that has no edges reaches itself.
    """
    one = _clean(edges)
    up = one.select(F.col("synset").alias("node"), F.lit(False).alias("down"), F.col("hypernym").alias("to"), F.lit(False).alias("then"))
    turn = [one.select(F.col("hypernym").alias("node"), F.lit(d).alias("down"), F.col("synset").alias("to"), F.lit(True).alias("then")) for d in (False, True)]
    with scratch() as keep:
        moves = keep(durable(up.unionByName(turn[0]).unionByName(turn[1])))
        start = targets.where("target IS NOT NULL").select(F.col("target").alias("start"), F.col("target").alias("node"), F.lit(False).alias("down"))
        found = _reach(start, moves, keep)
        return durable(found.groupBy(F.col("start").alias("target"), F.col("node").alias("synset")).agg(F.min("steps").alias("distance")))


def heights(edges: DataFrame, synsets: DataFrame) -> DataFrame:
    """(synset, height): the distance to the farthest ancestor, 0 without any.  synsets: (synset)."""
    up = _clean(edges).select(F.col("synset").alias("node"), F.lit(False).alias("down"), F.col("hypernym").alias("to"), F.lit(False).alias("then"))
    start = synsets.where("synset IS NOT NULL").select(F.col("synset").alias("start"), F.col("synset").alias("node"), F.lit(False).alias("down"))
    with scratch() as keep:
        found = _reach(start, keep(durable(up)), keep)
        return durable(found.groupBy(F.col("start").alias("synset")).agg(F.max("steps").alias("height")))


def part_of_speech(name: str):
    """The second part from the end of a synset's name: n in bank.n.01."""
    return F.try_element_at(F.split(F.col(name), r"\."), F.lit(-2))


def similarities(senses: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(word, target, similarity), double: the best over a word's senses of the target's part of speech.

    senses: (word, synset).  Words of which no sense is joined with a target have no row for it.
    """
    fit = senses.select("word", "synset").where("word IS NOT NULL AND synset IS NOT NULL").distinct()
    near = distances(edges, targets).where(part_of_speech("synset") == part_of_speech("target"))
    paths = fit.join(near, "synset").select("word", "target", "distance")
    verbs = targets.where(part_of_speech("target") == "v").select("target").distinct()
    if not verbs.isEmpty():
        said = fit.where(part_of_speech("synset") == "v")
        height = heights(edges, said.select("synset").unionByName(verbs.select(F.col("target").alias("synset"))).distinct())
        least = said.join(height, "synset").groupBy("word").agg(F.min("height").alias("low"))
        ends = verbs.join(height, F.col("target") == F.col("synset")).select("target", "height")
        # stated targets, against all words
        rooted = least.join(ends, F.lit(True)).select("word", "target", (F.col("low") + F.col("height") + 2).alias("distance"))
        paths = paths.unionByName(rooted)
    return paths.groupBy("word", "target").agg((F.lit(1.0) / (F.min("distance") + 1)).alias("similarity"))
