"""Mixing sources to target weights by Pareto order sampling.

A source's target says how many words the mix takes of it. A document is due
a number of copies in proportion to its grade, the number of binary digits of
its size (long documents more than short ones), by the factor that brings the
source to its target, and ``most`` copies at most. Whole copies are certain; the
fraction p left is the document's inclusion probability, and documents are ranked
by (u / (1 - u)) / (p / (1 - p)), u being a hash of seed and id. Those of lowest
rank are taken, as many as bring the source's words nearest to what its
target still lacks.

The factor follows from a row for each source and grade (64 grades at most). The cut
is found without sorting a source in one place: histograms of words over
the rank's bins, in two levels, tell the bin in which it lies, and only
that bin's rows are ordered. What is taken then depends on a row's own values and its
source's cut alone, so that no join by id is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the rank are STEP coarse ones with STEP fine ones each.
STEP = 256
SCALE = 2**52
SEED = 20240229
_NONE = -(2**63)
_MIX, _KEY, _GRADE, _RULE = (f"__siftwood_{x}__" for x in ("mix", "key", "grade", "rule"))


def _draw(seed: int) -> Column:
    """u, of 52 bits, from the id (from the text where there is none), the same in every run and engine; never 0 or 1."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long") + 0.5) / float(SCALE)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) out of (source, source_size): shares of the whole by weight, at most ``most`` times a size.

    Weights repeat over the sources by code point, null last. The shares are
    found in closed form: sources stop at their cap in the order of cap over
    weight, so one running sum over that order tells who has stopped. A row per
    source is all that is sorted.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), "weight", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ahead = weighed.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ahead = ahead.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    ahead = ahead.withColumn("unit", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
    ahead = ahead.withColumn("stops", F.col("unit") * F.col("weight") >= F.col("cap"))
    unit = F.min(F.when(~F.col("stops"), F.struct(F.col("gone").alias("gone"), F.col("unit").alias("unit")))).over(all_rows)["unit"]
    return ahead.withColumn("unit", unit).select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("unit") * F.col("weight")).alias("target"))


def factors(graded: DataFrame, goal: DataFrame, most: int = 3) -> DataFrame:
    """(key, grade, source_size, target, whole, p): copies that are certain, and inclusion probability, of the documents of a grade.

    graded: (key, grade, words); goal: (key, source_size, target). Copies are
    factor times grade, ``most`` at most: higher grades stop first, so one running
    sum over a source's grades tells which have stopped.
    """
    down = Window.partitionBy("key").orderBy(F.desc("grade"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole_source = Window.partitionBy("key")
    rows = graded.join(goal, "key").withColumn("stopped", F.coalesce(F.sum("words").over(before), F.lit(0)))
    rows = rows.withColumn("left", F.sum(F.col("words") * F.col("grade")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("factor", F.try_divide(F.col("target") - most * F.col("stopped"), F.col("left")))
    # the first grade that does not stop has the factor of all that don't
    rows = rows.withColumn("stops", F.col("factor") * F.col("grade") >= most)
    going = F.max(F.when(F.col("factor").isNotNull() & ~F.col("stops"), F.struct("grade", "factor"))).over(whole_source)
    due = F.when(F.col("grade") > F.coalesce(going["grade"], F.lit(0)), F.lit(float(most))).otherwise(going["factor"] * F.col("grade"))
    rows = rows.withColumn("due", F.least(F.greatest(due, F.lit(0.0)), F.lit(float(most))))
    # a fraction below a millionth, or so near to one, is none
    rows = rows.withColumn("whole", F.floor(F.col("due") + 1e-6).cast("long")).withColumn("p", F.col("due") - F.col("whole"))
    return rows.select("key", "grade", "source_size", "target", "whole", F.when(F.col("p") > 1e-6, F.col("p")).otherwise(F.lit(0.0)).alias("p"))


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """docs with what the mix needs of a row in one column: id (the least number for none), key, size, grade, u."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    mine = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), key.alias("key"), size.alias("size"), F.length(F.bin(size)).alias("grade"), _draw(seed).alias("u"))
    return docs.withColumn(_MIX, mine)


def _rank(u: Column, p: Column) -> Column:
    """The random odds over the inclusion odds; null for a probability of 0."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _bin(rank: Column) -> Column:
    """rank / (1 + rank) lies between 0 and 1, with a cut near the middle."""
    return F.least(F.floor(rank / (1 + rank) * STEP * STEP), F.lit(STEP * STEP - 1)).cast("long")


def lacks(graded: DataFrame, fine: DataFrame) -> DataFrame:
    """(key, lack): the words that a source's target needs besides whole copies. graded: (key, grade, words); fine: factors()."""
    words = graded.join(fine.select("key", "grade", "whole", "target"), ["key", "grade"])
    return words.groupBy("key").agg(F.greatest(F.first("target") - F.sum(F.col("whole") * F.col("words")), F.lit(0.0)).alias("lack"))


def _level(rows: DataFrame, name: str, base: str) -> DataFrame:
    """(key, lack, at, base): the first of a source's bins in whose course the words come above what is lacking, and the words before it."""
    running = Window.partitionBy("key").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("key", name, base, "lack").agg(F.sum("size").alias("words")).withColumn("upto", F.col(base) + F.sum("words").over(running))
    return bins.where("upto > lack").groupBy("key", "lack").agg(F.min(F.struct(F.col(name).alias("at"), (F.col("upto") - F.col("words")).alias("base"))).alias("c")).select("key", "lack", "c.at", "c.base")


def _cuts(sized: DataFrame, fine: DataFrame, lack: DataFrame) -> DataFrame:
    """(key, cut_bin, cut): a source's sample is all bins below cut_bin, and in that bin what is not above cut, (rank, id, size).

    sized: (id, key, size, grade, u); fine: factors(); lack: lacks(). Rows that are
    equal in rank, id and size go together: they are taken if no more than half of
    their words lies beyond what is lacking. A source without a row here is
    less than what is lacking, as a whole.
    """
    ranked = sized.where("size > 0").join(fine.where("p > 0").select("key", "grade", "p"), ["key", "grade"]).withColumn("rank", _rank(F.col("u"), F.col("p")))
    ranked = ranked.withColumn("bin", _bin(F.col("rank"))).withColumn("part", F.floor(F.col("bin") / STEP)).select("key", "part", "bin", "rank", "id", "size")
    coarse = cut(_level(ranked.join(lack, "key").withColumn("zero", F.lit(0).cast("long")), "part", "zero"), "coarse", 4)
    precise = cut(_level(ranked.join(coarse, "key").where(F.col("part") == F.col("at")), "bin", "base"), "fine", 4)
    inside = ranked.join(precise, "key").where(F.col("bin") == F.col("at"))
    ties = inside.groupBy("key", "rank", "id", "size", "lack", "base").agg(F.sum("size").alias("words"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("key").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = ties.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("lack")).groupBy("key").agg(F.max(F.struct("rank", "id", "size")).alias("cut"))
    return precise.select("key", F.col("at").alias("cut_bin")).join(last, "key", "left")


def _rules(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source and grade: what decides over its documents."""
    graded = cut(sized.groupBy("key", "grade").agg(F.sum("size").alias("words")), "grades", 4)
    source = F.when(F.col("key") != "n", F.expr("substring(key, 2)")).alias("source")
    goal = targets(graded.groupBy("key").agg(F.sum("words").alias("source_size")).select(source, "source_size"), weights, most)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source_size", "target")
    fine = cut(factors(graded, goal, most), "factors", 4)
    cuts = _cuts(sized, fine, lacks(graded, fine))
    of = F.struct("source_size", "target", "whole", "p", "cut_bin", "cut").alias(_RULE)
    return cut(fine.join(cuts, "key", "left").select(F.col("key").alias(_KEY), F.col("grade").alias(_GRADE), of), "rules", 4)


def _decided(rows: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """rows, whose column _MIX holds _measured()'s values, with (id, key, size, source_size, target, copies) in it."""
    mine, of = F.col(_MIX), F.col(_RULE)
    rank = _rank(mine["u"], of["p"])
    upto = F.struct(rank.alias("rank"), mine["id"].alias("id"), mine["size"].alias("size"))
    within = of["cut_bin"].isNull() | (_bin(rank) < of["cut_bin"]) | ((_bin(rank) == of["cut_bin"]) & F.coalesce(upto <= of["cut"], F.lit(False)))
    extra = F.when(rank.isNotNull() & within, F.lit(1)).otherwise(F.lit(0))
    copies = F.when(mine["size"] > 0, F.least(of["whole"] + extra, F.lit(most))).otherwise(F.lit(0)).cast("long")
    out = rows.join(rules, (mine["key"] == F.col(_KEY)) & (mine["grade"] == F.col(_GRADE)))
    return out.withColumn(_MIX, F.struct(mine["id"].alias("id"), mine["key"].alias("key"), mine["size"].alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), copies.alias("copies"))).drop(_KEY, _GRADE, _RULE)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies times size).

    Reads ``doc_id``, ``text`` and ``source`` only. A null or empty text has
    size 0 and no copies; a null source is a source of its own. Rows without an id
    draw by their text. Rows that are equal in id (or text), source and size share
    their draw and go together; equal ranks are ordered by id and size. An empty
    table gives an empty result.
    """
    sized = cut(_measured(docs, seed).select(f"{_MIX}.*"), "sizes")
    out = _decided(sized.select(F.struct("*").alias(_MIX)), _rules(sized, weights, most), most).select(f"{_MIX}.*")
    return out.select(F.when(F.col("id") != _NONE, F.col("id")).alias("doc_id"), F.when(F.col("key") != "n", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it; rows that share an id are each taken by themselves."""
    wide = _measured(docs, seed)
    out = _decided(wide, _rules(cut(wide.select(f"{_MIX}.*"), "sizes"), weights, most), most)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(_MIX)["copies"]))
    return out.where(F.col(_MIX)["copies"] > 0).withColumn("__siftwood_copy__", again).select(*(F.col(f"`{c}`") for c in docs.columns))
