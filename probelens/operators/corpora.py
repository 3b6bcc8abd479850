"""Crossed corpora from labelled statements and from verified answers.

A candidate is (text, truth, edited, entity, entities, domain, strategy). Draws are md5 orders of what is drawn from, so
that any engine and any partitioning give the same corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions import text as said
from probelens.functions.draws import h32, meet, placed
from probelens.functions.stage import staged
from probelens.operators import cells, gates, joins


def object_counts(rows: DataFrame, text: str = "statement", topic: str = "topic") -> DataFrame:
    """(topic, object, cnt): in how many statements that fit the template an object stands, true or false."""
    obj = said.parse(F.trim(text), F.col(topic))[1]
    return rows.select(topic, obj.alias("object")).where("object is not null").groupBy(topic, "object").agg(F.count("*").alias("cnt"))


def true_objects(pairs: DataFrame) -> DataFrame:
    """(topic, subject, objects): what is true of each subject."""
    return pairs.groupBy("topic", "subject").agg(F.sort_array(F.collect_set("object")).alias("objects"))  # of one subject


def swap_candidates(rows: DataFrame, edit_rate: float = 0.5, seed=20260712) -> DataFrame:
    """rows(topic, statement, label) -> candidates with seq, edited as often among true as among false statements.

    For each topic with at least four true pairs: of its n true pairs a share of edit_rate is replaced by other true
    pairs, the rest stay as they are; as many false ones are made, of which the same share are pairs with a wrong object,
    in turn from the third most and the third least frequent objects, and the rest are false statements as found. The
    first of equal texts holds. A place has no wrong object only where every subject is true of all objects of its tier.
    """
    pairs = said.true_pairs(rows).withColumn("id", F.concat_ws("|", "subject", "object"))
    pairs = staged(pairs, "pairs")
    numbered = staged(placed(pairs, f"{seed}:pair", "id", ("topic",), "k"), "numbered")
    sizes = pairs.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 4").withColumn("m", F.bround(F.lit(edit_rate) * F.col("n")).cast("long"))
    true = numbered.join(F.broadcast(sizes), "topic")
    drawn = true.where("k <= m").select("topic", "k", "n", (h32(f"{seed}:swap", F.col("topic"), F.col("k")) % F.col("n") + 1).alias("at"))
    other = numbered.select("topic", F.col("k").alias("at"), "subject", "object")
    kept = true.where("k > m").select("topic", "k", "subject", "object")
    own = [drawn.join(other, ["topic", "at"]).select("topic", "k", "subject", "object", F.lit(True).alias("truth"), F.lit(True).alias("edited"), F.lit("truth_preserving_swap").alias("strategy")),
           kept.select("topic", "k", "subject", "object", F.lit(True).alias("truth"), F.lit(False).alias("edited"), F.lit("original_true").alias("strategy"))]
    # wrong objects: a place draws a pair, whose subject isn't true of all of the tier, and a number among the objects of the
    # tier that are not true of that subject; so every draw fits
    counts = object_counts(rows).join(pairs.select("topic", "object").distinct(), ["topic", "object"])
    tiers = placed(cells.tops(counts, ("topic",)).where("tier is not null"), f"{seed}:tier", "object", ("topic", "tier"), "at")
    tiers = staged(tiers, "tiers")
    widths = tiers.groupBy("topic", "tier").agg(F.count("*").alias("width"))
    known = pairs.select("topic", "subject", "object").distinct().join(tiers.select("topic", "tier", "object", "at"), ["topic", "object"])
    known = known.groupBy("topic", "tier", "subject").agg(F.sort_array(F.collect_set(F.col("at") - 1)).alias("own"))  # of one subject
    open_ = numbered.select("topic", "id", "subject").join(widths, "topic").join(known, ["topic", "tier", "subject"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>"))).where(F.size("own") < F.col("width"))
    open_ = staged(placed(open_, f"{seed}:open", "id", ("topic", "tier"), "who"), "open")
    many = open_.groupBy("topic", "tier").agg(F.count("*").alias("n_open"))
    asked = true.where("k <= m").select("topic", "k").withColumn("tier", F.when(F.col("k") % 2 == 1, "common").otherwise("rare")).join(many, ["topic", "tier"])
    asked = asked.withColumn("who", h32(f"{seed}:who", F.col("topic"), F.col("k")) % F.col("n_open") + 1).join(open_.select("topic", "tier", "who", "subject", "own", "width"), ["topic", "tier", "who"])
    free = h32(f"{seed}:what", F.col("topic"), F.col("k")) % (F.col("width") - F.size("own"))
    asked = asked.withColumn("at", F.aggregate("own", free, lambda x, o: F.when(o <= x, x + 1).otherwise(x)) + 1)
    wrong = asked.join(tiers.select("topic", "tier", "at", "object"), ["topic", "tier", "at"])
    wrong = wrong.select("topic", "k", "subject", "object", F.lit(False).alias("truth"), F.lit(True).alias("edited"), F.concat(F.lit("truth_breaking_swap_"), F.when(F.col("tier") == "common", "FT_lean").otherwise("FA_lean")).alias("strategy"))
    false = placed(said.natural_false(rows), f"{seed}:false", "statement", ("topic",), "k").join(F.broadcast(sizes), "topic").where("k <= n - m")
    found = false.select("topic", "k", "subject", "object", F.lit(False).alias("truth"), F.lit(False).alias("edited"), F.lit("original_false").alias("strategy"))
    every = own[0].unionByName(own[1]).unionByName(wrong).unionByName(found)
    order = F.when(F.col("truth"), 0).when(F.col("edited"), 1).otherwise(2)
    every = every.select(said.instantiate(F.col("topic"), F.col("subject"), F.col("object")).alias("text"), "truth", "edited", F.col("subject").alias("entity"), F.array("subject", "object").alias("entities"), F.col("topic").alias("domain"), "strategy", F.struct(order.alias("o"), "k", "strategy").alias("seq"))
    return joins.first_occurrence(every, "text", "seq").transform(staged, "candidates")


def crossed_corpus(candidates: DataFrame, freq: DataFrame, least: int = 20, seed=0, most_missing: float = 0.05) -> DataFrame:
    """candidates(text, truth, edited, entities, domain, ...) and freq(entity, cnt, logf) -> the balanced crossed corpus.

    Mean log frequency of the entities that have one, terciles within each domain, domains that have enough of every
    cell, the same number of rows in every (domain, cell, edited). More than most_missing of the entities without a
    count, or no row left, is an error.
    """
    keyed = candidates.withColumn("item_id", F.col("text"))
    means = cells.mean_frequency(keyed, freq)
    gaps = keyed.select(F.explode("entities").alias("entity")).distinct().join(freq.select("entity", "cnt"), "entity", "left").agg(F.count_if(F.col("cnt").isNull()).alias("k"), F.count("*").alias("n")).first()
    if gaps["k"] > most_missing * gaps["n"]:
        raise ValueError(f"{gaps['k']} of {gaps['n']} entities have no count")
    items = keyed.join(means, "item_id").withColumn("_k", F.xxhash64("item_id"))
    celled = cells.admitted(cells.with_cells(cells.terciles(items, key="_k", by=("domain",))), least)
    out = cells.balanced(celled, seed, "item_id").drop("_k", "n_missing")
    if out.isEmpty():
        raise ValueError("no domain has enough rows in every cell")
    return out


def harvested_corpus(truths: DataFrame, errors: DataFrame, gazetteer: DataFrame, canon: DataFrame, freq: DataFrame, least: int = 20, least_errors: int = 80, seed=0) -> DataFrame:
    """Crossed corpus of natural errors: truths(subject, object), errors(subject, object), gazetteer(subject, objects).

    Errors that the gazetteer holds true, or can't judge, go; objects get their canonical names, and what names no
    country goes; a subject of an error supplies no truth; items with an entity without a count go. Fewer than
    least_errors errors before or after that is an error.
    """
    known = joins.verify_countries(errors, gazetteer).where("status = 'kept'").drop("status")
    good = joins.canonicalised(known, "object", canon).select("subject", F.col("canon").alias("object")).distinct().transform(staged, "errors")
    fine = joins.canonicalised(joins.exclusive(truths, good, "subject"), "object", canon).select("subject", F.col("canon").alias("object")).distinct()
    rows = good.withColumn("truth", F.lit(False)).unionByName(fine.withColumn("truth", F.lit(True)))
    rows = rows.withColumns({"domain": F.lit("cities"), "edited": F.lit(False), "entity": F.col("subject"), "entities": F.array("subject", "object"), "text": said.instantiate("cities", F.col("subject"), F.col("object"))})
    resolved = rows.join(joins.all_resolved(rows.withColumn("item_id", F.col("text")), freq).withColumnRenamed("item_id", "text"), "text", "left_semi").transform(staged, "resolved")
    for n in (good.count(), resolved.where("not truth").count()):
        if n < least_errors:
            raise ValueError(f"{n} errors, {least_errors} are needed")
    items = resolved.withColumn("item_id", F.col("text"))
    items = items.join(cells.mean_frequency(items, freq), "item_id").withColumn("_k", F.xxhash64("item_id"))
    celled = cells.admitted(cells.with_cells(cells.terciles(items, key="_k", by=("domain",))), least)
    return cells.balanced(celled, seed, "item_id", halves=False).drop("_k", "n_missing")


def gated(corpus: DataFrame, text: str = "text", sign: str | None = None) -> DataFrame:
    """The gates that a corpus must pass before it is written, a row for each."""
    checks = [gates.crossed(gates.crossing_report(corpus)), gates.duplicates(corpus, text), gates.domain_share(corpus), gates.edit_balance(corpus), gates.sign_off(corpus, sign)]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def entity_universe(pairs: DataFrame, false: DataFrame, *more: DataFrame) -> DataFrame:
    """(entity) of all subjects and objects of true and false statements, and of further tables(entity), sorted."""
    out = pairs.select(F.explode(F.array("subject", "object")).alias("entity")).unionByName(false.select(F.explode(F.array("subject", "object")).alias("entity")))
    for m in more:
        out = out.unionByName(m.select("entity"))
    return out.where("entity is not null").distinct().orderBy("entity")


def with_gazetteer(names: DataFrame, gazetteer: DataFrame, key: str = "subject", value: str = "object") -> DataFrame:
    """names with objects: all the gazetteer lists for it, null where it lists nothing."""
    listed = gazetteer.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("objects"))  # of one name
    return names.join(listed, key, "left")


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two sets has, and which."""
    return a.select(key).distinct().exceptAll(b.select(key).distinct()).withColumn("only", F.lit("first")).unionByName(b.select(key).distinct().exceptAll(a.select(key).distinct()).withColumn("only", F.lit("second")))


def complement(rows: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in part, nulls included."""
    return meet(rows, part.select(key).distinct(), (key,), "left_anti")
