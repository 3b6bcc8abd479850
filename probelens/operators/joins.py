"""Swaps, verification, leakage and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelens.functions.countries import GROUPS, group_of
from probelens.functions.draws import h32, placed
from probelens.functions.text import answer_norm, clean_answer, country_norm


def false_swaps(pairs: DataFrame, seed=0, tries: int = 8) -> DataFrame:
    """pairs(subject, object), true -> (subject, object): for each subject one object that is not true of it.

    Objects are numbered by a seeded order; a subject draws ``tries`` numbers, the first draw that is not among its true
    objects holds. No cross join: subjects meet the objects they drew. A subject all of whose draws are true gets the
    first object, by number, that is missing among its own; only one that is true of all objects is left out.
    """
    pool = pairs.select("object").distinct()
    total = pool.agg(F.count("*").alias("m"))
    numbered = placed(pool, seed, "object", out="k").withColumn("k", F.col("k").cast("int") - 1)
    drawn = pairs.select("subject").distinct().crossJoin(F.broadcast(total)).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    drawn = drawn.withColumn("k", (h32(seed, F.col("subject"), F.col("try")) % F.col("m")).cast("int"))
    fit = drawn.join(numbered, "k").join(pairs, ["subject", "object"], "left_anti")
    got = fit.groupBy("subject").agg(F.min_by("object", "try").alias("object"))
    left = pairs.select("subject", "object").distinct().join(got.select(F.col("subject").alias("_s")), F.col("subject").eqNullSafe(F.col("_s")), "left_anti")
    place = F.row_number().over(Window.partitionBy("subject").orderBy("k")) - 1
    own = left.join(numbered, "object").withColumn("place", place)
    free = own.groupBy("subject").agg(F.coalesce(F.min(F.when(F.col("k") > F.col("place"), F.col("place"))), F.count("*").cast("int")).alias("k"))
    return got.unionByName(free.join(numbered, "k").select("subject", "object"))


def canonical(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with canon, from aliases(alias, canon, priority): the entry of least priority; null where there is none."""
    one = aliases.groupBy("alias").agg(F.min_by("canon", F.struct("priority", "canon")).alias("canon"))
    return rows.join(one.withColumnRenamed("alias", name), name, "left")


def canonical_map(spark: SparkSession, gold: DataFrame) -> DataFrame:
    """gold(name, seq) -> (alias, canon): normalised country names with the one they stand for.

    Alias groups come first, under their own name; other names stand for themselves, the first spelling of each holds.
    """
    own = gold.select(country_norm(F.col("name")).alias("alias"), "name", "seq").groupBy("alias").agg(F.min_by("name", "seq").alias("canon"))
    listed = spark.createDataFrame([(a, g.title()) for g, names in GROUPS.items() for a in (g, *names)], "alias string, canon string").select(country_norm(F.col("alias")).alias("alias"), "canon").distinct()
    return listed.unionByName(own.join(listed, "alias", "left_anti"))


def canonicalised(rows: DataFrame, name: str, canon: DataFrame) -> DataFrame:
    """rows whose name is a known country, with canon; canon(alias, canon) as canonical_map gives it."""
    return rows.withColumn("alias", country_norm(F.col(name))).join(canon, "alias").drop("alias")


def verify_countries(claims: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """verify() with objects equal if they name the same country under an alias; gazetteer(subject, objects): an array."""
    listed = gazetteer.select("subject", F.explode("objects").alias("object")).select("subject", group_of(F.col("object")).alias("object"))
    keyed = claims.withColumnRenamed("object", "_said").withColumn("object", group_of(F.col("_said")))
    return verify(keyed, listed).drop("object").withColumnRenamed("_said", "object")


def names_it(generated: Column, wanted: Column, aliases: Column) -> Column:
    """Whether a generated text has the wanted name, or one of its aliases (an array), as whole words; false below 3 letters."""
    said = F.concat(F.lit(" "), answer_norm(generated), F.lit(" "))
    one = answer_norm(wanted)
    has = lambda c: (c != "") & F.contains(said, F.concat(F.lit(" "), c, F.lit(" ")))
    return F.coalesce((F.trim(said) != "") & (F.length(one) >= 3) & (has(one) | F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: has(answer_norm(a)))), F.lit(False))


def adjudicated(answers: DataFrame, gold: DataFrame, canon: DataFrame) -> DataFrame:
    """answers(subject, answer) against gold(subject, objects): canon of the cleaned answer, and status.

    status: no_country where the answer names none, unverifiable without gold, correct or error else.
    """
    said = answers.withColumn("_a", clean_answer(F.col("answer"))).withColumn("alias", country_norm(F.col("_a"))).join(canon, "alias", "left").drop("alias", "_a")
    got = verify_countries(said.withColumn("object", F.coalesce("canon", F.lit(""))), gold).drop("object")
    return got.withColumn("status", F.when(F.col("canon").isNull(), "no_country").when(F.col("status") == "kept", "error").when(F.col("status") == "rejected", "correct").otherwise(F.col("status")))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n, n_both, aligned): whether two tables hold the same multiset of keys, by a full outer join of their counts."""
    count = lambda df, n: df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(n))
    x, y = count(a, "_a"), count(b, "_b").withColumnRenamed("_k", "_j")
    both = x.join(y, F.col("_k").eqNullSafe(F.col("_j")), "full_outer")
    same_n = F.coalesce(F.col("_a"), F.lit(0)) == F.coalesce(F.col("_b"), F.lit(0))
    return both.agg(F.count("*").alias("n"), F.count_if(same_n).alias("n_both")).withColumn("aligned", F.col("n") == F.col("n_both"))


def baseline_or(reference: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """reference with value from baseline where both hold the same keys, else its own; source says which."""
    ok = F.broadcast(aligned(reference, baseline, key).select(F.col("aligned").alias("_ok")))  # one row
    from_it = baseline.groupBy(key).agg(F.min(value).alias("_v"))
    rows = reference.join(from_it, key, "left").crossJoin(ok)
    return rows.withColumn(value, F.when(F.col("_ok"), F.col("_v")).otherwise(F.col(value))).withColumn("source", F.when(F.col("_ok"), "baseline").otherwise("reference")).drop("_v", "_ok")


def paired_vectors(a: DataFrame, b: DataFrame, key: str = "item_id", vec: str = "vec") -> DataFrame:
    """a's rows with the two vectors of a key end to end."""
    return a.join(b.select(key, F.col(vec).alias("_other")).hint("merge"), key).withColumn(vec, F.concat(F.col(vec).cast("array<double>"), F.col("_other").cast("array<double>"))).drop("_other")


def stacked_taps(acts: DataFrame, taps: tuple, key: str = "item_id", vec: str = "vec") -> DataFrame:
    """A row for each key with the vectors of the layers in taps end to end; keys that lack one are left out."""
    each = acts.where(F.col("layer").isin(*taps)).groupBy(key).agg(*[F.max(F.when(F.col("layer") == t, F.col(vec))).alias(f"_v{i}") for i, t in enumerate(taps)])
    return each.dropna().select(key, F.concat(*[F.col(f"_v{i}").cast("array<double>") for i in range(len(taps))]).alias(vec))


def verify(claims: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """claims(subject, object) against gazetteer(subject, object): status kept (known otherwise), rejected (in fact true), unverifiable."""
    known = gazetteer.groupBy("subject").agg(F.count("*").alias("_k"))
    true = gazetteer.select("subject", "object").distinct().withColumn("_t", F.lit(True))
    got = claims.join(known, "subject", "left").join(true, ["subject", "object"], "left")
    return got.withColumn("status", F.when(F.col("_k").isNull(), "unverifiable").when(F.col("_t"), "rejected").otherwise("kept")).drop("_k", "_t")


def without_leakage(train: DataFrame, evaluated: DataFrame, key: str = "entity") -> DataFrame:
    """train without subjects of evaluated, case and outer spaces aside."""
    fold = F.lower(F.trim(F.col(key)))
    return train.withColumn("_f", fold).join(evaluated.select(fold.alias("_f")).distinct(), "_f", "left_anti").drop("_f")


def all_resolved(items: DataFrame, freq: DataFrame, key: str = "item_id", entities: str = "entities") -> DataFrame:
    """Keys all of whose entities have a count (relational division); no entities: resolved."""
    each = items.select(key, F.explode_outer(entities).alias("entity")).join(freq.select("entity", "cnt"), "entity", "left")
    return each.groupBy(key).agg(F.bool_and(F.col("entity").isNull() | F.col("cnt").isNotNull()).alias("ok")).where("ok").select(key)


def exclusive(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def first_occurrence(rows: DataFrame, text: str, seq: str) -> DataFrame:
    """The row of least seq for each text, by aggregation instead of a sort."""
    rest = [c for c in rows.columns if c not in (text, seq)]
    got = rows.groupBy(text).agg(F.min(F.struct(seq, *rest)).alias("_m"))
    return got.select(text, *[F.col(f"_m.{c}").alias(c) for c in (seq, *rest)]).select(*rows.columns)


def newest(runs: DataFrame, by: tuple, date: str, name: str) -> DataFrame:
    """runs with current: the newest of each key, ties to the larger name."""
    order = Window.partitionBy(*by).orderBy(F.col(date).desc(), F.col(name).desc())
    return runs.withColumn("current", F.row_number().over(order) == 1)


def upsert(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Prior rows of keys that fresh does not have, and all fresh rows."""
    return prior.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def contains_word(rows: DataFrame, text: str, names: DataFrame, name: str, least: int = 3) -> DataFrame:
    """rows with each name that the text has as whole words: an equi-join on the words of the text up to the longest name."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    listed = names.select(F.col(name), F.concat_ws(" ", F.filter(F.split(F.lower(F.col(name)), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("_k")).where(F.length(name) >= least).distinct()
    longest = listed.agg(F.coalesce(F.max(F.size(F.split("_k", " "))), F.lit(1))).first()[0]
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - n + 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))))
    each = rows.withColumn("_w", words).withColumn("_k", F.explode(F.array_distinct(grams))).drop("_w")
    return each.join(listed, "_k").drop("_k")
