"""Statement templates, their negation, and cleaning of answers, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: topic: what stands between subject and object, what closes the statement, what stands between them when it is
#: negated, the kind of object (fixed values, in the order in which templates are tried)
TEMPLATES = {
    "cities": (" is a city in ", "", " is not a city in ", "country"),
    "generated": (" is located in ", "", " is not located in ", "place"),
    "inventions": (" invented ", "", " did not invent ", "invention"),
    "elements": (" is used in ", "", " is not used in ", "use"),
    "companies": (" has headquarters in ", "", " does not have headquarters in ", "country"),
    "animals": (" uses ", " for locomotion", " does not use ", "locomotion"),
}
#: verbs before which a statement's subject ends (fixed values)
VERBS = ("is", "was", "has", "are", "were", "can", "does", "contains", "belongs")
#: what an answer may begin with (fixed values)
LEAD_INS = ("the", "it is", "it's", "located in", "in")
ARTICLES = ("the", "a", "an")


def pattern(topic: str) -> str:
    between, close, _, _ = TEMPLATES[topic]
    return rf"^(.+?){between}(.+?){close}\.?$"


def parse(text: Column, topic: Column) -> tuple[Column, Column]:
    """(subject, object) by the topic's template; null where it does not fit."""

    def part(i):
        got = reduce(lambda rest, t: F.when(topic == t, F.regexp_extract(text, pattern(t), i)).otherwise(rest), TEMPLATES, F.lit(None).cast("string"))
        return F.nullif(F.trim(got), F.lit(""))

    return part(1), part(2)


def topic_of(text: Column) -> Column:
    """The first topic whose template fits all of the text; null if none does."""
    return reduce(lambda rest, t: F.when(text.rlike(pattern(t)), t).otherwise(rest), reversed(TEMPLATES), F.lit(None).cast("string"))


def instantiate(topic: str | Column, subject: Column, obj: Column) -> Column:
    """The topic's statement of a subject and an object; null for a topic without a template."""
    said = lambda t: F.concat(subject, F.lit(TEMPLATES[t][0]), obj, F.lit(TEMPLATES[t][1] + "."))
    if isinstance(topic, str):
        return said(topic)
    return reduce(lambda rest, t: F.when(topic == t, said(t)).otherwise(rest), TEMPLATES, F.lit(None).cast("string"))


def negate(text: Column, strict: bool = True) -> Column:
    """The negation by the first template that fits all of the text; without one an error, or null if not strict."""
    last = F.raise_error(F.concat(F.lit("no template fits: "), text)).cast("string") if strict else F.lit(None).cast("string")
    made = lambda t: F.regexp_replace(text, pattern(t), f"$1{TEMPLATES[t][2]}$2{TEMPLATES[t][1]}.")
    return reduce(lambda rest, t: F.when(text.rlike(pattern(t)), made(t)).otherwise(rest), reversed(TEMPLATES), F.when(text.isNotNull(), last))


def negate_all(df: DataFrame, text: str) -> DataFrame:
    """(n, n_in, n_out, injective) of the negation of distinct texts."""
    got = df.select(F.col(text).alias("a"), negate(F.col(text), False).alias("b"))
    return got.agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_in"), F.count_distinct("b").alias("n_out")).withColumn("injective", F.col("n_in") == F.col("n_out"))


def true_pairs(rows: DataFrame, text: str = "statement", label: str = "label", topic: str = "topic") -> DataFrame:
    """(topic, subject, object) of the statements labelled 1 that fit their topic's template."""
    subject, obj = parse(F.trim(text), F.col(topic))
    return rows.where(F.col(label).cast("int") == 1).select(topic, subject.alias("subject"), obj.alias("object")).where("subject is not null and object is not null")


def natural_false(rows: DataFrame, text: str = "statement", label: str = "label", topic: str = "topic") -> DataFrame:
    """(topic, statement, subject, object) of the statements labelled 0 that fit their topic's template."""
    subject, obj = parse(F.trim(text), F.col(topic))
    got = rows.where(F.col(label).cast("int") == 0).select(topic, F.trim(text).alias("statement"), subject.alias("subject"), obj.alias("object"))
    return got.where("subject is not null and object is not null")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _line(x: Column) -> Column:
    return F.split(x, "\n")[0]


def clean_answer(text: Column) -> Column:
    """First line, without quotes and dots at its ends, one lead-in and closing dots."""
    ends = F.regexp_replace(_strip(text), r"""^[."']+|[."']+$""", "")
    bare = F.regexp_replace(_strip(_line(ends)), rf"(?i)^({'|'.join(LEAD_INS)})\s+", "")
    return F.regexp_replace(_strip(bare), r"\.+$", "")


def first_sentence(text: Column) -> Column:
    """First clause of the first line, without an article before it."""
    clause = _strip(F.split(_line(_strip(text)), "[.;!?]")[0])
    return _strip(F.regexp_replace(clause, rf"(?i)^({'|'.join(ARTICLES)})\s+", ""))


def country_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]", " "))


def answer_norm(text: Column) -> Column:
    """Lower case, no leading article, letters only, single spaces."""
    bare = F.regexp_replace(_strip(F.lower(text)), rf"^({'|'.join(ARTICLES)})\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z ]", " "), r"\s+", " "))


def cluster_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def subject_prefix(text: Column) -> Column:
    """The text before its first verb, else the whole text."""
    got = F.regexp_extract(text, rf"^(.*?)\s+({'|'.join(VERBS)})\b", 1)
    return F.when(F.length(got) > 0, got).otherwise(text)


_PIECE = r"[A-Za-z]{1,4}|[0-9]|[^\sA-Za-z0-9]"


def count_features(text: Column, entity: Column) -> dict[str, Column]:
    """Surface counts that follow how a text falls into pieces (of at most four letters): pieces of the entity and of the
    text, the entity's characters, its pieces a word, and whether the text's last piece continues a word."""
    pieces = lambda x: F.regexp_count(x, F.lit(_PIECE))
    name = F.coalesce(entity, F.lit(""))
    words = F.size(F.filter(F.split(name, r"\s+"), lambda x: x != ""))
    last = F.length(F.regexp_extract(text, r"(\S+)\s*$", 1))
    return {"entity_pieces": pieces(name), "text_pieces": pieces(text), "entity_chars": F.length(name), "pieces_a_word": pieces(name) / F.greatest(words, F.lit(1)), "continues": (F.regexp_count(F.regexp_extract(text, r"(\S+)\s*$", 1), F.lit(_PIECE)) > 1).cast("int") * (last > 0).cast("int")}
