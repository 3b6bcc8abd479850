"""PII surrogates, in DataFrame operations only.

Detected entities are replaced by keyed surrogates of the same type and shape: digits stay digits, letters stay letters
of their case, separators stay; card numbers that pass the Luhn check get surrogates that pass it, octets of an address
stay octets; names after a title keep the title's gender and the name's script, and are replaced wherever the text has them
again, whole or by surname; a full name's surrogate ends in its surname's. Equal entities get equal surrogates in
the whole corpus (however a number is punctuated), different ones different: the table of distinct entities is checked
for surrogates that collide with each other or with a real entity, and those are drawn again. Where a shape has so few
free values that some still collide after ``DRAWS`` draws, the shape's entities exchange their values by keyed rotation,
which is one to one: no entity keeps its own, but a surrogate may then be another's real value.

Mentions are folded to distinct entities before they are shuffled, and only texts that have one are joined with the
table, by document; all other texts pass by.
"""

from __future__ import annotations

import secrets
from functools import reduce
from itertools import count as rounds

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelens.llm.common import written

#: titles by gender, as they stand before a name (fixed values)
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "Κυρία"), "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "Κύριος"), "n": ("Dr", "Prof", "Mx")}
#: given names of surrogates by script and gender (fixed values)
GIVEN = {
    "latin": {"f": ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Sara"), "m": ("Adam", "Daniel", "Felix", "Hugo", "Lukas", "Martin", "Oscar", "Simon"), "n": ("Alex", "Kim", "Noa", "Robin", "Sascha", "Sam", "Toni", "Luca")},
    "cyrillic": {"f": ("Анна", "Вера", "Елена", "Мария"), "m": ("Антон", "Иван", "Максим", "Павел"), "n": ("Саша", "Женя", "Валя", "Шура")},
    "greek": {"f": ("Άννα", "Ελένη", "Μαρία", "Σοφία"), "m": ("Γιώργος", "Νίκος", "Πέτρος", "Φίλιππος"), "n": ("Άρης", "Θάλεια", "Χάρις", "Έλλη")},
}
#: syllables of surrogate surnames by script (fixed values)
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"), "cyrillic": ("ба", "ве", "га", "до", "жи", "ко", "ла", "мо", "ни", "пе", "ра", "со", "ту", "фи", "ха", "че"), "greek": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "νι", "πε", "ρα", "σο", "τα", "φε", "χι", "ψο")}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_UPPER = r"\p{Lu}[\p{L}'’-]*+"
#: gives its last dot back where that ends a sentence
_DOMAIN = r"(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}"
#: (type, pattern), the first that fits holds; all are bounded by look-arounds and possessive where they repeat
PATTERNS = (
    ("email", rf"(?:(?<![\w.%+-])(?:\w[\w.%+-]*+|[%+-][.%+-]*+)|(?<=[.%+-])\w[\w.%+-]{{0,255}}+)@{_DOMAIN}"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho)[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("address", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19}+)(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("name", rf"(?<=(?<![\p{{L}}])(?:{_TITLE})\.? ){_UPPER}(?: {_UPPER})?"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: what a text must have to be looked at, implied by every pattern: a digit, an @, what a secret starts with, or a title
HINT = rf"[0-9@]|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z]{{16}}|(?:sk|pk|ghp|gho)[_-]|[a-fA-F]{{32}})|(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}"
_OWNS = "['’]s$"
DIGITS = ("card", "ssn", "phone")
#: draws before a shape counts as full
DRAWS = 12
#: entities that exchange values with each other, on average
EXCHANGE = 4096


def mentions(text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))


def _known(found: Column) -> Column:
    """A pattern of ANY and of the text's names wherever they stand, whole or by surname; ANY alone without names. found: mentions of ANY.

    A surname of one letter is only taken behind a title.
    """
    names = F.filter(F.array_distinct(found), lambda m: m.rlike(rf"^{_UPPER}(?: {_UPPER})?$") & (kind(m) == "name"))
    names = F.transform(names, lambda m: F.regexp_replace(m, _OWNS, ""))
    names = F.filter(F.array_distinct(F.concat(names, F.transform(names, lambda m: F.substring_index(m, " ", -1)))), lambda m: F.length(m) > 1)
    longest = F.transform(F.sort_array(F.transform(names, lambda m: F.struct(F.length(m).alias("n"), m.alias("m"))), False), lambda x: x["m"])
    return F.when(F.size(names) > 0, F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ANY))


def kind(m: Column) -> Column:
    """A mention's type: of the first pattern that fits all of it."""
    return reduce(lambda rest, p: F.when(m.rlike(rf"^(?:{p[1]})$"), p[0]).otherwise(rest), reversed(PATTERNS[:-1]), F.lit("name"))


def norm(m: Column, t: Column) -> Column:
    """What makes mentions the same entity: digits of a number, else the mention; an e-mail address in lower case, a name without 's."""
    return F.when(t == "name", F.regexp_replace(m, _OWNS, "")).when(t.isin(*DIGITS), F.regexp_replace(m, "[^0-9]", "")).when(t == "email", F.lower(m)).otherwise(m)


def _byte(digest: Column, i: Column) -> Column:
    """Number i of a digest of 64 bytes in hex, 0..255; beyond, mixed with the round."""
    at = F.pmod(i, F.lit(64))
    return F.pmod(F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 37, F.lit(256))


def _pick(values: tuple, n: Column, but: Column | None = None) -> Column:
    """Value number n, of those other than but."""
    left = F.lit(list(values)) if but is None else F.array_remove(F.lit(list(values)), but)
    return F.element_at(left, F.pmod(n, F.size(left)).cast("int") + 1)


def _shaped(s: Column, digest: Column) -> Column:
    """Digits to digits, hex letters to hex letters in hex strings, letters to letters of their case; the rest stays."""
    hexed = s.rlike("^[0-9a-fA-F]{32,}$")

    def one(c, i):
        b = _byte(digest, i)
        span = F.when(hexed, 6).otherwise(26)
        letter = lambda base: F.chr((F.pmod(b, span) + base).cast("long"))
        return F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    chars = F.reverse(F.split(digits, ""))
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10))


def _octets(s: Column, digest: Column) -> Column:
    """Each octet to one of as many digits."""

    def one(o, i):
        b = _byte(digest, i)
        return F.when(F.length(o) == 1, F.pmod(b, F.lit(10))).when(F.length(o) == 2, F.pmod(b, F.lit(90)) + 10).otherwise(F.pmod(b, F.lit(156)) + 100).cast("string")

    return F.array_join(F.transform(F.split(s, r"\."), one), ".")


def _by_script(s: Column, made) -> Column:
    return reduce(lambda rest, x: F.when(s.rlike(x[1]), made(x[0])).otherwise(rest), (("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}")), made("latin"))


def _surname(s: Column, digest: Column, attempt: Column) -> Column:
    """A surname of the script of s; later attempts draw longer ones."""
    return _by_script(s, lambda script: F.initcap(F.array_join(_syllables(script, digest, attempt), "")))


def _given(s: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """Another given name of the script and gender of s; later attempts draw double and longer ones."""

    def made(script):
        one = lambda g: F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(GIVEN[script][g], _byte(digest, i), F.substring_index(s, " ", 1))), "-")
        return F.when(gender == "f", one("f")).when(gender == "m", one("m")).otherwise(one("n"))

    return _by_script(s, made)


def _syllables(script: str, digest: Column, attempt: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda i: _pick(SYLLABLES[script], _byte(digest, i)))


def surrogate(entity: Column, t: Column, attempt: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), t, entity, attempt.cast("string")), 512)
    shaped = _shaped(entity, digest)
    lead = F.concat(F.substring(entity, 1, 1), F.substring(shaped, F.lit(2), F.length(shaped) - 1))  # a card's kind, a number's country
    open_end = F.substring(lead, F.lit(1), F.length(lead) - 1)
    check = F.pmod(10 - _luhn(F.concat(open_end, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(entity) == 0, F.concat(open_end, check)).otherwise(lead)
    last = F.regexp_extract(entity, r"(\.[A-Za-z]+)$", 1)
    email = F.concat(F.substring(shaped, F.lit(1), F.length(shaped) - F.length(last)), last)
    iban = F.concat(F.substring(entity, 1, 2), F.substring(shaped, F.lit(3), F.length(shaped)))
    kept = F.concat(F.regexp_extract(entity, r"^((?:AKIA|ASIA|sk|pk|ghp|gho)[_-]?)", 1), F.expr("''"))
    secret = F.when(F.length(kept) > 0, F.concat(kept, F.substring(shaped, F.length(kept) + 1, F.length(shaped)))).otherwise(shaped)
    return F.when(t == "card", card).when(t == "phone", lead).when(t == "email", email).when(t == "address", _octets(entity, digest)).when(t == "iban", iban).when(t == "secret", secret).when(t == "name", _surname(entity, digest, attempt)).otherwise(shaped)


def _exchanged(now: DataFrame, key: str) -> DataFrame:
    """now(type, entity, surrogate, clash) with the values of full shapes passed round among their entities.

    Values of a full shape that the draws made are none of its entities, so what is passed round is free. A lone entity
    of a shape keeps its last draw. Names have longer draws at hand and are never full.
    """
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("entity", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    now = now.withColumn("shape", shape)
    full = now.groupBy("type", "shape").agg(F.count("*").alias("n"), F.bool_or("clash").alias("full")).where("full and n > 1").drop("full")
    h = F.sha2(F.concat_ws("|", F.lit(key), "type", "entity"), 256)
    within = F.pmod(F.xxhash64(h), F.greatest(F.floor(F.col("n") / EXCHANGE), F.lit(1)))
    turn = Window.partitionBy("type", "shape", "slot").orderBy("h")
    ring = now.join(full, ["type", "shape"]).withColumns({"h": h, "slot": within})
    ring = ring.withColumn("surrogate", F.coalesce(F.lead("entity").over(turn), F.first("entity").over(turn)))
    return now.join(full, ["type", "shape"], "left_anti").select("type", "entity", "surrogate").unionByName(ring.select("type", "entity", "surrogate"))


def _distinct(now: DataFrame, drawn_by, rest: tuple = (), key: str | None = None) -> DataFrame:
    """now(type, entity, attempt, *rest) -> (type, entity, surrogate), drawn again until none collides with another or with a real entity.

    key: after DRAWS draws, full shapes exchange their values.
    """
    first = Window.partitionBy("type", "surrogate").orderBy("attempt", "entity")
    for draw in rounds(1):
        drawn = now.withColumn("surrogate", drawn_by)
        real = now.select("type", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        drawn = drawn.join(real, ["type", "surrogate"], "left").withColumn("clash", (F.row_number().over(first) > 1) | F.coalesce("real", F.lit(False)))
        now = written(drawn.select("type", "entity", *rest, (F.col("attempt") + F.when(F.col("clash"), 1).otherwise(0)).alias("attempt"), "surrogate", "clash"), "entities")
        if now.where("clash").isEmpty():
            return now.select("type", "entity", "surrogate")
        if key is not None and draw >= DRAWS and not now.where("clash and type <> 'name'").isEmpty():
            names = now.where("type = 'name'").select("type", "entity", *rest, "attempt")
            return written(_exchanged(now.where("type <> 'name'"), key), "exchanged").unionByName(_distinct(names, drawn_by, rest))
        now = now.drop("surrogate", "clash")


def entities(found: DataFrame, key: str) -> DataFrame:
    """found(type, entity, gender), distinct -> (type, entity, surrogate), one to one within a type and never a real entity but in full shapes.

    A full name gets the surrogate of its surname with a given name before it.
    """
    whole = (F.col("type") == "name") & F.col("entity").contains(" ")
    each = found.withColumn("surname", F.when(whole, F.substring_index("entity", " ", -1)))
    single = each.select("type", F.coalesce("surname", "entity").alias("entity")).distinct().withColumn("attempt", F.lit(0))
    table = _distinct(written(single, "entities"), surrogate(F.col("entity"), F.col("type"), F.col("attempt"), key), key=key)
    full = each.where(whole).groupBy("type", "entity", "surname").agg(F.min("gender").alias("gender")).withColumn("attempt", F.lit(0))
    full = written(full.join(table.select("type", F.col("entity").alias("surname"), F.col("surrogate").alias("family")), ["type", "surname"]), "full-names")
    if full.isEmpty():
        return table
    digest = F.sha2(F.concat_ws("|", F.lit(key), "type", "entity", F.col("attempt").cast("string")), 512)
    given = _given(F.col("entity"), F.col("gender"), digest, F.col("attempt"))
    return table.unionByName(_distinct(full, F.concat_ws(" ", given, "family"), ("gender", "family")))


def _rendered(m: Column, t: Column, s: Column) -> Column:
    """A surrogate in the mention's punctuation: for numbers, its digits put where the mention has digits."""
    chars = F.split(m, "")
    filled = F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(s, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c))
    cased = F.when((t == "email") & m.rlike("^[^a-z]*$"), F.upper(s)).otherwise(s)
    return F.when(t.isin(*DIGITS), F.array_join(filled, "")).when(t == "name", F.concat(s, F.regexp_extract(m, f"({_OWNS})", 1))).otherwise(cased)


def _gender(text: str, m: Column) -> Column:
    """Of a title before a mention in the text."""
    hit = lambda g: F.rlike(F.col(text), F.concat(F.lit(rf"(?<![\p{{L}}])(?:{'|'.join(TITLES[g])})\.? "), m, F.lit(r"(?![\p{L}])")))
    return F.when(hit("f"), "f").when(hit("m"), "m").otherwise("n")


def session_key(spark: SparkSession) -> str:
    """The secret of the session setting ``spark.probelens.pii.key``; a random one where it is unset."""
    return spark.conf.get("spark.probelens.pii.key", None) or secrets.token_hex(32)


def replace_pii(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """docs with surrogates in the text; other columns as they are. count: a column for the number of replaced mentions.

    Null and empty texts stay. The same key gives the same surrogates for the same corpus; with another key, or where
    entities collide that did not before, they differ. key: a secret; None takes session_key(). Rows may repeat or lack
    a doc_id, which may have any type: texts meet their surrogates by hashes of id and text. A column of docs named like count gives way.
    """
    key = key or session_key(docs.sparkSession)
    if count:
        docs = docs.drop(count)
    names = docs.columns
    has = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    rows = docs.where(has).select("doc_id", text, F.struct(*docs.columns).alias("_row")).withColumn("_m", mentions(text)).withColumn("_p", _known(F.col("_m")))
    rows = rows.withColumn("_m", F.when(F.col("_p") == ANY, F.col("_m")).otherwise(F.regexp_extract_all(F.col(text), F.col("_p"), F.lit(0))))
    pairs = rows.select(F.xxhash64("doc_id").alias("_d"), F.xxhash64(text).alias("_h"), F.explode(F.array_distinct("_m")).alias("m"), F.col(text).alias("x"))
    pairs = pairs.withColumn("type", kind(F.col("m"))).withColumn("gender", F.when(F.col("type") == "name", _gender("x", F.col("m"))).otherwise("n"))
    pairs = written(pairs.select("_d", "_h", "m", "type", norm(F.col("m"), F.col("type")).alias("entity"), "gender"), "mentions")
    table = entities(pairs.select("type", "entity", "gender"), key)
    drawn = pairs.join(table, ["type", "entity"]).select("_d", "_h", "m", _rendered(F.col("m"), F.col("type"), F.col("surrogate")).alias("s"))
    maps = drawn.groupBy("_d", "_h").agg(F.map_from_entries(F.collect_set(F.struct("m", "s"))).alias("_s"))  # of one text
    some = rows.withColumns({"_d": F.xxhash64("doc_id"), "_h": F.xxhash64(text)}).join(maps, ["_d", "_h"], "left")
    between = F.split(F.col(text), F.col("_p"), -1)
    new = F.transform("_m", lambda m: F.coalesce(F.element_at("_s", m), m))
    joined = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size("_m")).alias("b"), new.alias("n")), lambda z: F.concat(z["b"], z["n"])), ""), F.element_at(between, -1))
    new_text = F.when(F.size("_m") > 0, joined).otherwise(F.col(text)).alias(text)
    more = (F.size("_m").alias(count), F.lit(0).alias(count)) if count else ()
    done = some.select(*[new_text if c == text else F.col("_row")[c].alias(c) for c in names], *more[:1])
    return done.unionByName(docs.where(~has).select(*names, *more[1:]))
