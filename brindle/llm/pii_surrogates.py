"""PII surrogates, by DataFrame functions only.

Detected entities (emails, IP addresses, social security numbers, payment cards, phone numbers, personal names) get keyed
replacements of their own type. A surrogate is a function of key, type and canonical value, so mentions of one entity agree
whatever their format (coreference); digits go back into the mention's own punctuation (format), card numbers keep
passing the Luhn check if they did, given names keep gender and script, family names script. Surrogates of different
entities differ, and none is an entity of the corpus: every table of entities is checked for collisions, and colliding
entities are drawn again until none is left.

Null text stays null; empty text stays empty. Text without entities is returned as it is. Repeated rows get equal results.
Texts are handled whole. Ids tell which mentions a row has: rows that share an id share their table of surrogates. An
entity that a third of all rows hold is one row of the table of entities, and is joined back by broadcast. Entities that draw
one surrogate are told apart by their value. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import join_by_class, stage, text_of

# Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Paul Mark George Hans Klaus Pierre Jean Carlos Luis".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Anna Emma Laura Julia Marie Claire Greta Carmen Lucia".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Павел Олег Виктор".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Дарья".split(),
}
SYLLABLES = {"latin": "ba co den fer gar hol jen kin lor mas nel por quin ros sten tor".split(), "cyrillic": "ба во гор дан кар лев мир нов пет ров сам тур фил хар чер шин".split()}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"

ANY_NAME = "|".join(n for names in GIVEN.values() for n in names)
FAMILY = r"\p{Lu}[\p{L}'-]*\p{Ll}"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\p{L}\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\d]|\.\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d-])",
    "card": r"(?<![\p{L}\d+])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?(?![\p{L}\d])|(?<![\p{L}\d])\+\d{7,15}(?![\p{L}\d])",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLES})\.? (?:(?:{ANY_NAME}) )?{FAMILY}|(?:{ANY_NAME}) {FAMILY})(?!\p{{L}})",
}
#: All kinds, earlier ones first. What a match must begin with is asked first: most places then cost one character.
NUMBERS = "|".join(KINDS[k] for k in ("ip", "ssn", "card", "phone"))
ENTITY = rf"(?:{KINDS['email']})|(?=[\d(+])(?:{NUMBERS})|(?=\p{{Lu}}){KINDS['name']}"
MARK, ESCAPE = "\ue000", "\ue001"
#: From so many draws on, a crowded type's surrogates grow by a digit or a syllable, or use more address space, and again every
#: fourth draw; then draws are unlikely to end.
CROWDED, MOST_DRAWS = 8, 40
#: Bytes of per-document tables that may be broadcast.
BROADCAST_BYTES = 32 << 20


def parts(text: Column) -> Column:
    """Text before, entity, text, entity, ..., text after. MARK and ESCAPE in the text are escaped."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(MARK), F.lit(ESCAPE + "1"))
    return F.split(F.regexp_replace(safe, ENTITY, f"{MARK}$0{MARK}"), MARK, -1)


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def entities_in(cut: Column) -> Column:
    """The distinct entities among the parts."""
    return F.array_distinct(F.filter(cut, lambda x, i: i % 2 == 1))


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "card", "ssn", "ip", "email"):
        out = F.when(mention.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def hash_digits(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """64 keyed decimal digits."""
    return F.translate(F.sha2(F.concat_ws("\0", F.lit(key), kind, value, draw.cast("string"), F.lit(key)).cast("binary"), 256), "abcdef", "012345")


def luhn_sum(number: Column, doubled: int) -> Column:
    """Sum of digits from the right, each second one doubled, counted from place `doubled`."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == doubled, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def drawn(key: str) -> Column:
    """The surrogate of a canonical value, of columns kind, value and draw."""
    kind, value = F.col("kind"), F.col("value")
    h = hash_digits(key, kind, value, F.col("draw"))
    octet = [F.substring(h, 1 + 4 * i, 4).cast("int") % 254 + 1 for i in range(3)]
    grown = F.greatest(F.lit(0), F.floor((F.col("draw") - CROWDED) / 4) + 1).cast("int")
    same_length = F.concat(F.substring(value, 1, 1), F.substring(h, 1, 63)).substr(F.lit(1), F.length(value) + grown)
    body = same_length.substr(F.lit(1), F.length(same_length) - 1)
    check = ((10 - luhn_sum(body, 0) % 10) % 10).cast("string")
    place = F.sequence(F.lit(0), F.least(3 + grown, F.lit(20)))

    def family(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        return F.initcap(F.array_join(F.transform(place, lambda i: F.element_at(syllables, F.substr(h, 1 + 3 * i, F.lit(3)).cast("int") % len(SYLLABLES[script]) + 1)), ""))

    return (
        F.when(kind == "email", F.concat(F.lit("user"), F.substring(h, 1, 12), F.lit("@mail"), F.substring(h, 13, 1), F.lit(".example.org")))
        .when(kind == "ip", F.concat_ws(".", F.when(grown == 0, "10").otherwise((F.substring(h, 20, 3).cast("int") % 15 + 240).cast("string")), *(o.cast("string") for o in octet)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(h, 1, 60)).substr(F.lit(1), F.lit(9) + grown))
        .when((kind == "card") & (luhn_sum(value, 1) % 10 == 0), F.concat(body, check))
        .when(kind.isin("card", "phone"), same_length)
        .when(kind == "family-latin", family("latin"))
        .otherwise(family("cyrillic"))
    )


def settle(entities: DataFrame, key: str, most_draws: int = MOST_DRAWS) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no two alike within a kind, and none a value of the kind."""
    open_, settled = entities.withColumn("draw", F.lit(0)), None
    for _ in range(most_draws):
        tried = open_.withColumn("surrogate", drawn(key))
        values = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        taken = values if settled is None else values.unionByName(settled.select("kind", "surrogate", F.lit(True).alias("real")))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value"))
        judged = stage(tried.withColumn("n", first).join(taken.distinct(), ["kind", "surrogate"], "left"), "surrogates")
        good = judged.filter("n = 1 and real is null").select("kind", "value", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        open_ = judged.filter("n > 1 or real").select("kind", "value", (F.col("draw") + 1).alias("draw"))
        if open_.isEmpty():
            return settled
    raise ValueError(f"a type has too few surrogates for its entities after {most_draws} draws")


def refit(mention: Column, number: Column) -> Column:
    """The mention with its digits replaced, one by one, by those of number; more of them follow the last."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substr(number, a["i"] + 1, F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
    return F.aggregate(F.split(mention, ""), start, step, lambda a: F.concat(a["s"], F.substr(number, a["i"] + 1)))


def given_surrogate(name: Column, key: str) -> Column:
    """A given name of the same gender and script, by a keyed rotation of its list: different names stay different."""
    out = name
    for (gender, script), names in GIVEN.items():
        shift = F.abs(F.xxhash64(F.lit(f"{key}/{gender}/{script}"))) % (len(names) - 1) + 1
        listed = F.array(*map(F.lit, names))
        at = F.array_position(listed, name)
        out = F.when(at > 0, F.element_at(listed, (((at - 1 + shift) % len(names)) + 1).cast("int"))).otherwise(out)
    return out


def mention_table(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, size, surrogate) of distinct mentions with their numbers of rows."""
    family = F.regexp_extract("mention", r"(\S+)$", 1)
    known = mentions.withColumn("type", kind_of(F.col("mention"))).withColumns(
        {
            "kind": F.when(F.col("type") == "name", F.concat(F.lit("family-"), script_of(family))).otherwise(F.col("type")),
            "value": F.when(F.col("type") == "name", family).when(F.col("type") == "email", F.lower("mention")).when(F.col("type") == "ip", F.col("mention")).otherwise(digits(F.col("mention"))),
        }
    )
    known = stage(known, "mentions")
    settled = settle(known.select("kind", "value").distinct(), key)
    given = F.regexp_extract("mention", rf"({ANY_NAME}) \S+$", 1)
    before = F.regexp_extract("mention", rf"^((?:{TITLES})\.? )", 1)
    whole = F.concat(before, F.when(given != "", F.concat(given_surrogate(given, key), F.lit(" "))).otherwise(""), F.col("surrogate"))
    rendered = F.when(F.col("type") == "name", whole).when(F.col("type").isin("email", "ip"), F.col("surrogate")).otherwise(refit(F.col("mention"), F.col("surrogate")))
    return known.join(settled, ["kind", "value"]).select("mention", "size", "type", rendered.alias("surrogate"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_entities (mentions), n_distinct, and text with its entities replaced."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = stage(rows.select("id", F.explode_outer(entities_in(parts(text_of()))).alias("mention")).filter("mention is not null").distinct(), "entity-rows")
    table = stage(mention_table(each.groupBy("mention").agg(F.count("*").alias("size")), key), "mention-table")
    joined = join_by_class(each, table.select("mention", "size", "surrogate"), "mention", "size", each.count())
    # two documents' tables of one id are one table; each mention is in it once
    tables = joined.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("mention", "surrogate"))).alias("table"))
    tables = stage(tables, "entity-tables").withColumnRenamed("id", "i")
    weight = joined.agg(F.sum(F.length("mention") + F.length("surrogate") + 32)).first()[0] or 0
    tables = F.broadcast(tables) if weight <= BROADCAST_BYTES else tables.hint("shuffle_hash")
    cut = rows.join(tables, rows["id"].eqNullSafe(F.col("i")), "left").withColumn("cut", parts(F.col("text")))
    replaced = F.transform("cut", lambda x, i: F.when(i % 2 == 1, F.element_at("table", x)).otherwise(x))
    return cut.select(
        F.col("id").alias(id_col),
        F.coalesce(F.floor(F.size("cut") / 2), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.size(F.map_keys("table")), F.lit(0)).cast("long").alias("n_distinct"),
        F.when(F.col("text").isNull(), None).otherwise(unescaped(F.array_join(replaced, ""))).alias("text"),
    )
