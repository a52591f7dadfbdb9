r"""Personal data and secrets replaced by keyed surrogates (SQL functions only).

Entities: e-mail addresses, IPv4 and IPv6 addresses, card numbers, IBANs (with groups of letters as well), telephone and social-security
numbers, secrets (hex strings of 32 or more, known key prefixes, values assigned to names that end in "token", "password" and the like), and
personal names: a known given name with initials and a surname, double-barrelled or in capitals too, and unlisted names after a title or a
label ("Dr. ...", "name: ..."). Names that neither begin with a listed given name nor stand after such a word are not found. An entity's
*canonical form* (digits only for numbers, lower case for e-mail addresses, one case for names) and a key decide its surrogate, so every mention
of it, however it is written, becomes the same one, in the mention's own format: a digit stays a digit, capital and small letters stay
so, punctuation stays, a dotted number keeps the length of its parts, a card number that passed the check digit passes it again,
the top-level domain stays. A given name becomes another of the same gender and script, a surname a made-up one of that script.
Coreference: in a text, a surname that a full name there has (after a title or on its own) becomes the surname of that name's surrogate; of
several people with one surname the first counts. A mention of only a given name stays.

The key is an argument or the setting ``spark.strataframe.pii.key``; without either an application draws one at random, so that nobody can
work the surrogates out again. Draws come from HMAC-SHA256.

Collision checks: the surrogates of all distinct entities of the corpus are compared with each other and with all real entities;
whichever meets another (all but the least entity) or is real itself draws again, until none is left. A format of few values may be full
(all 10^4 dotted numbers of single digits); from the ``GROW``th draw on surrogates get longer, so that the draws always end. Only
exceptions, which are few, are joined to the texts; where there are none, texts are rewritten without a join. Distinct entities are found with
partial aggregation, so one address in a third of all texts is a row for each task.

Each text is rewritten in one pass, as the pieces between entities and the entities' surrogates in turn.

Defined cases: a null text stays null (``n_entities`` 0), an empty one empty; texts of any length are whole; rows that repeat an id are
rewritten each; null ids are kept; entities do not overlap (the leftmost counts, and of several kinds the first in the list above).
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataframe.llm.shared import few, read, removed, stored

SETTING, GROW = "spark.strataframe.pii.key", 12
#: Marks entities while a text is split; texts that hold it take a longer way.
EDGE = "\ufdd0"
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): ["Alice", "Amina", "Anna", "Carla", "Elena", "Emma", "Fatima", "Hannah", "Julia", "Laura", "Linda", "Lucy", "Maria", "Mary", "Mei", "Nina", "Olivia", "Priya", "Sarah", "Sophie", "Susan", "Yuki"],
    ("m", "latin"): ["Adam", "Ahmed", "Carlos", "Daniel", "David", "Felix", "Hiroshi", "James", "John", "Jonas", "Lucas", "Martin", "Michael", "Mohammed", "Omar", "Paul", "Peter", "Raj", "Robert", "Stefan", "Thomas", "Wei", "William"],
    ("f", "cyrillic"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("m", "cyrillic"): ["Алексей", "Андрей", "Борис", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"],
    ("f", "greek"): ["Αγγελική", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"],
}
SYLLABLES = {
    "latin": ["bar", "cor", "dan", "fel", "gar", "hol", "kin", "lan", "mar", "nor", "pel", "ros", "san", "tor", "val", "win"],
    "cyrillic": ["бар", "вол", "гор", "дан", "зор", "кал", "лев", "мар", "нов", "пол", "рос", "сок", "тар", "фед", "хол", "чер"],
    "greek": ["βαρ", "γερ", "δελ", "καρ", "λαμ", "μαν", "νικ", "παλ", "ραπ", "σαρ", "ταν", "φωτ"],
}
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_CAPITAL = "|".join(n.upper() for names in GIVEN.values() for n in names)
_WORD, _CAPITALS = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+", r"\p{Lu}{2,}+(?:-\p{Lu}{2,}+)*+"
_BEFORE = "|".join([r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ", r"(?i:name|contact|author|patient|customer|employee): ", "(?i:my name is|signed by|sincerely,) "])
_JUNK = r"[^\p{L}\p{N}\s]{0,3} ?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)*(?<=\.\p{L}{2,20})",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:\+?\d{{1,3}}{_JUNK})?\(\d{{3}}\){_JUNK}\d{{3}}[\-. ]\d{{4}}(?!\d)|(?<![\p{{L}}\p{{N}}.\-])(?:(?:\d{{1,3}}[ .\-])?\d{{3}}[\-.])?\d{{3}}-\d{{4}}(?![\d\-])|(?<![\p{{L}}\p{{N}}])\+\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,5}}(?!\d)|(?<![\p{{L}}\p{{N}}.\-])0\d{{2,4}}[ \-]\d{{3,4}}[ \-]?\d{{3,4}}(?![\d\-])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{12,}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|xox[abp]-[0-9A-Za-z\-]{10,})(?![\p{L}\p{N}])|(?<=[=:\s\"'])(?<=(?i:token|secret|passwd|password|api.key|access.key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[0-9A-Za-z+/_\-]{8,}",
    "name": rf"(?<!\p{{L}})(?:(?:{_GIVEN})(?: \p{{Lu}}\.)*+ {_WORD}|(?:{_CAPITAL})(?: \p{{Lu}}\.)*+ {_CAPITALS}|(?<={_BEFORE}){_WORD}(?:(?: \p{{Lu}}\.)*+ {_WORD})?+)(?!\p{{L}})",
}
#: Cheap conditions that hold wherever an entity of the kind can begin; the engine tries the patterns only there.
_OPENS = {
    "email": r"(?=[\p{L}\p{N}._%+\-])",
    "ip": r"(?=\d)",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)",
    "card": r"(?=\d)",
    "iban": r"(?=[A-Z]{2}\d)",
    "ssn": r"(?=\d)",
    "phone": r"(?=[+(\d])",
    "secret": r"(?=[0-9A-Za-z+/_\-])",
    "name": r"(?=\p{Lu})",
}
#: All entities of a text. Each begins at a digit or where no letter is before it, so inside a word of letters nothing is tried.
ENTITY = r"(?:(?<!\p{L})|(?=\d))(?:" + "|".join(f"{_OPENS[k]}(?:{p})" for k, p in PATTERNS.items()) + ")"


def kind(e: Column) -> Column:
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$"), "ip6")
        .when(e.rlike(r"^[\d \-]+$") & (digits >= 13), "card")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[+(\d][^\p{L}]*$"), "phone")
        .when(e.rlike(rf"^(?:{_WORD}|{_CAPITALS} (?=\p{{L}}))(?:(?: \p{{Lu}}\.)* \p{{Lu}}[\p{{L}}\-]+|{_CAPITALS}|$)$") | e.rlike(rf"^{_WORD}$"), "name")
        .when(e.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & (F.length(F.replace(e, F.lit(" "))) <= 34), "iban")
        .otherwise("secret")
    )


def canonical(e: Column, k: Column) -> Column:
    return F.when(k.isin("email", "ip6"), F.lower(e)).when(k == "name", F.initcap(F.lower(e))).when(k.isin("card", "ssn", "phone"), F.regexp_replace(e, r"\D", "")).when(k == "iban", F.replace(e, F.lit(" "))).otherwise(e)


def _draw(seed: Column, i: Column | int, n: Column | int) -> Column:
    """A number below n from the key's hash and a place."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, F.lit(i) if isinstance(i, int) else i.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits modulo ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _letters(e: Column, seed: Column, first: Column) -> Column:
    """Each letter or digit from place ``first`` on becomes one of its class; places count letters and digits only."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        draw = lambda n: _draw(seed, s["i"], n)
        new = (
            F.when(~c.rlike(r"[\p{L}\p{N}]") | (s["i"] < first), c)
            .when(c.rlike(r"\d"), draw(10).cast("string"))
            .when(c.rlike("[A-Z]"), F.char(draw(26) + 65))
            .when(c.rlike("[a-z]"), F.char(draw(26) + 97))
            .when(c.rlike(r"[Ѐ-ӿ]"), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), (draw(27) + 1).cast("int"), F.lit(1)))
            .when(c.rlike(r"[Ͱ-Ͽ]"), F.substr(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), (draw(24) + 1).cast("int"), F.lit(1)))
            .otherwise(F.substr(F.lit("áàâäéèêëíìîïóòôöúùûü"), (draw(20) + 1).cast("int"), F.lit(1)))
        )
        return F.struct(F.concat(s["out"], new).alias("out"), (s["i"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("i"))

    return F.aggregate(F.split(e, ""), state, step)["out"]


def _hex(e: Column, seed: Column) -> Column:
    """A hex string stays one, in its own case."""
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.length(e) - 1), lambda i: F.lower(F.hex(_draw(seed, i, 16)))), "")
    return F.when(e.rlike("[A-F]"), F.upper(made)).otherwise(made)


def key_of(spark: SparkSession, key: str | None = None) -> str:
    """The key given, that of the session, or one that this application draws."""
    key = key or spark.conf.get(SETTING, None)
    if not key:
        context = spark.sparkContext
        key = context._strataframe_key = getattr(context, "_strataframe_key", None) or secrets.token_hex(32)
    return key


def seed_of(k: Column, canon: Column, attempt: Column, key: str) -> Column:
    """HMAC-SHA256 of an entity and an attempt."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in own)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat_ws("|", k, canon, attempt.cast("string")).cast("binary")), 256))), 256)


def _name(e: Column, seed: Column, attempt: Column) -> Column:
    """Another given name of the gender and script, initials drawn anew, made-up words for the rest, all in the mention's case."""

    def word(t: Column, place: Column) -> Column:
        out = None
        for script, letters in (("greek", "[Ͱ-Ͽ]"), ("cyrillic", "[Ѐ-ӿ]"), ("latin", ".")):
            sound = F.array(*map(F.lit, SYLLABLES[script]))
            count = F.lit(2) + F.least(attempt, F.lit(4)).cast("int")
            made = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(sound, (_draw(seed, F.concat_ws(".", place, i), len(SYLLABLES[script])) + 1).cast("int"))), ""))  # noqa: B023
            out = F.when(t.rlike(letters), made) if out is None else out.when(t.rlike(letters), made)
        return out

    def part(t: Column, i: Column) -> Column:
        out = F.when(t.rlike(r"^\p{L}\.$"), F.concat(F.char(_draw(seed, i, 26) + 65), F.lit(".")))
        for pool in GIVEN.values():
            names = F.array(*map(F.lit, pool))
            own, drawn = F.array_position(names, F.initcap(F.lower(t))), _draw(seed, 0, len(pool) - 1) + 1
            out = out.when((i == 0) & (own > 0), F.element_at(names, (drawn + (drawn >= own).cast("int")).cast("int")))
        return out.otherwise(F.array_join(F.transform(F.split(t, "-"), lambda p, j: word(p, F.concat_ws("-", i, j))), "-"))

    made = F.array_join(F.transform(F.split(e, " "), part), " ")
    return F.when((F.upper(e) == e) & (F.length(e) > 2), F.upper(made)).otherwise(made)


def surrogate(e: Column, k: Column, seed: Column, attempt: Column) -> Column:
    """The surrogate of a mention. Its seed depends on the canonical form; it takes the mention's format."""
    octets = F.array_join(
        F.transform(F.split(e, r"\."), lambda p, i: F.when(F.length(p) == 1, _draw(seed, i, 10)).when(F.length(p) == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 156) + 100).cast("string")), "."
    )
    digits = F.regexp_replace(e, r"\D", "")
    card = _letters(e, seed, F.lit(1))
    passed = _luhn(digits) == 0
    made = F.regexp_replace(card, r"\D", "")
    # The last digit moves by what the check sum is off; its own weight there is one.
    last = F.pmod(F.substr(made, F.length(made), F.lit(1)).cast("int") - _luhn(made), F.lit(10)).cast("string")
    card = F.when(passed, F.concat(F.substr(card, F.lit(1), F.length(card) - 1), last)).otherwise(card)
    top = F.regexp_extract(e, r"(\.[^.@]+)$", 1)
    mail = F.concat(_letters(F.substr(e, F.lit(1), F.length(e) - F.length(top)), seed, F.lit(0)), top)
    plain = _letters(e, seed, F.when(k == "phone", F.when(F.length(digits) > 10, 1).otherwise(0)).when(k == "iban", 2).otherwise(0))
    secret = F.when(e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _hex(e, seed)).otherwise(plain)
    six = F.regexp_replace(e, "[0-9A-Fa-f]", "0")
    six = F.array_join(F.transform(F.split(six, ""), lambda c, i: F.when(c == "0", F.lower(F.hex(_draw(seed, i, 16)))).otherwise(c)), "")
    # From the GROWth draw on a few more digits.
    longer = F.array_join(F.transform(F.filter(F.sequence(F.lit(GROW), F.greatest(attempt.cast("int"), F.lit(GROW))), lambda i: i < attempt), lambda i: _draw(seed, i + 1000, 10).cast("string")), "")
    any_octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _draw(seed, i, 256).cast("string")), ".")
    named = F.when(k == "ip6", six).when(k == "card", card).when(k == "secret", secret).otherwise(plain)
    return (
        F.when(k == "email", F.concat(longer, mail))
        .when(k == "ip", F.when(attempt < GROW, octets).otherwise(any_octets))
        .when(k == "name", F.concat(_name(e, seed, attempt), F.translate(longer, "0123456789", "abcdefghij")))
        .otherwise(F.concat(named, longer))
    )


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pieces(text: Column) -> Column:
    """What is between the entities of a text, and the entities, in turn."""
    marked = F.split(F.regexp_replace(text, ENTITY, f"{EDGE}$0{EDGE}"), EDGE, -1)
    apart = F.flatten(F.zip_with(F.split(text, ENTITY, -1), _all(text, ENTITY), lambda p, e: F.array(p, e)))
    return F.when(F.contains(text, F.lit(EDGE)), F.slice(apart, 1, F.size(apart) - 1)).otherwise(marked)


def _kinds(pieces: Column) -> Column:
    """(e, k, c) of each entity among the pieces: the mention, its kind and its canonical form, each worked out once."""
    known = F.transform(F.filter(pieces, lambda e, i: i % 2 == 1), lambda e: F.struct(e.alias("e"), kind(e).alias("k")))
    return F.transform(known, lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), canonical(x["e"], x["k"]).alias("c")))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canon): each distinct entity of the corpus once."""
    return docs.select(F.explode(_kinds(_pieces(F.col(text_col)))).alias("x")).select(F.col("x.k").alias("kind"), F.col("x.c").alias("canon")).distinct()


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt): the entities whose first surrogates met another surrogate or a real entity."""

    def drawn(df: DataFrame) -> DataFrame:
        seeded = df.withColumn("seed", seed_of(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        return seeded.select("kind", "canon", "attempt", surrogate(F.col("canon"), F.col("kind"), F.col("seed"), F.col("attempt")).alias("made"))

    # Few rows with much to work out: dealt by count, not by size.
    first = stored(known, "entities")
    tasks = known.sparkSession.sparkContext.defaultParallelism
    now = stored(drawn(first.repartition(tasks, "kind", "canon").withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        real = first.select("kind", canonical(F.col("canon"), F.col("kind")).alias("met"), F.lit(True).alias("real"))
        met = now.withColumn("met", canonical(F.col("made"), F.col("kind")))
        order = F.row_number().over(Window.partitionBy("kind", "met").orderBy("attempt", "canon"))
        judged = met.withColumn("order", order).join(real, ["kind", "met"], "left")
        again = stored(judged.where("order > 1 or real").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "again")
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        old, now = now, stored(now.join(again, ["kind", "canon"], "left_anti").unionByName(drawn(again)), "surrogates")
        removed(old, again)


def _people(found: Column, made: Column) -> Column:
    """(old, new) surnames of the full names of a text, in one case, the first of each: surrogates of later mentions of the surname alone."""
    last = lambda name: F.element_at(F.split(F.when(F.upper(name) == name, F.initcap(F.lower(name))).otherwise(name), " "), -1)
    both = F.zip_with(found, made, lambda x, m: F.struct(x["k"].alias("k"), x["e"].alias("e"), last(x["e"]).alias("old"), last(m).alias("new")))
    return F.transform(F.filter(both, lambda p: (p["k"] == "name") & F.contains(p["e"], F.lit(" ")) & (F.length(p["old"]) > 2)), lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new")))


def _renamed(made: Column, mention: Column, people: Column) -> Column:
    """The surrogate of a mention of one word: that of the person with this surname, if the text names one in full."""
    whose = F.get(F.filter(people, lambda p: F.lower(p["old"]) == F.lower(mention)), F.lit(0))["new"]
    return F.when(F.contains(mention, F.lit(" ")) | whose.isNull(), made).when(F.upper(mention) == mention, F.upper(whose)).otherwise(whose)


def _surnames(piece: Column, people: Column) -> Column:
    """What is between entities, with the surnames of people in it replaced, whole words only."""

    def one(text: Column, p: Column) -> Column:
        word = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}_\-])"), w, F.lit(r"(?![\p{L}\p{N}_\-])"))
        big, small = F.upper(p["old"]), p["old"]
        return F.when(F.contains(text, small) | F.contains(text, big), F.regexp_replace(F.regexp_replace(text, word(small), p["new"]), word(big), F.upper(p["new"]))).otherwise(text)

    return F.aggregate(people, piece, one)


def rewritten(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts rewritten, and a column n_entities."""
    key = key_of(docs.sparkSession, key)
    odd = stored(exceptions(entities(docs, text_col), key), "exceptions")
    held = docs.withColumn("__pieces", _pieces(F.col(text_col))).withColumn("__found", _kinds(F.col("__pieces")))
    if not odd.isEmpty():
        # By the row's contents, not by its id alone: what rows of one hash would share are facts about entities, which hold everywhere.
        row = F.xxhash64(F.col(id_col), F.col(text_col))
        own = docs.select(row.alias("__id"), F.explode(_kinds(_pieces(F.col(text_col)))).alias("x"))
        own = own.select("__id", F.col("x.k").alias("kind"), F.col("x.c").alias("canon"))
        of_doc = own.join(F.broadcast(odd) if few(odd) else odd, ["kind", "canon"]).groupBy("__id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "canon"), "attempt"))).alias("__attempts"))
        held = held.withColumn("__id", row).join(of_doc, "__id", "left")

    def attempt(x: Column) -> Column:
        return F.lit(0) if "__attempts" not in held.columns else F.coalesce(F.try_element_at(F.col("__attempts"), F.concat_ws(":", x["k"], x["c"])), F.lit(0))

    tried = F.transform("__found", lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), x["c"].alias("c"), attempt(x).alias("a")))
    seeded = F.transform(tried, lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), x["a"].alias("a"), seed_of(x["k"], x["c"], x["a"], key).alias("s")))
    held = held.withColumn("__made", F.transform(seeded, lambda x: surrogate(x["e"], x["k"], x["s"], x["a"])))
    held = held.withColumn("__people", _people(F.col("__found"), F.col("__made")))
    size = F.greatest(F.size("__made"), F.lit(0))
    alone = lambda m, i: F.when(F.get("__found", i)["k"] == "name", _renamed(m, F.get("__found", i)["e"], F.col("__people"))).otherwise(m)
    made = F.when(F.size("__people") > 0, F.transform("__made", alone)).otherwise(F.col("__made"))
    pieces = F.when(F.size("__people") > 0, F.transform("__pieces", lambda p, i: F.when(i % 2 == 0, _surnames(p, F.col("__people"))).otherwise(p))).otherwise(F.col("__pieces"))
    held = held.withColumns({"__made": made, "__pieces": pieces})
    between = F.transform("__made", lambda m, i: F.concat(m, F.element_at(F.col("__pieces"), 2 * i + 3)))
    text = F.when(size > 0, F.concat(F.element_at("__pieces", 1), F.array_join(between, ""))).otherwise(F.col(text_col))
    return held.select(*(text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns), size.cast("long").alias("n_entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(read(spark, sf_dir, "documents").select("doc_id", "text"))
