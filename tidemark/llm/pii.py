"""Surrogates for personal data, in DataFrame functions alone.

Found are e-mail addresses, IPv4 and IPv6 addresses, phone and social security
numbers, IBANs, payment cards (with a valid check digit), credentials, and names
after a title (before it in Han characters). Each entity has a canonical form (lower case, or digits alone), and the
surrogate is drawn from a keyed digest of that: the same entity gets the same
surrogate in every document and every way of writing. A surrogate keeps type and
format: lengths, groups, case and character classes; a card's check digit, a
phone's country code and an IBAN's country; a name's script and, from its title,
its gender. A name's other mentions in the text follow it, without a title as well, and so do
those of a full name in any text of the table. A given name has one surrogate, of
the gender that some title gives it. An initial gives the initial of its surrogate.
Words of a name that also have another sense in the same text are changed with it.

Draws are checked: of entities that draw the same surrogate the first keeps it,
and none may equal an entity of the table; the others draw again until all are
distinct. Those few are stored and reach the documents that need them by a join
on a hash of the text; all other surrogates are computed in place.

Null text stays null and has no entities. Rows that repeat get the same result.
All columns stay as they are but the text; columns may have any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import documents
from tidemark.session import cut_lineage

KEY = "tidemark-surrogates"  # a deployment gives its own secret
MORE_ROOM = 6  # draws after which a surrogate may grow by letters or digits

_WORDS = r"(?i:password|passwd|pwd|secret|token|api[_ -]?key)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Fixed formats of each kind.
PATTERNS = {
    "secret": rf"(?<={_WORDS} {{0,2}}[=:] {{0,2}}[\"']{{0,1}})[A-Za-z0-9+/_.-]{{8,}}|\bAKIA[0-9A-Z]{{16}}\b",
    # A match begins where its run begins and gives nothing back, so a long run is looked at once.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,20}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
    r"|(?<![\d.-])(?:\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\d.-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold for any of them.
HINT = rf"[0-9@]|{_WORDS} {{0,2}}[=:]"
# Titles by gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин", "κύριος", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "госпожа", "κυρία"],
    "n": ["Dr", "Prof", "Professor", "Doktor"],
}
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_WORD = r"\p{Lu}(?:[\p{L}'-]+|\.)"  # of a name: a word or an initial
NAME = rf"(?<![\p{{L}}-])(?:{_ALL_TITLES})\.? +{_WORD}(?: {_WORD}){{0,2}}"
# Runs of words in which a full name may stand.
RUN = r"(?<![\p{L}'-])\p{Lu}(?:[\p{L}'-]++|\.)(?: \p{Lu}(?:[\p{L}'-]++|\.))++"
LONGEST = 3  # words of a full name
# Sixteen consonants and vowels of a script, one per hexadecimal digit, and the endings of names by gender.
SCRIPTS = {
    "Latin": ("bdfgklmnprstvzhj", "aeiouaeiouaeioua", {"m": "o", "f": "a", "n": "e", "s": "er"}),
    "Cyrillic": ("бвгдзклмнпрстфхж", "аеиоуаеиоуаеиоуа", {"m": "н", "f": "а", "n": "е", "s": "ко"}),
    "Greek": ("βγδζθκλμνξπρστφχ", "αεηιοαεηιοαεηιοα", {"m": "ος", "f": "α", "n": "ι", "s": "ου"}),
    "Han": ("王李张刘陈杨黄赵吴周徐孙马朱胡林", "文明华国建立志海天平安永春东成光", {"m": "伟", "f": "芳", "n": "晨", "s": "家"}),
}
# Where a title follows the name: common surnames, then one or two characters.
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "教授": "n", "博士": "n"}
HAN_NAME = rf"[{SCRIPTS['Han'][0]}]\p{{IsHan}}{{1,2}}?(?:{'|'.join(HAN_TITLES)})"
_HEX = "0123456789abcdef"
_LETTERS = "abcdefghijklmnop"


def _digest(kind: Column, canon: Column, attempt: Column, key: str, salt: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(salt), kind, attempt.cast("string"), canon), 256)


def _digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Digit sum from the right; every second digit doubled, from place `doubled` on."""
    n = F.length(digits)
    place = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def add(total, i):
        d = F.coalesce(F.substring(digits, n - i + 1, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(place, F.lit(0), add)


def kind_of(entity: Column) -> Column:
    """The kind of a match; null for a run of digits that is no card."""
    found = F.lit(None).cast("string")
    for kind in reversed(list(PATTERNS)):
        if kind == "secret":
            # Its own pattern needs what stands before; anything that no other kind takes is one.
            continue
        whole = entity.rlike(f"^(?:{PATTERNS[kind]})$")
        if kind == "card":
            digits = _digits_only(entity)
            found = F.when(whole, F.when((_luhn_sum(digits, 0) % 10 == 0) & (F.length(digits) <= 19), F.lit(kind))).otherwise(
                F.lit("secret")
            )
        else:
            found = F.when(whole, F.lit(kind)).otherwise(found)
    return found


def _country(entity: Column) -> Column:
    """The sign and digits of a phone number's country code, if it stands apart."""
    return F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)


GENDERS = ("m", "f", "n", "s")


def canon_of(kind: Column, entity: Column) -> Column:
    code = _country(entity)
    return (
        F.when(kind == "phone", F.concat(code, F.lit(":"), _digits_only(F.substring(entity, F.length(code) + 1, F.length(entity)))))
        .when(kind.isin("ssn", "card"), _digits_only(entity))
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin(*GENDERS), F.lower(entity))
        .otherwise(entity)
    )


def _by_class(text: Column, digest: Column, keep: Column, letters: str = _LETTERS) -> Column:
    """Digits for digits and letters for letters of either case; the first `keep` characters stay."""
    n = F.length(text)

    def draw(i):
        c = F.substring(text, i, F.lit(1))
        # Every place has its own hexadecimal digit; long texts take further digests.
        h = F.substring(F.sha2(F.concat_ws(":", digest, F.floor((i - 1) / 64).cast("string")), 256), (i - 1) % 64 + 1, F.lit(1))
        letter = F.translate(h, _HEX, letters)
        return (
            F.when(i <= keep, c)
            .when(c.rlike("[0-9]"), F.translate(h, "abcdef", "024680"))
            .when(c.rlike(r"\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), draw), "")).otherwise(text)


def _name(kind: Column, canon: Column, digest: Column, more: Column) -> Column:
    """Syllables of the name's own script, about as many letters as it has, and the ending of its gender."""
    made = None
    syllables = F.least(F.lit(8), F.greatest(F.lit(2), F.floor(F.length(canon) / 2).cast("int"))) + more
    for script, (consonants, vowels, endings) in SCRIPTS.items():
        count = F.lit(1) + more if script == "Han" else syllables
        ending = F.create_map(*(F.lit(x) for pair in endings.items() for x in pair))[kind]
        body = F.transform(F.sequence(F.lit(1), count), _syllable(digest, consonants, vowels))
        name = F.concat(F.array_join(body, ""), ending)
        made = name if made is None else F.when(canon.rlike(rf"\p{{Is{script}}}"), name).otherwise(made)
    return made


def _syllable(digest: Column, consonants: str, vowels: str):
    pick = lambda k: F.substring(digest, k, F.lit(1))
    return lambda i: F.concat(F.translate(pick(2 * i), _HEX, consonants), F.translate(pick(2 * i + 1), _HEX, vowels))


def draw(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate, in canonical form, that an entity draws at an attempt."""
    name = draw_name(kind, canon, attempt, key)
    return F.when(kind.isin(*GENDERS), name).otherwise(draw_data(kind, canon, attempt, key))


def draw_name(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The draw of a name alone."""
    more = F.greatest(F.lit(0), attempt - MORE_ROOM)
    return _name(kind, canon, _digest(kind, canon, attempt, key, "entity"), more)


def draw_data(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The draw of anything but a name."""
    digest = _digest(kind, canon, attempt, key, "entity")
    more = F.greatest(F.lit(0), attempt - MORE_ROOM)
    room = F.substring(F.translate(digest, "abcdef", "135790"), F.lit(1), F.least(more, F.lit(32)))
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    ip = F.concat_ws(".", *((1 + byte(2 * i) * 256 % 254 + byte(2 * i + 1)) % 254 + 1 for i in range(4)))
    at = F.instr(canon, "@")
    local, domain = F.substring(canon, F.lit(1), at - 1), F.substring(canon, at + 1, F.length(canon))
    host = F.substring(_digest(F.lit("domain"), domain, F.lit(0), key, "domain"), 1, 8)
    email = F.concat(_by_class(local, digest, F.lit(0)), room, F.lit("@m"), host, F.lit(".example.net"))
    body = _by_class(F.substring(canon, F.lit(1), F.length(canon) - 1), digest, F.lit(1))
    card = F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string"))
    keep = F.when(kind == "iban", 2).when(kind == "phone", F.instr(canon, ":")).when(canon.startswith("AKIA"), 4).otherwise(0)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "ipv6", _by_class(canon, digest, F.lit(0), "abcdef" * 2 + "abcd"))
        .when(kind == "email", email)
        .when(kind == "card", card)
        .otherwise(F.concat(_by_class(canon, digest, keep), F.when(kind == "secret", room).otherwise(F.lit(""))))
    )


def render_name(entity: Column, surrogate: Column) -> Column:
    titled = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, 2, 1000))
    initial = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.lit("."))
    return F.when(entity.endswith("."), initial).when((entity == F.upper(entity)) & (F.length(entity) > 1), F.upper(surrogate)).otherwise(titled)


def render_data(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A canonical surrogate written the way the entity is."""
    n = F.length(entity)
    before = lambda i: F.length(_digits_only(F.substring(entity, F.lit(1), i)))
    digits = _digits_only(surrogate)

    def digit(i):
        c = F.substring(entity, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before(i), F.lit(1))).otherwise(c)

    def solid(i):
        c = F.substring(entity, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), " ", ""))
        return F.when(c == " ", c).otherwise(F.substring(surrogate, at, F.lit(1)))

    local = F.instr(entity, "@") - 1

    def cased(i):
        return F.when(F.substring(entity, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(surrogate, i, F.lit(1)))).otherwise(F.substring(surrogate, i, F.lit(1)))

    in_case = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(local, F.lit(1))), cased), "")
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return (
        F.when(kind.isin("phone", "ssn", "card"), F.array_join(F.transform(places, digit), ""))
        .when(kind == "iban", F.array_join(F.transform(places, solid), ""))
        .when((kind.isin("email", "ipv6")) & (entity == F.upper(entity)), F.upper(surrogate))
        .when(kind == "email", F.concat(in_case, F.substring(surrogate, local + 1, F.length(surrogate))))
        .otherwise(surrogate)
    )


# What a text holds


def entities(text: Column) -> Column:
    """An array of (entity, kind) in order; kind is null where nothing is to be done."""
    some = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))


def titled(text: Column) -> Column:
    """An array of names after titles, each an array of (entity, kind): gender for given names, s for a surname."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), F.array().cast("array<string>"))

    def words(match):
        parts = F.split(match, " +")
        title = F.regexp_replace(F.element_at(parts, 1), r"\.$", "")
        gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
        own = F.slice(parts, F.lit(2), F.size(parts))
        return F.transform(own, lambda w, i: F.struct(w.alias("entity"), F.when(i == F.size(own) - 1, F.lit("s")).otherwise(gender).alias("kind")))

    return F.transform(found, words)


def names(text: Column) -> Column:
    """An array of (entity, kind): words of names after titles, and names of Han characters before one."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(HAN_NAME), F.lit(0)), F.array().cast("array<string>"))
    ends = F.create_map(*(F.lit(x) for pair in HAN_TITLES.items() for x in pair))

    def whole(match):
        own = F.substring(match, F.lit(1), F.length(match) - 2)  # titles have two characters
        return F.struct(own.alias("entity"), ends[F.substring(match, F.length(match) - 1, F.lit(2))].alias("kind"))

    return F.concat(F.flatten(titled(text)), F.transform(found, whole))


def people(found: DataFrame) -> DataFrame:
    """full and words of every name of two words or more that stands after a title somewhere; the most definite title counts."""
    each = found.select(F.explode("titled").alias("words")).where(F.size("words") > 1)
    full = F.array_join(F.transform("words", lambda w: w["entity"]), " ")
    return each.groupBy(full.alias("full")).agg(F.min("words").alias("words"))


def mentions(found: DataFrame, known: DataFrame) -> DataFrame:
    """h (hash of the text), entity and kind: words of known full names wherever they stand, with a title or not."""
    parts = found.select("h", F.explode("runs").alias("run")).select("h", F.split("run", " ").alias("w"))
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.lit(LONGEST)),
        lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " ")),
    ))
    met = parts.select("h", F.explode(spans).alias("full")).distinct().join(known, "full")
    return met.select("h", F.explode("words").alias("e")).select("h", "e.entity", "e.kind").distinct()


def _name_pattern(own: Column) -> Column:
    """Any of the words as a whole word; Han characters run on without one."""
    quoted = lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))
    whole = lambda w: F.concat(F.lit(r"(?<![\p{L}'-])"), quoted(w), F.lit(r"(?![\p{L}'-])"))
    words = F.array_distinct(F.transform(own, lambda e: e["entity"]))
    # Longer names first: an initial must not take the beginning of a word.
    ordered = F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    return F.array_join(F.transform(ordered, lambda x: F.when(x["w"].rlike(r"\p{IsHan}"), quoted(x["w"])).otherwise(whole(x["w"]))), "|")


def _key(kind: Column, canon: Column) -> Column:
    return F.concat_ws(":", kind, canon)


def _replace(text: Column, pattern: Column, found: Column, exceptions: Column, key: str, of_names: bool) -> Column:
    """The text with its matches, (entity, kind) in order, replaced: names, or all else."""
    known = F.transform(found, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), canon_of(e["kind"], e["entity"]).alias("canon")))

    def surrogate(e):
        own = (draw_name if of_names else draw_data)(e["kind"], e["canon"], F.lit(0), key)
        return F.coalesce(F.element_at(exceptions, _key(e["kind"], e["canon"])), own)

    def written(e):
        shown = render_name(e["entity"], e["drawn"]) if of_names else render_data(e["kind"], e["entity"], e["drawn"])
        return F.when(e["kind"].isNull(), e["entity"]).otherwise(shown)

    # Each step is bound once, so that the plan does not hold it again wherever it is used.
    drawn = F.transform(known, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), surrogate(e).alias("drawn")))
    gaps = F.split(text, pattern, -1)
    filled = F.zip_with(gaps, F.transform(drawn, written), lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(filled, "")).otherwise(text)


# The checked draws


def findings(df: DataFrame) -> DataFrame:
    """h (hash of the text), own (entities and words of names), titled names and runs that may be names, of texts with any.

    One scan: all that is known of the table before texts are changed comes from what is stored here.
    """
    text = F.col("text")
    own = F.array_distinct(F.concat(entities(text), names(text)))
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))
    found = df.where(text.isNotNull()).select(F.xxhash64("text").alias("h"), own.alias("own"), titled(text).alias("titled"), runs.alias("runs"))
    return found.where("size(own) > 0 or size(runs) > 0")


def dictionary(found: DataFrame) -> DataFrame:
    """kind and canon of every distinct entity in the table."""
    rows = found.select(F.explode("own").alias("e")).where("e.kind is not null")
    return rows.select("e.kind", canon_of(F.col("e.kind"), F.col("e.entity")).alias("canon")).distinct()


def checked_draws(known: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, surrogate and attempt: all surrogates of a kind distinct, and none an entity of the table.

    A given name that stands after a title of one gender somewhere has that gender
    everywhere: where its title says none it takes the same surrogate.
    """
    definite = known.where(F.col("kind").isin("m", "f")).groupBy("canon").agg(F.min("kind").alias("gender"))
    open_title = known.where("kind = 'n'").join(definite, "canon").select("kind", "canon", "gender")
    open_ = known.join(open_title.drop("gender"), ["kind", "canon"], "left_anti")
    settled, attempt = None, 0
    real = known.select("kind", F.col("canon").alias("surrogate"))
    while True:
        drawn = open_.select("kind", "canon", draw(F.col("kind"), F.col("canon"), F.lit(attempt), key).alias("surrogate"))
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        free = drawn.withColumn("place", place).join(real.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"], "left")
        else:
            free = free.withColumn("used", F.lit(None).cast("boolean"))
        good = (F.col("place") == 1) & F.col("taken").isNull() & F.col("used").isNull()
        judged = cut_lineage(free.select("kind", "canon", "surrogate", F.lit(attempt).alias("attempt"), good.alias("good")))
        won = judged.where("good").drop("good")
        settled = won if settled is None else settled.unionByName(won)
        open_ = judged.where("not good").select("kind", "canon")
        if open_.isEmpty():
            break
        attempt += 1
    same = settled.select(F.col("kind").alias("gender"), "canon", "surrogate")
    followed = open_title.join(same, ["gender", "canon"]).select("kind", "canon", "surrogate", F.lit(1).alias("attempt"))
    return cut_lineage(settled.unionByName(followed))


def replace(df: DataFrame, key: str = KEY) -> DataFrame:
    """`df` with personal data in `text` replaced."""
    columns = df.columns
    found = cut_lineage(findings(df))
    draws = checked_draws(cut_lineage(dictionary(found)), key)
    changed = draws.where("attempt > 0").select(_key(F.col("kind"), F.col("canon")).alias("k"), "surrogate")
    # Names that stand in a text without a title, and surrogates that are not the first draw: both reach
    # their texts by a hash of the text. Few texts have any.
    met = cut_lineage(mentions(found, cut_lineage(people(found))))
    text_hash = F.xxhash64("text")
    keys = found.select("h", F.explode("own").alias("e")).where("e.kind is not null")
    keys = keys.select("h", _key(F.col("e.kind"), canon_of(F.col("e.kind"), F.col("e.entity"))).alias("k"))
    keys = keys.union(met.select("h", _key(F.col("kind"), canon_of(F.col("kind"), F.col("entity"))))).distinct()
    pair = F.struct("k", "surrogate")
    told = keys.join(changed, "k").select("h", pair.alias("exception"), F.lit(None).cast("struct<entity:string,kind:string>").alias("mention"))
    seen = met.select("h", F.lit(None).cast("struct<k:string,surrogate:string>").alias("exception"), F.struct("entity", "kind").alias("mention"))
    per_text = told.union(seen).groupBy("h").agg(
        F.map_from_entries(F.collect_list("exception")).alias("exceptions"), F.sort_array(F.collect_list("mention")).alias("mentions")
    )
    # Stored, so that Spark knows its size and need not shuffle the texts when it is small.
    per_text = cut_lineage(per_text)
    packed = df.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), text_hash.alias("h"))
    rows = packed.join(per_text, "h", "left").select("row", "exceptions", "mentions")
    text = F.col("row.text")
    none = F.create_map().cast("map<string,string>")
    also = F.coalesce("mentions", F.array().cast("array<struct<entity:string,kind:string>>"))
    named = F.when(text.isNotNull(), F.concat(names(text), also))
    first = rows.select("row", F.coalesce("exceptions", none).alias("exceptions"), entities(text).alias("found"), named.alias("named"))
    first = first.withColumn("new", _replace(F.col("row.text"), F.lit(ANY), F.col("found"), F.col("exceptions"), key, False))
    # Names in what is left, wherever they stand; the first title decides on a word's kind.
    kinds = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(F.col("named"), lambda e: e["entity"])),
            lambda w: F.struct(w, F.element_at(F.filter(F.col("named"), lambda e: e["entity"] == w), 1)["kind"]),
        )
    )
    pattern = _name_pattern(F.col("named"))
    matches = F.transform(
        F.regexp_extract_all(F.col("new"), pattern, F.lit(0)),
        lambda w: F.struct(w.alias("entity"), F.element_at(kinds, w).alias("kind")),
    )
    named = F.when(F.size("named") > 0, _replace(F.col("new"), pattern, matches, F.col("exceptions"), key, True)).otherwise(F.col("new"))
    done = first.select("row", named.alias("new"))
    return done.select(*(F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns))


def op7_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return replace(documents(spark, folder).select("doc_id", "text"))
