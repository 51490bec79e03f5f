"""Operator 7, PII surrogates, in DataFrame functions only.

One pattern finds entities; each is replaced by another of its type that is made from a keyed hash of it: digits for
digits, letters for letters of the same case and script, valid check digits for card numbers, and for names other names of
the same gender and script. Equal entities have equal surrogates everywhere, so who is who stays plain across documents;
surrogates that two entities share, or that occur as real entities, are drawn anew until none does. What a type's format
allows is bounded, so from some round on surrogates grow by a letter, syllable or digit a round: however many entities there
are, the drawing ends. Names are found by a title or a listed given name before them; other names stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, few, settled, unused

#: Rounds of drawing from which names, addresses and secrets grow, and those from which numbers do.
GROWS, NUMBERS_GROW = 3, 12

# Titles that tell a gender, titles that don't, and given names by gender.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Mister", "Sir", "господин", "г-н", "κύριος", "κ")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Lady", "госпожа", "г-жа", "κυρία", "κα")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Doctor", "Doktor")
MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Hans", "Klaus", "Stefan", "Jürgen", "Pierre", "Jean", "Louis", "François", "Carlos", "José", "Juan", "Miguel", "Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Γιώργος", "Νίκος", "Δημήτρης", "Κώστας")
FEMALE_NAMES = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Emma", "Anna", "Petra", "Ursula", "Monika", "Heike", "Marie", "Claire", "Sophie", "Chloé", "Carmen", "María", "Lucía", "Elena", "Анна", "Мария", "Ольга", "Елена", "Наталья", "Μαρία", "Ελένη", "Κατερίνα", "Σοφία")
# Parts of surrogate surnames by script.
SYLLABLES = {
    "latin": ("bel", "car", "dun", "fen", "gar", "hol", "kel", "lan", "mor", "nor", "pel", "ras", "sten", "tor", "var", "wen"),
    "cyrillic": ("бел", "вар", "гор", "дол", "зим", "кар", "лес", "мор", "нор", "пол", "рас", "сол", "тар", "фад", "чер", "шум"),
    "greek": ("αλε", "βασ", "γεω", "δελ", "ζαχ", "καρ", "λαμ", "μαν", "νικ", "παν", "ραλ", "σαμ", "ταχ", "φιλ", "χατ", "ψαρ"),
}
_GIVEN = {(script, gender): tuple(n for n in names if (n[0] >= "А") == (script == "cyrillic") and ("Α" <= n[0] < "А") == (script == "greek")) for script in SYLLABLES for gender, names in (("m", MALE_NAMES), ("f", FEMALE_NAMES))}

_WORD = r"\p{Lu}[\p{L}\p{M}]+(?:[-'’]\p{Lu}[\p{L}\p{M}]+)?"
# Each pattern first looks at one character, so that most positions of a text are passed over at once.
_BEFORE = r"(?=[\p{Lu}гκ])(?<![\p{L}\p{N}_.-])"
_TITLED = rf"{_BEFORE}(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.?\x20{_WORD}(?:\x20{_WORD})?"
_GIVEN_NAME = rf"{_BEFORE}(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)})\x20{_WORD}"
#: Types in the order in which a match is told; the first pattern that fits all of it decides.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "access_key": r"(?=AKIA)(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=\")(?<=token = \")[A-Za-z0-9_-]{16,}|(?<==)(?<=password=)[^\s\"',;]{6,}|(?=[0-9a-f])(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=\d)(?<![\d.-])(?:(?:\d{4}[\x20-]?){3}\d{4}|3[47]\d{2}[\x20-]?\d{6}[\x20-]?\d{5})(?![\d-])",
    "phone": r"(?=[+(\d])(?<![\w.])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)|(?<!-)(?:\d{3}-\d{3}|0\d{1,3}-\d{3,4})-\d{4}(?![\w-]))",
    "person": rf"{_TITLED}|{_GIVEN_NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def found(text: Column) -> Column:
    """All matches in a text, in order; a text without what all other types need can hold persons only."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.coalesce(F.when(text.rlike("[0-9@=]|AKIA|[a-f]{40}"), every(PATTERN)).otherwise(every(PATTERNS["person"])), F.array().cast("array<string>"))


def _type(match: Column) -> Column:
    """The type of an entity on its own; look-behinds see nothing there, so secrets are what nothing else is."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        if name != "secret":
            out = F.when(match.rlike(rf"^(?:{p})$"), name).otherwise(out)
    return F.coalesce(out, F.lit("secret"))


def _digit(seed: Column, i: Column | int, most: int) -> Column:
    """A number below most made from the hexadecimal digest seed and a place."""
    return F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(most)).cast("int")


# For each class of characters, those that stand in for others of it.
_STAND_INS = (
    ("0123456789", "0-9"), ("abcdefghijklmnopqrstuvwxyz", "a-z"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A-Z"),
    ("абвгдежзиклмнопрстуфхцчшщэюя", r"\p{IsCyrillic}&&\p{Ll}"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", r"\p{IsCyrillic}&&\p{Lu}"),
    ("αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsGreek}&&\p{Ll}"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{IsGreek}&&\p{Lu}"),
    ("àâçèéêëîïñôùûäöüß", r"\p{IsLatin}&&\p{Ll}"), ("ÀÂÇÈÉÊËÎÏÑÔÙÛÄÖÜ", r"\p{IsLatin}&&\p{Lu}"),
    ("天地人山水火木金土日月星", r"\p{IsHan}"), ("あいうえおかきくけこさしすせそ", r"\p{IsHiragana}"), ("アイウエオカキクケコサシスセソ", r"\p{IsKatakana}"), ("가나다라마바사아자차카타파하", r"\p{IsHangul}"),
    ("ابتثجحخدرزسشصطعفقكلمنهوي", r"\p{IsArabic}&&\p{L}"), ("אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsHebrew}&&\p{L}"), ("कखगघचछजझटठडढतथदधनपफबभम", r"\p{IsDevanagari}&&\p{L}"),
    ("#*+!?~^%&$", r"[\p{P}\p{S}]&&[^\x20@.,;:'\"()/-]"),
)


#: Signs that hold a format together; they stay, but for secrets.
_KEPT = r"^[\x20@.,;:'\"()/-]$"


def _shaped(value: Column, seed: Column, hexadecimal: Column | None = None, whole: bool = False) -> Column:
    """value with every character replaced by another one: of its class in _STAND_INS, or a small letter where it is of none. Signs of _KEPT stay unless the whole value is meant."""

    def one(c: Column, i: Column) -> Column:
        letters = F.lit(_STAND_INS[1][0])
        for own, p in reversed(_STAND_INS):
            letters = F.when(c.rlike(f"^[{p}]$"), own).otherwise(letters)
        if whole:
            letters = F.when(c.rlike(_KEPT), _STAND_INS[-1][0]).otherwise(letters)
        if hexadecimal is not None:
            letters = F.when(hexadecimal & c.rlike("^[a-f]$"), "abcdef").otherwise(letters)

        def drawn(own: Column) -> Column:
            k, n = F.pmod(F.xxhash64(seed, i), F.length(own)).cast("int"), F.length(own)
            pick = lambda at: F.substr(own, at + 1, F.lit(1))
            return F.when(pick(k) == c, pick(F.pmod(k + 1, n))).otherwise(pick(k))

        new = F.get(F.transform(F.array(letters), drawn), F.lit(0))  # so that the class is looked for once
        return new if whole else F.when(c.rlike(_KEPT), c).otherwise(new)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _grown(seed: Column, round_: Column, since: int, parts: tuple[str, ...]) -> Column:
    """As many of the parts as rounds have passed since that round; none before."""
    more = F.transform(F.sequence(F.lit(1), F.greatest(round_ - since, F.lit(1))), lambda i: F.element_at(F.array(*map(F.lit, parts)), _digit(seed, i + 50, len(parts)) + 1))
    return F.when(round_ > since, F.array_join(more, "")).otherwise("")


_LETTERS, _DIGITS = tuple("abcdefghijklmnopqrstuvwxyz"), tuple("0123456789")


def _iban(value: Column) -> Column:
    """value, of which the third and fourth place are made the check digits of the rest."""
    bare = F.regexp_replace(value, r"\x20", "")
    chars = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(2)), F.lit("00")), ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)).cast("int"))
    return F.concat(F.substr(value, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(value, F.lit(5)))


def _luhn(value: Column) -> Column:
    """value, digits and separators, with its last digit made the check digit of the others."""
    digits = F.reverse(F.regexp_replace(F.substr(value, F.lit(1), F.length(value) - 1), r"\D", ""))
    parts = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    total = F.aggregate(parts, F.lit(0), lambda a, b: a + b)
    return F.concat(F.substr(value, F.lit(1), F.length(value) - 1), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _is(word: Column, words: tuple[str, ...]) -> Column:
    return word.isin(*words)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _given(word: Column, gender: Column, seed: Column, round_: Column) -> Column:
    """Given names of the word's script and the gender, joined: two, three from the second round on, and syllables of its script in later ones."""
    script, out = _script(word), F.lit(None).cast("string")
    for (s, g), names in _GIVEN.items():
        pick = lambda k, names=names: F.element_at(F.array(*map(F.lit, names)), _digit(seed, k, len(names)) + 1)
        joined = F.concat(F.concat_ws("-", pick(1), pick(2), F.when(round_ > 0, pick(3))), _grown(seed, round_, GROWS - 1, SYLLABLES[s]))
        out = F.when((script == s) & (gender == g), joined).otherwise(out)
    return out


def _surname(word: Column, seed: Column, round_: Column) -> Column:
    """Syllables of the word's script; a Cyrillic or Greek ending that tells a gender stays."""
    script, out = _script(word), F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        pick = lambda k, parts=parts: F.element_at(F.array(*map(F.lit, parts)), _digit(seed, k, len(parts)) + 1)
        out = F.when(script == s, F.initcap(F.concat(*[pick(k) for k in range(1, 6)], _grown(seed, round_, 0, parts)))).otherwise(out)
    ending = F.when(word.rlike("[оеё]ва$"), "ова").when(word.rlike("[оеё]в$"), "ов").when(word.rlike("ина$"), "ина").when(word.rlike("ин$"), "ин").when(word.rlike("ου$"), "ου").when(word.rlike("ος$"), "ος").otherwise("")
    return F.concat(out, ending)


def _chance(given: Column) -> Column:
    """A gender for a name that neither a list nor a title tells: by its hash."""
    return F.when(F.conv(F.substr(F.md5(F.coalesce(given, F.lit(""))), F.lit(1), F.lit(1)), 16, 10).cast("int") % 2 == 0, "f").otherwise("m")


def entities(match: Column, genders: Column | None = None) -> Column:
    """What a match is made of: an array of (type, value, title's gender), for a person its given name and surname apart.

    A given name has one gender wherever it stands: that of the lists, else that of genders, a map, else one by chance. A
    title counts only by what genders takes from it.
    """
    kind = _type(match)
    words = F.split(match, " ")
    bare = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    titled = _is(bare, MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
    given = F.when(titled & (F.size(words) == 3), F.element_at(words, 2)).when(~titled, F.element_at(words, 1))
    told = F.coalesce(F.try_element_at(genders, given), _chance(given)) if genders is not None else _chance(given)
    listed = _is(given, FEMALE_NAMES + MALE_NAMES)
    gender = F.when(_is(given, FEMALE_NAMES), "f").when(_is(given, MALE_NAMES), "m").otherwise(told)
    title = F.when(~listed & _is(bare, FEMALE_TITLES), "f").when(~listed & _is(bare, MALE_TITLES), "m")
    one = lambda t, v, g=F.lit(None).cast("string"): F.struct(t.alias("type"), v.alias("value"), g.alias("title"))
    surname, first = one(F.lit("surname"), F.element_at(words, -1)), one(F.concat(F.lit("given-"), gender), given, title)
    person = F.when(given.isNull(), F.array(surname)).otherwise(F.array(first, surname))
    return F.when(kind == "person", person).otherwise(F.array(one(kind, match)))


def surrogate(kind: Column, value: Column, round_: Column, key: str) -> Column:
    """The surrogate of an entity in a round of drawing."""
    seed = F.sha2(F.concat_ws("\x01", F.lit(key), kind, value, round_.cast("string"), F.sha2(F.concat(F.lit(key), value), 256)), 256)
    local, host = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    top = F.regexp_extract(host, r"((?:\.[^.]+)?\.[^.]+)$", 1)
    letters, digits = _grown(seed, round_, GROWS, _LETTERS), _grown(seed, round_, NUMBERS_GROW, _DIGITS)
    email = F.concat(_shaped(local, seed), letters, F.lit("@"), _shaped(F.substr(host, F.lit(1), F.length(host) - F.length(top)), F.md5(seed)), top)
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[\x20.(-])|)", 1)
    number = _shaped(F.substr(value, F.length(code) + 1), seed)
    phone = F.concat(code, F.when(value.rlike("^0"), F.concat(F.lit("0"), F.substr(number, F.lit(2)))).otherwise(F.regexp_replace(number, r"^([^0-9]*)[01]", r"$17")), digits)
    octets = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (_digit(seed, i, 254) + 1).cast("string")), ".")
    card = _luhn(F.concat(F.substr(value, F.lit(1), F.lit(1)), _shaped(F.substr(value, F.lit(2)), seed), digits))
    part = lambda k, most: F.lpad((_digit(seed, k, most) + 1).cast("string"), len(str(most)), "0")
    ssn = F.concat_ws("-", part(1, 665), part(2, 99), F.concat(part(3, 9999), digits))
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", F.concat(octets, digits)).when(kind == "card", card).when(kind == "ssn", ssn)
    out = out.when(kind == "access_key", F.concat(F.lit("AKIA"), _shaped(F.substr(value, F.lit(5)), seed), F.upper(letters))).when(kind == "surname", _surname(value, seed, round_))
    out = out.when(kind == "iban", _iban(F.concat(F.substr(value, F.lit(1), F.lit(2)), _shaped(F.substr(value, F.lit(3)), seed), digits)))
    out = out.when(kind == "given-f", _given(value, F.lit("f"), seed, round_)).when(kind == "given-m", _given(value, F.lit("m"), seed, round_))
    return out.otherwise(F.concat(_shaped(value, seed, value.rlike("^[0-9a-f]+$"), True), F.when(value.rlike("^[0-9a-f]+$"), digits).otherwise(letters)))


def _id(kind: Column, value: Column) -> Column:
    return F.concat_ws("\x01", kind, value)


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(id, round) of the entities (type, value) that need another round than the first for distinct surrogates.

    Of entities with one surrogate, that with the smallest value keeps it, unless it is a real entity's own value: the
    others, or all, go to the next round, until none is left. Surrogates grow with the rounds, so there is an end.
    """
    now = checkpointed(found.withColumn("round", F.lit(0)).withColumn("new", surrogate(F.col("type"), F.col("value"), F.col("round"), key)))
    real = now.select(F.col("type").alias("_type"), F.col("value").alias("_value"))
    while True:
        place = F.row_number().over(Window.partitionBy("type", "new").orderBy("value"))
        bad = now.withColumn("place", place).join(real, (F.col("type") == F.col("_type")) & (F.col("new") == F.col("_value")), "left").withColumn("bad", (F.col("place") > 1) | F.col("_value").isNotNull())
        if not bad.where("bad").take(1):
            return now.where("round > 0").select(_id(F.col("type"), F.col("value")).alias("id"), "round")
        # A column of its own, as a name given in the same select would stand for the new round inside lambdas.
        again = bad.withColumn("again", F.col("round") + F.col("bad").cast("int"))
        now = checkpointed(again.select("type", "value", F.when(F.col("bad"), surrogate(F.col("type"), F.col("value"), F.col("again"), key)).otherwise(F.col("new")).alias("new"), F.col("again").alias("round")))


def _with_map(rows: DataFrame, parts: Column, of: Column, table: DataFrame, name: str, value: str, text: str, c_found: str, c_text: str, out: str) -> DataFrame:
    """rows with out, a map of those rows of table (name, value) whose name is `of` an entity e of the text. Few texts hold one: maps are gathered by text and joined back."""
    only = rows.where(F.size(c_found) > 0)
    hit = only.select(F.xxhash64(text).alias(c_text), F.explode(parts).alias("e")).select(c_text, of.alias(name)).distinct()
    maps = settled(hit.join(F.broadcast(table) if few(table) else table, name).groupBy(c_text).agg(F.map_from_entries(F.collect_set(F.struct(name, value))).alias(out)), "maps")
    own = F.when(F.size(c_found) > 0, F.xxhash64(text)).otherwise(F.monotonically_increasing_id())
    return rows.withColumn(c_text, own).join(F.broadcast(maps) if few(maps, 50_000) else maps, c_text, "left").drop(c_text)


def replaced(docs: DataFrame, text: str = "text", *, key: str) -> DataFrame:
    """docs with text rewritten, n_entities (matches in the text) and n_distinct; columns of docs so named give way.

    Null texts stay null, with no match. Texts are taken whole; repeated rows are rewritten alike. Surrogates hang on the
    key, on the entity, and, for the few that had to be drawn anew, on the other entities of docs; of entities that draw one
    surrogate, the smaller value keeps it. Whoever has the key can tell which surrogate an entity gets, so it has no default;
    an empty one raises. Of a secret no character stays in its place, of a local part none but the separators (_KEPT): those of
    scripts without stand-ins become small letters, signs other signs. An empty table gives an empty result.
    """
    if not key:
        raise ValueError("surrogates need a key")
    c_found, c_text, c_rounds, c_genders = unused(docs, "found", "text_hash", "rounds", "genders")
    rows = docs.drop("n_entities", "n_distinct").withColumn(c_found, found(F.col(text)))
    told = lambda genders: F.array_distinct(F.flatten(F.transform(c_found, lambda m: entities(m, genders))))
    each = settled(rows.where(F.size(c_found) > 0).select(F.explode(told(None)).alias("e")).select("e.*").distinct(), "entities")
    # Titles decide, where they agree; only names whose gender that changes are looked up.
    titles = each.where(F.col("type").startswith("given-") & F.col("title").isNotNull()).groupBy("value").agg(F.collect_set("title").alias("g"))
    turned = settled(titles.where((F.size("g") == 1) & (F.get("g", F.lit(0)) != _chance(F.col("value")))).select("value", F.get("g", F.lit(0)).alias("gender")), "genders")
    some = bool(turned.take(1))
    if some:
        names = turned.withColumnRenamed("value", "_name")
        each = each.join(F.broadcast(names) if few(names) else names, F.col("type").startswith("given-") & (F.col("value") == F.col("_name")), "left")
        each = each.withColumn("type", F.when(F.col("gender").isNotNull(), F.concat(F.lit("given-"), "gender")).otherwise(F.col("type")))
        rows = _with_map(rows, told(None), F.col("e.value"), turned, "value", "gender", text, c_found, c_text, c_genders)
    else:
        rows = rows.withColumn(c_genders, F.lit(None).cast("map<string,string>"))
    genders = F.col(c_genders)
    again = settled(redrawn(each.select("type", "value").distinct(), key), "redrawn")
    if again.take(1):
        rows = _with_map(rows, told(genders), _id(F.col("e.type"), F.col("e.value")), again, "id", "round", text, c_found, c_text, c_rounds)
    else:
        rows = rows.withColumn(c_rounds, F.lit(None).cast("map<string,int>"))

    def new(match: Column) -> Column:
        own = F.transform(entities(match, genders), lambda e: surrogate(e["type"], e["value"], F.coalesce(F.try_element_at(F.col(c_rounds), _id(e["type"], e["value"])), F.lit(0)), key))
        title = F.regexp_extract(match, rf"^((?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.?\x20)", 1)
        return F.concat(F.when(_type(match) == "person", title).otherwise(""), F.array_join(own, " "))

    between = F.split(text, PATTERN, -1)
    pieces = F.zip_with(between, F.transform(c_found, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    rewritten = F.when(F.size(c_found) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return rows.withColumns({"n_entities": F.size(c_found), "n_distinct": F.size(F.array_distinct(c_found)), text: rewritten}).drop(c_found, c_rounds, c_genders)
