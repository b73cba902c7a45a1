"""Surrogates for personal data and secrets, with JVM expressions only.

Mentions are found by one pattern. Each gets a keyed replacement of its own type
and format: digits for digits, letters of the same case and script for letters,
octets that stay octets, card numbers that keep passing the Luhn test, given
names of the same gender and script. A person's given and family name are
entities of their own, so `Mr. Jones`, `Mrs. Maria Jones` and a bare `Jones`
later in the text keep one family name, and two persons share a new name only if
they shared the old one. The replacement depends on the key, the type and the
entity's canonical form alone, so every mention of an entity gets the same one
(coreference) wherever it stands. Two entities that would get the same
replacement, or a replacement that is itself an entity of the corpus, are found
by grouping all distinct entities and derived again (distinctness). Names and
mailboxes get longer with each round, so no pool runs out; what still clashes in
a format of fixed length, because its values are nearly all in use, gets a value
of that format that no one has. Only the few entities derived again are looked
up; all others are computed where they stand, so texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, light

#: Forms of address by script and gender, and given names that tell a person without one.
TITLES = {
    ("latin", "f"): ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Señora"),
    ("latin", "m"): ("Mr.", "Herr", "Monsieur", "Señor"),
    ("cyrillic", "f"): ("Госпожа",),
    ("cyrillic", "m"): ("Господин",),
}
GIVEN = {
    ("latin", "f"): tuple("Alice Anna Barbara Carmen Charlotte Clara Claudia Elena Elizabeth Emma Greta Helen Ingrid Irene Isabel Jane Jennifer Julia Katharina Laura Linda Lucia Maria Marie Martha Mary Monika Nora Patricia Paula Rosa Sabine Sarah Sofia Sophie Susan Teresa Ursula Vera".split()),
    ("latin", "m"): tuple("Adam Alexander Andreas Antonio Bruno Carl Carlos Charles Daniel David Emil Felix Francisco George Hans Hugo Ivan James Jean John Jorge Jürgen Karl Klaus Leon Louis Manuel Martin Michael Miguel Oscar Paul Peter Pierre Richard Robert Stefan Thomas Tomas Victor William".split()),
    ("cyrillic", "f"): tuple("Анна Вера Екатерина Елена Ирина Мария Наталья Нина Ольга Светлана Татьяна Юлия".split()),
    ("cyrillic", "m"): tuple("Александр Алексей Антон Борис Владимир Дмитрий Иван Михаил Олег Павел Пётр Роман Сергей Юрий".split()),
}
#: Parts of made names: a start, middles, and an end of a family name or a given name.
STARTS = {"latin": "al bar cor dal fen gar hol kel lan mor nor pal ros sel tor wel".split(), "cyrillic": "бел вол гор дуб зим кор лес мор нев пол род сев тер фил хол чер".split()}
MIDDLES = {"latin": "ba da fo ga ke li ma ne po ra se ti vo wa xe zi".split(), "cyrillic": "ба ве ги до жа зе ка ло ми но па ре си та фе ха".split()}
ENDS = {
    ("family", "latin", ""): "bert den field ham kin land man ner rich sen son ston ter ton well wick".split(),
    ("family", "cyrillic", ""): "бин дин кин лин мин нин пин рин син тин фин хин цин чин шин щин".split(),
    ("given", "latin", "f"): "a ia ina ela ita etta".split(),
    ("given", "latin", "m"): "o us an en ard ric".split(),
    ("given", "cyrillic", "f"): "а ия ина ела".split(),
    ("given", "cyrillic", "m"): "ан ей ис он".split(),
}
#: Middles of a family name and of a given name in the first round; each further round adds one.
PARTS = {"family": 3, "given": 2}
_TITLES = "|".join(t.replace(".", r"\.") for own in TITLES.values() for t in own)
_GIVEN = "|".join(n for own in GIVEN.values() for n in own)
_NAME = r"\p{Lu}\p{L}*+(?:['’-]\p{L}++)*+"
#: Two capitalised words in a row, before the lists are tried.
_CAPITALS = r"(?<!\p{L})(?=\p{Lu}\p{L}*+\.? \p{Lu})"
#: Starts of the keys that services hand out; they stay.
_HEADS = r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|sk-|xox[abeoprs]-|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_TAIL = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: Types and their patterns, in order of precedence. No quantifier can backtrack over a long run.
#: A run of over 128 hex digits is a secret if it has a letter; a number of that length is none.
PATTERNS = (
    ("token", rf"(?<![0-9A-Za-z])(?=[Agsxe])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{30,}}+|github_pat_[0-9A-Za-z_]{{30,}}+|sk-[0-9A-Za-z_-]{{20,}}+|xox[abeoprs]-[0-9A-Za-z-]{{10,}}+|AIza[0-9A-Za-z_-]{{35}}|eyJ[0-9A-Za-z_-]{{8,}}+\.eyJ[0-9A-Za-z_-]{{8,}}+\.[0-9A-Za-z_-]*+)(?![0-9A-Za-z])|-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----[0-9A-Za-z+/=\s]++{_TAIL}"),
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,128}|(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{129,}+)(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    ("person", rf"{_CAPITALS}(?:(?:{_TITLES}) {_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME})"),
)
PATTERN = "|".join(p for _, p in PATTERNS)
#: What every match has; texts without it are passed over.
_HINT = rf"[0-9@]|(?<![0-9A-Za-z])(?=[Agsxe-])(?:{_HEADS}|eyJ)|(?<![0-9A-Za-z])[A-Fa-f]{{32}}|{_CAPITALS}(?:{_TITLES}|{_GIVEN}) "
#: Rounds of derivation for formats of fixed length, and those in which a replacement may not be an entity of the corpus.
ROUNDS = STRICT = 64


def kind(mention: Column) -> Column:
    """The type of a match; null for a number of a card's length that fails the Luhn test."""
    out = F.lit("person")
    for name, pattern in reversed(PATTERNS[:-1]):
        passed = F.when(_luhn_sum(_digits(mention)) % 10 == 0, name) if name == "card" else F.lit(name)
        out = F.when(mention.rlike(f"^(?:{pattern})$"), passed).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def canonical(type_: Column, mention: Column) -> Column:
    """What the mentions of one entity have in common."""
    compact = F.regexp_replace(F.upper(mention), " ", "")
    return F.when(type_.isin("card", "phone", "ssn"), _digits(mention)).when(type_ == "iban", compact).when(type_ == "token", mention).otherwise(F.lower(mention))


def _bind(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value taken once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stream(seed: Column, n: Column) -> Column:
    """Digests of a seed, 16 rolls of 4 hex digits in each, enough for places 0 to n."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda b: F.sha2(F.concat_ws(":", seed, b.cast("string")), 256)), "")


def _roll(stream: Column, place: Column | int, n: int | Column) -> Column:
    """A keyed number below n for a place."""
    place = F.lit(place) if isinstance(place, int) else place
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(stream, 4 * place + 1, F.lit(4)), 16, 10).cast("int"), n)


def _pick(items: list[str], roll: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), roll)


def _each(text: Column, seed: Column, swap) -> Column:  # noqa: ANN001
    """Apply ``swap(character, place, stream)`` to every character."""
    n = F.length(text)
    made = _bind(_stream(seed, n), lambda s: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: swap(F.substring(text, i, F.lit(1)), i, s)), ""))
    return F.when(n > 0, made).otherwise("")


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def _letters(c: Column, i: Column, s: Column) -> Column:
    """Digits for digits, letters of the same script and case for letters."""
    out = F.when(c.rlike("[0-9]"), _roll(s, i, 10).cast("string"))
    for letters, script in zip(_ALPHABETS, (r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}"), strict=True):
        new = F.substring(F.lit(letters), _roll(s, i, len(letters)) + 1, F.lit(1))
        out = out.when(c.rlike(script), F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new))
    return out.otherwise(c)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _domain(domain: Column, key: str) -> Column:
    """Same domain, same replacement; the last label stays."""
    labels = F.split(domain, r"\.")
    head = F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), ".")
    return F.concat(_each(head, F.sha2(F.concat(F.lit(key + "|domain|"), domain), 256), _letters), F.lit("."), F.element_at(labels, -1))


def _mod97(chars: Column) -> Column:
    """Remainder by 97 of an IBAN's characters, letters as 10 to 35."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def surrogate(type_: Column, canon: Column, attempt: int, key: str) -> Column:
    """The replacement of a canonical form, itself in canonical form.

    Secrets, card numbers, phone numbers, social security numbers keep their
    length; phone numbers keep a leading country digit and a 555 exchange; IBANs
    keep country and letters and get valid check digits; keys keep what tells
    their service. Names and mailboxes get one more part in each round.
    """
    seed = F.sha2(F.concat_ws("|", F.lit(key), type_, F.lit(str(attempt)), canon), 256)
    long_ = F.lit(16 * (1 + attempt // 16))
    rolls = _stream(seed, long_)
    tail = [_pick([*_ALPHABETS[0]], _roll(rolls, k, len(_ALPHABETS[0]))) for k in range(attempt)]
    email = F.concat(_each(F.substring_index(canon, "@", 1), seed, _letters), *tail, F.lit("@"), _domain(F.substring_index(canon, "@", -1), key))
    secret = _each(canon, seed, lambda c, i, s: F.lower(F.conv(_roll(s, i, 16).cast("string"), 10, 16)))
    head, end = F.regexp_extract(canon, f"^(?:{_HEADS})?", 0), F.regexp_extract(canon, f"(?:{_TAIL})?$", 0)
    body = F.substring(canon, F.length(head) + 1, F.length(canon) - F.length(head) - F.length(end))
    token = F.concat(head, _each(body, seed, _letters), end)

    def octet(part: Column, i: Column, s: Column) -> Column:
        low = F.when(F.length(part) == 1, 0).when(F.length(part) == 2, 10).otherwise(100)
        size = F.when(F.length(part) == 1, 10).when(F.length(part) == 2, 90).otherwise(156)
        return (low + _roll(s, i, size)).cast("string")

    ip = _bind(_stream(seed, F.lit(4)), lambda s: F.array_join(F.transform(F.split(canon, r"\."), lambda p, i: octet(p, i, s)), "."))
    digits = _each(canon, seed, lambda c, i, s: F.when(i == 1, c).otherwise(_roll(s, i, 10).cast("string")))
    # the last digit makes the Luhn sum a multiple of ten
    card = _bind(F.substring(digits, F.lit(1), F.length(digits) - 1), lambda d: F.concat(d, F.pmod(-_luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))
    ssn = _each(canon, seed, lambda c, i, s: _roll(s, i, 10).cast("string"))
    n = F.length(canon)
    exchange = F.substring(canon, n - 6, F.lit(3)) == "555"
    phone = _each(canon, seed, lambda c, i, s: F.when((n > 10) & (i <= n - 10), c).when(exchange & (i > n - 7) & (i <= n - 4), c).otherwise(_roll(s, i, 10).cast("string")))
    land = F.substring(canon, 1, 2)
    rest = _each(F.substring(canon, F.lit(5), n), seed, lambda c, i, s: F.when(c.rlike("[0-9]"), _roll(s, i, 10).cast("string")).otherwise(c))
    iban = _bind(rest, lambda r: F.concat(land, F.lpad((98 - _mod97(F.concat(r, land, F.lit("00")))).cast("string"), 2, "0"), r))
    choices = {"email": email, "secret": secret, "token": token, "iban": iban, "ip": ip, "ssn": ssn, "card": card, "phone": phone}

    def made(what: str, script: str, ends: list[str]):  # noqa: ANN202
        more = range(PARTS[what] + attempt)
        middles = lambda s: [_pick(MIDDLES[script], _roll(s, 2 + k, len(MIDDLES[script]))) for k in more]
        return lambda s: F.concat(_pick(STARTS[script], _roll(s, 0, len(STARTS[script]))), *middles(s), _pick(ends, _roll(s, 1, len(ends))))

    for (what, script, gender), ends in ENDS.items():
        choices["|".join((what, script, gender))] = _bind(_stream(seed, F.lit(2 + PARTS[what] + attempt)), made(what, script, ends))
    return reduce(lambda out, t: F.when(type_ == t, choices[t]).otherwise(out), choices, F.lit(None).cast("string"))


def _cased(new: Column, old: Column) -> Column:
    """``new`` with capitals where ``old`` has them."""
    places = F.transform(F.sequence(F.lit(1), F.length(new)), lambda i: F.when(F.substring(old, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1))))
    return F.when(F.length(new) > 0, F.array_join(places, "")).otherwise("")


def _capital(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def written(type_: Column, mention: Column, canon: Column) -> Column:
    """The replacement ``canon`` written as the mention is: its separators and its case."""

    def filled(sep: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), sep, ""))
        places = F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.when(F.substring(mention, i, F.lit(1)).rlike(sep), F.substring(mention, i, F.lit(1))).otherwise(F.substring(canon, before(i), F.lit(1))))
        return F.array_join(places, "")

    # a secret in upper case has digits too: its letters follow the whole; one in mixed case keeps the case of each place
    secret = F.when(mention.rlike("[A-F]") & mention.rlike("[a-f]"), _cased(canon, mention)).when(mention.rlike("[A-F]"), F.upper(canon)).otherwise(canon)
    return F.when(type_.isin("card", "phone", "ssn"), filled("[^0-9]")).when(type_ == "iban", filled(" ")).when(type_ == "secret", secret).when(type_ == "token", canon).otherwise(_cased(canon, mention))


def _names(mention: Column) -> Column:
    """(type, canon, word) of the names in a mention of a person; the form of address is none."""
    title = F.regexp_extract(mention, rf"^(?:{_TITLES}) ", 0)
    words = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    first, last = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    script = F.when(first.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.lit("m")
    for (_, who), own in [*GIVEN.items(), *((k, tuple(t + " " for t in v)) for k, v in TITLES.items())]:
        # a form of address decides before the given name
        gender = F.when(title.isin(*own) | (title == "") & first.isin(*own), who).otherwise(gender)
    given = first.isin(*(n for own in GIVEN.values() for n in own)) | last.isNotNull()
    name = lambda kind_, word: F.struct(F.concat_ws("|", *kind_).alias("type"), F.lower(word).alias("canon"), word.alias("word"))
    families = name((F.lit("family"), script, F.lit("")), F.coalesce(last, first))
    return F.when(~given, F.array(families)).when(last.isNull(), F.array(name((F.lit("given"), script, gender), first))).otherwise(F.array(name((F.lit("given"), script, gender), first), families))


_TYPES = "array<struct<mention:string,type:string,parts:array<struct<type:string,canon:string,word:string>>>>"


def mentions(text: Column) -> Column:
    """All matches of a text in order: array of (mention, type, parts); parts are the entities named: (type, canon, word).

    A match that is none after all, as its Luhn test fails, has a null type and no parts.
    """
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    typed = F.transform(found, lambda m: F.struct(m.alias("mention"), kind(m).alias("type")))
    whole = lambda e: F.array(F.struct(e["type"].alias("type"), canonical(e["type"], e["mention"]).alias("canon"), e["mention"].alias("word")))
    parts = lambda e: F.when(e["type"] == "person", _names(e["mention"])).when(e["type"].isNotNull(), whole(e)).otherwise(F.array())
    return F.coalesce(F.transform(typed, lambda e: F.struct(e["mention"].alias("mention"), e["type"].alias("type"), parts(e).alias("parts"))), F.array()).cast(_TYPES)


def _losers(settled: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Entities that have to be derived again; replacements in ``taken`` (type, surrogate) count as in use."""
    ranked = settled.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n"))
    clash = settled.join(ranked.where("n > 1"), ["type", "surrogate"]).where(F.col("first.canon") != F.col("canon")).select("type", "canon")
    own = settled.where("surrogate = canon") if taken is None else settled.join(taken, ["type", "surrogate"], "left_semi")
    return cut(clash.unionByName(own.select("type", "canon")).distinct(), "clashes")


def _format(type_: Column, canon: Column) -> Column:
    """What an entity and its replacement always have in common."""
    n = F.length(canon)
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda p: F.length(p).cast("string")), ".")
    phone = F.concat_ws("|", n.cast("string"), F.when(n > 10, F.substring(canon, F.lit(1), n - 10)))
    card = F.concat_ws("|", n.cast("string"), F.substring(canon, 1, 1), (_luhn_sum(canon) % 10 == 0).cast("string"))
    iban = F.concat(F.substring(canon, 1, 2), F.regexp_replace(F.substring(canon, F.lit(5), n), "[0-9]", "0"))
    token = F.regexp_replace(F.regexp_replace(F.regexp_replace(canon, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    choices = {"ip": octets, "phone": phone, "card": card, "iban": iban, "secret": n.cast("string"), "token": token}
    return reduce(lambda out, t: F.when(type_ == t, choices[t]).otherwise(out), choices, F.lit(""))


def _exact(settled: DataFrame, losers: DataFrame) -> DataFrame:
    """``settled`` with distinct replacements for ``losers``: unused values among the entities of the same format.

    A format's entities have at least as many values as it has entities, so as
    many as it has losers are unused. Values that no loser has itself are given
    first, and to the losers whose own value is unused, so none gets its own;
    if those are all the unused ones, they go round. A single loser that is left
    with its own value changes with another entity of the format.
    """
    form = _format(F.col("type"), F.col("canon")).alias("form")
    lost = losers.select("type", "canon", form)
    some = lost.select("type", "form").distinct()
    members = cut(settled.select("type", "canon", "surrogate", form).join(some, ["type", "form"], "left_semi"), "formats")
    kept = cut(settled.join(losers, ["type", "canon"], "left_anti"), "kept")
    free = members.select("type", "form", F.col("canon").alias("value")).join(kept.select("type", F.col("surrogate").alias("value")), ["type", "value"], "left_anti")
    free = free.join(lost.select("type", F.col("canon").alias("value"), F.lit(True).alias("own")), ["type", "value"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    free = cut(free, "free")
    lost = lost.join(free.select("type", F.col("value").alias("canon"), F.lit(True).alias("own")), ["type", "canon"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    whole = Window.partitionBy("type", "form")
    free = free.withColumn("u", F.count("*").over(whole)).withColumn("a", F.sum(F.col("own").cast("int")).over(whole)).withColumn("k", F.row_number().over(whole.orderBy("own", "value")))
    # all unused values are losers' own: the next one's
    free = free.withColumn("k", F.when(F.col("u") == F.col("a"), F.col("k") % F.col("u") + 1).otherwise(F.col("k")))
    lost = lost.withColumn("k", F.row_number().over(whole.orderBy(F.desc("own"), "canon")))
    paired = lost.join(free.select("type", "form", "k", "value"), ["type", "form", "k"]).select("type", "form", "canon", F.col("value").alias("surrogate"))
    paired = cut(paired, "paired")
    single = paired.where("canon = surrogate").select("type", "form", F.col("canon").alias("x"))
    other = members.join(losers, ["type", "canon"], "left_anti").groupBy("type", "form").agg(F.min(F.struct("canon", "surrogate")).alias("y"))
    change = cut(single.join(other, ["type", "form"]), "changed")
    moved = change.select("type", F.col("x").alias("canon"), F.col("y.surrogate").alias("surrogate")).unionByName(change.select("type", F.col("y.canon").alias("canon"), F.col("x").alias("surrogate")))
    given = cut(paired.select("type", "canon", "surrogate").join(moved, ["type", "canon"], "left_anti").unionByName(moved), "given")
    rest = settled.join(given, ["type", "canon"], "left_anti")
    return cut(rest.unionByName(given.withColumn("attempt", F.lit(ROUNDS))), "surrogates")


#: Types whose replacements get longer with each round, and so never run out.
OPEN = ("email", *("|".join(k) for k in ENDS))


def derived_again(distinct: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate) of the entities whose first replacement clashes.

    Of entities that would share a replacement the first by code point keeps it.
    A replacement that is an entity of the corpus counts as taken too. Open
    types are derived until nothing clashes; formats of fixed length in ROUNDS
    rounds, after which a format that is nearly full is settled exactly, by
    distinctness and being other than the original alone. Replacements that are
    still shared are an error.
    """
    spark = distinct.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = cut(distinct.repartition(parts, "type", "canon"), "entities")
    settled = cut(distinct.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("type"), F.col("canon"), 0, key)), "surrogates")
    taken = distinct.withColumnRenamed("canon", "surrogate")
    attempt, exact = 0, False
    while True:
        attempt += 1
        if attempt == ROUNDS:
            fixed = _losers(settled.where(~F.col("type").isin(*OPEN)), None)
            if fixed.count():
                settled, exact = _exact(settled, fixed), True
        losers = _losers(settled if attempt < ROUNDS else settled.where(F.col("type").isin(*OPEN)), taken if attempt < min(STRICT, ROUNDS) or attempt >= ROUNDS else None)
        n = losers.count()
        if not n:
            break
        again = losers.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", surrogate(F.col("type"), F.col("canon"), attempt, key))
        kept = settled.join(light(losers, n, 256), ["type", "canon"], "left_anti")
        settled = cut(kept.unionByName(again), "surrogates")
    if exact and (shared := settled.groupBy("type", "surrogate").count().where("count > 1").count()):
        raise ValueError(f"{shared} replacements are shared by several entities")
    return settled.where("attempt > 0").select("type", "canon", "surrogate")


def pseudonymise(docs: DataFrame, key: str = "latticework", text: str = "text") -> DataFrame:
    """Replace the entities in ``text`` of all of ``docs``; adds n_entities and entity_types.

    In a text that names a person, the person's names are replaced where they
    stand alone too, unless the text has the same word without a capital; those
    are not counted in n_entities. Null texts stay null with 0 entities; texts
    without entities stay as they are, byte for byte. Equal rows get equal texts,
    empty tables give empty results, other columns are passed through, whatever
    their names (n_entities and entity_types are replaced if they exist).
    """
    names = [c for c in docs.columns if c not in ("n_entities", "entity_types")]
    found_, again_, row_, hash_ = (fresh(docs, c) for c in ("_mentions", "_again", "_row", "_hash"))
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    body = F.col(f"`{text}`")
    # one scan for the entities; what it finds is kept, not the texts
    seen = docs.select(F.xxhash64(body).alias("row"), mentions(body).alias("m")).where(F.size("m") > 0)
    seen = cut(seen.select("row", F.array_distinct(F.flatten(F.transform("m", lambda e: F.transform(e["parts"], lambda p: F.struct(p["type"].alias("type"), p["canon"].alias("canon")))))).alias("parts")).where(F.size("parts") > 0), "mentions")
    each = seen.select("row", F.explode("parts").alias("e")).select("row", "e.type", "e.canon")
    again = cut(derived_again(each.select("type", "canon").distinct(), key), "again")
    n = again.count()
    found = docs.withColumn(found_, mentions(body))
    if n:
        by_row = each.distinct().join(light(again, n, 256), ["type", "canon"]).groupBy(F.col("row").alias(hash_)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("=", "type", "canon"), "surrogate"))).alias(again_))
        by_row = cut(by_row, "again_by_row")
        # texts without a match meet nothing, and are spread over all tasks
        found = found.withColumn(row_, F.when(F.size(found_) > 0, F.xxhash64(body)).otherwise(F.monotonically_increasing_id()))
        found = found.join(light(by_row, by_row.count(), 512), F.col(row_) == F.col(hash_), "left")
    else:
        found = found.withColumn(again_, F.lit(None).cast("map<string,string>"))
    new = lambda p: F.coalesce(F.try_element_at(again_, F.concat_ws("=", p["type"], p["canon"])), surrogate(p["type"], p["canon"], 0, key))
    swap = fresh(found, "_swaps")
    made = lambda e: F.transform(e["parts"], lambda p: F.struct(p["type"].alias("type"), p["word"].alias("word"), new(p).alias("canon")))
    found = found.withColumn(swap, F.transform(found_, lambda e: F.struct(e["mention"].alias("mention"), e["type"].alias("type"), made(e).alias("parts"))))
    title = lambda e: F.regexp_extract(e["mention"], rf"^(?:{_TITLES}) ", 0)
    person = lambda e: F.concat(title(e), F.array_join(F.transform(e["parts"], lambda p: _capital(p["canon"])), " "))
    only = lambda e: F.get(e["parts"], F.lit(0))
    rewritten = F.transform(swap, lambda e: F.when(e["type"] == "person", person(e)).when(e["type"].isNotNull(), written(e["type"], e["mention"], only(e)["canon"])).otherwise(e["mention"]))
    # names that may stand alone: of at least two letters, and not a common word of this text
    bare = fresh(found, "_bare")
    known = F.flatten(F.transform(F.filter(swap, lambda e: e["type"] == "person"), lambda e: e["parts"]))
    alone = lambda p: (F.length(p["word"]) > 1) & ~F.regexp_like(body, F.concat(F.lit(r"(?<!\p{L})"), F.lower(p["word"]), F.lit(r"(?!\p{L})")))
    found = found.withColumn(bare, F.filter(known, alone))
    gaps = F.split(body, PATTERN)
    either = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(bare, lambda p: p["word"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    renamed = lambda w: _capital(F.get(F.filter(bare, lambda p: p["word"] == w), F.lit(0))["canon"])
    within = lambda gap: F.array_join(F.zip_with(F.split(gap, either), F.concat(F.transform(F.regexp_extract_all(gap, either, F.lit(0)), renamed), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    filled = F.when(F.size(bare) > 0, F.transform(gaps, within)).otherwise(gaps)
    pieces = F.zip_with(filled, F.concat(rewritten, F.array(F.lit(""))), lambda gap, own: F.concat(gap, own))
    counted = F.filter(found_, lambda e: e["type"].isNotNull())
    replaced = F.when(F.size(counted) > 0, F.array_join(pieces, "")).otherwise(body)
    types = F.array_sort(F.array_distinct(F.transform(counted, lambda e: e["type"])))
    return found.select(*[replaced.alias(text) if c == text else F.col(f"`{c}`") for c in names], F.size(counted).alias("n_entities"), types.alias("entity_types"))
