"""PII: every detected entity gets a keyed surrogate of its own type and format. Column expressions only.

Detected are e-mail addresses, phone, card, account and social security numbers, IP addresses, access keys, secrets, and names of persons
after a title or with a known first name. A surrogate is a keyed hash poured into the entity's format: letters stay letters of their
case, digits digits, separators stay; names keep gender and script. All mentions of an entity get the same surrogate in the
whole corpus, also when a number is written with other separators.

Distinct entities must get distinct surrogates, and no surrogate may be an entity of the corpus. Both are checked on the table of distinct
entities: whoever collides, save the first, is hashed again with another attempt, until nothing collides. Surrogates grow after
some attempts, so that this ends also where entities use up the strings of their form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch

# First names by script and gender, titles, and syllables of made-up family names by script.
FIRST_NAMES = {
    ("latin", "f"): (
        "Anna", "Maria", "Sophie", "Laura", "Julia", "Emma", "Clara", "Elena", "Lucia", "Martha", "Helen", "Alice", "Sarah", "Carmen",
        "Ingrid", "Claire",
    ),
    ("latin", "m"): (
        "James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Carlos", "Pablo", "Hans", "Karl", "Pierre", "Jean",
        "Martin", "Simon",
    ),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Татьяна", "Наталья", "Светлана"),
    ("cyrillic", "m"): ("Иван", "Алексей", "Сергей", "Дмитрий", "Николай", "Павел", "Андрей", "Михаил"),
}
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
TITLE_GENDERS = {"f": ("Mrs", "Ms", "Frau", "Madame", "Señora"), "m": ("Mr", "Herr", "Monsieur", "Señor")}
SYLLABLES = {
    "latin": tuple("ba be do fi ga ha ka ke la lo ma me na no ra ro sa se ta to va ve wi za".split()),
    "cyrillic": tuple("ба бе ва во га да до за ка ко ла ле ма ми на но ра ро са со та то".split()),
    "greek": tuple("βα βε γα δο ζα θε κα κο λα λε μα μι να νο πα ρα ρο σα σο τα τε φι".split()),
}
HASHES = 4  # each gives 64 hexadecimal digits

LETTER = r"\p{L}\p{M}\p{N}"
EMAIL = rf"(?<![{LETTER}._%+\-])[{LETTER}._%+\-]++@[{LETTER}\-]++(?:\.[{LETTER}\-]++)++"
# A keyword in any case and a separator lead to the value: up to the closing quote if it is in quotes, else up to white space.
KEYWORD = r"(?i:password|passwd|secret|token|api[_\-]?key)"
SECRET_LEAD = rf"{KEYWORD}[\"']?[ \t]*+(?:=>|[:=]{{1,2}})[ \t]*+"
SECRET = rf"{SECRET_LEAD}(?:\"[^\"\r\n]{{4,}}+(?=\")|'[^'\r\n]{{4,}}+(?=')|[\"']?[^\s\"']{{4,}}+)"
ACCESS_KEY = r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])"
HEX = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
CARD = r"(?<!\d)\d{4}(?:[ \-]?\d{4}){3}(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
# Two letters, two check digits, and groups of four, of which all but the first hold a digit.
IBAN = (
    r"(?<![A-Z0-9])[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,7}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![A-Z0-9])"
)
PHONE = "|".join(
    (
        r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)",
        r"(?<![\d+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)",
        r"(?<![\d+\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)",
        r"(?<![\d+])\+\d{8,15}(?!\d)",
        # With a country's code, 8 to 15 digits in groups; with a trunk zero, 9 to 13 in two groups or more.
        r"(?<![\d+])\+(?=(?:\d[ .\-/()]{0,2}){8,15}(?!\d))[1-9]\d{0,2}(?:[ .\-/]\(?\d{1,9}\)?)++(?!\d)",
        r"(?<![\d+.,:/\-])0(?=(?:\d[ \-/]?){8,12}(?!\d))[1-9]\d{1,4}[ /\-]\d{2,8}(?:[ \-]\d{2,8})*+(?![\d\-])",
    )
)
ALL_FIRST = "|".join(name for names in FIRST_NAMES.values() for name in names)
CAPITAL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
FIRST = rf"(?<!\p{{L}})(?:{ALL_FIRST})(?= \p{{Lu}}\p{{Ll}})"
LAST = rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{ALL_FIRST}) ){CAPITAL}"
#: A title leads to all names that follow; the last one is the family name.
TITLE_LEAD = rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? (?=\p{{Lu}})"
TITLED = rf"{TITLE_LEAD}{CAPITAL}(?: {CAPITAL})*+"
ENTITY = "|".join((EMAIL, SECRET, ACCESS_KEY, HEX, IP, IBAN, CARD, SSN, PHONE, TITLED, FIRST, LAST))
#: What a match holds before the entity, which stays.
LEAD = rf"^(?:{SECRET_LEAD}[\"']?|{TITLE_LEAD})"
#: Texts without any of these hold no entity; it spares most texts the long pattern.
HINT = rf"[@+]|\d[\d.\- ]{{6}}|{KEYWORD}|[0-9a-fA-F]{{32}}|AKIA|(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?|{ALL_FIRST}) \p{{Lu}}"


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _words(entity: Column) -> Column:
    """The names of a full name, or the entity alone."""
    return F.when(entity.rlike(rf"^{CAPITAL}(?: {CAPITAL})+$"), F.split(entity, " ")).otherwise(F.array(entity))


#: Kind of a match that turns out to be no entity.
PLAIN = "plain"


def _unspaced(entity: Column) -> Column:
    return F.regexp_replace(entity, " ", "")


def _turned(account: Column) -> Column:
    """An account number with its country and check digits at the end."""
    return F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4)))


def _mod97(account: Column) -> Column:
    """Rest of the number that the characters spell, A as 10 to Z as 35; 1 for a valid account number that is turned."""

    def add(s: Column, i: Column) -> Column:
        c = F.substring(account, i, F.lit(1))
        digit = c.rlike("[0-9]")
        value = F.when(digit, F.ascii(c) - ord("0")).otherwise(F.ascii(c) - ord("A") + 10)
        return F.pmod(s * F.when(digit, 10).otherwise(100) + value, F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), add)


def _kind(entity: Column, given: Column) -> Column:
    """Type of a detected string, by its own form, and whether it is a `given` name of a full one."""
    script = F.when(entity.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    first = [F.when(entity.isin(*names), f"first_{script}_{gender}") for (script, gender), names in FIRST_NAMES.items()]
    kind = F.coalesce(
        F.when(entity.contains("@") & entity.rlike(_whole(EMAIL)), "email"),
        F.when(entity.rlike(_whole(ACCESS_KEY)), "access_key"),
        F.when(entity.rlike(_whole(HEX)), "hex"),
        F.when(entity.rlike(_whole(IP)), "ip"),
        F.when(entity.rlike(_whole(IBAN)), F.when(_mod97(_turned(_unspaced(entity))) == 1, "iban").otherwise(PLAIN)),
        F.when(entity.rlike(_whole(CARD)), "card"),
        F.when(entity.rlike(_whole(SSN)), "ssn"),
        F.when(entity.rlike(_whole(PHONE)), "phone"),
        *first,
        F.when(entity.rlike(_whole(CAPITAL)), F.concat(F.when(given, "given_").otherwise("last_"), script)),
        F.lit("secret"),
    )
    return kind


NUMBERS = ("card", "ssn", "phone")


def _canonical(kind: Column, entity: Column) -> Column:
    """What all mentions of an entity share: the digits of a number, the lower-cased address, else the string."""
    digits = F.regexp_replace(entity, r"\D+", "")
    shared = F.when(kind.isin(*NUMBERS), digits).when(kind == "email", F.lower(entity)).when(kind == "iban", _unspaced(entity))
    return shared.otherwise(entity)


def _digest(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(i)), kind, attempt.cast("string"), canonical), 256) for i in range(HASHES)]
    return F.concat(*parts)


def _byte(digest: Column, place: Column) -> Column:
    """One of the digest's bytes; places beyond the digest start over."""
    at = (F.pmod(place, F.lit(32 * HASHES)) * 2 + 1).cast("int")
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str, value: Column) -> Column:
    return F.substring(F.lit(choices), F.pmod(value, F.lit(len(choices))).cast("int") + 1, F.lit(1))


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
SYMBOLS = "!#%*+-.?^~"
#: Attempts in an entity's own format; each further one makes the surrogate a character longer.
SAME_FORMAT = 4


def _poured(digest: Column, form: Column, letters: str = LOWER, symbols: bool = False) -> Column:
    """Every letter and digit of `form` replaced by a keyed one of its kind, and with `symbols` all else but white space too.

    Letters that are neither Latin nor Cyrillic give Latin ones.
    """

    def replaced(i: Column) -> Column:
        c, byte = F.substring(form, i, F.lit(1)), _byte(digest, i - 1)
        made = F.when(c.rlike("[0-9]"), _pick(DIGITS, byte))
        made = made.when(c.rlike("[a-z]"), _pick(letters, byte)).when(c.rlike("[A-Z]"), _pick(letters.upper(), byte))
        made = made.when(c.rlike("[А-ЯЁ]"), _pick(CYRILLIC.upper(), byte)).when(c.rlike("[а-яё]"), _pick(CYRILLIC, byte))
        made = made.when(c.rlike(r"\p{Lu}"), _pick(letters.upper(), byte)).when(c.rlike(r"\p{L}"), _pick(letters, byte))
        made = made.when(c.rlike(r"\p{N}"), _pick(DIGITS, byte))
        return (made.when(c.rlike(r"\S"), _pick(SYMBOLS, byte)) if symbols else made).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), replaced), "")


def _grown(form: Column, attempt: Column, by: str) -> Column:
    """`form` with a character more for each attempt that its own length was not enough for."""
    return F.concat(form, F.repeat(F.lit(by), F.greatest(attempt - (SAME_FORMAT - 1), F.lit(0))))


def _email(digest: Column, form: Column, attempt: Column) -> Column:
    """The local part in its format, at a keyed host of a domain kept for examples, under the same last label if that is common."""
    local, host = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    ending = F.substring_index(host, ".", -1)
    ending = F.when(ending.isin("com", "net", "org"), ending).otherwise("com")
    label = _poured(F.reverse(digest), F.substring_index(host, ".", 1))
    return F.concat(_poured(digest, _grown(local, attempt, "a")), F.lit("@"), label, F.lit(".example."), ending)


def _ip(digest: Column, form: Column, attempt: Column) -> Column:
    """Four numbers with as many digits as before; of three digits where such have collided, at last beyond what addresses use."""

    def octet(part: Column, i: Column) -> Column:
        value = _byte(digest, i * 2) * 256 + _byte(digest, i * 2 + 1)
        beyond = (F.pmod(value, F.lit(744)) + 256).cast("string")
        wide = F.pmod(value, F.lit(155)) + 100
        middle, single = F.pmod(value, F.lit(90)) + 10, F.pmod(value, F.lit(9)) + 1
        fitting = F.when((F.length(part) == 3) | (attempt >= SAME_FORMAT), wide).when(F.length(part) == 2, middle).otherwise(single)
        return F.when(attempt >= 2 * SAME_FORMAT, beyond).otherwise(fitting.cast("string"))

    return F.array_join(F.transform(F.split(form, r"\."), octet), ".")


def _digits(digest: Column, form: Column) -> Column:
    """The first digit, which names a country or a network, and keyed ones."""
    return F.concat(F.substring(form, 1, 1), _poured(digest, F.substring(form, F.lit(2), F.length(form))))


def _luhn(digits: Column) -> Column:
    """Sum that is a multiple of ten for valid card numbers."""

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda s, x: s + x)


def _card(digest: Column, form: Column) -> Column:
    """Sixteen digits; the last one makes the number valid where the original is valid."""
    raw = _digits(digest, form)
    zeroed = F.concat(F.left(raw, F.lit(15)), F.lit("0"))
    check = F.pmod(10 - F.pmod(_luhn(zeroed), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(_luhn(form), F.lit(10)) == 0, F.concat(F.left(raw, F.lit(15)), check)).otherwise(raw)


def _iban(digest: Column, form: Column, attempt: Column) -> Column:
    """The country, an account in its format, and the check digits that make both valid."""
    account = _poured(digest, _grown(F.substring(form, F.lit(5), F.length(form)), attempt, "0"))
    country = F.left(form, F.lit(2))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, account)


def _first(digest: Column, attempt: Column, script: str, gender: str) -> Column:
    """A first name of the list; a second one joins it when tries with one have collided."""
    names = F.array(*[F.lit(n) for n in FIRST_NAMES[(script, gender)]])
    count = len(FIRST_NAMES[(script, gender)])

    def name(place: int) -> Column:
        return F.get(names, F.pmod(_byte(digest, F.lit(place)), F.lit(count)))

    single = name(0)
    doubled = F.when(attempt >= 3, F.concat_ws("-", single, name(1))).otherwise(single)
    return F.when(attempt >= 40, F.concat_ws("-", single, name(1), name(2), name(3))).otherwise(doubled)


def _last(digest: Column, attempt: Column, script: str) -> Column:
    """Syllables, three of them and one more for each failed attempt."""
    syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    count = F.least(attempt + 3, F.lit(40))

    def syllable(i: Column) -> Column:
        return F.get(syllables, F.pmod(_byte(digest, i), F.lit(len(SYLLABLES[script]))))

    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), syllable), ""))


def _surrogate(entities: DataFrame, key: str) -> DataFrame:
    """`entities` (kind, canonical, gender, attempt) with `surrogate`, in canonical form."""
    made = entities.withColumn("digest", _digest(key, F.col("kind"), F.col("canonical"), F.col("attempt")))
    kind, digest, form, attempt = F.col("kind"), F.col("digest"), F.col("canonical"), F.col("attempt")
    value = F.when(kind == "email", _email(digest, form, attempt)).when(kind == "ip", _ip(digest, form, attempt))
    value = value.when(kind == "card", _card(digest, form)).when(kind.isin("ssn", "phone"), _digits(digest, _grown(form, attempt, "0")))
    value = value.when(kind == "hex", _poured(digest, _grown(form, attempt, "0"), "abcdef"))
    value = value.when(kind == "access_key", F.concat(F.lit("AKIA"), _poured(digest, F.expr("substring(canonical, 5)"))))
    value = value.when(kind == "iban", _iban(digest, form, attempt))
    for script, gender in FIRST_NAMES:
        known = (kind == f"first_{script}_{gender}") | ((kind == f"given_{script}") & (F.col("gender") == gender))
        value = value.when(known, _first(digest, attempt, script, gender))
    for script in SYLLABLES:
        value = value.when(kind.isin(f"last_{script}", f"given_{script}"), _last(digest, attempt, script))
    # A form that ends with a digit grows by digits.
    secret = F.when(form.rlike("[0-9]$"), _grown(form, attempt, "0")).otherwise(_grown(form, attempt, "a"))
    return made.withColumn("surrogate", value.otherwise(_poured(digest, secret, symbols=True))).drop("digest")


def assign_surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canonical, surrogate) of distinct entities (kind, canonical and, if there is one, a `gender` for given names).

    Of equal surrogates of one kind the entity with the fewest attempts stays, then the smallest; the others and those whose
    surrogate is itself an entity try again. Each round is a join and an aggregation of narrow rows.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(None).cast("string"))
    current = scratch.write(_surrogate(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        holder = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical"))["canonical"].alias("holder"))
        taken = current.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("taken"))
        judged = current.join(holder, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        judged = judged.withColumn("again", (F.col("holder") != F.col("canonical")) | F.col("taken").isNotNull())
        judged = scratch.write(judged.select("kind", "canonical", "gender", "attempt", "surrogate", "again"), "judged")
        if judged.where("again").isEmpty():
            scratch.drop(judged)
            return current.select("kind", "canonical", "surrogate")
        retry = _surrogate(judged.where("again").select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt")), key)
        following = scratch.write(judged.where("not again").drop("again").unionByName(retry), "surrogates")
        scratch.drop(current, judged)
        current = following


def _in_format(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A canonical surrogate written as the mention is: its digits between the mention's separators, further ones at the end."""
    between = F.split(entity, "[0-9]")

    def placed(part: Column, i: Column) -> Column:
        return F.concat(part, F.substring(surrogate, i + 1, F.when(i < F.size(between) - 1, 1).otherwise(F.length(surrogate))))

    grouped = F.when(entity.contains(" "), F.regexp_replace(surrogate, "(.{4})(?=.)", "$1 ")).otherwise(surrogate)
    written = F.when(kind.isin(*NUMBERS), F.array_join(F.transform(between, placed), "")).when(kind == "iban", grouped)
    return written.otherwise(surrogate)


def replace_entities(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with surrogates in place of all entities of the texts, and `n_entities`.

    Texts without entities, empty and missing ones come out as they are, with 0 entities. Rows are told apart by id and text, so
    missing and repeated ids do no harm, and equal rows get equal texts. Other columns pass, but for one named n_entities.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    kept = [c for c in docs.columns if c != "n_entities"]
    text = F.col(f"`{text_column}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_column}`").alias("id"), text.alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    # A row's key is its id and the hash of its text: two texts of one id stay apart.
    candidates = packed.where(hinted).withColumn("hash", F.xxhash64("text", F.reverse("text")))
    found = candidates.select("id", "hash", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("entities")).where(F.size("entities") > 0)
    found = scratch.write(found.dropDuplicates(["id", "hash"]), "found")
    mentions = found.select("id", "hash", F.posexplode("entities").alias("place", "match"))
    mentions = mentions.withColumn("lead", F.regexp_extract("match", LEAD, 0))
    mentions = mentions.withColumn("words", _words(F.expr("substring(match, length(lead) + 1)")))
    title = F.regexp_replace("lead", "[. ]", "")
    gender = F.coalesce(*[F.when(title.isin(*titles), g) for g, titles in TITLE_GENDERS.items()])
    mentions = mentions.select(
        "id", "hash", "place", "lead", gender.alias("gender"), F.size("words").alias("n_words"), F.posexplode("words").alias("part", "entity")
    )
    mentions = mentions.withColumn("kind", _kind(F.col("entity"), F.col("part") < F.col("n_words") - 1)).drop("n_words")
    mentions = scratch.write(mentions.withColumn("canonical", _canonical(F.col("kind"), F.col("entity"))), "mentions")
    # A given name has the gender that titles give it, if they agree, wherever it stands.
    one = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    entities = mentions.where(F.col("kind") != PLAIN).groupBy("kind", "canonical").agg(one.alias("gender"))
    surrogates = assign_surrogates(entities, key, scratch)
    # An entity may have any share of the mentions: one row on the other side, so hot ones are split at run time.
    replaced = mentions.join(surrogates, ["kind", "canonical"], "left")
    written = F.coalesce(_in_format(F.col("kind"), F.col("entity"), F.col("surrogate")), F.col("entity"))
    placed = F.struct("place", "part", "lead", written.alias("written"), (F.col("kind") != PLAIN).cast("long").alias("is_entity"))
    lists = replaced.groupBy("id", "hash").agg(F.sort_array(F.collect_list(placed)).alias("placed"))
    stored = lists = scratch.write(lists, "lists")
    lists = lists.withColumnsRenamed({"id": "own_id", "hash": "own_hash"})
    same_row = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
    joined = candidates.join(lists.hint("merge"), same_row, "left")
    between = F.split("text", ENTITY)
    joined = joined.withColumn("between", F.when(F.col("placed").isNotNull(), between))
    # What stands before an entity, or the space before a further name of a full one.
    before: Callable[[Column], Column] = lambda p: F.when(p["part"] == 0, F.concat(F.get("between", p["place"]), p["lead"])).otherwise(" ")
    pieces = F.transform("placed", lambda p: F.concat(before(p), p["written"]))
    rebuilt = F.concat(F.array_join(pieces, ""), F.get("between", F.size("between") - 1))
    counted = F.aggregate("placed", F.lit(0).cast("long"), lambda n, p: n + p["is_entity"])
    count = F.when(F.col("placed").isNull(), 0).otherwise(counted).cast("long")
    changed = joined.select("row", F.coalesce(rebuilt, F.col("text")).alias("text"), count.alias("n"))
    whole = changed.union(packed.where(~hinted).select("row", "text", F.lit(0).cast("long")))
    scratch.keep_only(stored)
    source: Callable[[str], Column] = lambda c: F.col("text") if c == text_column else F.col("row").getField(c)
    return whole.select(*[source(c).alias(c) for c in kept], F.col("n").alias("n_entities"))
