"""PII: detected entities get keyed, type-consistent surrogates, the same for each mention and distinct between entities."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import save

# Titles and given names by gender, and the letters of each script.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Signor г-н господин κύριος"
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Signora г-жа госпожа κυρία"
OTHER_TITLES = "Dr Prof"
GIVEN_NAMES = {
    "male_latin": "James John Robert Michael William David Thomas Peter Hans Karl Pierre Jean Louis Carlos Juan Miguel Antonio Marco",
    "female_latin": "Mary Patricia Linda Elizabeth Susan Sarah Anna Emma Claudia Monika Marie Sophie Claire Carmen Lucia Elena Isabel Giulia",
    "male_cyrillic": "Иван Пётр Сергей Дмитрий Алексей Николай Михаил Андрей",
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана",
    "male_greek": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης",
    "female_greek": "Μαρία Ελένη Κατερίνα Σοφία Αναστασία",
}
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâäçèéêëìíîïñòóôöùúûü",
    "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
    "абвгдежзийклмнопрстуфхцчшщыэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)

_GIVEN = "|".join(n for names in GIVEN_NAMES.values() for n in names.split())
_TITLES = "|".join(f"{MALE_TITLES} {FEMALE_TITLES} {OTHER_TITLES}".split())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])"
# Three, three and four digits come before cards, which would take two such numbers for one of their own.
_LOCAL_PHONE = r"(?<![\w.+-])\d{3}-\d{3}-\d{4}(?![\w-])"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w)])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CLOUD_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-)[A-Za-z0-9]{20,}"
_SECRET = r"(?<=[=:]\s{0,2}[\"']?)(?<=(?i:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'&<>]{6,}"
_NAME_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_NAME = rf"(?=\p{{Lu}})(?:(?<=\b(?:{_TITLES}) |\b(?:{_TITLES})\. |\b(?:{_GIVEN}) ){_NAME_WORD}|\b(?:{_GIVEN})(?= \p{{Lu}}\p{{Ll}}))"
# One alternative for each kind of first character, so that most characters are passed over at once.
PATTERN = rf"{_EMAIL}|(?=[\d+(])(?:{_IP}|{_SSN}|{_LOCAL_PHONE}|{_CARD}|{_PHONE})|(?=[A-Zgs])(?:{_IBAN}|{_CLOUD_KEY})|{_SECRET}|{_NAME}"

# Attempts before a surrogate may grow longer than its entity, for kinds of which so few values exist.
_GROW = 4


def _matches(entity: Column, pattern: str) -> Column:
    return F.rlike(entity, F.lit(f"^(?:{pattern})$"))


def luhn(digits: Column) -> Column:
    """Sum of digits, every second one from the right doubled: 0 modulo 10 for a card number."""
    size = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((size - i) % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def kind_of(entity: Column) -> Column:
    """The type of a detected string; null for a long number that is no card number."""
    given = F.lit(None).cast("string")
    for kind, names in GIVEN_NAMES.items():
        given = F.coalesce(given, F.when(entity.isin(*names.split()), F.lit(f"given_{kind}")))
    digits = F.regexp_replace(entity, r"[ -]", "")
    return (
        F.when(F.contains(entity, F.lit("@")) & _matches(entity, r"[A-Za-z0-9._%+-]+@.*"), "email")
        .when(_matches(entity, rf"(?:{_OCTET}\.){{3}}{_OCTET}"), "ip")
        .when(_matches(entity, r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(_matches(entity, r"[+(][\d ().-]+|\d{3}-\d{3}-\d{4}"), "phone")
        .when(_matches(entity, r"\d(?:[ -]?\d){12,18}"), F.when(luhn(digits) == 0, F.lit("card")))
        .when(_matches(entity, r"(?:AKIA|ASIA)[0-9A-Z]{16}"), "cloud_key")
        .when(_matches(entity, r"[A-Z]{2}\d{2}[A-Z0-9 ]{10,}"), "iban")
        .when(_matches(entity, _NAME_WORD), F.coalesce(given, F.lit("family")))
        .otherwise("secret")
    )


def _byte(digest: Column, at: Column) -> Column:
    return F.conv(F.substring(digest, (at * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int") + at


def _mapped(entity: Column, digest: Column, keep: Column) -> Column:
    """Each letter or digit replaced by one of its script and case; the first `keep` characters and all others stay."""
    hexadecimal = _matches(entity, "[0-9a-f]+")

    def letter(c: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for n, alphabet in enumerate(ALPHABETS):
            letters = F.when(hexadecimal, F.lit("abcdef")).otherwise(F.lit(alphabet)) if n == 1 else F.lit(alphabet)
            out = F.coalesce(out, F.when(F.instr(F.lit(alphabet), c) > 0, F.substring(letters, _byte(digest, i) % F.length(letters) + 1, F.lit(1))))
        return F.when(i < keep, c).otherwise(F.coalesce(out, c))

    return F.array_join(F.transform(F.split(entity, ""), letter), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is written, and computed, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def given_names(key: str) -> dict[str, str]:
    """The replacement of each given name: the next one of its list in a keyed order, so none is its own and no two are alike."""
    out = {}
    for kind, names in GIVEN_NAMES.items():
        ordered = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|given_{kind}|{n}".encode()).digest())
        out |= zip(ordered, [*ordered[1:], ordered[0]])
    return out


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity: keyed by type, entity and attempt, of the same type, format and script."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 256)
    # A country code stays, as do a bank's country, the mark of a cloud key and a card's first digit.
    code = F.length(F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])|^\(?", 0))
    keep = F.when(kind == "card", 1).when(kind == "cloud_key", 4).when(kind == "iban", 2).when(kind == "phone", code).otherwise(0)

    def formed(x: Column) -> Column:
        mapped, own = x["mapped"], x["digest"]
        longer = F.when(attempt >= _GROW, F.lower(F.translate(F.substring(own, F.lit(50), F.least(attempt - _GROW + 1, F.lit(12))), "0123456789", "ghijklmnop"))).otherwise("")
        domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lower(F.substring_index(entity, "@", -1))), 256)
        top = _let(domain, lambda d: F.concat(F.lit("@m"), F.substring(d, 1, 8), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), F.conv(F.substring(d, 20, 2), 16, 10).cast("int") % 3 + 1)))
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substring(own, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string"))
        stem = F.substring(mapped, F.lit(1), F.length(mapped) - 1)
        check = (10 - luhn(F.concat(F.regexp_replace(stem, r"[ -]", ""), F.lit("0")))) % 10
        given = F.try_element_at(F.create_map(*(F.lit(x) for pair in given_names(key).items() for x in pair)), entity)
        return (
            F.when(kind == "email", F.concat(F.substring_index(mapped, "@", 1), longer, top))
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "card", F.concat(stem, check.cast("string")))
            .when(kind.isin("phone", "cloud_key", "iban", "ssn"), F.concat(mapped, F.translate(longer, "abcdefghijklmnop", "0123450123456789")))
            .when(F.startswith(kind, F.lit("given_")), given)
            .otherwise(F.concat(mapped, longer))
        )

    return _let(F.struct(_mapped(entity, digest, keep).alias("mapped"), digest.alias("digest")), formed)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt, surrogate) for distinct `entities(kind, entity)`: no two of a kind alike, none a real one.

    An entity whose surrogate an earlier one has, or that is itself found in the table, tries again with the next
    attempt until none is left. What is left shrinks with every round: from the fourth attempt on, surrogates other than IP addresses and
    cards, of which there are billions, grow by a sign each time, so that forms of which the table holds most values run out of none. Given names come from short lists, of which
    each name has another one, distinct by construction, so they need no check; all of a list may be real ones.
    """
    every = entities.where(~F.startswith("kind", F.lit("given_")))
    placed = save(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)), "surrogates")
    while True:
        checked = placed.where(~F.startswith("kind", F.lit("given_")))
        shared = checked.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1")
        later = checked.join(shared, ["kind", "surrogate"]).where(F.col("entity") > F.col("first")).select("kind", "entity")
        real = checked.join(every.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity")
        again = save(later.union(real).distinct().withColumn("again", F.lit(1)), "again")
        if not again.head(1):
            return placed.select("kind", "entity", "attempt", "surrogate")
        attempt = F.col("attempt") + F.coalesce("again", F.lit(0))
        moved = placed.join(again, ["kind", "entity"], "left").select("kind", "entity", attempt.alias("attempt"), "again", "surrogate")
        renewed = F.when(F.col("again") == 1, surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)).otherwise(F.col("surrogate"))
        placed = save(moved.select("kind", "entity", "attempt", renewed.alias("surrogate")), "surrogates")


def replace(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_entities, n_replaced) for every row of `docs`: its text with surrogates for all that was detected.

    An entity has the same surrogate wherever it occurs, and no other entity of its kind has it; kinds, lengths, signs,
    scripts, case, checksums, a title's gender and the gender of given names stay. Long numbers that are no card
    number stay as they are. Null stays null and counts nothing; rows with equal keys are told apart by their texts, equal
    rows get equal results. Whoever knows `secret` can make the surrogates again. Texts are never shuffled for their entities: a surrogate follows from its entity, and only
    the few that had to try again are joined to the rows that mention them; a mention that a large share of rows
    hold is split by the skew join. Further columns are not read; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    narrow = narrow.withColumn("hash", F.xxhash64("text"))
    found = F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    mentions = narrow.select("key", "hash", F.explode(F.array_distinct(found)).alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    mentions = save(mentions.where("kind is not null"), "mentions")
    known = surrogates(mentions.select("kind", "entity").distinct(), secret)
    again = mentions.join(known.where("attempt > 0"), ["kind", "entity"])
    named = F.struct(F.concat_ws("|", "kind", "entity").alias("key"), "attempt")
    again = again.groupBy("key", "hash").agg(F.map_from_entries(F.collect_set(named)).alias("attempts"))
    again = save(again.select(F.col("key").alias("k"), F.col("hash").alias("h"), "attempts"), "attempts")
    joined = narrow.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
    joined = joined.withColumn("found", F.transform(found, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind"))))
    own = F.transform("found", lambda x: _replacement(x["kind"], x["entity"], F.col("attempts"), secret))
    woven = F.array_join(F.zip_with(F.split("text", PATTERN, -1), own, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.select(
        F.col("key").alias(key),
        F.when(F.size("found") == 0, F.col("text")).otherwise(woven).alias("text"),
        F.size("found").cast("long").alias("n_entities"),
        F.size(F.filter("found", lambda x: x["kind"].isNotNull())).cast("long").alias("n_replaced"),
    )


def _replacement(kind: Column, entity: Column, attempts: Column, secret: str) -> Column:
    attempt = F.coalesce(F.try_element_at(attempts, F.concat_ws("|", kind, entity)), F.lit(0))
    return F.when(kind.isNull(), entity).otherwise(surrogate(kind, entity, attempt, secret))
