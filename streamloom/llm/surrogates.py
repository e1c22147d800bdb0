"""PII surrogates: detected entities get keyed, type-consistent replacements.

1. Detect: one alternation of patterns, read off every whole text. Where a text titles names, it is read once more for its mentions of
   them without a title, the whole name or the family name.
2. Values: an address in lower case, a number's digits; a name's given and family name are values of their own, so that
   full and short mentions of one family name, whoever bears it, share its surrogate. All spellings of one value share one in
   all documents.
3. Surrogates: a keyed hash of kind and value, spelt in the same shape: digits for digits, letters for letters of the same
   script, a given name of the same gender. Collision checks over all kinds: a surrogate that another value also has, or that
   is itself a detected value, is drawn again with the next attempt number from a wider space, until all are distinct.
4. Replace: a text is what lies between its entities with the surrogates in between, in the case and punctuation of each
   mention.

All of it is DataFrame functions. Only texts with entities are shuffled, keyed by their list of entities, and never all
mentions of one entity. Names are found by their titles: a name that a text never titles stays in that text.
Defined results: a null text stays null; repeated rows are rewritten alike; an empty table gives an empty one; all columns are
kept, whatever their names; more values than a shape can spell get longer surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import free_name, materialize

# Titles by gender, given names by script and gender, alphabets by script, syllables of surnames.
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
#: Titles of either gender.
TITLES_N = "Dr|Prof|Professor"
TITLES = f"{TITLES_F}|{TITLES_M}|{TITLES_N}"
PARTICLES = "von|van|vom|zu|zur|de|del|della|der|den|di|da|dos|du|la|le|el|al|bin|ibn|ten|ter"
GIVEN = {
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Helga", "Irma", "Julia", "Karla", "Lydia", "Marta", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Anton", "Bruno", "Carlo", "David", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Nils", "Oscar", "Paul"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария"],
    ("cyrillic", "m"): ["Антон", "Борис", "Глеб", "Денис", "Иван", "Лев", "Олег", "Павел"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Μαρία"],
    ("greek", "m"): ["Γιώργος", "Κώστας", "Νίκος", "Πέτρος"],
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "latin": ["bar", "del", "fen", "gor", "hal", "kin", "lor", "mar", "nel", "por", "ran", "sil", "tor", "val", "wen", "zan"],
    "cyrillic": ["бар", "вел", "гор", "дан", "жел", "кин", "лор", "мар", "нел", "пор", "рам", "сил", "тор", "хал", "чер", "шан"],
    "greek": ["βαρ", "γαλ", "δελ", "θαν", "καρ", "λιν", "μαρ", "νελ", "παρ", "ραν", "σιλ", "τορ", "φαν", "χαλ", "ζαρ", "ξεν"],
}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
HEX = r"[0-9A-Fa-f]{1,4}"
#: A given name or an initial, and a family name with particles before it; parts may have hyphens and capitals inside.
GIVEN_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
FAMILY_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)*(?:-\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*)*"
WITH_PARTICLES = rf"(?:(?:{PARTICLES}) ){{0,3}}{FAMILY_NAME}"
#: What a secret stands after, and the beginnings of keys that tell what they are; both stay.
CONTEXT = r"""(?i:api[_-]?key|access[_-]?key|token|secret|passwd|password)["']? {0,3}[=:] {0,3}["']?"""
KEY_START = r"AKIA|ASIA|sk-(?:[a-z]{2,6}-)?|gh[pousr]_|xox[abprs]-"
#: Kinds and their patterns, in the order in which they are tried where a run of letters or digits begins.
PATTERNS = {
    "email": r"(?<![._+-])[\p{L}\p{N}._+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "assigned": rf"{CONTEXT}(?=[^\s\"']{{0,127}}[0-9])[A-Za-z0-9+/=_.~!@#$%^&*-]{{7,127}}[A-Za-z0-9+/=]",
    "key": rf"(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9])|sk-(?:[a-z]{{2,6}}-)?[A-Za-z0-9_-]{{20,200}}|gh[pousr]_[A-Za-z0-9]{{30,80}}|xox[abprs]-[A-Za-z0-9-]{{10,80}}",
    "ip6": rf"(?<!:)(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{HEX}(?::{HEX}){{7}}|{HEX}(?::{HEX}){{0,5}}::(?:{HEX}(?::{HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}:])",
    "secret": r"(?=[A-Fa-f]{0,63}[0-9])[A-Fa-f0-9]{32,64}+(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![\p{L}\p{N}]|[ -][0-9])",
    "numbers": r"(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}|[0-9]{13,19})(?![\p{L}\p{N}])",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]){6,13}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![\p{L}\p{N}-])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}(?![0-9])",
    "name": rf"(?:{TITLES})\.? (?:(?:{GIVEN_NAME}|\p{{Lu}}\.?)(?: \p{{Lu}}\.)? {WITH_PARTICLES}|\p{{Lu}}\.{FAMILY_NAME}|{WITH_PARTICLES})(?!\p{{L}})",
}
#: Before an entity there is no letter or digit; before its mention in "(030)" no bracket either.
BEFORE = r"(?<![\p{L}\p{N}])"
ENTITY = BEFORE + "(?:" + "|".join(PATTERNS.values()) + ")"
#: In front of a mention without a title, with its gender: two characters that texts don't have.
BARE = "\x01"


#: What every text with an entity has.
GUARD = rf"[0-9@]|(?:{TITLES})\.? \p{{Lu}}|(?:{TITLES})\.? (?:{PARTICLES}) "
TITLED = rf"^(?:{TITLES})\.? "


def entities(text: Column) -> Column:
    """The entities of a text, in order; none of a null text."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text.rlike(GUARD), F.lit(False)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def _bare(found: Column) -> Column:
    """An entity without its title or mark."""
    return F.regexp_replace(F.regexp_replace(found, rf"^{BARE}.", ""), TITLED, "")


def _family(bare: Column) -> Column:
    """The family name of a name without a title, without particles."""
    return F.regexp_extract(bare, rf"({FAMILY_NAME})$", 1)


def _first(bare: Column) -> Column:
    """The given name or initial of a name without a title; empty if it has none."""
    return F.regexp_extract(bare, rf"^({GIVEN_NAME}|\p{{Lu}})(?=[. ])", 1)


def own_pattern(found: Column) -> Column:
    """For a text with titled names the patterns of ENTITY and its own names without titles; else null."""
    names = F.array_distinct(F.transform(F.filter(found, lambda e: e.rlike(TITLED)), _bare))
    families = F.filter(F.transform(names, _family), lambda f: F.length(f) > 1)
    full = F.filter(names, lambda n: n.contains(" ") & (F.length(_first(n)) > 1))
    every = F.array_distinct(F.concat(full, families))
    # Longer ones first, so that a whole name is not taken for its beginning.
    ordered = F.transform(F.reverse(F.array_sort(F.transform(every, lambda n: F.struct(F.length(n).alias("k"), n.alias("n"))))), lambda s: F.concat(F.lit(r"\Q"), s["n"], F.lit(r"\E")))
    whole = F.concat(F.lit(BEFORE + "(?:" + "|".join(PATTERNS.values()) + "|(?:"), F.array_join(ordered, "|"), F.lit(r")(?!\p{L}))"))
    return F.when(F.size(every) > 0, whole)


def marked(found: Column, raw: Column) -> Column:
    """raw, the entities of own_pattern(), with a mark and the gender of its titled mention before each name without a title."""
    titled = F.filter(found, lambda e: e.rlike(TITLED))
    same = lambda e: F.filter(titled, lambda t: _bare(t) == e)
    gender = lambda e: F.when(F.size(same(e)) > 0, F.substring(kind_of(F.get(same(e), F.lit(0))), -1, 1)).otherwise(F.lit("n"))
    families = F.transform(titled, lambda t: _family(_bare(t)))
    is_bare = lambda e: F.exists(titled, lambda t: _bare(t) == e) | F.array_contains(families, e)
    return F.transform(raw, lambda e: F.when(is_bare(e), F.concat(F.lit(BARE), gender(e), e)).otherwise(e))


def value_of(found: Column) -> Column:
    """An entity without what it was assigned to."""
    return F.regexp_replace(found, rf"^{CONTEXT}", "")


def luhn(digits: Column) -> Column:
    """Whether digits have the check digit of card numbers."""
    return F.pmod(_luhn_sum(digits), F.lit(10)) == 0


def _luhn_sum(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _mod97(text: Column) -> Column:
    """The number that letters and digits spell, letters as 10 to 35, modulo 97."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + number(c), F.lit(97)).cast("int"))


def kind_of(found: Column) -> Column:
    """An entity's kind; names by gender; "plain" for numbers that are no card's."""
    value, digits = value_of(found), F.regexp_replace(found, "[ -]", "")
    kind = F.lit("key")
    for name, test in (
        ("ip", rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        ("phone", r"^(?:\+|\([0-9]{3}\) ?[0-9]{3}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$)"),
        ("card", r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$"),
        ("iban", r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})"),
        ("secret", r"^[A-Fa-f0-9]{32,64}$"),
        ("ip6", r"^[0-9A-Fa-f:]+:[0-9A-Fa-f:]*$"),
    ):
        kind = F.when(value.rlike(test), F.lit(name)).otherwise(kind)
    kind = F.when(found.rlike(r"^[0-9][0-9 -]{11,22}$") & (kind == "key"), F.when(luhn(digits), F.lit("card")).otherwise(F.lit("plain"))).otherwise(kind)
    kind = F.when(found.rlike(rf"^{KEY_START}") | (found != value) & ~kind.isin("secret"), F.lit("key")).otherwise(kind)
    kind = F.when((found == value) & found.contains("@"), F.lit("email")).otherwise(kind)
    for name, titles in (("name_f", TITLES_F), ("name_m", TITLES_M), ("name_n", TITLES_N)):
        kind = F.when(found.rlike(rf"^(?:{titles})\.? ") | found.startswith(BARE + name[-1]), F.lit(name)).otherwise(kind)
    return kind


def canonical(found: Column, kind: Column) -> Column:
    """The value of an entity other than a name without the format of this mention."""
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(found, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "key", value_of(found))
        .otherwise(F.lower(value_of(found)))
    )


def parts(found: Column, kind: Column) -> Column:
    """The values that surrogates are assigned to, as an array of struct(kind, canon): a name's given name (by gender) or initial, and
    its family name, which is one value whoever bears it and however it is mentioned; else the value itself."""
    bare = _bare(found)
    first, last = F.lower(_first(bare)), F.lower(_family(bare))
    of_first = F.when(F.length(first) == 1, F.lit("initial")).otherwise(F.concat(F.lit("given_"), F.substring(kind, -1, 1)))
    family = F.struct(F.lit("family").alias("kind"), last.alias("canon"))
    name = F.when(first != "", F.array(F.struct(of_first.alias("kind"), first.alias("canon")), family)).otherwise(F.array(family))
    return F.when(kind.startswith("name"), name).otherwise(F.array(F.struct(kind.alias("kind"), canonical(found, kind).alias("canon"))))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a hash in hexadecimal digits, over and over."""
    return F.conv(F.substring(digest, 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str] | str, n: Column) -> Column:
    if isinstance(values, str):
        return F.substring(F.lit(values), F.pmod(n, F.lit(len(values))) + 1, F.lit(1))
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))))


def _reshape(value: Column, digest: Column) -> Column:
    """value with other digits and letters in the same places, letters from the same script."""

    def one(i: Column) -> Column:
        c, b = F.substring(value, i + 1, F.lit(1)), _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(ALPHABETS["cyrillic"], b))
            .when(c.rlike(r"\p{IsGreek}"), _pick(ALPHABETS["greek"], b))
            .when(c.rlike(r"\p{Lu}"), F.upper(_pick(ALPHABETS["latin"], b)))
            .when(c.rlike(r"\p{L}"), _pick(ALPHABETS["latin"], b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _more(syllables: list[str], digest: Column, attempt: Column) -> Column:
    """A syllable for each attempt after the second, 24 at most."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: _pick(syllables, _byte(digest, i + 5)))
    return F.array_join(F.slice(drawn, F.lit(1), F.least(F.greatest(attempt - 2, F.lit(0)), F.lit(24))), "")


def _name(canon: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """A part of a name in the same script; a given name has the same gender. Each attempt after the second adds a syllable."""
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    out = F.lit(None).cast("string")
    for s in ALPHABETS:
        more = _more(SYLLABLES[s], digest, attempt)
        family = F.concat(*(_pick(SYLLABLES[s], _byte(digest, F.lit(i))) for i in (1, 2, 3, 4)), more)
        # A double name gets one.
        family = F.concat(family, F.when(canon.contains("-"), F.concat(F.lit("-"), *(_pick(SYLLABLES[s], _byte(digest, F.lit(i))) for i in (29, 30, 31)))).otherwise(""))
        out = F.when((script == s) & (kind == "family"), family).when((script == s) & (kind == "initial"), _pick(ALPHABETS[s], _byte(digest, F.lit(0)))).otherwise(out)
        for g in "fmn":
            names = GIVEN[s, "f"] + GIVEN[s, "m"] if g == "n" else GIVEN[s, g]
            second = F.when(canon.contains("-"), F.concat(F.lit("-"), F.lower(_pick(names, _byte(digest, F.lit(28)))))).otherwise("")
            out = F.when((script == s) & (kind == f"given_{g}"), F.concat(F.lower(_pick(names, _byte(digest, F.lit(0)))), more, second)).otherwise(out)
    return out


def _keyed(key: str, *parts: Column) -> Column:
    inner = F.sha2(F.concat_ws("\x1f", F.lit(f"{key}/inner"), *parts), 256)
    return F.sha2(F.concat(F.lit(f"{key}/outer"), inner), 256)


def _draw(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt -> the surrogate in canonical form."""
    rows = found.withColumn("digest", _keyed(key, F.col("kind"), F.col("canon"), F.col("attempt").cast("string")))
    kind, canon, digest, attempt = F.col("kind"), F.col("canon"), F.col("digest"), F.col("attempt")
    # Shapes have finitely many values: from the fourth attempt on they grow by a digit each.
    more = F.substring(F.translate(digest, "abcdef", "012345"), F.lit(1), F.greatest(attempt - 3, F.lit(0)))
    host = F.substring_index(canon, "@", -1)
    mail = F.concat(_reshape(F.substring_index(canon, "@", 1), digest), more, F.lit("@"), _reshape(F.substring_index(host, ".", 1), _keyed(key, F.lit("host"), host)), F.lit(".example.com"))
    # There are more addresses than any text can name, so one that is taken is drawn again without being longer.
    octets = F.concat_ws(".", (F.pmod(_byte(digest, F.lit(0)), F.lit(223)) + 1).cast("string"), *(_byte(digest, F.lit(i)).cast("string") for i in (1, 2, 3)))
    groups = F.array_join(F.transform(F.split(canon, ":"), lambda g, i: F.when(g == "", g).otherwise(F.substring(digest, 4 * i + 1, F.length(g)))), ":")
    phone = F.concat(F.substring(canon, 1, 1), _reshape(F.expr("substring(canon, 2)"), digest), more)
    # Check digits are right where those of the value are.
    body = F.concat(_reshape(F.substring(canon, F.lit(1), F.length(canon) - 1), digest), more)
    last = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(luhn(canon), F.concat(body, last)).otherwise(F.concat(_reshape(canon, digest), more))
    account = F.concat(_reshape(F.expr("substring(canon, 5)"), digest), more)
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((98 - _mod97(F.concat(account, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0"), account)
    secret = F.concat(F.expr("substring(concat(digest, sha2(digest, 256)), 1, length(canon))"), more)
    start = F.regexp_extract(canon, rf"^(?:{KEY_START})", 0)
    secret_key = F.concat(start, _reshape(F.substring(canon, F.length(start) + 1, F.length(canon)), digest), more)
    drawn = (
        F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "ip6", groups).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "secret", secret).when(kind == "key", secret_key).when(kind == "plain", canon)
        .when(kind.isin("family", "given_f", "given_m", "given_n", "initial"), _name(canon, kind, digest, attempt)).otherwise(F.concat(_reshape(canon, digest), more))
    )
    return rows.select("kind", "canon", "attempt", drawn.alias("surrogate"))


def assign(known: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct (kind, canon): surrogates are distinct over all kinds, and none is a known value.

    Every attempt widens the space that it draws from (names from the third on, other shapes from the fourth), so that few are left
    each time, however many values there are. Initials are letters, which can't be distinct, and take the first draw."""
    known = materialize(known.where("kind <> 'plain'"), "pii-known")
    initials = _draw(known.where("kind = 'initial'").withColumn("attempt", F.lit(0)), key)
    values = known.where("kind <> 'initial'").select(F.col("canon").alias("surrogate")).distinct()
    drawn = materialize(_draw(known.where("kind <> 'initial'").withColumn("attempt", F.lit(0)), key), "pii-drawn")
    while True:
        first = drawn.groupBy("surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "kind", "canon")).alias("keeps")).where("n > 1").drop("n")
        shared = drawn.join(materialize(first, "pii-shared"), "surrogate").where((F.col("keeps.canon") != F.col("canon")) | (F.col("keeps.kind") != F.col("kind"))).select("kind", "canon", "attempt")
        real = drawn.join(values, "surrogate", "left_semi").select("kind", "canon", "attempt")
        again = materialize(shared.unionByName(real).distinct(), "pii-again")
        if again.isEmpty():
            return drawn.unionByName(initials).select("kind", "canon", "surrogate")
        kept = drawn.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti")
        drawn = materialize(kept.unionByName(_draw(again.withColumn("attempt", F.col("attempt") + 1), key)), "pii-drawn")


def _digits_into(mention: Column, digits: Column) -> Column:
    """The mention's punctuation with other digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(a["out"], F.when(digit, F.substring(digits, a["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step, lambda a: F.concat(a["out"], F.substring(digits, a["k"], F.length(digits))))


def _case_of(mention: Column, surrogate: Column) -> Column:
    """The surrogate with capitals where the mention has them."""
    one = lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)
    return F.when(mention.rlike(r"\p{Lu}"), F.array_join(F.transform(F.split(surrogate, ""), one), "")).otherwise(surrogate)


def _capitals(name: Column) -> Column:
    """A name with a capital at the start of each of its parts."""
    return F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")


def render(mention: Column, kind: Column, surrogates: Column) -> Column:
    """The surrogates of a mention's parts in its format."""
    bare = F.regexp_replace(mention, rf"^{BARE}.", "")
    family = _family(_bare(mention))
    # What stands before the family name but the given name: title, gap and particles.
    title = F.regexp_extract(bare, rf"^((?:{TITLES})\.? )", 1)
    first = _first(_bare(mention))
    middle = F.substring(bare, F.length(title) + F.length(first) + 1, F.length(bare) - F.length(title) - F.length(first) - F.length(family))
    before = F.regexp_extract(mention, rf"^{CONTEXT}", 0)
    surrogate, last = F.get(surrogates, F.lit(0)), F.get(surrogates, F.size(surrogates) - 1)
    value = value_of(mention)
    plain = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(surrogate)).otherwise(_case_of(value, surrogate))
    groups = F.when(mention.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    name = F.concat(title, F.when(F.size(surrogates) > 1, _capitals(surrogate)).otherwise(""), middle, _capitals(last))
    return (
        F.when(kind == "plain", mention)
        .when(kind.isin("card", "phone", "ssn"), _digits_into(mention, surrogate))
        .when(kind == "iban", groups)
        .when(kind.startswith("name"), name)
        .when(kind == "key", F.concat(before, surrogate))
        .otherwise(F.concat(before, plain))
    )


def _signature(found: str) -> Column:
    return F.sha2(F.array_join(found, "\x1f"), 256)


def mentions(lists: DataFrame, key: str) -> DataFrame:
    """mention, kind, replacement of every distinct mention in lists of entities (found)."""
    found = lists.select(F.explode(F.array_distinct("found")).alias("mention")).distinct()
    found = found.withColumn("kind", kind_of(F.col("mention")))
    found = materialize(found.withColumn("parts", parts(F.col("mention"), F.col("kind"))), "pii-mentions")
    each = found.where("kind <> 'plain'").select("mention", F.posexplode("parts").alias("at", "part")).select("mention", "at", "part.*")
    given = assign(each.select("kind", "canon").distinct(), key)
    # At most two parts for each mention.
    named = each.join(given, ["kind", "canon"]).groupBy("mention").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("surrogates"))
    return materialize(found.where("kind <> 'plain'").join(named, "mention").select("mention", "kind", render(F.col("mention"), F.col("kind"), F.col("surrogates")).alias("replacement")), "pii-map")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with all entities of the text replaced; count_col: also how many there were, under a free name."""
    count_col = count_col and free_name(docs.columns, count_col)
    # Patterns run over the texts once, and over those with titled names twice; the rows are written with what was found, and rewritten
    # from there. Numbers that are no card's are found too and left as they are.
    source = F.col(f"`{text_col}`")
    first = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), entities(source).alias("found")).withColumn("pattern", own_pattern(F.col("found")))
    text = F.col("doc").getField(text_col)
    again = F.when(F.col("pattern").isNotNull(), marked(F.col("found"), F.regexp_extract_all(text, F.col("pattern"), F.lit(0)))).otherwise(F.col("found"))
    boxed = materialize(first.withColumn("found", again), "pii-found")
    listed = boxed.where(F.size("found") > 0).withColumn("sig", _signature("found"))
    lists = materialize(listed.select("sig", "found").groupBy("sig").agg(F.first("found").alias("found")), "pii-lists")
    table = mentions(lists, key)
    maps = lists.select("sig", F.explode(F.array_distinct("found")).alias("mention")).join(table.select("mention", "replacement"), "mention", "left")
    maps = maps.withColumn("replacement", F.coalesce("replacement", "mention"))
    maps = materialize(maps.groupBy("sig").agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("to")), "pii-maps")
    between = F.split(text, F.coalesce("pattern", F.lit(ENTITY)), -1)
    # A number that is no card's has no surrogate.
    spliced = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.try_element_at("to", F.get("found", i)), F.get("found", i), F.lit("")))), "")
    extra = [F.size(F.filter("found", lambda e: kind_of(e) != "plain")).cast("long").alias(count_col)] if count_col else []
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    changed = listed.join(maps, "sig").select(*(c if n != text_col else spliced.alias(n) for n, c in zip(docs.columns, columns, strict=True)), *extra)
    return boxed.where(F.size("found") == 0).select(*columns, *extra).unionByName(changed)
