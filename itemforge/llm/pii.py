"""Personal data: detected entities receive keyed surrogates.

One pattern finds e-mail addresses, secrets, IBANs, IPv4 and IPv6 addresses, phone, card and social security
numbers and titled names; a second one, made for a text, its named people without their titles.  A name's
entities are its family name and its given one with the gender, whatever the title.  An entity's canonical form (case and separators dropped where they carry
no identity) and a key give its surrogate, so one entity reads alike in all documents.  Surrogates
keep the kind, script, case, length of numbers and separators, a card's Luhn validity, a phone's
country code, an IBAN's country, and a name's gender; addresses come from reserved blocks.  All distinct
entities of the corpus are checked: a surrogate that equals another's, or a real entity, is drawn again
until all differ.  Draws after the third grow longer than the original, so the space of surrogates never
runs out, whatever the shape.

Defined results: a null text stays null, an empty one empty; texts without entities are unchanged; a
run without a letter or digit is no secret; repeated rows are treated alike, and null ids are an id of
their own; of surrogates drawn alike, the one of the first canonical form stays (ties end by the country
code); an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_name, let, materialise

#: Moved surrogates that travel as one broadcast map; of more, a join finds them.
BROADCAST = 10_000
#: Stands around a mention while a text is cut.
MARK = "\x01"
#: Kinds in order of precedence, and their patterns.
MALE_TITLES = ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Signor", "Господин", "Господина", "Господину")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Dra", "Profa", "Madame", "Mme", "Mademoiselle", "Mlle", "Signora", "Госпожа", "Госпожи", "Госпоже")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Professeur", "Profesor", "Profesora", "Doctora", "Mx", "Rev", "Доктор", "Профессор")
TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)
GAP = r"[ \u00A0]+"
#: Words inside a name that start small, and words that end one though they start large.
PARTICLES = "von|van|vom|zu|zum|zur|den|der|de|del|della|di|da|do|dos|das|du|des|la|le|el|al|bin|ibn|ben|ter|ten|af|av|y|e"
ENDS = "The|This|That|These|Those|They|And|But|When|While|Where|What|If|His|Their|Our|Your|Is|Was|Are"
#: Initials, or a word with inner capitals, hyphens and apostrophes.
WORD = r"(?:(?:\p{Lu}\.[ -]?)+(?=[ \u00A0]*[\p{L}])|(?:[dlDL]['’])?\p{Lu}[\p{L}\p{M}]*(?:['’\u2010\u2011-][\p{L}\p{M}]+)*)"
NAME = rf"(?:(?:{PARTICLES}){GAP})*{WORD}(?:(?:{GAP}|(?<=[. -]))(?!(?:{ENDS})(?![\p{{L}}'’-]))(?:(?:{PARTICLES}){GAP})*{WORD})*"
V4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
H = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{32,}+|(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])|(?<=[=:] ?[\"']?)(?<=(?i:token|secret|password|api[_-]?key) ?[=:] ?[\"']?)(?=[_+/=-]*+[A-Za-z0-9])[A-Za-z0-9_+/=-]{12,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}_:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[A-Fa-f:]*[0-9]|(?:[A-Fa-f]*:){{4}})(?:(?:{H}:){{6}}(?:{H}:{H}|{V4})|(?:{H}(?::{H}){{0,6}})?::(?:(?:{H}:){{0,5}}{V4}|{H}(?::{H}){{0,6}})?)(?![\p{{L}}\p{{N}}_]|:[0-9A-Fa-f:]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,3}(?![0-9])|(?<![0-9(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLE})(?:\.[ \u00A0]*|{GAP}))+{NAME}(?!\p{{L}})",
}
INITIALS = "".join(sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES}))
#: What a mention's first characters must be, where that is cheaper to look at than its pattern.
GUARDS = {"iban": "(?=[A-Z]{2}[0-9]{2})", "ip": "(?=[0-9])", "phone": "(?=[0-9+(])", "ssn": "(?=[0-9])", "card": "(?=[0-9])", "name": f"(?=[{INITIALS}])"}
INSIDE = ("ip", "phone", "ssn", "card")


def any_of(kinds: list[str]) -> str:
    """All kinds at the start of a word; inside of one only numbers."""
    one = lambda k: f"{GUARDS.get(k, '')}(?:{PATTERNS[k]})"
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(one, kinds))})|(?<=[\p{{L}}\p{{N}}])(?=[0-9(+])(?:{'|'.join(map(one, INSIDE))})"


#: Of a text with an @, and of one without.
ANY, BARE = any_of(list(PATTERNS)), any_of([k for k in PATTERNS if k != "email"])
#: Nothing in PATTERNS matches a text without one of these.
HINT = (
    rf"(?=[0-9@=:_A{INITIALS}-])(?:[0-9@]|[=:] ?[\"']?[A-Za-z0-9_+/=-]{{12}}|[_-][A-Za-z0-9_-]{{16}}|AKIA[A-Z]{{16}}|:[A-Fa-f]{{0,4}}:|(?<!\p{{L}})(?:{TITLE})[. \u00A0])"
)
#: Given names by gender, syllables of family names, by script.
GIVEN = {
    "m": ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    "f": ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera"),
    "cm": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"),
    "cf": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"),
}
SYLLABLES = {
    "l": ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "zel"),
    "c": ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ва", "зел"),
}
#: Classes of letters and digits that a character stays in, as ranges of code points.
RANGES = (
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x5D0, 0x5EA), (0x627, 0x63A), (0x641, 0x64A), (0x660, 0x669), (0x6F0, 0x6F9), (0x915, 0x939), (0x966, 0x96F), (0xE01, 0xE2E),
    (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x51FF), (0xAC00, 0xAFFF),
)
#: Country codes of phones by their digits: of one and two digits; all others have three.
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Words after a family name.
SUFFIX = r"[ \u00A0]+(?:Jr|Sr|Junior|Senior|II|III|IV|PhD|MD|Esq)\.?$"
DIGITS = ("phone", "ssn", "card")
CYRILLIC = r"\p{IsCyrillic}"


def pieces(text: Column, pattern: Column) -> Column:
    """The text cut at its mentions: text, mention, text, ...  One pass of the pattern; two where the text has the mark."""
    fast = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda s, e: F.array(s, e))
    return F.when(F.contains(text, F.lit(MARK)), F.array_compact(F.flatten(pairs))).otherwise(fast)


def first_pieces(text: Column) -> Column:
    """`pieces` of all kinds; the whole text alone where it can't hold any."""
    found = F.when(F.contains(text, F.lit("@")), pieces(text, F.lit(ANY))).otherwise(pieces(text, F.lit(BARE)))
    return F.when(text.rlike(HINT), found).otherwise(F.array(text))


def odd(ps: Column) -> Column:
    """The mentions among pieces."""
    return F.filter(ps, lambda x, i: i % 2 == 1)


def kind(e: Column) -> Column:
    out = F.lit("name")
    for name, p in reversed([x for x in PATTERNS.items() if x[0] not in ("name", "secret")]):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    titled = e.rlike(f"^(?:{PATTERNS['name']})$")
    return F.when(titled, F.lit("name")).when(e.rlike("^[0-9A-Fa-f]{32,}$"), F.lit("secret")).otherwise(F.when(out == "name", F.lit("secret")).otherwise(out))


def groups(e: Column) -> Column:
    """An IPv6 address as eight groups, in small letters and without leading zeros."""
    four = F.split(F.regexp_extract(e, rf":({V4})$", 1), r"\.")
    pair = lambda i: F.lower(F.hex(F.get(four, F.lit(i)).cast("int") * 256 + F.get(four, F.lit(i + 1)).cast("int")))
    whole = F.lower(F.when(F.contains(e, F.lit(".")), F.concat(F.regexp_replace(e, rf"{V4}$", ""), pair(0), F.lit(":"), pair(2))).otherwise(e))
    parts = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    short = F.transform(F.split(whole, "::"), parts)
    first, last = F.get(short, F.lit(0)), F.coalesce(F.get(short, F.lit(1)), F.array().cast("array<string>"))
    filled = F.concat(first, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(first) - F.size(last), F.lit(0))), last)
    return F.array_join(F.transform(filled, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def canonical(k: Column, e: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(k.isin(*DIGITS), digits)
        .when(k == "iban", F.upper(F.regexp_replace(e, " ", "")))
        .when(k.isin("email", "ip"), F.lower(e))
        .when(k == "ip6", groups(e))
        .when((k == "secret") & e.rlike("^[0-9A-Fa-f]+$"), F.lower(e))
        .otherwise(e)
    )


def stream(k: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Hexadecimal digits, two for each character of the canonical form and 32 more."""
    seed = F.concat_ws("\n", F.lit(key), k, attempt.cast("string"), canon)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 32).cast("int") + 1), lambda j: F.sha2(F.concat_ws("\n", j.cast("string"), seed), 256))
    return F.array_join(blocks, "")


def value(s: Column, i: Column) -> Column:
    return F.conv(F.substr(s, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def letter(first: str, n: int, v: Column) -> Column:
    alphabet = F.lit("".join(chr(ord(first) + i) for i in range(n)))
    return F.substr(alphabet, v % n + 1, F.lit(1))


def classes() -> Column:
    """RANGES as an array of first and last character and all between."""
    one = lambda low, high: F.struct(F.lit(chr(low)).alias("low"), F.lit(chr(high)).alias("high"), F.lit("".join(map(chr, range(low, high + 1)))).alias("all"))
    return F.array(*[one(low, high) for low, high in RANGES])


def shaped(c: Column, s: Column, hexadecimal: Column, keep: Column) -> Column:
    """Each character replaced within its class, letters of other classes by Latin ones; the first `keep` characters stay."""

    def one(i: Column) -> Column:
        def by_class(x: Column) -> Column:
            v = value(s, i)
            alike = F.get(F.filter(classes(), lambda r: x.between(r["low"], r["high"])), F.lit(0))["all"]
            drawn = lambda a: F.substr(a, v * 97 % F.length(a) + 1, F.lit(1))
            other = F.when(x.rlike(r"\p{L}"), letter("a", 26, v)).otherwise(x)
            return F.when(i < keep, x).when(hexadecimal, F.substr(F.lit("0123456789abcdef"), v % 16 + 1, F.lit(1))).otherwise(let(alike, lambda a: F.coalesce(drawn(a), other)))

        return let(F.substr(c, i + 1, F.lit(1)), by_class)

    chars = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), one)
    return F.array_join(chars, "")


def luhn(digits: Column) -> Column:
    """Sum of the Luhn digits, counted so that the last digit is not doubled."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda acc, x: acc + x)


def card(canon: Column, body: Column, s: Column) -> Column:
    """A shaped card, its last digit such that it is Luhn-valid if and only if the original is."""
    zero = F.concat(F.substr(body, F.lit(1), F.length(canon) - 1), F.lit("0"))
    last = lambda b: (10 - luhn(b) % 10 + F.when(luhn(canon) % 10 == 0, 0).otherwise(1 + value(s, F.lit(0)) % 9)) % 10
    return let(zero, lambda b: F.concat(F.substr(b, F.lit(1), F.length(b) - 1), last(b).cast("string")))


def email(canon: Column, body: Column, s: Column, attempt: Column) -> Column:
    """A shaped local part, grown to ten characters; in later draws by ten."""
    n = F.length(canon)
    extra = F.array_join(F.transform(F.sequence(n, n + 9), lambda i: letter("a", 26, value(s, i))), "")
    pad = F.substr(extra, F.lit(1), F.when(attempt == 0, F.greatest(F.lit(10) - F.length(body), F.lit(0))).otherwise(10))
    return F.concat(pad, body, F.lit("@mail.example.org"))


def tail(k: Column, canon: Column, s: Column, attempt: Column) -> Column:
    """What draws after the third add, eight characters more each time, 24 at most."""
    n = F.length(canon)
    one = lambda i: F.when(k.isin(*DIGITS), letter("0", 10, value(s, i))).otherwise(letter("a", 26, value(s, i)))
    return F.when(attempt < 3, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(n, n + F.least(8 * (attempt - 2), F.lit(24)) - 1), one), ""))


def syllables(canon: Column, s: Column, start: int, attempt: Column) -> Column:
    """Of up to ten letters; longer in later draws, so names never run out."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), value(s, F.lit(i)) % len(xs) + 1)
    of = lambda xs: F.concat(*[pick(xs, i) for i in range(start, start + 8)])
    return F.substr(F.when(canon.rlike(CYRILLIC), of(SYLLABLES["c"])).otherwise(of(SYLLABLES["l"])), F.lit(1), F.when(attempt == 0, 10).otherwise(17))


def given_name(canon: Column, s: Column, attempt: Column) -> Column:
    """By gender (the first letter of the canonical form) and script; later draws have a second part, so they never run out."""
    pick = lambda *names: F.element_at(F.array(*[F.lit(x.lower()) for n in names for x in GIVEN[n]]), value(s, F.lit(0)) % (16 * len(names)) + 1)
    cyr, gender = canon.rlike(CYRILLIC), F.substr(canon, F.lit(1), F.lit(1))
    latin = F.when(gender == "f", pick("f")).when(gender == "m", pick("m")).otherwise(pick("f", "m"))
    name = F.when(~cyr, latin).when(gender == "f", pick("cf")).when(gender == "m", pick("cm")).otherwise(pick("cf", "cm"))
    return F.when(attempt == 0, name).otherwise(F.concat(name, F.lit("-"), syllables(canon, s, 1, attempt)))


def surrogate(k: Column, canon: Column, country: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate.  country: digits of a phone that stay."""

    def build(s: Column) -> Column:
        # of the block reserved for later, which no network routes
        octets = F.concat_ws(".", (value(s, F.lit(0)) % 15 + 240).cast("string"), *[value(s, F.lit(i)).cast("string") for i in range(1, 4)])
        # of the block for documentation
        eight = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.lower(F.hex(value(s, F.lit(2 * i)) * 256 + value(s, F.lit(2 * i + 1)))) for i in range(6)])
        hexadecimal = (k == "secret") & canon.rlike("^[0-9a-f]+$")
        keep = F.when(k == "phone", country).when(k == "iban", F.lit(2)).when(k == "card", F.lit(1)).otherwise(F.lit(0))
        source = F.when(k == "email", F.substring_index(canon, "@", 1)).otherwise(canon)

        def of_shape(body: Column) -> Column:
            whole = F.when(k == "card", card(canon, body, s)).otherwise(body)
            return F.when(k == "email", email(canon, body, s, attempt)).otherwise(F.concat(whole, tail(k, canon, s, attempt)))

        return (
            F.when((k == "ip") & (attempt < 3), octets)
            .when(k.isin("ip", "ip6"), eight)
            .when(k == "family", syllables(canon, s, 1, attempt))
            .when(k == "given", given_name(canon, s, attempt))
            .otherwise(let(shaped(source, s, hexadecimal, keep), of_shape))
        )

    return let(stream(k, canon, attempt, key), build)


def titles(e: Column) -> Column:
    return F.regexp_extract(e, rf"^(?:(?:{TITLE})(?:\.[ \u00A0]*|{GAP}))+", 0)


def body(e: Column) -> Column:
    """A name without its titles, with single spaces."""
    return F.regexp_replace(F.substr(e, F.length(titles(e)) + 1, F.length(e)), GAP, " ")


def family(name: Column) -> Column:
    """The last word of a body that isn't a suffix, without a small prefix of its own."""
    return F.regexp_extract(F.regexp_replace(name, SUFFIX, ""), r"([^ ]+)$", 1)


def given(name: Column) -> Column:
    """The words before the family name, particles left out; initials stand apart."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(name, SUFFIX, ""), r"[^ ]+$", ""), " "), lambda w: (w != "") & ~w.rlike(f"^(?:{PARTICLES})$"))
    return F.array_join(words, " ")


def gender(e: Column) -> Column:
    said = F.split(F.regexp_replace(titles(e), r"[. \u00A0]+", " "), " ")
    has = lambda names: F.arrays_overlap(said, F.array(*map(F.lit, names)))
    return F.when(has(FEMALE_TITLES), F.lit("f")).when(has(MALE_TITLES), F.lit("m")).otherwise(F.lit("n"))


def people(es: Column) -> Column:
    """The titled names among a text's mentions: body and gender."""
    titled = F.filter(es, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    return F.array_distinct(F.transform(titled, lambda e: F.struct(body(e).alias("body"), gender(e).alias("gender"))))


def untitled(known: Column) -> Column:
    """The pattern of a text's known names without titles: whole ones, and family names; longest first."""
    whole = F.transform(known, lambda p: p["body"])
    forms = F.array_distinct(F.concat(whole, F.transform(whole, family)))
    forms = F.transform(F.filter(forms, lambda x: F.length(x) > 1), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    either = F.array_join(F.transform(F.array_sort(forms), lambda f: F.regexp_replace(F.regexp_replace(f["x"], r"([.\-])", r"\\$1"), " ", r"[ \\u00A0]+")), "|")
    return F.concat(F.lit("(?:" + ANY + r")|(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])"))


def scan(text: Column, then: Callable[[Column, Column], Column]) -> Column:
    """`then` of the text's pieces and its known people.

    A name that a title gives away is a mention wherever the same text has it without one.
    """

    def found(ps: Column) -> Column:
        wider = lambda known: let(F.when(F.size(known) > 0, pieces(text, untitled(known))).otherwise(ps), lambda all_of: then(all_of, known))
        return let(people(odd(ps)), wider)

    return let(first_pieces(text), found)


def named(e: Column, known: Column) -> Column:
    """The given (if any) and the family name of a mention; gender by its title, else by the same name's elsewhere in the text."""
    name = body(e)
    same = F.filter(known, lambda p: (F.lower(p["body"]) == F.lower(name)) & (p["gender"] != "n"))
    g = F.when(gender(e) != "n", gender(e)).otherwise(F.coalesce(F.get(same, F.lit(0))["gender"], F.lit("n")))
    first = F.struct(F.lit("given").alias("kind"), F.concat(g, F.lit(" "), F.lower(given(name))).alias("canon"), F.lit(0).alias("country"))
    last = F.struct(F.lit("family").alias("kind"), F.lower(family(name)).alias("canon"), F.lit(0).alias("country"))
    return F.when(given(name) == "", F.array(last)).otherwise(F.array(first, last))


def render(e: Column, k: Column, scs: Column) -> Column:
    """The surrogate in the mention's own titles, case and separators.  scs: one, or a given and a family name."""
    sc = F.get(scs, F.lit(0))

    def overlay(keep: str) -> Column:
        def one(i: Column) -> Column:
            x = F.substr(e, i + 1, F.lit(1))
            at = F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), keep, ""))
            return F.when(x.rlike(keep), x).otherwise(F.substr(sc, at, F.lit(1)))

        rest = F.substr(sc, F.length(F.regexp_replace(e, keep, "")) + 1, F.length(sc))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.length(e) - 1), one), ""), rest)

    upper = (F.upper(e) == e) & (F.lower(e) != e)
    words = F.array_join(F.transform(scs, lambda x: F.initcap(x)), " ")
    loud = (F.upper(body(e)) == body(e)) & (F.length(family(body(e))) > 1)
    return (
        F.when(k.isin(*DIGITS), overlay("[^0-9]"))
        .when(k == "iban", overlay(" "))
        .when(k.isin("email", "secret") & upper, F.upper(sc))
        .when(k.isin("given", "family"), F.concat(titles(e), F.when(loud, F.upper(words)).otherwise(words)))
        .otherwise(sc)
    )


def country(e: Column) -> Column:
    """The length of an international number's country code, by its digits alone."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return F.when(F.startswith(e, F.lit("+")), F.length(F.regexp_extract(digits, f"^(?:{CODES})", 0))).otherwise(0)


def entities(e: Column, known: Column) -> Column:
    """Kind, canonical form and kept country digits of a mention; of a name, of its given and its family name."""

    def by_kind(k: Column) -> Column:
        plain = F.struct(k.alias("kind"), canonical(k, e).alias("canon"), F.when(k == "phone", country(e)).otherwise(0).alias("country"))
        return F.when(k == "name", named(e, known)).otherwise(F.array(plain))

    forms = lambda p: (p["body"] == body(e)) | (family(p["body"]) == body(e))
    titled = e.rlike(f"^(?:{PATTERNS['name']})$")
    return let(F.when(titled | F.exists(known, forms), F.lit("name")).otherwise(kind(e)), by_kind)


def redraw(known: DataFrame, key: str) -> DataFrame:
    """Entities whose first surrogate isn't theirs alone: (kind, canon, country, sc) with one that is.

    `known` has all distinct (kind, canon, country).  Rounds go on until no two surrogates are alike
    and none is a real entity.
    """
    pool = materialise(known.withColumn("attempt", F.lit(0)), "pii-entities")
    bare = F.when(F.col("kind") == "given", F.expr("substring(canon, 3)")).otherwise(F.col("canon"))
    real, fixed = known.select("kind", bare.alias("sc")).distinct(), None
    while True:
        drawn = pool.withColumn("sc", surrogate(F.col("kind"), F.col("canon"), F.col("country"), F.col("attempt"), key))
        taken = real if fixed is None else real.unionByName(fixed.select("kind", "sc"))
        first = Window.partitionBy("kind", "sc").orderBy("canon", "country")
        judged = drawn.withColumn("place", F.row_number().over(first)).join(taken.distinct().withColumn("clash", F.lit(True)), ["kind", "sc"], "left")
        judged = materialise(judged.withColumn("ok", (F.col("place") == 1) & F.col("clash").isNull()), "pii-drawn")
        won = judged.where("ok").select("kind", "canon", "country", "attempt", "sc")
        fixed = won if fixed is None else fixed.unionByName(won)
        pool = judged.where("not ok").select("kind", "canon", "country", (F.col("attempt") + 1).alias("attempt"))
        if not pool.limit(1).count():
            return fixed.where("attempt > 0").select("kind", "canon", "country", "sc")


def named_by(x: Column) -> Column:
    """An entity's name in the map of moved surrogates."""
    return F.concat_ws("\n", x["kind"], x["country"].cast("string"), x["canon"])


def replaced(text: Column, key: str, moved: Column | None) -> Column:
    """The text with every mention rendered anew.  moved: a map from named_by to other surrogates than the first drawn."""

    def drawn(x: Column) -> Column:
        base = surrogate(x["kind"], x["canon"], x["country"], F.lit(0), key)
        return base if moved is None else F.coalesce(F.try_element_at(moved, named_by(x)), base)

    def join(ps: Column, known: Column) -> Column:
        one = lambda e: let(entities(e, known), lambda xs: render(e, F.get(xs, F.lit(0))["kind"], F.transform(xs, drawn)))
        return F.when(F.size(ps) < 2, text).otherwise(F.array_join(F.transform(ps, lambda x, i: F.when(i % 2 == 1, one(x)).otherwise(x)), ""))

    return scan(text, join)


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every entity of `text` replaced by its surrogate under `key`, a secret of the caller's; columns and rows unchanged otherwise."""
    doc_id, text = column_name(docs, doc_id), column_name(docs, text)
    each = scan(F.col(f"`{text}`"), lambda ps, known: F.flatten(F.transform(odd(ps), lambda e: entities(e, known))))
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.explode(each).alias("x")).select("id", "x.kind", "x.canon", "x.country")
    found = materialise(found.distinct(), "pii-mentions")
    moved = materialise(redraw(found.select("kind", "canon", "country").distinct(), key), "pii-moved")
    n = moved.limit(BROADCAST + 1).count()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("~row")
    rows, special = docs.select(row), None
    if n:
        entries = F.map_from_entries(F.collect_list(F.struct(named_by({c: F.col(c) for c in moved.columns}).alias("k"), F.col("sc").alias("v"))))
        if n <= BROADCAST:
            rows = rows.crossJoin(F.broadcast(moved.agg(entries.alias("~moved"))))  # one row
        else:
            per = found.join(moved, ["kind", "canon", "country"]).groupBy(F.col("id").alias("~id")).agg(entries.alias("~moved"))
            rows = rows.join(per, F.col("`~row`")[doc_id].eqNullSafe(F.col("`~id`")), "left")
        special = F.col("`~moved`")
    return rows.select(*[(replaced(F.col("`~row`")[c], key, special) if c == text else F.col("`~row`")[c]).alias(c) for c in docs.columns])
