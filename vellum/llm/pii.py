"""Personal data: detected entities receive keyed surrogates of their own type. DataFrame expressions only.

Entities are e-mail addresses, IPv4 and IPv6 addresses, phone, payment-card, bank-account (IBAN) and social-security numbers, secrets after a
telling word, and names of persons: those after a title or with a listed given name, and later mentions of such a person in the same text by
surname or given name alone. Detecting is one pass over the texts, written to the shared folder; matches and the gaps between them make up
the text, so replacing is joining them anew.

A surrogate is drawn from a keyed digest of the entity's type and normal form, so spellings of one entity (case, separators) get one
surrogate in all documents. It keeps the format: digits for digits, letters of the same script and case, separators, the top-level domain,
the country code, the first digit and the Luhn validity of a card, country and check digits of an account, private addresses private (of the
block 10.0.0.0/8, or loopback), title, particle, gender and script of names. Given names are exchanged by a keyed permutation of the names
of their gender and script; a surname maps alike with and without a given name. A surrogate that is another's or a real value of the corpus
is drawn again; where a format has too few values left for that, the last ones exchange their own values in a keyed cycle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import hot_join, materialize, table
from vellum.llm.names import GIVEN_BY_CLASS, PARTICLES, TITLES

#: The key of the queries; production passes a secret one.
KEY = "vellum"
#: Rounds of drawing surrogates; what has none then takes part in the exchange. More than FEW of which hardly one gets its own exchange at once.
ROUNDS, FEW = 24, 100

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEX = "[0-9A-Fa-f]{1,4}"
WORD = r"(?:[OD]['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
#: Country codes of two digits; those of one digit are 1 and 7, all others have three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def alternation(words: list[str]) -> str:
    """A pattern for any of the words, by their first letters: an alternation of all would try each at each place."""
    heads = sorted({w[0] for w in words})
    return "(?:" + "|".join(f"{h}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == h), key=lambda w: (-len(w), w)))})" for h in heads) + ")"


GIVEN = [n for names in GIVEN_BY_CLASS.values() for n in names]
CAPITAL = [n.upper() for n in GIVEN]
HEADS = "".join(sorted({w[0] for w in [*GIVEN, *TITLES]}))
PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
SURNAME = rf"(?:{PARTICLE} ){{0,2}}{WORD}(?:-{WORD})*"
PATTERNS = {
    "secret": r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Za-z+/_-]*\d)(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,2}[=:]\s{0,2}["']?)[A-Za-z0-9+/_-]{16,}+""",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "ip": rf"(?<![\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?!\p{{N}}|\.\p{{N}})",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|[0-9A-Fa-f]{{3,4}}(?::{HEX}){{0,5}}:(?::{HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?=(?:[A-Z ]*\d){6})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?!\p{N})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<!\d\.)(?<![\p{L}\p{N}])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\p{L}\p{N}])",
    "name": rf"(?=[{HEADS}])(?<![\p{{L}}\p{{N}}])(?:(?:{alternation(TITLES)}\.? )+{SURNAME}(?: (?:\p{{Lu}}\. )?{SURNAME}){{0,2}}|{alternation(GIVEN)} (?:\p{{Lu}}\. ){{0,2}}{SURNAME}"
    rf"|{alternation(CAPITAL)} (?:\p{{Lu}}\. )?\p{{Lu}}{{2,}}(?:['’-]\p{{Lu}}+)*)(?![\p{{L}}\p{{N}}])",
}
ENTITY = "|".join(PATTERNS.values())
#: All but names hold a digit or an at sign, and few texts do: a scan for one character comes first.
TELLING, NUMERIC = "[0-9@]", "|".join(p for k, p in PATTERNS.items() if k != "name")
#: Names have a title or given name before a space and a capital or particle: a scan for these comes first.
NAMED = rf" (?=\p{{Lu}}|{PARTICLE} \p{{Lu}})(?<=(?:{alternation(TITLES)}\.?|{alternation(GIVEN)}|{alternation(CAPITAL)}) )"

ROW, KEYED, FOUND, MAP, MENTIONS = "__vellum_row", "__vellum_key", "__vellum_found", "__vellum_map", "__vellum_mentions"
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SYLLABLES = {
    "latin": [c + v for c in "b d f g k l m n p r s t v".split() for v in "a e i o u".split()],
    "cyrillic": [c + v for c in "б в г д к л м н п р с т".split() for v in "а е и о у".split()],
    "greek": [c + v for c in "β γ δ κ λ μ ν π ρ σ τ".split() for v in "α ε ι ο".split()],
}


def kind_of(surface: Column) -> Column:
    return (
        F.when(surface.contains("@"), "email")
        .when(surface.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(surface.rlike(r"^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ip6")
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(surface.rlike(r"^\+[\d .()-]+$"), "phone+")
        .when(surface.rlike(r"^(?:\(\d{3}\) ?\d{3}[ .-]|\d{3}-\d{3}-)\d{4}$"), "phone")
        .when(surface.rlike(r"^[\d -]{13,}$"), "card")
        .when(surface.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,}$"), "iban")
        .when(surface.rlike(r"^[^\d]+$"), "name")
        .otherwise("secret")
    )


def digits(surface: Column) -> Column:
    return F.regexp_replace(surface, "[^0-9]", "")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def number(digest: Column, at: Column | int) -> Column:
    """The at-th number from 0 to 4095 of a digest in hexadecimal digits."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substr(digest, F.lit(1) + F.pmod(at * 3, F.lit(126)), F.lit(3)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.lit(1) + F.pmod(n, F.lit(len(letters))), F.lit(1))


def shaped(core: Column, digest: Column, latin: str = LATIN) -> Column:
    """core with keyed digits for digits and keyed letters for letters, of the same script and case; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n = number(digest, i)
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC, n)).when(c.rlike(r"\p{IsGreek}"), pick(GREEK, n)).otherwise(pick(latin, n))
        return F.when(c.rlike("[0-9]"), pick("0123456789", n)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(core, ""), one), "")


def luhn(number_text: Column) -> Column:
    """The Luhn sum of a digit string modulo 10."""
    worth = F.transform(F.split(F.reverse(number_text), ""), lambda c, i: F.when(c == "", F.lit(0)).when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(worth, F.lit(0), lambda a, x: a + x), F.lit(10))


def mod97(account: Column) -> Column:
    """An account's digits and letters (A is 10, Z is 35) read as a number, modulo 97."""
    return F.aggregate(F.split(account, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def surrogate_of(kind: Column, core: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form. Later attempts give other ones, of e-mail addresses and surnames longer ones."""
    digest = F.sha2(F.concat_ws("\u001f", F.lit(key), kind, core, attempt.cast("string")), 512)
    extra = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 0, pick(LATIN, number(digest, 60 + i))).otherwise("")), "")
    email = F.concat(extra, shaped(F.regexp_extract(core, r"^(.*)\.[^.]*$", 1), digest), F.lit("."), F.regexp_extract(core, r"([^.]*)$", 1))
    private = F.when(core.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"), "10.").when(core.startswith("127."), "127.").otherwise("")
    octets = F.transform(F.split(core, r"\."), lambda o, i: F.when(i == 0, (F.lit(11) + F.pmod(number(digest, i), F.lit(89))).cast("string")).otherwise(F.pmod(number(digest, i), F.lit(256)).cast("string")))
    ip = F.when(private == "", F.array_join(octets, ".")).otherwise(F.concat(private, F.array_join(F.slice(octets, 2, 3), ".")))
    scope = F.regexp_extract(core, "^(fe80|f[cd][0-9a-f]{2}|ff[0-9a-f]{2}|)", 1)
    ip6 = F.concat(scope, shaped(F.substr(core, F.length(scope) + 1), digest, "abcdef"))
    country = F.regexp_extract(core, rf"^(1|7|{'|'.join(TWO_DIGITS)}|\d{{3}})", 1)
    plus = F.concat(country, shaped(F.substr(core, F.length(country) + 1), digest))
    own = shaped(F.substr(core, F.lit(5)), digest)
    check97 = F.lpad((F.lit(98) - mod97(F.concat(own, F.substring(core, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(core, 1, 2), F.when(mod97(F.concat(F.substr(core, F.lit(5)), F.substring(core, 1, 4))) == 1, check97).otherwise(shaped(F.substring(core, 3, 2), F.reverse(digest))), own)
    body = F.concat(F.substring(core, 1, 1), shaped(F.substr(core, F.lit(2), F.length(core) - 2), digest))
    check = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, F.when(luhn(core) == 0, check).otherwise(F.pmod(check + 1 + F.pmod(number(digest, 41), F.lit(9)), F.lit(10))).cast("string"))
    secret = F.when(F.lower(core).rlike("^[0-9a-f]+$"), shaped(core, digest, "abcdef")).otherwise(shaped(core, digest))

    def surname(script: str, ending: Column) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), lambda i: F.element_at(parts, 1 + F.pmod(number(digest, i), F.lit(len(SYLLABLES[script]))))), ""), ending)

    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "iban", iban).when(kind.isin("phone", "ssn"), shaped(core, digest)).when(kind == "phone+", plus).when(kind == "card", card).when(kind == "secret", secret)
        .when(kind == "surname:cyrillic", surname("cyrillic", F.when(core.rlike("[ая]$"), "ва").otherwise("в")))
        .when(kind == "surname:greek", surname("greek", F.when(core.rlike("ς$"), "ς").otherwise("")))
        .otherwise(surname("latin", pick("nr", number(digest, 40))))
    )


def given_map(key: str) -> Column:
    """Each given name in lower case to another of its gender and script: a keyed cycle, so no two meet and none stays."""
    pairs = {}
    for names in GIVEN_BY_CLASS.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\u001f{n}".encode()).digest())
        pairs |= {a.lower(): b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])


def surrogates(cores: DataFrame, key: str = KEY) -> DataFrame:
    """cores(kind, core) with surrogate: distinct within a kind, and no real core of that kind, unless it was exchanged (see `exchanged`)."""
    real = cores.select("kind", F.col("core").alias("value"), F.lit(True).alias("real"), F.lit(None).cast("struct<later:boolean,core:string>").alias("own"))
    rows, before, left = cores.withColumn("attempt", F.lit(0)).withColumn("kept", F.lit(False)), (), float("inf")
    for _ in range(ROUNDS):
        rows = rows.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("core"), F.col("attempt"), key))
        pool = rows.select("kind", F.col("surrogate").alias("value"), F.lit(False).alias("real"), F.struct((~F.col("kept")).alias("later"), "core").alias("own")).union(real)
        verdict = pool.groupBy("kind", "value").agg(F.max("real").alias("real"), F.min("own").alias("first")).where(F.col("first").isNotNull())
        rows = rows.join(verdict.select(F.col("kind").alias("k"), F.col("value").alias("v"), "real", F.col("first.core").alias("winner")), (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")))
        rows = materialize(rows.select("kind", "core", "attempt", "surrogate", (~F.col("real") & (F.col("core") == F.col("winner"))).alias("kept")), replaces=before)
        before = (rows,)
        left, last = rows.where(~F.col("kept")).count(), left
        if not left:
            return rows.select("kind", "core", "surrogate")
        drawn = rows
        if FEW < left > 0.9 * last:
            break
        rows = rows.select("kind", "core", (F.col("attempt") + F.when(F.col("kept"), 0).otherwise(1)).alias("attempt"), "kept")
    return drawn.where("kept").select("kind", "core", "surrogate").union(exchanged(drawn.where("NOT kept"), key))


def exchanged(rows: DataFrame, key: str) -> DataFrame:
    """rows(kind, core) with each other's cores as surrogates, inside one kind and format in a keyed cycle. Their formats have hardly a value
    left that isn't real; kept surrogates are never real, so these stay distinct."""
    prefix = F.when(F.col("kind") == "iban", F.substring("core", 1, 2)).when(F.col("kind") == "ip", F.regexp_extract("core", r"^(10\.|127\.|192\.168\.|172\.)", 1)).otherwise(F.regexp_extract("core", rf"^(1|7|{'|'.join(TWO_DIGITS)}|\d{{3}}|)", 1))
    shape = F.concat_ws("|", prefix, F.regexp_replace(F.regexp_replace("core", "[0-9]", "0"), r"\p{L}", "a"), F.when(F.col("kind") == "card", (luhn(F.col("core")) == 0).cast("string")))
    alone = F.count(F.lit(1)).over(Window.partitionBy("kind", "shape")) == 1
    order = [F.sha2(F.concat_ws("\u001f", F.lit(key), "kind", "core"), 256), F.col("core")]
    cycle, whole = Window.partitionBy("kind", "shape").orderBy(*order), Window.partitionBy("kind", "shape").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    shaped_rows = rows.withColumn("shape", shape).withColumn("shape", F.when(alone, "").otherwise(F.col("shape")))
    return shaped_rows.select("kind", "core", F.coalesce(F.lead("core").over(cycle), F.first("core").over(whole)).alias("surrogate"))


def cased(like: Column, text: Column) -> Column:
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(text)).otherwise(text)


def surface_map(surfaces: DataFrame, key: str = KEY) -> DataFrame:
    """(surface, replacement) of distinct rows (surface)."""
    kinds = materialize(surfaces.select("surface", kind_of(F.col("surface")).alias("kind")))
    normal = F.when(F.col("kind").isin("email", "ip6"), F.lower("surface")).when(F.col("kind").isin("ip", "secret"), F.col("surface")).when(F.col("kind") == "iban", F.regexp_replace("surface", " ", "")).otherwise(digits(F.col("surface")))
    plain = kinds.where(F.col("kind") != "name").withColumn("core", normal)
    word = F.col("word")
    words = kinds.where(F.col("kind") == "name").select("surface", F.posexplode(F.split("surface", " ")).alias("at", "word"))
    stays = F.regexp_replace(word, r"\.$", "").isin(TITLES) | word.isin(PARTICLES)
    words = words.withColumn("stays", stays).withColumn("initial", word.rlike(r"^\p{Lu}\.$")).withColumn("given", F.element_at(given_map(key), F.lower(word)))
    named = words.withColumn("kind", F.when(~F.col("stays") & ~F.col("initial") & F.col("given").isNull(), F.concat(F.lit("surname:"), script_of(word)))).withColumn("core", F.lower(word))
    cores = plain.select("kind", "core").union(named.where(F.col("kind").isNotNull()).select("kind", "core")).distinct()
    drawn = surrogates(materialize(cores), key)
    joined = plain.join(drawn, ["kind", "core"])
    surface, new = F.col("surface"), F.col("surrogate")

    def laid_over(sign: str) -> Column:
        """The signs of the surrogate in the places of the surface's signs."""
        return F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c.rlike(sign), F.substr(new, F.length(F.regexp_replace(F.substr(surface, F.lit(1), i + 1), f"[^{sign[1:]}", "")), F.lit(1))).otherwise(c)), "")

    exact = F.when(F.col("kind").isin("email", "ip6"), cased(surface, new)).when(F.col("kind").isin("ip", "secret"), new).when(F.col("kind") == "iban", laid_over("[A-Z0-9]")).otherwise(laid_over("[0-9]"))
    exact = joined.select("surface", exact.alias("replacement"))
    initial = shaped(word, F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit("initial"), word), 512))
    part = F.when(F.col("stays"), word).when(F.col("initial"), initial).otherwise(cased(word, F.coalesce("given", F.initcap("surrogate"))))
    parts = named.join(drawn, ["kind", "core"], "left").select("surface", "at", part.alias("part"))
    persons = parts.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p")).select("surface", F.array_join(F.col("p.part"), " ").alias("replacement"))
    return exact.union(persons)


def mentions(text: Column, found: Column) -> Column:
    """The words by which a text may mention its persons again: their given names and surnames, unless the text has them in lower case too."""
    names = F.filter(found, lambda s: s.rlike(r"^[^\d@]+$"))
    words = F.flatten(F.transform(names, lambda s: F.split(F.regexp_replace(s, rf"^(?:{alternation(TITLES)}\.? )+", ""), " ")))
    telling = F.filter(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}'’-]{2,}$") & ~text.contains(F.concat(F.lit(" "), F.lower(w), F.lit(" "))))
    # in falling order a name comes before those it begins with
    return F.reverse(F.array_sort(F.array_distinct(telling)))


def entities(words: Column) -> Column:
    """The pattern for the entities of a text that has these mentions."""
    again = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(words) > 0, again).otherwise(F.lit(ENTITY))


def pseudonymize(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """docs with surrogates in text; where the table has n_chars, it follows the new text. `count`: a column with the number of entities.

    All rows and columns stay. Null texts stay null, and texts without an entity, empty ones included, stay as they are; repeated rows
    change alike; ids aren't used. An empty table stays empty. Names beginning with __vellum_ are reserved. Texts are scanned once; the
    scan's result lies in the shared folder, and an entity that many texts hold is joined to them in parts.
    """
    text = F.col("text")
    hit = F.coalesce((text.rlike(TELLING) & text.rlike(NUMERIC)) | (text.rlike(NAMED) & text.rlike(PATTERNS["name"])), F.lit(False))
    scanned = docs.withColumn(FOUND, F.when(hit, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))))
    scanned = scanned.withColumn(MENTIONS, F.when(F.col(FOUND).isNotNull(), mentions(text, F.col(FOUND)))).withColumn(ROW, F.monotonically_increasing_id())
    scanned = scanned.withColumn(FOUND, F.when(F.size(MENTIONS) > 0, F.regexp_extract_all("text", entities(F.col(MENTIONS)), F.lit(0))).otherwise(F.col(FOUND)))
    scanned = materialize(scanned)
    dirty = scanned.where(F.col(FOUND).isNotNull())
    seen = dirty.select(F.col(ROW).alias("row"), F.explode(F.array_distinct(FOUND)).alias("surface"))
    counted = materialize(seen.groupBy("surface").agg(F.count(F.lit(1)).alias("n")))
    changes = materialize(surface_map(counted.select("surface"), key).join(counted, "surface"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    maps = hot_join(seen, changes, "surface", "n", total).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias(MAP))
    both = dirty.join(maps.withColumnRenamed("row", KEYED), F.col(ROW) == F.col(KEYED))
    gaps = F.split("text", entities(F.col(MENTIONS)), -1)
    new = F.array_join(F.transform(gaps, lambda gap, i: F.when(i < F.size(FOUND), F.concat(gap, F.element_at(F.col(MAP), F.get(FOUND, i)))).otherwise(gap)), "")
    n_chars = [F.length(new).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    kept = [c for c in docs.columns if c != "text" and not (n_chars and c == "n_chars")]
    number_of = [F.size(FOUND).cast("long").alias(count)] if count else []
    changed = both.select(*[F.col(f"`{c}`") for c in kept], new.alias("text"), *n_chars, *number_of)
    same = scanned.where(F.col(FOUND).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns], *([F.lit(0).cast("long").alias(count)] if count else []))
    return same.unionByName(changed.select(*[F.col(f"`{c}`") for c in same.columns]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymize on all documents: a row for each, with the number of entities."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), count="entities")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; null texts, repeated rows and empty tables: see pseudonymize."""
    return pseudonymize(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
