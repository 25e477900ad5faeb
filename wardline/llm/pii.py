"""PII surrogates with DataFrame functions only: keyed, type-consistent replacements.

Mentions of e-mail and IP addresses, card, bank account, social security and telephone numbers and of
people are found in whole texts. A person's name is found by a title or a common given name before it;
the surnames and given names so found are then found in the rest of their text without either. Every
distinct entity of the corpus gets one surrogate from a keyed SHA-256, so all its mentions change alike;
two entities that draw the same surrogate, or one that draws a real entity, are drawn again until all
are distinct. A mention keeps its separators, letter case, title, script and gender, a telephone number
its country code, a card or account number a valid check digit, an e-mail address the form of its local
part; addresses of one domain stay addresses of one domain. Texts without mentions are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import cut, free, named
from wardline.llm.secrets import let

#: Titles by gender, particles of surnames, common given names that are no other words, country codes of two digits.
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Д-р", "Δρ")
PARTICLES = ("Mc", "Mac", "Van", "Von", "De", "Der", "Di", "van", "von", "de", "der", "den", "di", "du", "da")
MEN = "James John Robert Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Hans Karl Peter Klaus Jürgen Wolfgang Pierre Jean Luis Carlos Juan Miguel Иван Пётр Алексей Γιώργος Νίκος".split()
WOMEN = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Jane Anna Maria Ursula Monika Helga Marie Sophie Carmen Lucía Ольга Анна Мария Ελένη Κατερίνα".split()
TWO_DIGIT_CODES = r"2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

#: Java patterns. Each first looks at the character at hand, so that most places of a text are passed over at once.
EMAIL = r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
IPV6 = r"(?=[0-9A-Fa-f]{2,4}:)(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{2,4}(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"
IBAN = r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}){2,3}(?![0-9])"
LOCAL = r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"
WORD = r"\p{Lu}(?:\p{L}|['’](?=\p{Lu})|-(?=\p{L}))+"
PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) )"
SURNAME = rf"{PARTICLE}*{WORD}"
GIVEN = rf"(?:(?!{PARTICLE})(?:\p{{Lu}}\.|{WORD}) )"
TITLE = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.? "
NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{TITLE}{GIVEN}{{0,2}}|(?:{'|'.join(MEN + WOMEN)}) (?:\p{{Lu}}\. )?){SURNAME}"
FIGURES = f"(?=[0-9])(?:{IPV4}|{SSN}|{LOCAL}|{CARD})|{PHONE}|(?=\\()(?:{LOCAL})|{IBAN}"
ANY = f"{EMAIL}|{IPV6}|{FIGURES}|{NAME}"
#: In texts with a name, every capitalised word is looked at: it may be that name again.
ANY_WORD = rf"{ANY}|(?=\p{{L}})(?<!\p{{L}}){SURNAME}"
TYPES = ("email", "ip", "card", "phone", "name", "ssn", "iban")

#: Syllables of surrogate names, and endings of surnames and given names by script and gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа".split(),
    "greek": "βα βε βο γα γε γο δα δε δο ζα ζε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα".split(),
}
ENDINGS = {
    "latin": {"m": ("ner", "lan"), "f": ("nel", "lia"), "u": ("nes", "lin")}, "cyrillic": {"m": ("нов", "лан"), "f": ("нова", "лия"), "u": ("ненко", "лин")},
    "greek": {"m": ("νης", "λος"), "f": ("νου", "λια"), "u": ("νίδη", "λιν")},
}


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mentions_any(text: Column) -> Column:
    """Whether `ANY` is found in a text; each pattern is tried only where the text has a character that it needs."""
    like = lambda p: F.regexp_like(text, F.lit(p))
    return (text.contains("@") & like(EMAIL)) | (like("[0-9]") & like(FIGURES)) | (text.contains(":") & like(IPV6)) | like(NAME)


def luhn(digits: Column, whole: bool) -> Column:
    """Luhn sum modulo 10 of a number, `whole` with its check digit, else as if one followed."""
    start = F.struct(F.lit(int(not whole)).alias("i"), F.lit(0).alias("s"))

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + acc["i"] % 2)
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"))

    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), start, step)["s"] % 10


def mod97(account: Column) -> Column:
    """The number that an account number stands for (its first four characters moved to the end, letters from 10) modulo 97."""
    moved = F.concat(F.substring(account, 5, 99), F.substring(account, 1, 4))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def kind_of(m: Column) -> Column:
    """The type of a match; `word` for a capitalised word, null for a number that fails its check."""
    d = digits_of(m)
    grouped = m.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$")
    return (
        F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{IPV4})$"), "ip").when(m.rlike(rf"^(?:{IPV6})$"), "ip6").when(m.startswith("+"), "phone")
        .when(m.rlike(rf"^(?:{SSN})$"), "ssn").when(m.rlike(rf"^(?:{LOCAL})$"), "phone")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(mod97(F.regexp_replace(m, " ", "")) == 1, "iban"))
        .when(m.rlike("^[0-9]"), F.when(grouped | (luhn(d, True) == 0), "card"))
        .when(m.rlike(rf"^(?:{NAME})$"), "name").otherwise("word")
    )


def gender_of(title: Column, given: Column) -> Column:
    """m or f, by the title or else the given name; null if neither says."""
    bare = F.regexp_extract(title, r"^([^ .]*)", 1)
    first = F.regexp_extract(given, r"^([^ ]*)", 1)
    return F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").when(first.isin(*MEN), "m").when(first.isin(*WOMEN), "f")


def entity_of(m: Column, kind: Column) -> Column:
    """What all mentions of one entity that is no name have in common."""
    return (
        F.when(kind == "domain", F.lower(m)).when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits_of(m))).when(kind.isin("card", "ssn"), digits_of(m))
        .when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    )


def surrogate_of(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The draw of one attempt. Later names and addresses are longer, and from the twelfth attempt on numbers too, so that none runs out."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    digits = F.translate(F.concat(digest, F.sha2(digest, 256)), "abcdef", "024681")
    more = F.floor(attempt / 12).cast("int")
    length = F.length(entity) + more

    octet = lambda i: (byte(i) % 254 + 1).cast("string")
    first = let(byte(0) % 220 + 1, lambda o: F.when(o.isin(10, 127, 172, 192), o + 1).otherwise(o)).cast("string")
    ip = (
        F.when(entity.startswith("10.") | (entity.rlike(r"^192\.168\.") & (more > 0)), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3)))
        .when(entity.rlike(r"^192\.168\."), F.concat_ws(".", F.lit("192.168"), octet(2), octet(3))).otherwise(F.concat_ws(".", first, octet(1), octet(2), octet(3)))
    )
    group = lambda i: F.substring(digest, 4 * i + 1, 4)
    ip6 = F.when(entity.contains("::"), F.concat_ws(":", F.lit("2001:db8:"), *[group(i) for i in range(4)])).otherwise(F.concat_ws(":", F.lit("2001:db8"), *[group(i) for i in range(6)]))
    syllable = lambda s, i: F.get(F.array(*[F.lit(x) for x in SYLLABLES[s]]), F.conv(F.substr(digest, 4 * (i % 15) + 1, F.lit(4)), 16, 10).cast("int") % len(SYLLABLES[s]))
    # The parts of a local part between its marks become words and figures of their own; later draws are longer.
    marks = F.split(F.regexp_extract(entity, "^([^@]*)", 1), r"(?<=[._%+-])|(?=[._%+-])|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
    email = F.array_join(F.transform(marks, lambda part, i: F.when(part.rlike("^[a-z]"), F.when(F.length(part) == 1, F.concat(syllable("latin", i), F.substr(digest, F.lit(40), attempt))).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1) + attempt), lambda k: syllable("latin", 3 * i + k)), "")))
        .when(part.rlike("^[0-9]"), F.substr(digits, 5 * (i % 12) + 1, F.length(part) + attempt)).otherwise(part)), "")
    domain = F.concat(F.lit("d"), F.substr(digest, F.lit(1), F.lit(6) + 2 * attempt), F.lit(".example"))

    code = F.regexp_extract(entity, rf"^(\+(?:[17]|{TWO_DIGIT_CODES}|[0-9]{{3}}))", 1)
    kept = F.when(entity.startswith("+"), code).otherwise(F.left(entity, F.lit(1)))
    phone = F.concat(kept, F.substr(digits, F.lit(1), length - F.length(kept)))
    body = F.concat(F.left(entity, F.lit(1)), F.substr(digits, F.lit(1), length - 2))
    card = F.concat(body, ((10 - luhn(body, False)) % 10).cast("string"))
    number = lambda i, n: (F.conv(F.substring(digest, i, 7), 16, 10).cast("int") % n + 1).cast("string")
    ssn = F.concat(F.lpad(number(1, 665), 3, "0"), F.lpad(number(8, 99), 2, "0"), F.lpad(number(15, 9999), 4, "0"), F.substr(digits, F.lit(30), more))
    letters = F.translate(digest, "0123456789abcdef", "ABCDEFGHJKLMNPRS")
    account = F.array_join(F.transform(F.filter(F.split(F.substring(entity, 5, 99), ""), lambda c: c != ""), lambda c, i: F.substr(F.when(c.rlike("[0-9]"), digits).otherwise(letters), i + 1, F.lit(1))), "")
    account = F.concat(account, F.substr(digits, F.lit(50), more))
    country = F.left(entity, F.lit(2))
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

    plain = F.substring(entity, 3, 1 << 20)
    script = F.when(plain.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(plain.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def name(s: str, which: int) -> Column:
        parts = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 - which) + attempt), lambda i: F.get(parts, F.conv(F.substr(digest, 4 * (i % 15) + 1, F.lit(4)), 16, 10).cast("int") % len(SYLLABLES[s]))), "")
        ends = ENDINGS[s]
        return F.initcap(F.concat(stem, F.when(entity.startswith("f:"), ends["f"][which]).when(entity.startswith("m:"), ends["m"][which]).otherwise(ends["u"][which])))

    names = lambda w: F.when(script == "cyrillic", name("cyrillic", w)).when(script == "greek", name("greek", w)).otherwise(name("latin", w))
    drawn = {"email": email, "domain": domain, "ip": ip, "ip6": ip6, "phone": phone, "card": card, "ssn": ssn, "iban": iban, "given": names(1)}
    return reduce(lambda c, k: F.when(kind == k, drawn[k]).otherwise(c), drawn, names(0))


def real_form(kind: Column, entity: Column) -> Column:
    """The entity as a surrogate would be written, for comparing."""
    return F.when(kind.isin("name", "given"), F.initcap(F.substring(entity, 3, 1 << 20))).otherwise(entity)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity); within a kind no two share one and none is real.

    Each round draws for all that are open; a draw stands if it is nobody's, and of several that draw
    the same the least entity keeps it. Names of either gender count as one kind of written form.
    Draws grow longer, so the rounds end.
    """
    real = entities.select("kind", real_form(F.col("kind"), F.col("entity")).alias("surrogate")).distinct()
    done, open_, attempt = None, cut(entities.select("kind", "entity")), 0
    while True:
        drawn = open_.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("entity"), key, F.lit(attempt)))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done, ["kind", "surrogate"], "left_anti")
        first = first.select("kind", "entity", "surrogate")
        done = cut(first if done is None else done.unionByName(first))
        open_ = cut(open_.join(done, ["kind", "entity"], "left_anti"))
        if open_.isEmpty():
            return done
        attempt += 1


def rendered(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: separators and letter case stay; what a longer surrogate has more comes last."""
    marks = F.filter(F.split(mention, ""), lambda c: c != "")

    def filled(pattern: str, source: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
        put = lambda acc, c: let(c.rlike(pattern), lambda mark: F.struct(
            (acc["n"] + F.when(mark, 1).otherwise(0)).alias("n"), F.concat(acc["out"], F.when(mark, F.substr(source, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        ))
        return let(F.aggregate(marks, start, put), lambda f: F.concat(f["out"], F.substr(source, f["n"] + 1, F.length(source))))

    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention) & (F.length(mention) > 1), F.upper(surrogate)).otherwise(surrogate)
    phone, number = filled("[0-9]", F.regexp_replace(surrogate, r"^\+", "")), filled("[A-Za-z0-9]", surrogate)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn", "iban"), number).when(kind == "ip", surrogate).otherwise(cased)


def mentions_of(flagged: DataFrame, row: str, text: Column) -> DataFrame:
    """(row, at, sub, prefix, piece, kind, entity): the parts of every match; a match that is none of PII has a null kind.

    A name is two parts, given and surname, with its title as prefix. A capitalised word, or a name whose
    title and given name tell no gender, is the person of that surname (or given name) that was last named
    with a gender before it in the text, or first after it; a word that no name has is nobody.
    """
    named = F.regexp_like(text, F.lit(NAME))
    hits = F.when(named, F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    m = F.col("m")
    found = flagged.select(row, F.posexplode(hits).alias("at", "m")).withColumn("kind", kind_of(m))
    title = F.regexp_extract(m, rf"^({TITLE})", 1)
    rest = F.substr(m, F.length(title) + 1, F.length(m))
    given = F.regexp_extract(rest, rf"^({GIVEN}{{0,2}}){SURNAME}$", 1)
    piece = lambda prefix, text, kind, gender, titled: F.struct(prefix.alias("prefix"), text.alias("piece"), kind.alias("kind"), gender.alias("gender"), titled.alias("titled"))
    of_name = let(F.struct(title.alias("t"), given.alias("g"), F.substr(rest, F.length(given) + 1, F.length(rest)).alias("s")), lambda p: let(gender_of(p["t"], p["g"]), lambda sex: F.when(
        p["g"] == "", F.array(piece(p["t"], p["s"], F.lit("name"), sex, F.lit(True)))
    ).otherwise(F.array(piece(p["t"], F.rtrim(p["g"]), F.lit("given"), sex, F.lit(True)), piece(F.lit(" "), p["s"], F.lit("name"), sex, F.lit(True))))))
    none = F.lit(None).cast("string")
    no = F.lit(False)
    of_email = F.array(piece(F.lit(""), m, F.lit("email"), none, no), piece(F.lit("@"), F.regexp_extract(m, "@(.*)$", 1), F.lit("domain"), none, no))
    parts = F.when(F.col("kind") == "name", of_name).when(F.col("kind") == "email", of_email).when(F.col("kind") == "word", F.array(piece(F.lit(""), m, F.lit("word"), none, F.lit(False)))).otherwise(F.array(piece(F.lit(""), m, F.col("kind"), none, F.lit(False))))
    split = found.select(row, "at", F.posexplode(parts).alias("sub", "p")).select(row, "at", "sub", "p.*")
    people = split.where("kind in ('name', 'given', 'word')").withColumn("low", F.lower("piece"))
    group = Window.partitionBy(row, "low").orderBy("at", "sub")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    after = group.rowsBetween(1, Window.unboundedFollowing)
    named_kind = F.when(F.col("kind") != "word", F.col("kind"))
    near = lambda c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after))
    known = people.withColumn("as", F.coalesce(named_kind, near(named_kind))).withColumn("sex", F.coalesce("gender", near(F.col("gender")), F.lit("u")))
    known = known.select(row, "at", "sub", "prefix", "piece", F.col("as").alias("kind"), F.concat("sex", F.lit(":"), "low").alias("entity"))
    others = split.where("kind is null or kind not in ('name', 'given', 'word')")
    return others.select(row, "at", "sub", "prefix", "piece", "kind", entity_of(F.col("piece"), F.col("kind")).alias("entity")).unionByName(known)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts_col: str = "pii_counts") -> DataFrame:
    """`docs` with surrogates in its text column, and `counts_col`: struct of mentions by type.

    Rows with possible mentions are checkpointed, so that all mentions find their row again. A null text
    stays null with counts of zero; an empty one stays empty. Repeated rows change alike. An empty table
    gives an empty result. A column of `docs` named like `counts_col` gives way to it; other columns stay,
    whatever their names. Entities with over a thousandth of all mentions (a thousand at most) are
    broadcast, so none makes a hot key.
    """
    keep = named(docs, None, (counts_col,))
    row, new, count = free(docs.columns, "row", "new", "count")
    text = docs[text_col].cast("string")
    some = F.coalesce(mentions_any(text), F.lit(False))
    flagged = cut(docs.select(*keep).where(some).withColumn(row, F.monotonically_increasing_id()))
    mentions = cut(mentions_of(flagged, row, F.col(text_col).cast("string")).withColumnRenamed(row, "row"))
    real = mentions.where("kind is not null")
    entities = cut(real.groupBy("kind", "entity").agg(F.count("*").alias("n")))
    total = entities.agg(F.sum("n")).first()[0] or 0
    surrogates = cut(assign_surrogates(entities.select("kind", "entity"), key).join(entities, ["kind", "entity"]))
    is_hot = F.col("n") > max(1000, total // 1000)
    hot = surrogates.where(is_hot).drop("n")
    common = real.join(F.broadcast(hot.select("kind", "entity")), ["kind", "entity"], "left_anti")
    drawn = common.join(surrogates.where(~is_hot).drop("n"), ["kind", "entity"]).unionByName(real.join(F.broadcast(hot), ["kind", "entity"]))
    drawn = drawn.select("row", "at", "sub", "kind", F.concat("prefix", rendered(F.col("piece"), F.col("kind"), F.col("surrogate"))).alias("new"))
    same = mentions.where("kind is null").select("row", "at", "sub", "kind", F.concat("prefix", "piece").alias("new"))
    type_of = F.when(F.col("kind") == "ip6", "ip").otherwise(F.col("kind"))
    counts = F.struct(*[F.count_if((type_of == k) if k != "name" else F.col("kind").isin("name", "given") & (F.col("sub") == 0)).alias(k) for k in TYPES])
    lines = drawn.unionByName(same).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "sub", "new"))).alias("parts"), counts.alias(count))
    # parts of one match are next to one another: a match's second part goes to its first
    joined = F.transform(F.filter("parts", lambda p: p["sub"] == 0), lambda p: p["new"])
    second = F.map_from_entries(F.transform(F.filter("parts", lambda p: p["sub"] == 1), lambda p: F.struct(p["at"], p["new"])))
    lines = lines.select(F.col("row").alias(row), F.when(F.exists("parts", lambda p: p["sub"] == 1), let(second, lambda s: F.transform(joined, lambda x, i: F.concat(x, F.coalesce(F.try_element_at(s, i), F.lit("")))))).otherwise(joined).alias(new), count)
    own = F.col(text_col).cast("string")
    gaps = F.when(F.regexp_like(own, F.lit(NAME)), F.split(own, ANY_WORD, -1)).otherwise(F.split(own, ANY, -1))
    whole = F.array_join(F.zip_with(gaps, F.col(new), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    none = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in TYPES])
    changed = flagged.join(lines, row).select(*[F.col(c) for c in keep if c != text_col], whole.alias(text_col), F.col(count).alias(counts_col))
    untouched = docs.where(~some).select(*[docs[c] for c in keep if c != text_col], text.alias(text_col), none.alias(counts_col))
    return changed.unionByName(untouched).select(*keep, counts_col)
