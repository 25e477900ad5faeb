"""Secret scans with DataFrame functions only: known forms, and random strings by character Markov models.

Two first-order character models, of random strings and of ordinary identifiers, are counted from
labelled samples; a candidate token is a secret where its mean log-likelihood ratio per transition is
over a threshold. Positions come from splitting a text at its matches and adding up lengths, so they
count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import free, named

#: The kinds in the order in which ties are listed, with Java patterns and the shortest match kept.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the same matches as one character or more, less the short ones
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

FIRST, SYMBOLS = 43, 80  # '+' to 'z'
GROUP = 64  # values of a group, and groups of a block, in running totals
BLOCK = 1024  # code points of a piece of text when it is rebuilt


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(i: Column) -> Column:
    return F.floor(i / GROUP).cast("int")


def _totals(values: Column, start: Column, join) -> Column:
    """`join` of each GROUP values."""
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), _part(F.greatest(F.size(v), F.lit(1)) - 1)), lambda k: F.aggregate(F.slice(v, k * GROUP + 1, F.lit(GROUP)), start, join)))


def _before(values: Column, bases: Column, join) -> Column:
    """For every value, `join` of its group's base and the values before it in the group."""
    return let(F.struct(values.alias("v"), bases.alias("b")), lambda x: F.transform(x["v"], lambda _, i: F.aggregate(F.slice(x["v"], _part(i) * GROUP + 1, i % GROUP), F.get(x["b"], _part(i)), join)))


def _blocks(g: Column, start: Column, join) -> Column:
    return F.aggregate(_totals(g, start, join), F.array(start), lambda a, v: F.array_append(a, join(F.element_at(a, -1), v)))


def running(rows: DataFrame, asked: dict[str, tuple[Column, Column, object]]) -> DataFrame:
    """`rows` with a column for each name asked: for every value of an array, `join` of `start` and all values before it.

    `asked` is name: (values, start, join). Values are joined in groups and groups in blocks, so that a value
    costs at most twice GROUP steps. Each step is a projection of its own, which keeps expressions small; what
    a lambda reads again and again is bound by `let`, as a column may be put back in place of its name.
    """
    names = {n: free([*rows.columns, *asked], f"{n}_v", f"{n}_g", f"{n}_b", f"{n}_p") for n in asked}
    out = rows.select("*", *[v.alias(names[n][0]) for n, (v, _, _) in asked.items()])
    out = out.select("*", *[_totals(F.col(names[n][0]), s, j).alias(names[n][1]) for n, (_, s, j) in asked.items()])
    out = out.select("*", *[_blocks(F.col(names[n][1]), s, j).alias(names[n][2]) for n, (_, s, j) in asked.items()])
    out = out.select("*", *[_before(F.col(names[n][1]), F.col(names[n][2]), j).alias(names[n][3]) for n, (_, _, j) in asked.items()])
    return out.select(*rows.columns, *[_before(F.col(names[n][0]), F.col(names[n][3]), j).alias(n) for n, (_, _, j) in asked.items()])


def _add(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _spans(rows: DataFrame, text: str, patterns: dict[str, tuple[str, object]], values: str) -> DataFrame:
    """`rows` with a column array<struct<start,kind,end>> for each of `patterns`: name: (pattern, good(match, second group of the first pattern)).

    Kinds are numbered in order. `values` is a name for the second groups of the first pattern.
    """
    taken = [*rows.columns, *patterns, values]
    tmp = {n: free(taken, f"{n}_h", f"{n}_n", f"{n}_w", f"{n}_s", f"{n}_l") for n in patterns}
    taken += [t for ts in tmp.values() for t in ts]
    t, ints, strings = F.col(text), "array<int>", "array<string>"
    one = next(iter(patterns.values()))[0]
    there = {n: F.regexp_like(t, F.lit(p)) for n, (p, _) in patterns.items()}
    out = rows.select(
        "*", *[F.when(there[n], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast(strings)).alias(tmp[n][0]) for n, (p, _) in patterns.items()],
    )
    hits = lambda n: F.col(tmp[n][0])
    gaps = lambda n, p: F.when(F.size(hits(n)) > 0, F.transform(F.slice(F.split(t, p, -1), F.lit(1), F.size(hits(n))), lambda g: F.length(g))).otherwise(F.array().cast(ints))
    out = out.select(
        "*", *[gaps(n, p).alias(tmp[n][1]) for n, (p, _) in patterns.items()], *[F.transform(hits(n), lambda h: F.length(h)).alias(tmp[n][4]) for n in patterns],
        F.when(F.size(hits(next(iter(patterns)))) > 0, F.regexp_extract_all(t, F.lit(one), F.lit(2))).otherwise(F.array().cast(strings)).alias(values),
    )
    out = running(out, {tmp[n][3]: (F.zip_with(tmp[n][1], tmp[n][4], _add), F.lit(0), _add) for n in patterns})

    def found(n: str, kind: int, good) -> Column:
        bound = F.struct(F.zip_with(tmp[n][3], tmp[n][1], _add).alias("s"), F.col(tmp[n][4]).alias("l"), hits(n).alias("h"), F.col(values).alias("v"))
        return let(bound, lambda x: F.filter(F.transform(x["s"], lambda s, i: F.when(
            good(F.get(x["h"], i), F.get(x["v"], i)), F.struct(s.cast("int").alias("start"), F.lit(kind).alias("kind"), (s + F.get(x["l"], i)).cast("int").alias("end"))
        )), lambda y: y.isNotNull()))

    columns = [found(n, kind, good).alias(n) for kind, (n, (_, good)) in enumerate(patterns.items())]
    return out.select(*rows.columns, *columns)


def _transitions(samples: DataFrame) -> DataFrame:
    """(label, a, b, n) counts of neighbouring characters of samples (value, label)."""
    chars = samples.select("label", F.filter(F.split("value", ""), lambda c: (F.ascii(c) >= FIRST) & (F.ascii(c) < FIRST + SYMBOLS)).alias("c"))
    pairs = F.zip_with("c", F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))
    return chars.select("label", F.explode(pairs).alias("p")).where("p.b is not null").groupBy("label", "p.a", "p.b").count()


def random_strings(spark: SparkSession, n: int = 1200, start: int = 0) -> DataFrame:
    """Labelled random strings in the usual alphabets, made from SHA-512 digests of counters from `start` on."""
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 512)
    form = F.col("id") % 6
    value = (
        F.when(form == 0, F.substring(digest, 1, 40))
        .when(form == 1, F.substring(F.base64(F.unhex(digest)), 1, 44))
        .when(form == 3, F.substring(F.lower(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")), 1, 36))
        .when(form == 4, F.substring(F.regexp_replace(F.regexp_replace(F.base64(F.unhex(digest)), "[+]", "-"), "/", "_"), 1, 40))
        .when(form == 2, F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")), 1, 40))
        .otherwise(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 40))
    )
    return spark.range(start, start + n).select(value.alias("value"), F.lit(1).alias("label"))


def ordinary_words(docs: DataFrame, text_col: str, id_col: str, bound: int = 400) -> DataFrame:
    """Labelled identifiers: words of at least 4 characters of at most `bound` whole documents chosen by a hash, without known secrets."""
    million = 1_000_000
    part = min(million, -(-4 * bound * million // max(1, docs.count())))  # a few times as many as asked for, so that little is sorted
    rows = docs.select(docs[text_col].cast("string").alias("t"), F.xxhash64(docs[id_col].cast("string")).alias("h")).where("t is not null")
    some = rows.where(F.pmod("h", F.lit(million)) < part).orderBy("h", "t").limit(bound)
    bare = F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    return some.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))).alias("value"), F.lit(0).alias("label"))


def identifiers(words: DataFrame) -> DataFrame:
    """Labelled ordinary tokens of other forms, made of the words (value, label) of a bounded sample: camelCase, PascalCase,
    snake_case, UPPER_CASE, kebab-case, paths and numbered names; and time stamps, numbers, alphabets and runs of one character."""
    bare = words.select(F.regexp_extract_all("value", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 0).select(F.lower(F.get("w", F.lit(0))).alias("a"))
    # Each word is its own neighbour in another form, so no order of rows counts.
    a, b = F.col("a"), F.reverse("a")
    up, number = F.initcap("a"), F.pmod(F.xxhash64("a"), F.lit(1000)).cast("string")
    forms = F.array(
        F.concat(a, up, up), F.concat(up, up, up), F.concat_ws("_", a, a, a), F.concat_ws("_", F.upper(a), F.upper(a)), F.concat_ws("-", a, a, a), F.concat(F.lit("/"), a, F.lit("/"), a, F.lit("/"), a), F.concat(a, F.lit("_"), number), F.concat(a, up, number),
        F.concat(a, F.lit("="), a), F.concat(F.lit("/"), up, F.lit("/"), a, F.lit("-"), number))
    made = bare.select(F.explode(forms).alias("value"))
    spark = words.sparkSession
    when = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1_700_000_000)))
    fixed = spark.range(400).select(F.explode(F.array(
        F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss-SSSSSS"), F.date_format(when, "yyyyMMddHHmmssSSS"), F.date_format(when, "yyyy/MM/dd/HH/mm/ss"), F.concat(F.date_format(when, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.col("id").cast("string")),
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("01234567890123456789"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), F.repeat(F.lit("-"), F.lit(30)), F.repeat(F.lit("="), F.lit(30)), F.repeat(F.lit("_"), F.lit(30)), F.repeat(F.lit("/"), F.lit(20)),
    )).alias("value"))
    return made.unionByName(fixed).withColumn("label", F.lit(0))


def _class(code: int) -> int:
    """Digits, capitals and small letters are a class each, and every other character is one."""
    c = chr(code)
    return 0 if c.isdigit() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else code


def fit(samples: DataFrame, strength: float = 4.0, backoff: float = 0.3) -> list[int]:
    """Log-likelihood ratios of every transition in thousandths, row by row, from samples (value, label 1 random, 0 ordinary).

    A transition's probability leans on its second character's by `strength` counts, so a context
    never seen counts like that character anywhere, and by `backoff` on that of the characters' classes: letters of a
    language that the samples don't have are still letters after letters. At most 2 * 80 * 80 counts come to the driver.
    """
    from math import log

    counts = [[0] * (SYMBOLS * SYMBOLS) for _ in range(2)]
    for r in _transitions(samples).collect():
        counts[r.label][(r.a - FIRST) * SYMBOLS + r.b - FIRST] += r["count"]
    kinds = [_class(FIRST + k) for k in range(SYMBOLS)]
    sizes = {k: kinds.count(k) for k in kinds}

    def chances(c: list[int]) -> list[float]:
        rows = [sum(c[k * SYMBOLS : (k + 1) * SYMBOLS]) for k in range(SYMBOLS)]
        single = [(sum(c[k::SYMBOLS]) + 0.5) / (sum(c) + 0.5 * SYMBOLS) for k in range(SYMBOLS)]
        pairs, left = {}, {}
        for i, n in enumerate(c):
            pair = (kinds[i // SYMBOLS], kinds[i % SYMBOLS])
            pairs[pair] = pairs.get(pair, 0) + n
            left[pair[0]] = left.get(pair[0], 0) + n
        coarse = lambda p, q: (pairs[p, q] + 0.5) / (left[p] + 0.5 * len(sizes)) / sizes[q]
        return [(1 - backoff) * (n + strength * single[i % SYMBOLS]) / (rows[i // SYMBOLS] + strength) + backoff * coarse(kinds[i // SYMBOLS], kinds[i % SYMBOLS]) for i, n in enumerate(c)]

    ordinary, random = chances(counts[0]), chances(counts[1])
    return [round(1000 * (log(r) - log(o))) for r, o in zip(random, ordinary, strict=True)]


def calibrated(model: list[int], held: DataFrame, threshold: int = 1500) -> list[int]:
    """The model moved so that `threshold` divides the held-out tokens (value, label) best: the mean ratio per transition
    at which as few as can be of either label, each by its share, are on the wrong side, in steps of 25 thousandths; the middle of equal ones."""
    mean = ratio(F.col("value"), model) / (F.length("value") - 1)
    cells = held.where(F.length("value") >= 20).select("label", F.ceil(mean / 25).alias("cell")).groupBy("label", "cell").count().collect()
    steps = list(range(-2000, 4001, 25))
    total = {y: sum(r["count"] for r in cells if r.label == y) for y in (0, 1)}
    if not all(total.values()):
        return model
    over = lambda y, s: sum(r["count"] for r in cells if r.label == y and 25 * (r.cell - 1) >= s) / total[y]
    wrong = [over(0, s) + 1 - over(1, s) for s in steps]
    best = [s for s, w in zip(steps, wrong, strict=True) if w <= min(wrong) + 1e-12]
    return [v + threshold - best[len(best) // 2] for v in model]


def ratio(token: Column, model: list[int]) -> Column:
    """Sum of the log-likelihood ratios of a token's transitions, in thousandths."""
    table = F.expr(f"array({','.join(map(str, model))})")  # one call; thousands of literals would cost seconds
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("bigint").alias("sum"))
    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c) - FIRST
        known = (acc["last"] >= 0) & (code >= 0) & (code < SYMBOLS)  # `last` is -1 at the start and after other characters
        gain = F.when(known, F.get(table, acc["last"] * SYMBOLS + code)).otherwise(0)
        last = F.when((code >= 0) & (code < SYMBOLS), code).otherwise(-1)
        return F.struct(last.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step)["sum"]


FAR = 1 << 30


def find_secrets(docs: DataFrame, model: list[int], text_col: str = "text", threshold: int = 1500, spans_col: str = "secret_spans") -> DataFrame:
    """`docs` with `spans_col`: array<struct<start,kind,end>> in code points, end exclusive, by start and kind.

    `kind` indexes KINDS. Known forms are leftmost and non-overlapping within a kind; a candidate
    token adds a `markov` span if its mean ratio is over `threshold` thousandths and it overlaps no
    known form: spans of both are sorted by start and swept from either side. A null text has no spans,
    as an empty one; texts are searched whole, in steps in proportion to their matches. Repeated rows get
    equal spans; an empty table gives an empty result. A column of `docs` named like `spans_col` gives way to it.
    """
    kept = named(docs, None, (spans_col,))
    text, assign, access, hexa, token, values, base, spans, last, after, swept = free(kept, "text_of", "assign", "access", "hexa", "token", "values_of", "base", "spans", "last", "after", "swept")
    rows = docs.select(*[docs[c] for c in kept], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(text))
    rows = _spans(rows, text, {
        assign: (ASSIGN, lambda _, v: F.length(v) >= 6), access: (ACCESS, lambda h, _: F.length(h) >= 20), hexa: (HEX, lambda h, _: F.length(h) >= 24),
        token: (CANDIDATE, lambda h, _: ratio(h, model) > threshold * (F.length(h) - 1)),
    }, values)
    rows = rows.select(*kept, token, F.concat(assign, access, hexa).alias(base))
    both = (F.size(token) > 0) & (F.size(base) > 0)
    tag = lambda c, new: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,new:int,kind:int,end:int>>")
    rows = rows.select("*", F.when(both, F.array_sort(F.concat(tag(base, 0), tag(token, 1)))).otherwise(none).alias(spans))
    ends = F.transform(spans, lambda s: F.when(s["new"] == 0, s["end"]).otherwise(0))
    starts = F.reverse(F.transform(spans, lambda s: F.when(s["new"] == 0, s["start"]).otherwise(FAR)))
    rows = running(rows, {last: (ends, F.lit(0), _most), after: (starts, F.lit(FAR), _least)})
    rows = rows.select("*", F.reverse(after).alias(swept))
    clear = let(F.struct(F.col(spans).alias("s"), F.col(last).alias("l"), F.col(swept).alias("n")), lambda x: F.filter(F.transform(x["s"], lambda s, i: F.when(
        (s["new"] == 1) & (F.get(x["l"], i) <= s["start"]) & (F.get(x["n"], i) >= s["end"]), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )), lambda s: s.isNotNull()))
    return rows.select(*kept, F.array_sort(F.concat(base, F.when(both, clear).otherwise(F.col(token)))).alias(spans_col))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start), or what spans before it leave of it, replaced by `mark`.

    The text is cut into blocks once, and what stays is put together from them, so no part is looked for from the start.
    """
    def between(blocks: Column, a: Column, z: Column) -> Column:
        parts = F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((z - 1) / BLOCK).cast("int")), lambda k: (
            let(F.greatest(a - k * BLOCK, F.lit(0)), lambda low: F.substr(F.get(blocks, k), low + 1, F.least(z - k * BLOCK, F.lit(BLOCK)) - low))
        ))
        return F.when(z > a, F.array_join(parts, "")).otherwise("")

    start, join = F.lit(0), _most

    def rebuilt(given: Column) -> Column:
        ss, ends = given["spans"], F.transform(given["spans"], lambda s: s["end"])
        last = let(_totals(ends, start, join), lambda g: let(_before(g, _blocks(g, start, join), join), lambda base: _before(ends, base, join)))
        return let(last, lambda e: F.concat(
            F.array_join(F.transform(ss, lambda s, i: F.when(s["end"] > F.get(e, i), F.concat(between(given["blocks"], F.get(e, i), s["start"]), F.lit(mark))).otherwise("")), ""),
            between(given["blocks"], F.greatest(F.element_at(e, -1), F.element_at(ss, -1)["end"]), given["n"]),
        ))

    whole = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, let(whole, rebuilt)).otherwise(text)
