import re

from pyspark.sql import functions as F

from wardline.llm import pii

ROWS = [
    (1, "Mail ann.lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, call +1 (212) 555-0199."), (2, "+12125550199 is +1 212 555 0199; card 4111-1111-1111-1111 or 4111111111111111"),
    (3, "from 10.20.30.40, not 1.2.3.4.5 nor 1234567890123456789"), (4, None), (5, ""), (6, "nothing here"), (7, "Herr Müller traf Frau Müller; Г-жа Иванова, Г-н Иванов, Κυρία Παπαδοπούλου, Mr. SMITH and Mr Smith"),
    (8, "ann.lee@mail.example.com " * 3000), (8, "ann.lee@mail.example.com " * 3000), (None, "call +1 (212) 555-0199"), (9, "x" * 60000 + " bob@b.co"),
]


def test_surrogates_keep_type_format_and_coreference(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in ROWS], "doc_id bigint, text string, kind int").repartition(3)
    got = pii.pseudonymise(docs, key="k").collect()
    assert len(got) == len(ROWS) and {r.kind for r in got} == {3}
    out = {r.doc_id: r for r in got}
    one, two = out[1].text, out[2].text
    mails = re.findall(r"\S+@\S+\w", one)
    assert mails[1] == mails[0].upper().rstrip(",") and "ann.lee" not in one.lower() and mails[0] in out[8].text and out[8].text.count(mails[0]) == 3000
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    digits = re.sub(r"\D", "", phone)
    assert f"+{digits}" in two and digits != "12125550199" and phone in out[None].text
    dashed, plain = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", two)[0], re.search(r"\b\d{16}\b", two)[0]
    assert dashed.replace("-", "") == plain != "4" + "1" * 15
    ip = re.search(r"from (\d+\.\d+\.\d+\.\d+),", out[3].text)[1]
    assert ip != "10.20.30.40" and all(0 < int(x) < 256 for x in ip.split(".")) and "1.2.3.4.5 nor 1234567890123456789" in out[3].text
    names = out[7].text
    herr, frau = re.search(r"Herr (\w+)", names)[1], re.search(r"Frau (\w+)", names)[1]
    assert herr != frau and herr.endswith("ner") and frau.endswith("nel") and "Müller" not in names
    assert re.search(r"Г-жа [А-Яа-я]+нова", names) and re.search(r"Г-н [А-Яа-я]+нов\b", names) and re.search(r"Κυρία [Α-Ωα-ω]+νου", names)
    loud, calm = re.search(r"Mr\. (\w+)", names)[1], re.search(r"Mr (\w+)", names)[1]
    assert loud == calm.upper() and out[4].text is None and out[5].text == "" and out[6].text == "nothing here"
    assert out[7].pii_counts.name == 7 and out[4].pii_counts.email == 0


def test_keys_matter_and_reruns_agree(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id bigint, text string")
    run = lambda k: sorted(r.text for r in pii.pseudonymise(docs, key=k).collect())
    assert run("a") == run("a") != run("b")


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With a draw of few values, entities still end up with different surrogates, none of them real."""
    few = lambda kind, entity, key, attempt: F.concat(F.lit("s"), (F.crc32(entity.cast("binary")) % (5 + 40 * attempt)).cast("string"))
    monkeypatch.setattr(pii, "surrogate_of", few)
    entities = spark.createDataFrame([("email", f"e{i}") for i in range(30)] + [("email", "s3")], "kind string, entity string")
    got = pii.assign_surrogates(entities, "k").collect()
    assert len(got) == 31 == len({r.surrogate for r in got}) and "s3" not in {r.surrogate for r in got}


def test_empty_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.pseudonymise(docs, key="k").collect() == []
    rows = spark.createDataFrame([(7, "a@b.co", 5, 6, 8), (9, "none", 5, 6, 8)], "pii_counts bigint, text string, `row` int, new int, __row int")
    got = pii.pseudonymise(rows, key="k").collect()
    assert {(r.row, r.new, r["__row"]) for r in got} == {(5, 6, 8)} and sorted(r.pii_counts.email for r in got) == [0, 1]


def run(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    return [r.text for r in pii.pseudonymise(docs, key="k").orderBy("doc_id").collect()]


def test_given_and_surnames_and_later_mentions(spark):
    (got,) = run(spark, "Mr John Smith met Mrs Smith. Later Smith, and Dr. Jane Doe; Doe's friend John, SMITH-like. Frau Mc Donald and Mc Donald.")
    pattern = r"Mr (\w+) (\w+) met Mrs (\w+)\. Later (\w+), and Dr\. (\w+) (\w+); (\w+)'s friend (\w+), SMITH-like\. Frau (\w+) and (\w+)\."
    john, smith, mrs, later, jane, doe, again, friend, donald, once = re.fullmatch(pattern, got).groups()
    assert later == mrs != smith and again == doe and friend == john and donald == once
    assert smith.endswith("ner") and mrs.endswith("nel") and john.endswith("lan") and jane.endswith("lia") and doe.endswith("nel")
    assert not re.search("Smith|John|Jane|Doe|Donald", got)


def test_numbers_of_all_kinds(spark):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10

    text = "call 212-555-0199 or (212) 555-0199 or +44 20 7946 0958, +351 21 123 4567; amex 3782 822463 10005, card 4111111111111111; SSN 123-45-6789; host 2001:db8:1:2:3:4:5:6 and fe80::1; IBAN DE89 3704 0044 0532 0130 00 again DE89370400440532013000; 10.1.2.3"
    (got,) = run(spark, text)
    pattern = r"call (\d{3}-\d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\+44 \d\d \d{4} \d{4}), (\+351 \d\d \d{3} \d{4}); amex (\d{4} \d{6} \d{5}), card (\d{16}); SSN (\d{3}-\d\d-\d{4}); host (2001:db8:[0-9a-f:]+) and (2001:db8::[0-9a-f:]+); IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) again (DE\d{20}); (10\.\d+\.\d+\.\d+)"
    found = re.fullmatch(pattern, got).groups()
    assert re.sub(r"\D", "", found[0]) == re.sub(r"\D", "", found[1]) != "2125550199"
    assert luhn(re.sub(" ", "", found[4])) == 0 == luhn(found[5]) and found[5][0] == "4" and found[4][0] == "3"
    iban = found[9].replace(" ", "")
    assert iban == found[10] and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert not set(found) & set(re.split(r"[,;] | or | and | again ", text))
    same = "version 1.2.3.4.5, serial 1234567890123456789, on 2024-01-02 at 12:30:45, A::b, AB12 3456 7890, DE00 3704 0044 0532 0130 00, Monday Morning Sun"
    assert run(spark, same) == [same]


def test_random_documents_against_their_templates(spark):
    """Brute force: texts made of slots; each slot has to change, alike for one entity and differently for two, and nothing else may."""
    import random

    rng = random.Random(9)
    slots = [(k, f"{n}.{i}@mail.org") for i, n in enumerate("abcde") for k in ["email"]] + [("ip", f"8.{i}.4.{i}") for i in range(5)]
    slots += [("phone", f"+1 212 555 01{i:02d}") for i in range(5)] + [("ssn", f"12{i}-45-6789") for i in range(5)] + [("name", f"Mr {s}") for s in ("Abel", "Brown", "Clark", "Diaz", "Evans")]
    lines = []
    for _ in range(60):
        chosen = [rng.choice(slots) for _ in range(rng.randint(0, 12))]
        lines.append([(" ".join(rng.choices(["filler", "text", "—", "ünder", "no. 4:"], k=rng.randint(1, 6))), s) for s in chosen])
    got = run(spark, *["".join(f"{gap} {s[1]} " for gap, s in line) + "end" for line in lines])
    seen = {}
    for line, text in zip(lines, got, strict=True):
        pattern = "".join(f"{re.escape(gap)} (.+?) " for gap, _ in line) + "end"
        for (_, s), new in zip(line, re.fullmatch(pattern, text).groups(), strict=True):
            assert seen.setdefault(s, new) == new != s[1]
    assert len(set(seen.values())) == len(seen)


def test_more_entities_than_surrogates_of_their_length(spark):
    """The draws of 15 telephone numbers that keep all digits but one can't be distinct in ten forms; they grow instead of failing."""
    entities = spark.createDataFrame([("phone", f"{i % 10}{i // 10}") for i in range(15)], "kind string, entity string").distinct()
    got = pii.assign_surrogates(entities, "k").collect()
    assert len({r.surrogate for r in got}) == len(got) == 15


def test_addresses_keep_their_form_and_their_domain(spark):
    (got,) = run(spark, "ann.lee@corp.com, bob_ray7@corp.com, ANN.LEE@CORP.COM, ann.lee@other.org and x@corp.com")
    one, two, same, other, short = re.split(", | and ", got)
    assert re.fullmatch(r"[a-z]+\.[a-z]+@d\w+\.example", one) and re.fullmatch(r"[a-z]+_[a-z]+[0-9]@d\w+\.example", two) and same == one.upper()
    domain = lambda a: a.split("@")[1]
    assert domain(one) == domain(two) == domain(short) != domain(other) and len({one, two, other, short}) == 4
    assert not re.search("ann|lee|corp", got.lower())


def test_many_addresses_stay_distinct(spark):
    texts = [f"{chr(97 + i % 26)}@a.com {chr(97 + i % 26)}.{chr(97 + i // 26)}@a.com {i}@b{i % 7}.org" for i in range(300)]
    got = run(spark, *texts)
    pairs = {a: b for x, y in zip(texts, got) for a, b in zip(x.split(), y.split(), strict=True)}
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


def test_a_column_named_like_the_counts_in_other_case(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de", 5)], "doc_id int, text string, PII_COUNTS int")
    got = pii.pseudonymise(docs, key="k")
    assert got.columns == ["doc_id", "text", "pii_counts"] and got.first().pii_counts.email == 1
