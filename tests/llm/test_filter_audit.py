import itertools
import re

from wardline.llm.queries import op13_filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, A string, same string"


def flags(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((lang or "", i, {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}))
    return out


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows, out = flags(docs), []
    for part in {r[0] for r in rows}:
        here, shapley, found = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = here
            for k, x in enumerate(order):
                gone = [r for r in left if r[2][x]]
                left = [r for r in left if not r[2][x]]
                shapley[x] += len(gone)
                found.append((x, ["".join(order), k + 1, len(left), len(gone), sum(r[2][x] for r in here) - len(gone), sum(r[2][x] and sum(r[2].values()) == 1 for r in here),
                                  sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]))
        out += [(part, *f, shapley[x]) for x, f in found]
    return sorted(out)


def run(spark, folder, docs, labels):
    spark.createDataFrame([(*d, "s", 1, "a", "b") for d in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return sorted(map(tuple, op13_filter_audit(spark, str(folder)).collect()))


def test_all_orders_equal_brute_force(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(220))
    texts = [long, long + " $", "SHOUT " * 210, "a b c", "", None, "x " * 300, "ÀÉ %", long + " X" * 5, "word " * 5000]
    docs = [(i, texts[i % len(texts)], ["en", "fr", None, "", "en"][i % 5]) for i in range(83)]
    docs += [(None, long, "en"), (None, long, "en"), (None, "only without id", "de"), (7, texts[7], "fr"), (7, texts[7], "fr"), (-1, "a b c", "en"), (5, "another text", "en")]
    docs += [(1000 + i, "hot copy", "en") for i in range(100)]
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 83, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None), (99999, 1, 1)]
    assert run(spark, tmp_path, docs, labels) == brute(docs, labels)


def test_no_documents(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []
