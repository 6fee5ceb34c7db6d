import random
import re

from rowlens.llm import winnow


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for _, text in docs:
        w, hit, held = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    held |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(held)))
    return sorted(out)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_a_plain_search(spark, documents):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([1, 3, 5, 9, 10, 11, 14, 30, 0, 2, 10])]
    items += [(50, items[5][1]), (51, None), (52, "...")]
    docs = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"x {t} y") for i, t in items if t] + [(300, " ".join(items[7][1].split()[3:14])), (301, None), (302, "")]
    found = winnow.contamination(documents(docs), items_of(spark, items)).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in found) == plain(docs, items)


def test_awkward_rows(spark, awkward):
    items = items_of(spark, [(1, "Gamma-DELTA"), (None, "café Ünïcode")])
    found = [(r["doc_id"], r["n_hit"], r["items"]) for r in winnow.contamination(awkward, items).collect()]
    assert len(found) == 10 and found.count((1, 2, ["1"])) == 2 and (7, 2, [""]) in found
    kept = winnow.keep_clean(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == 7


def test_empty_tables(spark, documents):
    assert winnow.contamination(documents([]), items_of(spark, [(1, "a b")])).count() == 0
    assert winnow.contamination(documents([(1, "a b")]), items_of(spark, [])).first()["n_hit"] == 0
