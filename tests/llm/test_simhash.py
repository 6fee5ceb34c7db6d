import random
import re

import xxhash

from rowlens.llm import simhash
from rowlens.llm.components import components


def plain(text, n=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(ids, prints, radius):
    group = list(range(len(ids)))
    for _ in ids:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius:
                    group[i] = group[j] = min(group[i], group[j])
    return {ids[i]: min(ids[j] for j in range(len(ids)) if group[j] == group[i]) for i in range(len(ids))}


def test_fingerprints_and_groups_equal_plain_ones(documents):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randint(0, 80))
        rows.append((3 * i + 2, " ".join(base)))
        rows.append((3 * i + 1, " ".join(base).upper() if i % 2 else " ".join([*base, "end"])))
    found = simhash.near_duplicates(documents(rows)).select("doc_id", simhash.hexadecimal().alias("fp"), "component").collect()
    prints = [plain(t) for _, t in rows]
    assert {r["doc_id"]: int(r["fp"], 16) for r in found} == {i: p for (i, _), p in zip(rows, prints)}
    assert {r["doc_id"]: r["component"] for r in found} == groups([i for i, _ in rows], prints, 3)


def test_all_distances_up_to_the_radius_are_found(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), d)) for p in prints for d in (1, 2, 3, 4)]
    rows = [(i, i.to_bytes(8, "big")) for i in range(0)]
    rows = [(int.from_bytes(p.to_bytes(8, "big"), "big", signed=False) - (1 << 64 if p >> 63 else 0), p.to_bytes(8, "big")) for p in set(prints)]
    links = simhash.links(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, fp binary"))
    roots = {r["vertex"]: r["root"] for r in components(links).collect()}
    ids = [i for i, _ in rows]
    expected = groups(ids, [int.from_bytes(b, "big") for _, b in rows], 3)
    assert {i: roots.get(i, i) for i in ids} == expected


def test_awkward_rows(awkward):
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == 10
    by_key = {}
    for r in found:
        by_key.setdefault(r["doc_id"], set()).add(r["component"])
    # Null, empty and blank texts share fingerprint 0; a null key never names a group.
    assert by_key[2] == by_key[3] == by_key[4] == {2} and by_key[6] == {5} and by_key[1] == {1}
    assert {r["component"] for r in found if r["doc_id"] is None} == {2, None}


def test_one_row_of_each_group_stays(awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 7), (True, 0)]


def test_near_copies_go_and_unrelated_short_texts_stay(documents):
    """A word more than 300 is a near copy; 3,000 texts of six words and an empty one have nothing in common."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [*base, "more"]
    short = [(10 + i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(6))) for i in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))), (4, ""), *short]
    held = documents(rows)
    values = {r["doc_id"]: int.from_bytes(r["fp"], "big") for r in simhash.near_duplicates(held).collect()}
    assert (values[1] ^ values[2]).bit_count() <= simhash.RADIUS
    assert sorted(r["doc_id"] for r in simhash.keep_one(held).collect()) == [1, 3, 4, *(i for i, _ in short)]


def test_wider_fingerprints(documents):
    """Several lanes tell texts apart at a wide radius, where one could not."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    near = [*base[:30], "changed", *base[31:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)))]
    kept = simhash.keep_one(documents(rows), words=5, radius=51, lanes=4)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.keep_one(documents([])).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    roots = {r["vertex"]: r["root"] for r in components(links).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}
