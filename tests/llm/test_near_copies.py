import random

from tablechange.llm.near_copies import near_copy_classes
from tests.llm.test_simhash import classes


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    group, least = classes(links, range(len(rows))), {}
    for k, (i, _) in enumerate(rows):
        least[group[k]] = min(least.get(group[k], i), i)
    return sorted((i, least[group[k]]) for k, (i, _) in enumerate(rows))


def test_classes_against_brute_force(make):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 60, 120, 400]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 35)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, "one common line of words here " + " ".join(f"a{i}" for i in range(50))), (501, "One common line of words here " + " ".join(f"b{i}" for i in range(50)))]
    rows += [(502, None), (503, "  "), (504, "Two words"), (505, "two  words"), (506, "other words")]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_copy_classes(make(rows)).collect())
    assert got == brute(rows)
    assert near_copy_classes(make([])).count() == 0
