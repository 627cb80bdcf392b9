"""Licence passages next to one another, and broken up by foreign words, against every range of words."""

import random
from collections import Counter

import pytest

from docloom.llm import licences
from docloom.llm.licence_texts import TEMPLATES
from tests.llm.conftest import prose

SCAN = licences.Scanner(TEMPLATES).scan
BAGS = [(n, Counter(zip(w, w[1:]))) for n, w in ((n, licences.normalised(t)) for n, t in TEMPLATES)]
SHORT = [t for _, t in TEMPLATES if len(t) < 90]


def by_hand(text, least=0.8):
    words, found = licences.normalised(text), []
    order = sorted(BAGS, key=lambda b: b[1].total())
    for t, (name, bag) in enumerate(order):
        for a in range(len(words)):
            have, common = Counter(), 0
            for b in range(a + 2, min(len(words), a + 1 + int(1.5 * bag.total() + 1e-9)) + 1):
                p = words[b - 2], words[b - 1]
                have[p] += 1
                common += have[p] <= bag[p]
                d = 2 * common / (b - a - 1 + bag.total())
                if d >= least:
                    found.append((-d, a - b, a, t, name))
    out, used = [], set()
    for d, n, a, _, name in sorted(found):
        if not used & set(range(a, a - n)):
            used |= set(range(a, a - n))
            out.append((name, -d, a, a - n))
    return sorted(out, key=lambda m: m[2])


@pytest.mark.parametrize("one", ["Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."])
def test_neighbours(one):
    other = "Licensed under the MIT License."
    for text in (f"{one} {other}", f"{other}\n{one}", f"{other} {one} {other}", f"the MIT x y the License. {one}"):
        assert SCAN(text) == by_hand(text)
        assert [d for _, d, _, _ in SCAN(text)].count(1.0) == sum(text.count(x) for x in {one, other})


@pytest.mark.parametrize("seed", range(20))
def test_several_statements(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(2, 5)):
        words = rng.choice(SHORT).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "other"
        parts += [" ".join(words), rng.choice([" ", "\n", f" {prose(rng.randint(0, 99), rng.randint(1, 6))} "])]
    text = "".join(parts)
    assert SCAN(text) == by_hand(text)


@pytest.mark.parametrize("name, text", [(n, t) for n, t in TEMPLATES if len(t) > 250])
def test_foreign_words_inside(name, text):
    words = text.split()
    broken = " ".join([prose(1, 9), *words[: len(words) // 2], prose(2, 8), *words[len(words) // 2 :], prose(3, 9)])
    assert SCAN(broken) == by_hand(broken) and {m[0] for m in SCAN(broken)} == {name}
