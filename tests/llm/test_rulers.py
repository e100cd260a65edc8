"""Decontamination of texts that repeat one character or a few: bounded in time and memory, and nothing is lost."""

import random
import resource
import time

import pytest

from talus.llm import decontam
from tests.llm.test_results import best_place

RULERS = {"dashes": "-" * 200, "words round dashes": "the title of it " + "-" * 200 + " and what follows", "dots": "- " * 100, "equals": "=-" * 90 + "end of the table", "phrase": "lorem ipsum " * 20}


@pytest.mark.parametrize("name", sorted(RULERS))
def test_a_megabyte_of_one_ruler(name):
    items = decontam.Items([(1, decontam.normalised(RULERS[name])), (2, "a passage without any rule at all")], 12, 0.08)
    text = decontam.normalised({"dots": "- ", "equals": "=-", "phrase": "lorem ipsum "}.get(name, "-") * 1_000_000)[:1_000_000]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    found = items.find(text)
    assert time.perf_counter() - began < 40  # 10 s on an idle machine
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    if name in ("dashes", "dots", "phrase"):
        assert len(found) > 1000 and all(edits == 0 for *_, edits in found)
    elif name == "words round dashes":
        assert found == []


@pytest.mark.parametrize("seed", range(6))
def test_items_with_rulers_in_long_texts_like_brute_force(seed):
    """Texts of up to 9000 characters in which rulers, and edited copies of items, stand between words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rule = lambda: rng.choice(["-", "=-", "- ", "*"]) * rng.randint(20, 90)
    items = [" ".join([*(word() for _ in range(8)), rule(), *(word() for _ in range(rng.randint(0, 9)))]) for _ in range(3)] + [rule() + "x"]
    items = [decontam.normalised(i) for i in items]
    parts = []
    for _ in range(40):
        parts.append(rng.choice([word(), rule(), " ".join(word() for _ in range(20))]))
        if rng.random() < 0.15:
            copy = list(rng.choice(items))
            for _ in range(rng.randint(0, int(len(copy) * 0.1))):
                copy[rng.randrange(len(copy))] = rng.choice("abcz-")
            parts.append("".join(copy))
    text = decontam.normalised(" ".join(parts))
    found = {k for k, *_ in decontam.Items(list(enumerate(items)), 12, 0.08).find(text)}
    want = {k for k, item in enumerate(items) if best_place(item, text) <= int(len(item) * 0.08 + 1e-9)}
    assert found == want
