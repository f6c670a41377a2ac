import random

import pytest


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text): prose with copies, near copies, shared passages, repeats, odd characters, nulls and empty texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("the an ou er st ing re ha ti é ß".split()) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize()
    shared = [prose(80) for _ in range(3)]
    out = []
    for i in range(120):
        kind = i % 8
        if kind == 0 and out:
            text = r.choice(out)
        elif kind == 1 and out and r.choice(out):
            w = (r.choice([x for x in out if x])).split(" ")
            w[r.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 2:
            text = prose(r.randint(0, 60)) + "\n" + r.choice(shared) + "\n" + prose(r.randint(0, 60))
        elif kind == 3:
            text = (prose(r.randint(1, 3)) + " ") * r.randint(1, 120)
        elif kind == 4:
            text = r.choice([None, "", " ", "a", "Z\t\x0b", "日本語 テキスト", prose(2), "x" * 700])
        else:
            text = prose(r.randint(1, 300))
        out.append(text)
    return [(i * 3 + 7, t) for i, t in enumerate(out)]
