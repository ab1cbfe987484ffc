import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOICES = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(VOICES) + rng.choice(["", "ing", "er", "ly"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared lines, secrets, nulls, an empty and a long text, a repeated row and a null id."""
    rng = random.Random(5)
    shared = "This line stands on many sites and says the same everywhere."
    out = []
    for i in range(40):
        lines = [sentence(rng) for _ in range(8)]
        if i % 3 == 0:
            lines.insert(2, shared)
        if i % 7 == 0:
            lines.append(f"password = {rng.randrange(10**12):012d}ab")
        out.append([i, "\n".join(lines), ["en", "de", None][i % 3], f"s{i % 8}", 0])
    words = out[4][1].split(" ")
    for j in range(6):
        near = list(words)
        near[10 + 7 * j] = f"edit{j}"
        out.append([100 + j, " ".join(near), "en", "s1", 0])
    out += [[200, out[5][1], "en", "s2", 0], [201, out[5][1], "en", "s3", 0]]
    out += [[300, None, "en", "s1", 0], [301, "", None, None, 0], [302, " \n\t ", "en", "s2", 0], [303, "One two.", "en", "s2", 0], [304, " ".join(sentence(rng) for _ in range(900)), "en", "s4", 0]]
    out += [list(out[6]), [None, "No id here but some words to count.", "en", "s5", 0]]
    for r in out:
        r[4] = len(r[1] or "")
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
