import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "Li", "mu", "te", "zör", "né") for b in ("n", "ra", "s", "vi", "ll")]


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty and blank texts, copies, near copies, shared passages, one long text and repeated rows."""
    r = random.Random(11)
    passage, rows = words(r, 40), []
    for i in range(40):
        t = words(r, r.choice([1, 2, 3, 5, 25, 60, 150]))
        if i % 4 == 0:
            t = f"{t} {passage}\n{words(r, 8)}"
        rows.append((i, t))
    base = words(r, 120).split(" ")
    for i in range(40, 52):
        near = list(base)
        for _ in range(i % 4):
            near[r.randrange(len(near))] = "x%d" % r.randrange(9)
        rows.append((i, " ".join(near)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, rows[3][1].upper()), (63, None), (64, ""), (65, " \t\n "), (66, "uno"), (67, "uno"), (68, words(r, 4000)), (69, "w" * 3000), (70, "ha " * 90), (71, "one two"), (72, "One TWO")]
    rows.append(rows[8])  # a repeated row
    rows.append((None, passage))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in corpus], "doc_id long, text string, size string, d long, sg_d long")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
