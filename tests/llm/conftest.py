import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
AZ = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n string"


def make_docs(seed=3, n=60):
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing columns."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(r.choice([1, 2, 3, 8, 60, 120, 200]))
        if i % 5 == 1 and rows:
            t = rows[-1][1] or ""  # a copy
        elif i % 5 == 2 and rows:
            words = (rows[-1][1] or "a").split(" ")
            words[r.randrange(len(words))] = "edited"
            t = " ".join(words)
        elif i % 7 == 3:
            t = text(20) + "\n" + passage + "\t" + text(10)
        rows.append([i, t, "en" if i % 3 else "de", f"s{i % 4}"])
    rows[10][1], rows[11][1], rows[12][1], rows[13][1] = None, "", " \n\t ", "ÀÉ 日本 x A a"
    rows[14][3] = rows[15][2] = None
    rows.append([1000, text(6000), "en", "s0"])
    rows.append([1001, rows[-1][1] + " tail", "en", "s0"])
    rows.append([None, passage, "en", "s1"])
    rows.append(list(rows[0]))
    return [(*x, None, 0.25, "clash") for x in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text, lower=False):
    return WORD.findall((text or "").translate(AZ) if lower else text or "")
