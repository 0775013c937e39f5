"""A small corpus with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, text_md5 string, score double"
WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll lagoon meadow north orchard prairie quarry ridge summit tundra upland valley willow yonder zephyr".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + (rng.choice((".", ",", "")) if i % 7 == 6 else "") for i in range(n))


def corpus(seed=3, n=30):
    rng = random.Random(seed)
    shared = [prose(rng, 20) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines[1:1] = shared
        rows.append((i, "\n".join(lines), "en" if i % 3 else "xx", f"s{i % 4}"))
    near = rows[5][1].split(" ")
    near[2] = "changed"
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[0][1], "en", "s0"), (102, " ".join(near), "en", "s1")]
    rows += [(103, None, None, None), (104, "", "en", "s1"), (None, "a text of no id with some words in it", "en", "s1"), (None, None, None, None)]
    rows += [(105, prose(rng, 4000), "en", "s2"), (106, "one", "en", None), (107, " \n\t \n", "en", "s2"), (3, rows[3][1], "en", "s3"), (3, rows[3][1], "en", "s3")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", "clash", "clash", 1.0) for i, t, lang, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
