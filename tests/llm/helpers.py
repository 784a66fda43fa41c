"""Small tables with the cases that every operator must take: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use themselves.
EXTRA = "lang string, source string, n_chars long, h string, n string, fp string, root string, score string, removed string, range string, place string, label string"


def texts(seed: int = 1, n: int = 120) -> list[str | None]:
    rng = random.Random(seed)
    words = "the of and to in élan ñu über x y z 世界 don't".split()
    out: list[str | None] = []
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        out.append("\n".join(lines))
    out += ["a <|endoftext|> b<|endoftext|>", None, "", " ", "\n\n", "a", "\t b\x0bc \x1c d", "x" * 3000, "é" * 50]
    out += [" ".join(rng.choice(words) for _ in range(6000))]
    out += [out[0], out[0], out[3], out[3] + " end"]
    return out


def documents(spark, seed: int = 1, n: int = 120):
    """(doc_id, text) and the extra columns: one doc_id null, one repeated with its text, one repeated with another."""
    rows = list(enumerate(texts(seed, n)))
    rows += [(None, "no name"), (5, rows[5][1]), (6, "another text"), (-7, rows[9][1]), (1 << 40, rows[2][1])]
    full = [(i, t, "en", "s", None if t is None else len(t), *["?"] * 9) for i, t in rows]
    return rows, spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}").repartition(3)


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]
