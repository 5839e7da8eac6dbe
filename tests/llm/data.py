"""Small tables with every awkward case: nulls, blanks, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _w string"


def prose(seed: int, words: int, alphabet: str = "abcdefgh") -> str:
    draw = random.Random(seed)
    out, left = [], words
    while left > 0:
        n = min(left, draw.randint(3, 14))
        out.append(" ".join("".join(draw.choices(alphabet, k=draw.randint(2, 6))) for _ in range(n)).capitalize() + ".")
        left -= n
    return " ".join(out)


def edited(text: str, seed: int, changes: int) -> str:
    words, draw = text.split(), random.Random(seed)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def awkward_docs(spark):
    base = [prose(i, 60 + 7 * i, "abcdefgh" if i % 2 else "qrstuvwx") for i in range(12)]
    rows = [(i, t, "aa" if i % 2 else "bb", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "bb", "s0"), (21, base[0], None, None), (22, edited(base[8], 1, 3), "bb", "s1")]
    rows += [(23, edited(base[8], 2, 4), "bb", "s1"), (24, edited(base[8], 3, 60), "bb", "s2")]
    rows += [(30, None, "aa", "s0"), (31, "", "aa", "s1"), (32, " \n\t ", None, "s1"), (33, "123 456 ... !!", "aa", "s2")]
    rows += [(34, "one", "aa", "s2"), (34, "one", "aa", "s2"), (None, base[3], "aa", None), (None, "no id here", None, None)]
    rows += [(40, base[5] + " " + base[5], "aa", "s0"), (41, prose(99, 6000), "aa", "s1"), (34, "another text of the same id", "aa", "s2")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 0.5, "x", "y") for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
