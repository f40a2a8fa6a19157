"""Small documents with every case that an operator has to define."""

import random

from pyspark.sql import types as Y

# names that operators use inside, or used to
INSIDE = ("uid", "key", "node", "starts", "content", "copies", "held", "n_words", "doc", "mine", "times", "ends", "nth", "place",
          "_doc", "_text_uid", "_uid", "_copies", "_rows", "_hit_doc")
EXTRA = len(INSIDE)

SCHEMA = Y.StructType([
    Y.StructField("doc_id", Y.LongType()), Y.StructField("text", Y.StringType()), Y.StructField("lang", Y.StringType()),
    Y.StructField("source", Y.StringType()), Y.StructField("n_chars", Y.LongType()),
    *[Y.StructField(n, Y.StringType()) for n in INSIDE]])

SYLLABLES = "an the re ion ti er st ou ing ha ly ver sch ei ñ é ü ción tz".split()


def prose(rng, n, line=0.05):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < line else rng.choice([" ", " ", " ", ". ", ", "])) for w in words)


def documents(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(25)]
    passage = prose(rng, 90, 0)
    texts = [*base, None, None, "", " ", "\n\n \t", "!!! ... ###", base[3], base[3], base[7],
             base[5] + passage + base[6], base[8] + " " + passage, passage, "word " * 200, "a" * 1500, "x y " * 300,
             prose(rng, 20000), "one two three four", "one two three four", "One TWO three, four!", "x\u00a0y z\u2003 w",
             "日本語 のテキスト です", "tail space ", "GNU General Public License and CC BY-NC 4.0, licensed under CC BY NC 4.0"]
    words = base[10].split(" ")
    for i in range(3):
        changed = list(words)
        changed[(i * 37) % len(words)] = f"changed{i}"
        texts.append(" ".join(changed))
    rows = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "a", "a"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (3, "another text of a doc_id that is there already", "en", "b", 1), (None, base[2], "en", "b", 1),
             (None, None, None, None, None)]
    return [(*r, *["x"] * EXTRA) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)
