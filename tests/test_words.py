"""Word boundaries: the Spark predicate against Python's ``re`` (the reference's engine)."""

import random
import re

from pyspark.sql import functions as F

from toponymic.functions.words import whole_word

# letters, a combining mark (not a word character in Python), digits of other scripts,
# a superscript digit, the underscore and separators
ALPHABET = ["a", "b", "é", "é", "_", "1", "٣", "²", " ", "-", ".", "\n", "x"]
NAMES = ["ab", "a-b", "é", "é", "1", "_x", "b.", "-a", "a b", "²", "x٣"]


def test_whole_word_equals_python_re(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    rows = [(t, n) for t in texts for n in NAMES]
    df = spark.createDataFrame(rows, "text string, name string")
    got = [r.hit for r in df.select(whole_word(F.col("text"), F.col("name")).alias("hit")).collect()]
    want = [bool(re.search(r"\b" + re.escape(n) + r"\b", t)) for t, n in rows]
    assert got == want
    assert sum(want) > 100
