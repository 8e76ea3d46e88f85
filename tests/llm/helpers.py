"""Texts for small fixtures, and plain Python to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"aa": "ka to mi ne su ra".split(), "bb": "zwo erg plu ind oxt ums".split()}


def prose(seed, words=40, language="aa"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[language], k=rng.randint(1, 4))) for _ in range(words))


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
