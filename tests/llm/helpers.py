"""Documents with every odd case, and comparison of rows."""

import re

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "the quick brown fox is réal " * 4000

TEXTS = [
    (1, "The MIT License, and the apache  license; General Public License."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "12345 !!!"), (7, "a"),
    (8, "Ñandú – “quoted” Ünïcode 🙂 <|endoftext|> <s> ▁▁ x\u0301"), (9, "a\x00b\x1cc\x85d\u3000e"), (9, "same id again"), (9, "same id again"), (None, "no id here"), (None, None),
]


def odd_docs(spark, n=None):
    """Odd rows with further columns whose names clash with those that operators use, or have a dot."""
    rows = [(i, t, "en" if k % 2 else None, "src0", len(t or ""), f"x{k}", k, f"y{k}") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows if n is None else rows[:n], "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, `a.b` string")


def low_words(text):
    return WORDS.findall((text or "").translate(LOWER))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
