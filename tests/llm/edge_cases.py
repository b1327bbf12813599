"""Documents with what must not break an operator, and plain restatements of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, start string, kept boolean, fp long, h long, n_removed int"


def documents(spark, texts, ids=None):
    """Extra columns clash with names that operators use."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", True, 7, 8, 9) for i, t in zip(ids, texts)], SCHEMA)


def some_texts(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [prose(120) for _ in range(6)]
    shared = prose(60)
    line = "license " + prose(20)
    out = list(base) + base[:3]  # copies
    out += [x.replace(x.split()[40], "changed", 1) for x in base]  # near copies
    out += [prose(30) + "\n" + shared + "\n" + prose(30) for _ in range(5)]  # a shared passage
    out += [prose(20) + "\n" + line + "\n" + prose(15) for _ in range(20)]  # a very common line
    out += ["", None, " ", "\n\n", "one", "two words", "a b c", "x" * 5000, ("ab " * 3000).strip(), "é 中文 \x0b tab\tend ", "<|endoftext|> it's he'll  double  space\r\n"]
    out += [prose(9000)]
    return out
