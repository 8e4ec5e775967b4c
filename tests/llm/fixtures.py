"""Small documents with the awkward cases: nulls, empty, long, ties, repeats, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    syllables = ["an", "the", "tion", "er", "ing", "ou", "Sh", "é", "ß", "ñ", "re", "st."]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "one two", "one two three", "one two three four", "A b\tC\nd\x0be f\r g"]
    base = words(rng, 120)
    texts += [base, base, base.replace("the", "tha", 1), base + " more", base.upper(), base.lower()]
    texts += ["x" * 70_000, "ab'll" * 3_000, "  two  spaces \n here ", "mixed  space　 end", "中文字 és ünïcode 😀 ", "<|endoftext|> in text", "a<|endof"]
    texts += [words(rng, rng.randint(1, 400)) for _ in range(40)]
    texts += ["same line here. \n" * 30, "tail without words \t \n"]
    near = words(rng, 200).split(" ")
    for i in range(30):
        copy = list(near)
        copy[rng.randrange(200)] = f"w{i}"
        texts.append(" ".join(copy))
    out = [(i * 3 + 1, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, "no id at all here", None, None, None), (None, None, None, None, None)]
    out += [out[9], out[9]]  # the same row again
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def write(spark, tmp_path, data=None) -> str:
    """A folder laid out as the driver's."""
    frame(spark, data).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
