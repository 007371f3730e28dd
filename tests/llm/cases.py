"""Documents with every awkward case, as rows ``doc_id, text, lang, source, n_chars``."""

import random

WORDS = "the of and tion erth heon lyin ould thre ande being ouest nd re".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents() -> list[tuple]:
    long_text = prose(1, 9000)
    passage = prose(2, 60)
    texts = [
        None, "", " \t\n", "a", "A b", "a  b", "a\nb", " a b ", "a\x1cb", "a b", "İÉ naïve é",
        "one two three", "one two three four", "one two three four five", long_text, long_text + " end", "x" * 30000,
        "z " * 3000, "Same line.\nSame line.\nOther line.\n\n  \nSame line.", "<|endoftext|> it's 12 ½१ 中文 \x00 <|startoftext|>x",
        "!!! ### $$$ %%% &&& ||| <<<", passage, prose(3, 40) + " " + passage + " " + prose(4, 40), passage + " " + prose(5, 50),
        prose(6, 20) + "\n" + passage.replace(" ", "\n"), prose(7, 35), prose(7, 35) + " tail", "d " * 36, "d " * 35, "e " * 34,
    ]
    texts += [prose(8, 120)] * 7 + [prose(k, 30 + k) for k in range(20, 60)]
    near = prose(9, 300).split()
    for k in range(12):
        changed = list(near)
        changed[(k * 37) % 300] = f"edit{k}"
        texts.append(" ".join(changed))
    rows = [(k, text, None if k % 5 == 0 else "en", f"s{k % 3}", len(text or "")) for k, text in enumerate(texts)]
    rows += [(4, "A b", "en", "s0", 3), (4, "other text", "en", "s0", 10), (None, "a b", "en", "s1", 3), (None, "none", None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """The rows with extra columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
    return made.withColumns({
        "id": F.lit("x"), "h": F.lit(1), "row": F.lit(2), "key": F.lit(3), "words": F.lit("w"), "n_words": F.lit(-1), "kept": F.lit("k"), "first": F.lit(0),
        "n": F.lit(0), "gid": F.lit(0), "fp": F.lit(0), "node": F.lit(0), "piece": F.lit(0), "start": F.lit(0), "length": F.lit(0), "_text": F.lit(0), "salt": F.lit(0),
    })
