"""Small tables with the odd cases that every operator must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "0123456789 " * 3, "the\tend\x0b\x0c\r\n", "a" * 5000, "é日本語 ☃ \U0001f600 text", " a  b   c ", "x " * 3000, "|endoftext|> <|endoftext|>", "mail a.b@c.d.e, +1 (974) 555-3436. 10.0.0.256 1.2.3.4"]


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(words))


def documents(spark, texts, start=0, step=3):
    rows = [(start + step * i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=1, size=60):
    """Prose with exact and near copies, shared passages, repeated lines and the odd texts."""
    rng = random.Random(seed)
    texts = ["\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(size)]
    passage = prose(rng, 55)
    for i in range(0, size, 4):
        texts[i] += "\n" + passage + "\n" + prose(rng, 5)
    copies = [rng.choice(texts) for _ in range(size // 4)]
    near = []
    for t in [max(texts, key=len)] * 8 + rng.sample(texts, size // 4):
        words = t.split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"edit{rng.random():.4f}"
        near.append(" ".join(words))
    out = texts + copies + near + ODD + ODD[:4]
    rng.shuffle(out)
    return out
