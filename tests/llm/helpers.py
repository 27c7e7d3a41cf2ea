"""Small documents: null, empty and blank texts, a very long one, ties, repeated rows, near copies, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"
EN = "the of and to in is that it was for with as on be at by this had not are".split()
DE = "der die und das in den von zu mit sich des auf für ist im dem nicht ein als auch".split()
FR = "le la les de des et un une que qui dans pour pas sur est au plus par avec ce".split()


def words(seed, n, base=EN):
    r = random.Random(seed)
    return [r.choice(base) if r.random() < 0.4 else "".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(n)]


def documents(spark, extra=()):
    base = words(1, 60)
    near = base[:]
    near[30] = "changed"
    texts = [None, "", "  \n\t ", "one", "two words", " ".join(base), " ".join(near), " ".join(base), " ".join(words(2, 20000)), "Ünïcode ΣΑΣ 中文 🎉 İ", "<|endoftext|> x", *extra]
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id here at all, none", "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labelled(spark, n=90):
    rows = []
    for i in range(n):
        lang, base = (("en", EN), ("de", DE), ("fr", FR))[i % 3]
        text = " ".join(words(i, 40, base))
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, None if i % 10 == 9 else lang, f"s{i % 5}", len(text), 0.1, 1))
    return spark.createDataFrame(rows, SCHEMA)
