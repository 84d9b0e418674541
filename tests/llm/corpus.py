"""A small corpus with the awkward cases, and plain versions of the operators."""

import random
import re

SCHEMA = "n long, doc_id long, text string, lang string, source string, n_chars long, kept string, id string, h string, first string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=7, n=60):
    """(doc_id, text): random prose, copies, edited copies, shared passages, nulls, blanks, a long text, repeated rows and ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeghilmnorstué") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(70)
    lines = "\n".join(prose(6) for _ in range(4))
    out = []
    for i in range(n):
        kind = i % 10
        text = "\n".join(prose(r.randint(3, 30)) for _ in range(r.randint(1, 6)))
        if kind == 1 and out:
            text = out[r.randrange(len(out))][1] or ""
        elif kind == 2 and i > 5:
            words = (out[r.randrange(len(out))][1] or "x").split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        elif kind == 3:
            text = prose(5) + " " + passage + "  " + prose(9)
        elif kind == 4:
            text = prose(4) + "\n" + lines + "\n" + prose(3)
        elif kind == 5:
            text = text.upper() if i % 20 == 5 else text
        out.append((i, text))
    last = out[3][1]
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "One"), (105, "two words"), (106, prose(6000)), (107, "ab" * 700), (108, "!!! ???\n..."), (109, "<|endoftext|> x"), (110, "東京　tok yo \U0001f600")]
    out += [(3, last), (5, "another text under an id that is taken"), (None, last), (None, prose(20)), (200, out[7][1] + " \n"), (None, None)]
    return out


def frame(spark, rows):
    """Rows as a table with other columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(1, i, t, ("aa", "bb", None)[k % 3], "s", 0 if t is None else len(t), "x", "y", "z", "w") for k, (i, t) in enumerate(rows)], SCHEMA)
