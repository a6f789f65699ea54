"""Small fixtures with copies, near copies, shared passages, repeats and odd rows."""

import random


def words(r, n, letters="abcdefg"):
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n)]


def corpus(seed=1, n=30, size=80):
    r = random.Random(seed)
    base = [words(r, r.randint(0, size)) for _ in range(n)]
    passage = words(r, 45)
    texts = [" ".join(w) for w in base]
    texts += texts[:6] + [texts[1]] * 3
    for w in base[:10]:
        w = list(w)
        if w:
            w[r.randrange(len(w))] = "changed"
        texts.append("\n".join([" ".join(w[:20]), " ".join(w[20:])]))
    for w in base[10:18]:
        cut = r.randint(0, len(w))
        texts.append(" ".join(w[:cut] + passage + w[cut:]))
    texts += [None, "", " \n\t ", "x", "é ü\x0b日本 x", " ".join(passage * 3), "same words " * 40, "a" * 3000, "\n".join(["one line of five words here"] * 4)]
    return [(i, t, f"clash{i}", i) for i, t in enumerate(texts)]


#: Extra columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, kept string, ord long"
