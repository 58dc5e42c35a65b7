"""Fixtures and plain-Python reference results for the operators' tests."""

from __future__ import annotations

import random

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]


def docs_of(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def near_copies(seed: int = 1, bases: int = 12, copies: int = 6, words: int = 60) -> list[str]:
    """Texts with exact and near copies, chains, short and blank ones."""
    rnd = random.Random(seed)
    out = []
    shared = " ".join(rnd.choice(WORDS) for _ in range(12))
    for _ in range(bases):
        cur = [rnd.choice(WORDS) for _ in range(words)]
        for _ in range(copies):
            out.append(" ".join(cur))
            cur = list(cur)
            for _ in range(rnd.randrange(3)):
                cur[rnd.randrange(len(cur))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                cur = cur + shared.split()
    out += [None, "", "  \n", "one two", "ONE two", "one two three four five", "ONE two Three four five", out[0], "é " * 7]
    rnd.shuffle(out)
    return out


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def ascii_words(text: str) -> list[str]:
    out, cur = [], ""
    for c in text + " ":
        if c in " \t\n\r\x0b\x0c":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out


def smallest_reachable(ids, links) -> dict:
    at = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def edit_distance(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]
