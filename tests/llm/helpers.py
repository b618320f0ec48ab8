"""Small fixtures and brute-force versions for the text operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "\n\t", "one", "two words", "1234 5678", "!!! ???", "é" * 50]


def vocabulary(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(["ba", "ke", "li", "mo", "nu", "ra", "si", "to"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n)).strip()


def corpus(n: int = 60, seed: int = 2) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): odd texts, copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = vocabulary(300)
    texts: list[str | None] = list(ODD)
    passage = prose(rng, words, 70)
    while len(texts) < n:
        kind = rng.random()
        long = [t for t in texts if t and len(t.split()) > 40]
        if kind < 0.15 and long:
            texts.append(rng.choice(long))
        elif kind < 0.35 and long:
            w = rng.choice(long).split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind < 0.5:
            texts.append(prose(rng, words, rng.randint(5, 60)) + " " + passage + " " + prose(rng, words, rng.randint(5, 60)))
        else:
            texts.append(prose(rng, words, rng.randint(1, 200)))
    rng.shuffle(texts)
    return [(i, t, rng.choice(["xx", "yy", None]), rng.choice(["s1", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = WORD.findall(text or "")
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
