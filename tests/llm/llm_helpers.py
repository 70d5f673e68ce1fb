"""Rows and comparisons the tests of this folder share."""

import re

DOCUMENTS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size string, mix int, "
             "score string, pii string, place int, block string, rejected string, kept int")
PROSE = ("Then the old ship came into the harbour and the men went down to see what it had brought, for "
         "nobody had heard of it in many years and some had said that it was lost at sea with all hands.")


def odd_rows():
    """Null ids, texts, languages and sources; empty, very long and repeated texts; ties."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, PROSE, "en", "a"), (5, PROSE, "en", "b"),
        (5, PROSE, "en", "b"), (None, PROSE, None, "b"), (None, None, None, None), (6, "one two", "en", "a"),
        (7, "ONE  two\n", "en", "a"), (8, long_text, "en", "a"), (9, "x" * 200_000, "en", "c"),
        (10, "é" * 50 + " mail a.b@c.example.org now 1.2.3.4", "fr", "c"), (11, PROSE.upper(), "en", "c"),
        (12, "<|end|> \\ <|text|> $1 \\E", "en", "c"), (13, "12345 67890", "", ""),
    ]


def plain(frame):
    return sorted((r.asDict() for r in frame.collect()), key=repr)


def same(got, expected):
    order = lambda rows: sorted((tuple(sorted(r.items())) for r in rows), key=repr)
    assert order(got) == order(expected)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def expected(texts):
    """doc_id to (set size, component), comparing all pairs."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    least = {k: k for k in texts}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}
