"""Rows that every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
EXTRA = ("kept", "size", "key", "id", "_text", "_digest", "component", "held_out", "ids", "host", "fold", "toxic", "_key", "spans")


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


LONG = " ".join(f"long{i % 977}x{i}" for i in range(30_000))

ROWS = [
    (1, words(40), "en", "a", 1),
    (2, words(40).replace(" ", "\t\n"), "en", "b", 1),
    (3, words(38) + " other end", "en", "b", 1),
    (4, words(40, 500), "de", None, None),
    (5, None, None, None, None),
    (6, "", "en", "a", 0),
    (7, "  \n\t ", None, "c", 3),
    (8, "Three small words", "en", "c", 3),
    (9, "three small words", "fr", "c", 3),
    (10, LONG, "en", "a", len(LONG)),
    (11, LONG + " end", "en", "d", len(LONG)),
    (None, words(40), "en", "a", 1),
    (None, "text without an id", None, "e", 1),
    (12, "repeated row é ß 漢字 😀 x", "fr", "e", 1),
    (12, "repeated row é ß 漢字 😀 x", "fr", "e", 1),
]
