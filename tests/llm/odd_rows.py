"""Rows with every odd case: nulls, empty and very long texts, ties, repeated rows, names that clash."""

WORDS = [f"w{i:04d}" for i in range(5_000)]
LONG = " ".join(WORDS) * 8
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (1, COPY), (2, COPY), (2, COPY), (3, COPY + "."), (4, None), (5, ""), (6, "   \n\t "), (7, LONG), (8, LONG + " end"),
    (None, COPY), (None, None), (9, "a"), (10, "x" * 50_000), (11, "é ü 日本 🙂 Ünïcode"),
    (12, "Released under the MIT License. mail a.b@c.de and +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111"),
]
#: Names that the operators use themselves.
CLASHES = ("fp", "key", "n", "_row", "_base", "_text", "cell", "node", "root", "a", "b", "first", "label", "_group", "component_id", "w")
