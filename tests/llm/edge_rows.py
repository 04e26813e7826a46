"""Documents with what real tables hold: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30 ", "changed ")
FAR = BASE.replace("w10 ", "x ").replace("w25 ", "y ").replace("w45 ", "z ")

ROWS = [
    (1, "Hello World", "en", "b", 1, "other"),
    (2, "hello world", "en", None, 2, None),
    (3, None, None, None, None, None),
    (4, "", "en", "a", 0, "x"),
    (5, " \t\n", "en", "a", 3, "x"),
    (6, "ÉCOLE Straße ΑΣ", "fr", "é", 15, "x"),
    (7, "École straße ας", "fr", "é", 15, "x"),
    (8, LONG, "en", "b", len(LONG), "x"),
    (9, LONG.upper(), "en", "b", len(LONG), "x"),
    (10, BASE, "en", "b", len(BASE), "x"),
    (11, NEAR, "en", "a", len(NEAR), "x"),
    (12, FAR, "en", "a", len(FAR), "x"),
    (12, FAR, "en", "a", len(FAR), "x"),
    (13, "a" * 70_000, "en", "c", 70_000, "x"),
    (14, "one two", "en", "c", 7, "x"),
    (15, "<|endoftext|> I'll  say\x1cso", "en", "c", 20, "x"),
    (None, "no id", "en", "c", 5, "x"),
    (None, "no id", "en", "c", 5, "x"),
]
#: Columns of documents, and two whose names operators use inside or give out.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {}"


def documents(spark, extra="kept string", rows=ROWS):
    return spark.createDataFrame([r[: 5 + ("," in SCHEMA)] for r in rows], SCHEMA.format(extra))


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
