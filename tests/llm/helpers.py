"""Small document tables with every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea near old harbour walls".split()


def text(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + ("" if x % 5 else str(x % 97)))
    return " ".join(out)


def awkward(spark):
    """Nulls in every column, empty and blank texts, a long one, copies, near copies, repeated rows."""
    base = text(1, 120)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("fox", "cat", 1), "en", "b", 1), (4, None, "en", "a", None), (5, "", "de", None, 0),
        (6, " \n\t ", None, "b", 4), (7, text(2, 4000), "fr", "c", 9), (8, "one two", "en", "c", 7), (8, "one two", "en", "c", 7), (None, text(3, 60), None, None, None),
        (9, "ÉTÉ ▁ \U0001f600\x0b#*$ <b>&", "fr", "c", 3), (10, text(4, 80), "en", "a", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same with extra columns named like ones that operators add."""
    from pyspark.sql import functions as F

    names = ("size", "shard", "slot", "score", "predicted", "copies", "target", "failed_bits", "n_words", "pieces", "component_id", "kept", "rank", "key", "own")
    return df.withColumns({n: F.lit("x") for n in names})


def empty(spark):
    return spark.createDataFrame([], DOCS)
