"""Small tables with everything that may be odd in one."""

KINDS = ("doc_id long, text string, lang string, source string, n_chars long, id long, size long, fp long, key string, "
         "class long, copies long, n long, m long, u long, component string, unit string, value string, attempt int")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau".split()


def text(n, seed=0):
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 15] + str(x >> 16 & 63))
    return " ".join(out)


def rows():
    long_ = text(30_000, 5)
    plain = [(1, text(80, 1), "en", "a"), (2, text(80, 1), "en", "b"), (2, text(80, 1), "en", "b"), (3, None, "en", "a"),
             (4, "", None, None), (5, long_, "de", "a"), (None, text(60, 2), "en", None), (None, None, None, None),
             (6, " \t\n", "en", "a"), (7, "x" * 5000, "en", "c"), (8, text(40, 3), None, "c"), (9, text(41, 4), "en", "a"),
             (2, text(33, 9), "en", "b"), (10, "one two", "en", "a"), (11, "漢字 é 🎉 \x00 end", "zh", "a")]
    return [(*r, None, 99, 98, 97, "k", 96, 95, 94, 93, 92, "c", "u", "v", 1) for r in plain]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, KINDS)


def empty(spark):
    return spark.createDataFrame([], KINDS)


def docs(spark, texts):
    """A table of documents with the given texts, ids from 0."""
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
