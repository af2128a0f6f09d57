"""Documents with NULLs, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, key long, h long, b long, size long, base string, stratum string, fp long, k long, data binary,"
    " component_id long, score double, at long, piece int, _text string, _w string, _key long, _d long, _k long, _s string, _h long, _b long, _r long, _l long, _c long, _rank long, _take long, _takes long, _spans string, row string, d long, s string, r long,"
    " length2 long, masked string, hit boolean, take string, rank long, data2 string, spans string, `a.b` long"
)


def prose(seed: int, n: int, words: int = 300) -> str:
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append("w%d" % r.randrange(words) + r.choice(["", "", "", ".", ","]))
        out.append(r.choice([" "] * 9 + ["\n"]))
    return "".join(out)


def texts() -> list[tuple]:
    base = prose(1, 120)
    odd = "line one here\nline one here\n\n  \nline one here\t\x0bx é日本 #$%& " + "a b c a b c " * 8
    rows = [
        (0, base), (1, base), (2, base + " tail"), (3, None), (4, ""), (5, " \t\n "), (6, odd), (6, odd), (7, "one"), (8, "one two"), (9, prose(2, 6000)), (10, prose(2, 6000) + " changed end"),
        (None, prose(3, 80)), (11, prose(4, 90)), (12, prose(4, 90)), (6, "another text with the same id " * 9), (13, "ONE Two"), (14, "aaaa" * 400), (15, prose(5, 60) + base[20:600] + prose(6, 60)),
        (16, "Zoë " + base[100:420]), (17, "x" * 199), (18, "x" * 199 + "y"),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ("en", "fr", None)[n % 3], ("s0", "s0", "s1", None)[n % 4], None if t is None else len(t), *[None] * 41) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return documents(spark).limit(0)
