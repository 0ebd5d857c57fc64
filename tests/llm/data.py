"""A small table with every awkward row, and empty ones."""

import random

#: Columns whose names the operators use inside or return.
CLASHES = ["d", "m", "pos", "key", "h1", "h2", "n", "n_lines", "n_dropped", "held_out", "score", "predicted", "part", "ids", "start", "host", "path", "rule",
           "verdict", "row", "kind", "seq", "digest", "top", "keep_id", "group_size", "kept", "text_sha256", "cid", "node", "sig", "size", "at", "group",
           "n_shingles", "component_id", "source2", "mix_epoch", "mix_block", "n_bytes", "n_tokens", "over_limit", "n_words", "base_failed", "length", "loss",
           "quality", "id", "word_chars", "total", "tokens", "weight", "epochs", "budget", "blocks", "full", "rest", "h", "b", "s", "cut", "cross", "room"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
_r = random.Random(3)
WORDS = ["".join(_r.choice("abcdefghijklmnoprstuvwé") for _ in range(_r.randint(2, 8))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(n=40):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        text = "\n".join([prose(rng, rng.randint(3, 60)) for _ in range(rng.randint(1, 4))])
        if i % 3 == 0:
            text += "\n  Shared Line of all\t"
        rows.append((i, text, "src0" if i % 3 else f"src{i % 7}"))
    base = prose(rng, 200)
    rows += [(100, base, "src1"), (101, base.upper(), "src1"), (102, base.replace(" ", "  ", 3), None), (103, base + " extra words here", "src2")]
    rows += [(200, None, "src0"), (201, "", "src0"), (202, " \n\t ", None), (203, "one", "src3"), (204, "x" * 30_000, "src0"), (205, prose(rng, 20_000), "src0")]
    rows += [(300, "same row here", "src0")] * 2 + [(301, "A first text", "src0"), (301, "a second text of the same id", "src0")]
    rows += [(None, "a row without an id", "src0"), (None, None, None)]
    rows += [(400, "odd\x0bspaces\x1cand\x85more\u00a0of\u2003them  here \n there \u0301x <|endoftext|> don't", "src4"), (401, "#### $$$$ !!!! 1234 #### $$$$ !!!! 1234", "src4")]
    rows += [(402, "tail \n", "src4"), (403, " lead", "src4"), (404, "\n\n", "src4"), (405, "\x01 a \x01", "src4")]
    return [(i, t, "en", s, 0) + ("clash",) * len(CLASHES) for i, t, s in rows]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]
