"""Clean-up, masking and verdicts of SQL text."""

import random

import pytest
from pyspark.sql import functions as F

from tablesteward.functions.sqltext import FENCE_TAGS, WRITE_KEYWORDS, mask, with_verdict

TABLES = ("orders", "lineitem", "customer")
BLANK = (" ", "\n", "\t", "\u2003")
# Parts of statements over the driver's tables; what a text should get follows from the parts it is made of.
BODIES = (
    "SELECT count(*) AS n FROM {t}",
    "WITH w AS (SELECT * FROM {t}) SELECT max(n) FROM w",
    "((SELECT 5 AS n) UNION ALL (SELECT n FROM {t}))",
    "select {column} from {t} group by all",
)
COLUMNS = tuple(f"{lead}{word.lower()}{tail}" for word in WRITE_KEYWORDS for lead, tail in (("x_", ""), ("", "_x"), ("é", ""), ("", "9")))


def hidden(draw, inside):
    """``inside`` where it counts for nothing: in a comment, a literal or a quoted name."""
    shape = draw.choice(["'{}'", '"{}"', "\'\'\'{}\'\'\'", "`{}`", "/* {} */", "-- {}\n", "# {}\n", r"'\' {}'"])
    return " " + shape.format(inside) + " "


def read_text(draw):
    body = draw.choice(BODIES).format(t=draw.choice(TABLES), column=draw.choice(COLUMNS))
    word = draw.choice(WRITE_KEYWORDS)
    head, tail = (draw.choice(["", hidden(draw, f"{word} it; {word}")]) for _ in range(2))
    return (head if head.strip().startswith(("/*", "--", "#")) else "") + body + tail


def fenced(draw, text):
    tag = draw.choice(["", *FENCE_TAGS, *(t.upper() for t in FENCE_TAGS)])
    return draw.choice(["", "so: "]) + "```" + tag + "\n" + text + draw.choice(["\n", " "]) + "```" + draw.choice(["", " done; bye"])


@pytest.fixture(scope="module")
def audited(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
        return with_verdict(df, "sql").orderBy("i").collect()

    return run


def test_clean_up(audited):
    draw = random.Random(11)
    wanted = [draw.choice(BODIES).format(t=draw.choice(TABLES), column="n") for _ in range(200)]
    dressed = []
    for text in wanted:
        ends = "".join(draw.choice([*BLANK, ";"]) for _ in range(draw.randint(0, 4)))
        plain = draw.choice(BLANK) + text + ends
        dressed.append(draw.choice([plain, fenced(draw, text + ends), "```sql\n" + text + ends]))
    assert [r["cleaned"] for r in audited(dressed)] == wanted


def test_empty_texts(audited):
    draw = random.Random(12)
    texts = [None, *("".join(draw.choice([*BLANK, ";", "\u00a0"]) for _ in range(n)) for n in range(12))]
    rows = audited(texts + [f"```{tag}\n```" for tag in FENCE_TAGS])
    assert {r["verdict"] for r in rows} == {"empty"} and {r["cleaned"] for r in rows} == {None}


def test_reads(audited):
    draw = random.Random(13)
    assert [r["sql"] for r in audited([read_text(draw) for _ in range(400)]) if r["verdict"] != "ok"] == []


def test_two_statements(audited):
    draw = random.Random(14)
    texts = [read_text(draw) + "\n;" + read_text(draw) for _ in range(100)]
    assert {r["verdict"] for r in audited(texts)} == {"multiple_statements"}


def test_writes(audited):
    draw = random.Random(15)
    texts = []
    for word in WRITE_KEYWORDS:
        shown, t = draw.choice([word, word.lower(), word.title()]), draw.choice(TABLES)
        texts += [f"{shown} {t}", f"/* first */ {shown} {t}", f"WITH w AS (SELECT 5) {shown} {t}", f"SELECT {shown} FROM {t}"]
    texts += ["VALUES (5)", "SHOW TABLES", "USE x", "selects 5"]
    assert [r["sql"] for r in audited(texts) if r["verdict"] != "not_read_only"] == []


def scan(sql):
    """Masking by the rules, one character at a time."""
    out, i = [], 0
    while i < len(sql):
        closer = None
        for opener in ("--", "#", "/*", "'''", '"""', "'", '"', "`"):
            if sql.startswith(opener, i):
                closer = {"--": "\n", "#": "\n", "/*": "*/"}.get(opener, opener)
                break
        if closer is None:
            out.append(sql[i])
            i += 1
            continue
        out.append(" ")
        i += len(opener)
        while i < len(sql) and not sql.startswith(closer, i):
            i += 2 if len(opener) == 1 and opener != "#" and sql[i] == "\\" else 1
        i += 0 if closer == "\n" else len(closer)
    return "".join(out)


def test_mask_equals_a_scanner(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("'\"`\\-#/*;\n ab") for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    got = [r["m"] for r in df.select("i", mask(F.col("sql")).alias("m")).orderBy("i").collect()]
    assert [t for t, g in zip(texts, got) if g != scan(t)] == []


def test_long_literals(evaluate):
    long = "x" * 1_000_000
    texts = [f"SELECT '{long}' a", f"SELECT '{long}", f"/* {long}", f"SELECT '''{long}''' b"]
    assert evaluate(texts, "string", mask(F.col("x"))) == ["SELECT   a", "SELECT  ", " ", "SELECT   b"]
