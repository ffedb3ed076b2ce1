"""Quality rules and line frequency against plain Python."""

import random

from tablesteward.llm import quality

KIND = "doc_id long, text string, source string, extra string"


def plain_verdicts(rows, line_limit):
    """The same by dictionaries over all rows."""
    lines = []
    for id_, text, host in rows:
        found = {}
        for line in (text or "").encode().split(b"\n"):
            if quality.characters(line):
                chars, times = found.get(quality.normalised(line), (0, 0))
                found[quality.normalised(line)] = (chars + quality.characters(line), times + 1)
        lines.append(found)
    holders = {}
    for (id_, _, host), found in zip(rows, lines, strict=True):
        for line in found:
            holders.setdefault((host, line), []).append(id_)
    out = []
    for (id_, text, host), found in zip(rows, lines, strict=True):
        words = (text or "").encode().split()
        gone = [line for line in found if len(ids := holders[host, line]) > line_limit and id_ != min(ids)]
        lost = sum(found[line][0] for line in gone)
        windows = {}
        for at in range(len(words) - 7):
            windows.setdefault(tuple(words[at : at + 8]), []).append(at)
        repeated = {p for starts in windows.values() if len(starts) > 1 for at in starts for p in range(at, at + 8)}
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        chars = sum(len(w.decode()) for w in words)
        out.append((id_, len(words), len(repeated), failed, lost, not failed and not lost > 0.5 * chars))
    return sorted(out)


def test_against_plain_python(spark):
    rng = random.Random(1)
    common = ["All rights reserved 2024", "page 7 of 9", "  spaced   OUT line "]
    rows = []
    for i in range(120):
        own = [" ".join(rng.choice(["é", "b", "#x", "dd", f"w{i}"]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 4))]
        text = "\n".join(rng.sample(common, rng.randint(0, 3)) + own + ([own[0]] if own and rng.random() < 0.3 else []))
        rows.append((i, text, rng.choice(["a", "b", None])))
    rows += [(200, None, "a"), (201, "", None), (202, " \n ", "b"), (203, "word " * 40, "a")]
    frame = spark.createDataFrame([(*row, "kept") for row in rows], KIND)
    got = quality.quality_verdicts(frame, line_limit=10).collect()
    told = sorted((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.lost_chars, r.kept) for r in got)
    assert told == plain_verdicts(rows, 10) and any(r[4] for r in told)


def test_lines_stay_in_their_first_document(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"License 1.{i}\n{body} {chr(97 + i)}", "h", "x") for i in range(8)]
    docs = spark.createDataFrame(rows + [rows[0]], KIND)
    cleaned = sorted(r.text for r in quality.clean_documents(docs, line_limit=5).collect())
    assert sum(text.startswith("License") for text in cleaned) == 2 and len(cleaned) == 9
    copies = spark.createDataFrame([(i, body, "h", "x") for i in range(8)], KIND)
    assert [r.doc_id for r in quality.clean_documents(copies, line_limit=5).collect()] == [0]


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([], KIND)
    assert quality.quality_verdicts(docs).count() == 0 and quality.clean_documents(docs).columns == docs.columns
    clash = spark.createDataFrame([(1, "a " * 5, "h", 3, 4)], "doc_id long, text string, source string, row_id int, host int")
    assert quality.clean_documents(clash).columns == clash.columns
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"License\n{body} {chr(97 + i)}", "h", "mine", i) for i in range(8)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, source string, __kept string, __Hashes int")
    cleaned = quality.clean_documents(clash)
    assert cleaned.columns == clash.columns and {r["__kept"] for r in cleaned.collect()} == {"mine"}
    assert sum(r.text.startswith("License") for r in cleaned.collect()) == 1


def test_limit_follows_the_host(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.quality_verdicts(given).where("lost_lines > 0")
    assert got.count() > 0
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"License\n{body} {chr(97 + i)}", "small", "x") for i in range(8)]
    rows += [(100 + i, ("License\n" if i < 8 else "") + f"{body} {'b' * (i + 1)}", "large", "x") for i in range(200)]
    rows += [(1000 + i, f"{body} c", "copies", "x") for i in range(40)]
    got = quality.quality_verdicts(spark.createDataFrame(rows, KIND)).where("lost_lines > 0").collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 8))


def test_query_removes_lines(spark):
    """The registered query's method decides on a given table; its SQL is compared in test_registry."""
    got = quality.op10_quality_rules(spark, "/root/testdata/sf0.01")
    assert got.where("lost_lines > 0").count() > 0


def test_long_text(spark):
    text = "\n".join(f"line {chr(97 + i % 26)} of a very long text {i}" for i in range(33_000))
    docs = spark.createDataFrame([(1, text, "h"), (2, "word " * 250_000, "h")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert len(text) > 1_000_000 and got[1].n_words == 264_000 and got[2].base_failed and got[1].word_chars == len(text.translate({32: None, 10: None}))


def test_home_passes_the_base_rules(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(0, "License", "h", "x")] + [(i, f"License\n{body} {chr(97 + i)}", "h", "x") for i in range(1, 9)]
    cleaned = quality.clean_documents(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r.doc_id for r in cleaned if r.text.startswith("License")) == [1] and len(cleaned) == 8
