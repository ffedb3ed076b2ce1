"""Personal data and secrets against plain Python patterns, and what the methods add."""

import glob
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from tablesteward.llm import pii, secretscan

PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = {
    "assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(number):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(part) <= 255 for part in match[0].split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
        "assign": lambda: len(match[2]) >= 12,
        "access": lambda: len(match[0]) >= 18,
        "hex": lambda: len(match[0]) >= 16,
    }[kind]()


def plain_spans(text, patterns):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if holds(k, m)]
    return sorted(found)


def made(rng, parts):
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(800)]


@pytest.fixture(scope="module")
def edges():
    return [(9001, None), (9002, ""), (9003, "a" * 100000 + "@b.c"), (9003, "a" * 100000 + "@b.c")]


def test_personal_data(spark, edges):
    parts = [*"a1.2@-+% ()c0\x01\x02é😀", " ", "123.45.6.255", "a.b@c.d_e@f.g", "+1 (547) 555-3286", "4041894974608795", " 4041 8949-7460 8795 "]
    rows = made(random.Random(7), parts) + edges
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, base int")
    texts = dict(rows)
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.base] == plain_spans(texts[r.id], PERSONAL)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_added_phone_numbers_and_redaction(spark):
    rng = random.Random(8)

    def number():
        return f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    rows = [(i, f"call +1 {number()} now") for i in range(150)]
    rows += [(1000 + i, f"hash a{rng.randrange(10**9):09d}f and b{rng.randrange(10**10):010d}c") for i in range(150)]
    rows += [(5000, "call (547) 555-3286 now, mail é joe@mail.example.com"), (5001, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in pii.personal_data(docs).collect()}
    assert [s.kind for s in got[5000].spans] == ["phone", "email"] and not got[5001].spans
    texts = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert texts[0] == "call [phone] now" and texts[5000].endswith("now, mail é [email]") and texts[1000] == dict(rows)[1000]


OTHER_FORMS = {
    "email": "please contact jo.doe [at] mail [dot] com soon",
    "ip": "the server 2001:db8:1:0:0:8a2e:370:7334 is up",
    "card": "my visa card 4012.8888.8888.1881 was charged",
    "phone": "call (547) 555-3286 now",
}


@pytest.mark.parametrize("rows", [0, 10_000])
def test_added_span_of_each_kind(spark, rows):
    """Forms that no base rule finds, alone and among many documents; replayed by plain Python."""
    made = [(i, text) for i, text in enumerate(OTHER_FORMS.values())]
    rng = random.Random(3)
    filler = ["mail joe@mail.org", "call +1 547 555 3286", "pay 4111 1111 1111 1111", "at 10.0.0.1 now", "id 4111111111111112x", "order 1234567", "v1.2.3.400"]
    made += [(100 + i, f"{rng.choice(filler)} {rng.randrange(1000)}") for i in range(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.id: [s.kind for s in r.spans] for r in pii.personal_data(docs.where(f"doc_id < {100 + rows}")).collect()}
    assert [got[i] for i in range(4)] == [[kind] for kind in OTHER_FORMS]
    found = pii.with_candidates(docs, "text", ["key", "base", "found"])
    scorer = pii.fitted(found, "key", "found")

    def grown(node, values):
        while not isinstance(node, float):
            feature, threshold, left, right = node
            node = left if values[feature] <= threshold else right
        return node

    for r in found.where("doc_id < 120").select("doc_id", "found", "base").collect():
        want = [(s.start, s.kind_no, s.end, s.kind) for s in r.base]
        for c in r.found:
            margin = sum(w * grown(t, c.features) for t, w in zip(scorer.trees, scorer.weights, strict=True))
            if c.label is None and c.free and 1 / (1 + 2.718281828459045 ** (-2 * margin)) >= scorer.thresholds.get(c.kind, 2.0):
                want.append((c.start, c.kind_no, c.end, c.kind))
        assert [k for *_, k in sorted(want)] == got[r.doc_id]


def test_many_matches_in_one_text(spark):
    """Places, overlaps and redaction stay exact, and cost what the text costs, beyond a chunk of matches."""
    unit = "+1 547 555 3286, a@b.co é "
    for count in (600, 16_000):
        text = unit * count
        docs = spark.createDataFrame([(1, text, "o")], "doc_id long, text string, source string")
        begun = time.monotonic()
        (row,) = pii.personal_data(docs).collect()
        places = [(s.start, s.end) for s in row.base]
        assert places == [(i * len(unit) + at, i * len(unit) + end) for i in range(count) for at, end in ((0, 15), (17, 23))]
        (told,) = pii.redact_documents(docs).collect()
        assert told.text == "[phone], [email] é " * count
        assert secretscan.secrets(docs).count() == 1
    assert time.monotonic() - begun < 120


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", "mine", 7, True)], "doc_id long, text string, __base string, __KEY int, __candidates boolean")
    assert pii.redact_documents(docs).collect() == [(1, "mail [email]", "mine", 7, True)]


def test_secrets(spark, edges):
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", " ", "=", ":", "'", '"', "abc", "AKIA", "0123456789ABCDEF", "deadbeef", "\x01", "é", "K", "Zx81mQ"]
    rows = made(random.Random(9), parts) + edges
    docs = spark.createDataFrame([(i, text, f"o{i % 5}", 1) for i, text in rows], "doc_id long, text string, source string, owner int")
    texts = dict(rows)
    got = secretscan.secrets(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.base] == plain_spans(texts[r.id], SECRET)


def test_ownership(spark):
    rows = [(1, "see ghp_a8Fk29dLqZx81mQw7pB here", "o1")] + [(10 + i, "see eyJhbGciOi9JIUzI1NiIsInR5 here", f"o{i % 3}") for i in range(9)]
    rows += [(50 + i, "see Qk81xLmZ02pRtY7vNw3s here", None) for i in range(8)]
    got = {r.id: r for r in secretscan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got[1].spans) == 1 and got[1].n_live == 1
    assert not got[10].spans and got[10].n_copied == 1
    assert not got[50].spans and got[50].n_copied == 1


def test_long_and_dotted_tokens(spark):
    key = "".join(random.Random(3).choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789", k=400))
    jwt = f"{key[:30]}.{key[30:90]}.{key[90:130]}"
    texts = [f"see {key} here", f"see {jwt} here", f"the key is {key[200:240]}.", f"{key[300:308]}.{key[308:312]}", "a." * 50000 + "..b"]
    rows = [(i, text, f"o{i}") for i, text in enumerate(texts)]
    got = {r.id: r.spans for r in secretscan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    places = {i: [(s.start, s.end) for s in spans] for i, spans in got.items()}
    assert places == {0: [(4, 404)], 1: [(4, 4 + len(jwt))], 2: [(11, 51)], 3: [], 4: []}


def test_credential_in_many_documents_of_its_owner(spark):
    rows = [(i, "see ghp_a8Fk29dLqZx81mQw7pB here" if i < 9 else f"see {i}", "o") for i in range(40)]
    got = secretscan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r.n_live for r in got) == 9 and not any(r.n_copied for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pii.personal_data(docs).count() == pii.redact_documents(docs).count() == secretscan.secrets(docs).count() == 0


def test_all_labelled_candidates_are_learnt(spark, monkeypatch):
    """Three quarters fit the trees, and the taught rows weigh as much as all candidates of the corpus."""
    weights = []

    class Told(pii.GBTClassifier):
        def fit(self, rows):
            weights.append(rows.agg({"weight": "sum"}).first()[0])
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Told)
    docs = spark.range(24_000).selectExpr("concat('mail a', id, '@b', id % 7, '.com now') AS text")
    found = pii.with_candidates(docs, "text", ["key", "base", "found"]).drop("text").localCheckpoint()
    labelled = found.selectExpr("inline(found)").where("label IS NOT NULL").count()
    scorer = pii.fitted(found, "key", "found")
    assert labelled >= 24_000 and 1.7 * labelled < weights[0] < 1.8 * labelled
    assert set(scorer.thresholds) == set(pii.KINDS)


def test_kept_texts_are_packed(spark):
    """The table of texts and candidates lies on disk under the stages that follow."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('mail a', id, '@b.com') AS text")
    redacted = pii.redact_documents(docs)
    files = [f for path in redacted.inputFiles() for f in glob.glob(path.removeprefix("file://")) if "pii-candidates" in f]
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    assert files and {g.column(i).compression for g in groups for i in range(g.num_columns)} == {"ZSTD"}
    assert {r.text for r in redacted.collect()} == {"mail [email]"}
