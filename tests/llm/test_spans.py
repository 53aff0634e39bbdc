"""Personal data and secrets against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm import pii, queries, secrets


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def texts():
    rnd = random.Random(3)
    bits = ["a@b.co", "x_", ".", "@", " ", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+", "é", "\U0001f600", "7", "-", "(", "password", "=", ": ", '"', "toKEN", "api_key", "AKIA", "ABCDEFGHIJ012345", "deadbeef", "0123456789abcdef", "\n", "call ", "secret"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(600)]
    return [*out, None, "", "x" * 5_000, "1" * 5_000, "a.b" * 2_000, "1 " * 5_000, "a@b.c " * 400, "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB83WEST12345698765432", "ssn 123-45-6789", "123-45-6789", "call 212-555-0100"]


def table(spark):
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0], (None, "a@b.co", "z")], "doc_id long, text string, spans string")


def rendered(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(spark, out, brute, kinds):
    rows = out.collect()
    assert len(rows) == len(texts()) + 2
    for r in rows:
        t = (texts()[r.doc_id] if r.doc_id is not None else "a@b.co") or ""
        want = brute(t)
        assert rendered(want) == ",".join(x for x in r.spans.split(",") if x.split(":")[0] in kinds), (r.doc_id, t[:200])
        assert r.base_sha256 == hashlib.sha256(rendered(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in want) for k in kinds]
    return {r.doc_id: r for r in rows}


def test_pii(spark):
    got = check(spark, queries._spans(pii.find(table(spark)), pii.BASE), base_pii, pii.BASE)
    n = len(texts())
    assert [got[n - i].spans for i in (6, 5, 4, 3, 2, 1)] == ["iban:0:27", "iban:0:22", "", "ssn:4:15", "", "tel:5:17"]


def test_pii_redacted(spark):
    found = pii.find(table(spark)).where("doc_id is not null")
    for r in pii.redact(found).join(found.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        if r.old is None:
            assert r.text is None
            continue
        want, at, spans = "", 0, sorted((s.start, -s.end, s.kind) for s in r.spans)
        runs = []
        for s, e, k in spans:
            if runs and runs[-1][1] > s:
                runs[-1][1] = max(runs[-1][1], -e)
            else:
                runs.append([s, -e, k])
        for s, e, k in runs:
            want, at = want + r.old[at:s] + f"[{k.upper()}]", e
        assert r.text == want + r.old[at:]


def test_ibans_before_and_after_other_words(spark):
    de, gb, be = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034"
    bare = [x.replace(" ", "") for x in (de, gb, be)]
    texts = {}
    for x in (de, gb, be, *bare):
        for before in ("", "pay ", "é IBAN ", "AB12 ", "XY99 0000 1111 2222 "):
            for after in ("", " Please", " Thanks.", " BIC COBADEFF", " 2024-01-02", " A", " 7", ", OK", " and more", "\nNEXT", " XX"):
                texts[before + x + after] = [x]
    for x, y in ((de, gb), (bare[0], bare[1]), (be, de), (bare[2], bare[2]), (bare[1], de)):
        texts[f"{x} {y}"] = [x, y]
        texts[f"AB12 {x} AND {y} OK"] = [x, y]
    for wrong in (de[:-1] + "1 Please", bare[0] + "A", bare[0] + "a", "x" + bare[0], "DE89 Please", de[:15]):
        texts[wrong] = []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        got = [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"]
        assert [x for x in got if not x.startswith(("AB12", "XY99"))] == texts[r.text], r.text  # these may pass by chance
    one = spark.createDataFrame([(1, f"pay {bare[0]} Please"), (2, f"{gb} 2024-01-02")], "doc_id long, text string")
    assert [r.text for r in pii.redact(pii.find(one)).orderBy("doc_id").collect()] == ["pay [IBAN] Please", "[IBAN] 2024-01-02"]


def test_many_starts_of_ibans_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "AB12 " * 4_000 + "DE89370400440532013000 Please")], "doc_id long, text string")
    (r,) = pii.find(docs).collect()
    assert [(s.start, s.end) for s in r.spans if s.kind == "iban"][-1] == (20_000, 20_022)


def test_secrets(spark):
    check(spark, queries._spans(secrets.findings(table(spark)), secrets.BASE), base_secrets, secrets.BASE)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path, df = f"file://{tmp_path}/ledger", spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, "")], "doc_id long, text string")
    assert secrets.update(df, path).count() == 2
    assert secrets.update(df.union(spark.createDataFrame([(4, "new")], df.schema)), path).count() == 3
    out = secrets.findings(df, path)
    assert secrets.ledger(df, path).count() == 3
    assert [(r.doc_id, len(r.spans)) for r in out.orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 0)]


def test_findings_of_rows_with_maps_or_text_alone(spark):
    df = spark.createDataFrame([("password=abcdef", {"a": 1}), (None, None)], "text string, `m.x` map<string,int>")
    assert sorted((len(r.spans), r["m.x"] or {}) for r in secrets.findings(df).collect()) == [(0, {}), (1, {"a": 1})]
    assert sorted(len(r.spans) for r in secrets.findings(df.select("text")).collect()) == [0, 1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).count() == secrets.findings(df).count() == pii.redact(pii.find(df)).count() == 0
