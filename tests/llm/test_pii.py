import duckdb

from basketry.llm import pii

from .brute import base_sha256, base_spans

TEXTS = [
    None, "", "nothing here", "mail a@b.com_x@y.org or a.b%c@d-e.co.uk.", "IP 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.255.0",
    "card 4111 1111 1111 1111 then 4111-1111-1111-1112", "7536784127813050 4845168114407329", "+1 (017) 555-7713, +12, +1234567890123456",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but not GB82WEST12345698765433",
    "my SSN: 123-45-6789, then 000-12-3456 far away from any word that would explain it",
    "é😀 naïve a@b.com 😀 10.0.0.1", "9" * 60_000, "1 " * 40_000, "a" * 60_000 + "@x.yz", "1." * 30_000, "+" * 20_000 + "1-1" * 9_000,
    "x@y.z " * 3_000,
]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1.0, [1]) for i, t in enumerate(texts)], "doc_id long, text string, spans string, score double, kind array<int>")


def test_base_spans_match_plain_search(spark):
    rows = pii.digest(pii.find_spans(_docs(spark, TEXTS))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        spans = base_spans(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == base_sha256(TEXTS[r["doc_id"]]), r["doc_id"]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]


def test_checksums_and_context_decide_added_kinds(spark):
    got = {r["doc_id"]: [(s["kind"], s["value"], s["context"]) for s in r["spans"] if s["kind"] in ("iban", "ssn")]
           for r in pii.find_spans(_docs(spark, TEXTS)).collect()}
    assert [v for _, v, _ in got[8]] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert got[9] == [("ssn", "123-45-6789", True)]


def test_redaction_keeps_columns_and_masks(spark):
    docs = _docs(spark, TEXTS)
    out = pii.redact(docs)
    assert out.schema.names == docs.schema.names
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[0] is None and text[1] == "" and text[2] == TEXTS[2]
    assert text[3] == "mail [EMAIL][EMAIL] or [EMAIL]."
    assert text[4] == "IP [IP].[IP] and 256.1.1.1 and [IP]"
    assert text[5] == "card [CARD] then 4111-1111-1111-1112"
    assert "123-45-6789" not in text[9] and "000-12-3456" in text[9]
    again = {r["doc_id"]: r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in pii.digest(pii.find_spans(out)).collect()}
    assert set(again.values()) == {0}


def test_overlapping_spans_are_masked_whole(spark):
    want = {
        "call +33.1.42.68.53.00 now": "call [PHONE] now",
        "é😀 +33.1.42.68.53.00, a@b.com, 10.0.0.1": "é😀 [PHONE], [EMAIL], [IP]",
        "a@b.com +33.1.42.68.53.00.x@y.org +49.30.12.34.567 z": "[EMAIL] [EMAIL] [PHONE] z",
        "user 1.2.3.4@host.org ok": "user [EMAIL] ok",
        "+1 (017) 555-7713 (4111111111111111)": "[PHONE] ([CARD])",
        "10.0.0.1 10.0.0.2": "[IP] [IP]",
    }
    got = {r["doc_id"]: r["text"] for r in pii.redact(_docs(spark, list(want))).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    for i, t in enumerate(want):
        inside = {at for _, a, b in base_spans(t) for at in range(a, b)}
        outside = "".join(c for at, c in enumerate(t) if at not in inside)
        assert sum(c.isdigit() for c in got[i]) <= sum(c.isdigit() for c in outside)


def test_repeated_rows_and_empty_table(spark):
    assert pii.digest(pii.find_spans(_docs(spark, ["a@b.co"] * 3).withColumnRenamed("score", "n_email"))).count() == 3
    assert pii.digest(pii.find_spans(_docs(spark, TEXTS).limit(0))).count() == 0


def test_oracle_agrees_on_hard_texts(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 1000]
    docs = _docs(spark, texts).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(pii.oracle_sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = pii.digest(pii.find_spans(docs)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(want)].astype(str))
