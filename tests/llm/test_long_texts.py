"""Spans and rewriting of a very long text with very many spans, against plain versions."""

import re

from kgweave.llm import secrets

MANY = 9_000


def test_secrets_of_a_long_text(spark):
    text = "".join(f" token=abcdef12345{i:05d} é🙂 {'Zz9' * 9}{i:05d}" for i in range(MANY))
    rows = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    r = secrets.secret_report(rows).where("doc_id = 1").first()
    assign = [m.span() for m in re.finditer(r"token=[A-Za-z0-9]+", text)]
    owned = [m.span() for m in re.finditer(r"(?:Zz9){9}\d{5}", text)]
    hexes = [m.span() for m in re.finditer(r"[0-9a-f]{16,}", text)]
    found = sorted((s.start, s.end, s.kind) for s in r.found)
    assert found == sorted([(*s, "assign") for s in assign] + [(*s, "owned") for s in owned] + [(*s, "hex") for s in hexes])
    out = {x.doc_id: x.text for x in secrets.redact(rows).collect()}
    assert out[1] == re.sub(r"token=[A-Za-z0-9]+|(?:Zz9){9}\d{5}", "[secret]", text)
    assert out[2] is None and out[3] == ""


def test_redaction_moves_texts_where_live_spans_are_many(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"{i} password = Abcdef{i:06d} end" if i % 2 else "nothing here", "s", i) for i in range(40)], "doc_id long, text string, source string, own int")
    few = sorted(map(tuple, secrets.redact(rows).collect()))
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, secrets.redact(rows).collect())) == few
    assert sum("[secret]" in r[1] for r in few) == 20
