"""Surrogates end, stay distinct and leave no shape behind."""

import re

from itemforge.llm import pii


def replaced(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_shapes_without_letters_end(spark):
    texts = ["Password: ____________", "a ..........@x.org b ..........@y.org", "token=------------------", "token=a___________", "mail __________@x.org"]
    out = replaced(spark, texts)
    assert out[0] == texts[0] and out[2] == texts[2] and "a____" not in out[3]
    mails = re.findall(r"\S+@\S+", out[1] + " " + out[4])
    assert len(set(mails)) == 3 and not {"..........@x.org", "..........@y.org"} & set(mails)


def test_small_spaces_never_run_out(spark):
    """All secrets of one letter or digit in their shape: every surrogate of that shape is a real one."""
    real = [f"{c}___________" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    out = [t[6:] for t in replaced(spark, [f"token={x}" for x in real])]
    assert len(set(out)) == len(real) and not set(out) & set(real)


def test_more_moved_than_a_broadcast_holds(spark, monkeypatch):
    texts = [f"Mr N{chr(97 + i // 26)}{chr(97 + i % 26)} Smith" for i in range(60)]
    want = replaced(spark, texts)
    monkeypatch.setattr(pii, "BROADCAST", 3)
    assert replaced(spark, texts) == want


def test_marks_scripts_and_column_case(spark):
    rows = [(1, "a\x01b 10.1.2.3\x01 c@d.org"), (2, "иван@почта.рф, דוד@x.il"), (3, None), (4, "")]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, TEXT string"), "k")
    text = {r["doc_id"]: r["TEXT"] for r in out.collect()}
    assert out.columns == ["doc_id", "TEXT"] and text[3] is None and text[4] == ""
    assert text[1].startswith("a\x01b 2") and "10.1.2.3" not in text[1] and "c@d" not in text[1] and text[1].count("\x01") == 2
    local = re.findall(r"(\S+)@mail", text[2])
    assert re.search("[а-я]{4}$", local[0]) and re.search("[א-ת]{3}$", local[1]) and "иван" not in text[2]
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", text[1])[0]
    assert 240 <= int(ip.split(".")[0]) <= 254
