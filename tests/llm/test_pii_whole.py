"""Names of any form and addresses of both kinds: no part stays."""

import re

import pytest

from itemforge.llm import pii

NAMES = [
    "Mr. McDonald", "Ms MacLeod", "Mr. O'Brien", "Mr J. Smith", "Mrs. Anna Maria Schmidt", "Frau Müller-Lüdenscheidt", "Herr Prof. Dr. Otto von Bismarck", "Dr. d'Artagnan",
    "Mr. J.R.R. Tolkien", "Frau von der Leyen", "Dr.Watson", "Mr SHOUTING", "Mr. O’Neil", "Sir Jean-Luc Picard", "Prof. Ada Lovelace", "Господин Иванов-Петров", "Доктор Живаго",
]
V6 = ["2001:db8:77::1", "fe80::77", "2001:0DB8:0000:0000:0000:ff00:0042:8329", "::ffff:10.77.0.1", "1:2:3:4:5:6:7:8"]
KEEP = ["std::vector", "12:30:45", "a::b", "00:1b:44:11:3a:b7", "The drive", "Mr Smith The"]


def replaced(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


@pytest.fixture(scope="module")
def titles():
    return {x.lower() for x in pii.MALE_TITLES + pii.FEMALE_TITLES + pii.NEUTRAL_TITLES}


def test_no_part_of_a_name_stays(spark, titles):
    for name, out in zip(NAMES, replaced(spark, [f"we saw {n}, who left" for n in NAMES]), strict=True):
        assert out.startswith("we saw ") and out.endswith(", who left")
        words = lambda t: {w for w in re.findall(r"\w+", t.lower()) if w not in titles}
        assert not words(name) & words(out[7:-10]), (name, out)


def test_addresses_of_version_six(spark):
    out = replaced(spark, [f"from {a}: up" for a in V6] + KEEP)
    for a, text in zip(V6, out, strict=False):
        assert a not in text and re.fullmatch(r"from 2001:db8(:[0-9a-f]{1,4}){6}: up", text), (a, text)
    assert out[len(V6) : -1] == KEEP[:-1] and out[-1].endswith(" The") and "Smith" not in out[-1]
    same = replaced(spark, ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "2001:db8::2"])
    assert same[0] == same[1] != same[2]


def test_names_and_phones_are_coreferent(spark):
    out = replaced(spark, [
        "Mr Smith, Mr. Smith, Mr John Smith, John Smith and Smith", "Mr. John Smith met Mrs Smith", "Dr. Smith and Mr Jones",
        "+1 555 123 4567 or +15551234567 or +44 20 7946 0958", "call +442079460958, +1-555-123-4567 or +49 30 123456", "Blacksmith Smithers, not Mr. Smith",
    ])
    assert not re.search(r"\b(John|Smith|Jones)\b|123.?4567|7946", "".join(out))
    family = re.match(r"Mr (\w+), Mr\. \1, Mr (\w+) \1, \2 \1 and \1$", out[0])
    assert family and out[1] == f"Mr. {family[2]} {family[1]} met Mrs {family[1]}"
    assert out[2].startswith(f"Dr. {family[1]} and Mr ") and not out[2].endswith(family[1]) and out[5] == f"Blacksmith Smithers, not Mr. {family[1]}"
    digits = lambda t: ["".join(re.findall(r"\d", p)) for p in re.findall(r"\+[\d -]*\d", t)]
    a, b = digits(out[3]), digits(out[4])
    assert a[0] == a[1] == b[1] != a[2] == b[0] and a[0].startswith("1") and b[0].startswith("44") and b[2].startswith("49")


def test_given_names_never_run_out(spark):
    """More given names than surrogates of a first draw: later draws tell them apart."""
    names = [f"N{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    out = replaced(spark, [f"Mr {n} Smith" for n in names])
    assert len(set(out)) == len({t.split(" ")[1] for t in out}) == 60 and len({t.split(" ")[2] for t in out}) == 1
