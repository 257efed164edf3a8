import random
import re

from tallyforge.llm import licenses
from tests.llm.conftest import ODD, SF, rows

MIT = licenses.TEMPLATES[0][0]
DOCS = [
    *ODD,
    (1, "Released under the MIT License. mit, license! M I T license MIT-LICENSE"),
    (2, "the GNU General\nPublic   License and General Public Apache License"),
    (3, "Preamble. " + MIT.upper().replace(" ", ", ") + " and more"),
    (4, "Preamble. " + MIT.replace("free of charge", "entirely free of any charge") + " and more"),
    (14, " ".join(MIT.split()[:9])),
    (13, "mit 漢字 license mit license"),
]


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_odd_rows(frame):
    out = licenses.license_scan(frame(DOCS)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out) == sorted(repr((d, *base(t))) for d, t in DOCS)
    by = {r.doc_id: r for r in out}
    assert by[3].labels == "mit" and by[3].score == 1.0 and by[3].n_base == 0
    assert by[4].labels == "mit" and 0.6 <= by[4].score < 1
    assert by[14].labels == "" and by[14].score == 0
    assert by[2].labels == "apache,gpl" and all(0 <= r.score <= 1 for r in out)


def test_empty_table(frame):
    assert licenses.license_scan(frame([])).count() == 0


def test_whole_table_equals_sql(spark, oracle):
    assert rows(licenses.op6_license_scan(spark, SF).toPandas()) == rows(oracle(licenses.OP6_SQL))


def test_no_python_on_the_path(documents, plans):
    assert plans(licenses.license_scan(documents), 0)


def test_whole_license_texts_as_a_table(spark, frame):
    """Long templates: whole copies, copies with words put in, and halves; texts that share only common words aren't found."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = {f"lic{i}": [r.choice(vocabulary) for _ in range(r.choice((150, 900, 3000)))] for i in range(12)}
    templates = spark.createDataFrame([(" ".join(t), k) for k, t in texts.items()] + [("", "none"), (None, "none"), ("one", "none")], "text string, label string")
    docs, expected = [], {}
    for i, (label, cut) in enumerate(texts.items()):
        put_in = [w for j, w in enumerate(cut) for w in ((w, "extra") if j % 50 == 25 and j // 50 % 12 == 0 else (w,))]
        for kind, some, found in ((0, cut, label), (1, put_in, label), (2, cut[: len(cut) // 2], ""), (3, r.sample(cut, len(cut)), "")):
            doc_id = 10 * i + kind
            docs.append((doc_id, " ".join(["intro", *some, "outro"])))
            expected[doc_id] = found
    docs.append((999, "the MIT License holds"))
    out = {x.doc_id: x for x in licenses.license_scan(frame(docs), templates=templates).collect()}
    assert {d: out[d].labels for d in expected} == expected
    assert out[999].base_labels == "mit" and out[999].labels == "mit" and len(out) == len(docs)
