import base64
import random

import pytest

from eventloom.llm import subjects
from eventloom.llm.mail import own_text

HEAD = "Received: from a\n\tby b;\nReceived: from c\n\t\nFrom x@y Mon\nfrom: A <a@x.test>\nSubject: {}\nMIME-Version: 1.0\n"


def test_own_text():
    assert own_text(None) == own_text("") == ""
    plain = HEAD + "Content-Type: text/plain\n\n> old\n>> older\nNew words.\n| old\nAB> old\n\n-- \nMe\nlaw court\n"
    assert own_text(plain.format("law")).split() == ["New", "words."]
    assert own_text(plain.format("x").replace("\n", "\r\n")).split() == ["New", "words."]
    coded = HEAD.format("x") + "Content-Transfer-Encoding: BASE64\n\n" + base64.b64encode("Grüße – neu\n-----Original Message-----\nold".encode()).decode()
    assert own_text(coded).strip() == "Grüße – neu"
    quoted = HEAD.format("x") + "Content-Transfer-Encoding: quoted-printable\n\nsoft=\nbreak =E2=82=AC\n"
    assert own_text(quoted).strip() == "softbreak €"
    assert own_text("no header at all\nsecond").split() == ["no", "header", "at", "all", "second"]


def test_parts():
    parts = HEAD.format("x") + (
        'Content-Type: multipart/mixed; boundary="b1"\n\nThis is a multi-part message\n--b1\nContent-Type: multipart/alternative;\n boundary=b2\n\n--b2\nContent-Type: text/plain\n\nplain one\n'
        "--b2\nContent-Type: text/html\n\n<p>html&nbsp;one</p>\n--b2--\n--b1\nContent-Type: text/plain; name=a.txt\nContent-Disposition: attachment\n\nattached\n--b1\nContent-Type: application/octet-stream\n\nAAAA\n"
    )
    assert own_text(parts).split() == ["plain", "one"]
    html = HEAD.format("x") + "Content-Type: text/html\n\n<html><head><style>p{}</style></head><p>caf&eacute;<br/>&gt; old</p><blockquote>old</blockquote>"
    assert own_text(html).split() == ["café"]
    damaged = HEAD.format("x") + "Content-Type: multipart/mixed\n\n--zz\nContent-Type: text/plain\n\nfound\n"
    assert own_text(damaged).split() == ["found"]


def test_rules_and_parts():
    plain = HEAD.format("x") + "Content-Type: text/plain\n\n"
    assert own_text(plain + "Intro\n-----\nMain text").split() == ["Intro", "-----", "Main", "text"]
    assert own_text(plain + "One.\n\n-----\n\nTwo.\n\nThree.").split() == ["One.", "Two.", "Three."]
    assert own_text(plain + "One.\n\n_________\nNo claim\narises.\n\nOn Monday A wrote:\n> old").split() == ["One.", "On", "Monday", "A", "wrote:"]
    assert own_text(plain + "One.\n\n____________\n\nFrom: A <a@x.test>\n\nold words").split() == ["One."]
    assert own_text(plain + "One.\n\n***\nFooter.\n\n---\nOther footer.\n\n").split() == ["One."]
    two = HEAD.format("x") + "Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nfirst\n-- \nMe\n--b\nContent-Type: text/plain\n\nsecond\n--b--\n"
    assert own_text(two).split() == ["first", "second"]
    deep = "Content-Type: text/plain\n\ninnermost\n"
    for i in range(40):
        deep = f"Content-Type: multipart/mixed; boundary=d{i}\n\n--d{i}\n{deep}--d{i}--\n"
    assert own_text(HEAD.format("x") + deep).split() == ["innermost"]
    for i in range(40, 140):
        deep = f"Content-Type: multipart/mixed; boundary=d{i}\n\n--d{i}\n{deep}--d{i}--\n"
    assert "innermost" in own_text(HEAD.format("x") + deep)


WORDS = {"sport": "goal match team league coach", "law": "court claim judge statute lease", "music": "chord violin tempo choir score"}


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        chosen = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        lines = ["Thanks for the note."] + [f"The {rng.choice(WORDS[s].split())} and the {rng.choice(WORDS[s].split())} came today." for s in chosen for _ in range(rng.randint(2, 4))]
        rng.shuffle(lines)
        docs.append((i, HEAD.format("law court") + "Content-Type: text/plain\n\n" + "\n\n".join(lines) + "\n> The goal and the judge came.\n--\ncourt", "x", 5))
        truth[i] = set(chosen)
    return docs, truth


@pytest.fixture(scope="module")
def found(spark):
    docs, truth = corpus()
    rng = random.Random(1)
    rated = []
    for i in range(250):
        for s in sorted(truth[i]) or [None]:
            rated.append((i, rng.choice(sorted(WORDS)) if rng.random() < 0.05 else s, "r"))
    df = spark.createDataFrame(docs + docs[:5] + [(9000, None, "x", 0), (9001, "", "x", 0)], "doc_id bigint, text string, subject string, n_sentences int")
    labels = spark.createDataFrame(rated + rated[:9] + [(None, "law", "r"), (3, "unlisted", "r")], "doc_id bigint, subject string, rater string")
    names = spark.createDataFrame([(s, s) for s in WORDS], "subject string, description string")
    return df, labels, names, truth


def test_held_out(found):
    df, labels, names, truth = found
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(df, labels, names).collect()}
    held = {(i, s) for i, x in truth.items() if i >= 250 for s in x}
    mine = {g for g in got if g[0] >= 250}
    assert len(mine & held) / len(held) > 0.95 and len(mine & held) / len(mine) > 0.95
    assert not any(i >= 9000 for i, _ in mine)


def test_composition_and_empty_tables(found):
    df, labels, names, _ = found
    out = subjects.document_subjects(df, labels, names).cache()
    c = {r.subject: r for r in subjects.composition(out, df, names).collect()}
    assert set(c) == {*WORDS, None} and c[None].n_documents + out.select("doc_id").distinct().count() == 602
    assert subjects.document_subjects(df.limit(0), labels, names).count() == 0
    assert subjects.document_subjects(df, labels.limit(0), names).count() == 0
    assert subjects.document_subjects(df, labels, names.limit(0)).count() == 0
